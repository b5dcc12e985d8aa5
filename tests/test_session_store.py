"""Sessions merged batch by batch against one run over all plays."""

import random

import pytest
from pyspark.sql import functions as F

from hearlog.operators import marts, session_store
from hearlog.params import Params
from hearlog.plans import layers

SCHEMA = "listener_id string, play_id long, start_ms long, ms_played long"
GAP = Params().session_gap_ms


def random_plays(seed, listeners=("a", "b", None), count=120):
    """Plays with gaps around the limit, long ones that reach over the next, ties and unknown times."""
    rng = random.Random(seed)
    rows, number = [], 0
    for listener in listeners:
        start = 0
        for _ in range(count):
            start += rng.choice([0, 1_000, GAP // 3, GAP - 1, GAP, GAP + 1, 3 * GAP, 90_000_000])
            length = rng.choice([0, 1_000, GAP // 2, 2 * GAP, None])
            rows.append((listener, number, None if rng.random() < 0.05 else start, length))
            number += 1
    return rows


def in_batches(spark, rows, sizes, params):
    stored, so_far = None, []
    for size in sizes:
        batch, rows = rows[:size], rows[size:]
        if stored is None:
            stored = session_store.sessions_of(spark.createDataFrame(batch, SCHEMA), params)
        else:
            stored = session_store.merged(stored, spark.createDataFrame(so_far, SCHEMA), spark.createDataFrame(batch, SCHEMA), params)
        so_far = so_far + batch
    assert not rows
    return stored


@pytest.mark.parametrize("keys, seed", [(("listener_id",), 1), (("listener_id",), 2), ((), 3)])
def test_batches_in_any_order_make_the_sessions_of_one_run(spark, keys, seed):
    rows, params = random_plays(seed), Params(listener_keys=keys)
    random.Random(seed).shuffle(rows)
    got = in_batches(spark, rows, [200, 1, 60, 99], params)
    plays = spark.createDataFrame(rows, SCHEMA)
    columns = got.columns
    want = session_store.sessions_of(plays, params).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    detail = session_store.session_detail(got, params)
    assert sorted(map(str, detail.collect())) == sorted(map(str, marts.session_detail(plays, params).select(detail.columns).collect()))


def test_a_late_play_splits_a_session(spark):
    """The break is by the play just before, so a short one inside a long one opens a gap."""
    rows = [("a", 1, 0, 2 * GAP), ("a", 2, 2 * GAP + 5, 10), ("a", 3, 5, 10)]
    got = in_batches(spark, rows, [2, 1], Params(listener_keys=("listener_id",)))
    assert sorted((r.session_id, r.plays) for r in got.collect()) == [(1, 2), (2, 1)]


def test_stored_sessions_are_updated(spark, tmp_path):
    rows, params = random_plays(4), Params(listener_keys=("listener_id",))
    old, new = spark.createDataFrame(rows[::2], SCHEMA), spark.createDataFrame(rows[1::2], SCHEMA)
    layers.update_sessions(old, old.limit(0), str(tmp_path), params)
    got = layers.update_sessions(old, new, str(tmp_path), params)
    want = marts.session_detail(old.union(new), params).select(got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_listeners_without_new_plays_are_not_scanned(spark, monkeypatch):
    seen = []
    scan = session_store.session_scan
    monkeypatch.setattr(session_store, "session_scan", lambda units, **more: seen.append(units) or scan(units, **more))
    params = Params(listener_keys=("listener_id",))
    rows = random_plays(5, listeners=("a", "b"))
    plays = spark.createDataFrame(rows, SCHEMA)
    stored = session_store.sessions_of(plays, params)
    new = spark.createDataFrame([("b", 9_999, 10**12, 5)], SCHEMA)
    merged = session_store.merged(stored, plays, new, params)
    assert {r[0] for r in seen[-1].select("listener_id").distinct().collect()} == {"b"}
    assert seen[-1].count() == stored.where("listener_id = 'b'").count() + 1
    assert merged.where("listener_id = 'a'").exceptAll(stored.select(merged.columns).where(F.col("listener_id") == "a")).isEmpty()
