import random

import pytest
from pyspark.sql import functions as F

from hearlog.operators.sequence import play_sessions, session_scan, skip_context
from hearlog.params import Params
from tests.plays import fact_plays

GAP = 1_800_000
SCHEMA = "play_id bigint, listener bigint, start_ms bigint, ms_played bigint, skip bigint"


def brute_force(rows, gap, keyed, from_start=False):
    """Plain scan in time order, per listener."""
    result, listeners = {}, {}
    for row in rows:
        listeners.setdefault(row[1] if keyed else 0, []).append(row)
    for plays in listeners.values():
        plays.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        session, previous, seen = 0, None, (0, 0, 0, 0)
        for play_id, _, start, ms, skip in plays:
            first = previous is None
            end = None if first else previous[2] if from_start else (
                None if previous[2] is None or previous[3] is None else previous[2] + previous[3])
            if start is None or end is None or start - end > gap:
                session, seen = session + 1, (0, 0, 0, 0)
            result[play_id] = (session, *seen)
            seen = (seen[0] + 1, seen[1] + (ms or 0), seen[2] + skip, skip * (seen[3] + 1))
            previous = (play_id, None, start, ms)
    return result


def scanned(df, keyed, blocks, from_start=False):
    found = session_scan(
        df, F.col("start_ms"), F.col("start_ms") if from_start else F.col("start_ms") + F.col("ms_played"), GAP,
        listener_keys=("listener",) if keyed else (),
        running={"ms_before": F.col("ms_played"), "skips_before": F.col("skip")}, blocks=blocks,
        streaks={"skip_streak": F.col("skip") == 1},
    )
    return {r["play_id"]: (r["session_id"], r["position"], r["ms_before"], r["skips_before"], r["skip_streak"]) for r in found.collect()}


def random_plays(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # A third of all plays: one listener, many of them at one instant.
        hot = rng.random() < 1 / 3
        listener = 0 if hot else rng.choice([None, *range(1, 9)])
        start = 7_000_000 if hot and rng.random() < 0.5 else rng.choice([None] + [rng.randrange(80_000_000)] * 30)
        rows.append((i, listener, start, rng.choice([None] + [rng.randrange(600_000)] * 9), rng.randrange(2)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, blocks", [(1, 1), (2, 2), (3, 7), (4, 40), (5, 200)])
@pytest.mark.parametrize("keyed", [True, False])
def test_scan_equals_brute_force(spark, seed, blocks, keyed):
    rows = random_plays(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert scanned(df, keyed, blocks) == brute_force(rows, GAP, keyed)


def test_scan_by_starts(spark):
    rows = [r for r in random_plays(6) if r[2] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    assert scanned(df, True, 13, from_start=True) == brute_force(rows, GAP, True, from_start=True)


def test_one_session_over_all_blocks(spark):
    rows = [(i, 1, i * 1000, 500, 1) for i in range(300)]
    found = scanned(spark.createDataFrame(rows, SCHEMA), False, 30)
    assert {v[0] for v in found.values()} == {1}
    assert found[299] == (1, 299, 299 * 500, 299, 299)


def test_streaks_over_borders(spark):
    """One session with few breaks: most streaks begin blocks before the one they end in."""
    rows = [(i, 1, i * 1000, 500, int(i % 67 != 40)) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert scanned(df, True, 50) == brute_force(rows, GAP, True)
    alone = session_scan(df, F.col("start_ms"), F.col("start_ms"), GAP, blocks=9, streaks={"n": F.when(F.col("play_id") != 7, True)})
    assert {r["play_id"]: r["n"] for r in alone.collect()} == {i: i if i < 8 else i - 8 for i in range(400)}


def test_empty_input(spark):
    assert scanned(spark.createDataFrame([], SCHEMA), True, 4) == {}


def test_blocks_are_even_under_a_hot_listener(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("play_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("listener"),
        F.lit(5).cast("bigint").alias("start_ms"), F.lit(1).cast("bigint").alias("ms_played"))
    blocks = rows.repartitionByRange(16, "listener", "start_ms", "play_id").groupBy(F.spark_partition_id()).count()
    sizes = [r["count"] for r in blocks.collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16


def test_gap_border(spark):
    end = 40_000
    exact = fact_plays(spark, {"start_ms": 0}, {"start_ms": end + GAP})
    over = fact_plays(spark, {"start_ms": 0}, {"start_ms": end + GAP + 1})
    sessions = lambda df: {r["session_id"] for r in play_sessions(df).collect()}
    assert sessions(exact) == {1}
    assert sessions(over) == {1, 2}


def test_skip_context(spark):
    fact = fact_plays(
        spark,
        {"start_ms": 0, "skipped": True, "reason_start": "playbtn"},
        {"start_ms": 60_000, "skipped": None, "shuffle": None, "ms_played": 700_000},
        {"start_ms": 120_000, "content_type": "podcast"},
        {"start_ms": 180_000, "skipped": True, "shuffle": True},
        {"start_ms": 180_000 + GAP + 1},
        {"start_ms": 0, "hour": None},
    )
    rows = sorted(skip_context(fact, Params(), blocks=2).collect(), key=lambda r: r["play_id"])
    assert [(r["play_id"], r["session_id"], r["position"], r["ms_before"], r["skips_before"], r["skip_streak"]) for r in rows] == [
        (0, 1, 0, 0, 0, 0), (1, 1, 1, 40_000, 1, 1), (3, 1, 2, 740_000, 1, 0), (4, 2, 0, 0, 0, 0)]
    assert [r["minute_bucket"] for r in rows] == [0, 0, 10, 0]
    assert [r["active"] for r in rows] == [1, 0, 0, 0]
    assert [r["skip"] for r in rows] == [1, 0, 1, 0]
