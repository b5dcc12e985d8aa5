"""Plans that have to hold at scale."""

import os

from pyspark.sql import functions as F

from hearlog.operators import marts, sequence
from hearlog.params import Params
from hearlog.session import durable, shared_folder, temporary_tables
from hearlog.sources import tables
from tests.plays import fact_plays


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored_fact(spark, tmp_path):
    path = str(tmp_path / "fact")
    rows = [{"year": 2020 + i % 3, "content_type": ["music", "podcast"][i % 2], "start_ms": i * 1000} for i in range(30)]
    tables.write_table(fact_plays(spark, *rows), path, ("year", "content_type"))
    return tables.read_table(spark, path)


def test_marts_read_only_their_columns_and_partitions(spark, tmp_path):
    fact = stored_fact(spark, tmp_path)
    shown = plan(marts.skip_rate_by_artist(fact))
    assert "ReadSchema: struct<artist_name:string,skipped:boolean>" in shown
    assert "PartitionFilters: [isnotnull(content_type" in shown
    assert "ReadSchema: struct<ms_played:bigint>" in plan(marts.time_per_year(fact))


def test_top_lists_sort_only_what_they_keep(spark, tmp_path):
    fact = stored_fact(spark, tmp_path)
    for mart in (marts.top_artists, marts.complete_tracks, marts.top_shows, marts.top_audiobooks):
        assert "TakeOrderedAndProject" in plan(mart(fact))


def test_marts_run_without_python_workers(spark, tmp_path):
    fact = stored_fact(spark, tmp_path)
    for mart in (marts.content_mix, marts.day_part_mix, marts.top_tracks_by_country, marts.session_detail):
        shown = plan(mart(fact))
        assert "Python" not in shown and "CartesianProduct" not in shown


def test_session_carry_is_one_row_per_block_at_most(spark):
    plays = spark.range(5000).select(
        F.col("id").alias("play_id"), (F.col("id") % 700).alias("listener"), (F.col("id") * 1000).alias("start_ms"),
        F.lit(10).cast("bigint").alias("ms_played"))
    seen = []
    carry = sequence._carry

    def watched(*args):
        result = carry(*args)
        seen.append(result.count())
        return result

    sequence._carry = watched
    try:
        sequence.session_scan(plays, F.col("start_ms"), F.col("start_ms"), 10, listener_keys=("listener",), blocks=16)
    finally:
        sequence._carry = carry
    assert seen[0] <= 15


def test_partitioned_write_makes_one_file_per_small_partition(spark, tmp_path):
    stored_fact(spark, tmp_path)
    files = [f for _, _, names in os.walk(tmp_path / "fact") for f in names if f.endswith(".parquet")]
    assert len(files) == 6


def test_temporary_tables_are_removed(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with temporary_tables(spark):
        assert durable(spark.range(3)).count() == 3
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_model_folds_and_parts_have_no_unbounded_window(spark):
    from hearlog.operators.evaluate import stratified_parts

    rows = spark.range(100).select(F.col("id").alias("key"), (F.col("id") % 2).alias("label"))
    shown = plan(stratified_parts(rows, "label", "key", [0.8, 0.2], Params().seed, "part"))
    numbered = [line for line in shown.splitlines() if "row_number()" in line and "Window [" in line]
    assert numbered and all("_bucket" in line.split("windowspecdefinition")[1] for line in numbered)


def test_training_rows_scan_the_plays_once(spark, tmp_path, monkeypatch):
    from hearlog.operators import origin

    rows = [{"start_ms": i, "reason_start": ["clickrow", "trackdone"][i % 2], "skipped": i % 3 == 0} for i in range(60)]
    path = str(tmp_path / "plays")
    tables.write_table(fact_plays(spark, *rows), path)
    shown = plan(origin.training_rows(origin.origin_plays(tables.read_table(spark, path))))
    assert path not in shown and "hearlog-" in shown


def test_sessions_are_scanned_once_for_detail_and_stats(spark, tmp_path, monkeypatch):
    from hearlog.plans import layers

    calls = []
    scan = sequence.session_scan
    monkeypatch.setattr(sequence, "session_scan", lambda *a, **k: calls.append(1) or scan(*a, **k))
    with temporary_tables(spark):
        results = layers.build_marts(stored_fact(spark, tmp_path))
        assert len(calls) == 1
        for name in ("session_detail", "session_stats"):
            shown = plan(results[name])
            assert "Join" not in shown and "_block" not in shown


def test_blocks_follow_the_number_of_plays(spark):
    plays = spark.range(1000).select(
        F.col("id").alias("play_id"), (F.col("id") * 1000).alias("start_ms"), F.lit(10).cast("bigint").alias("ms_played"))
    seen = []
    carry = sequence._carry

    def watched(rows, *args):
        seen.append(rows.select("_block").distinct().count())
        return carry(rows, *args)

    sequence._carry = watched
    try:
        sequence.play_sessions(plays, Params(session_block_rows=50)).count()
    finally:
        sequence._carry = carry
    assert seen[0] >= 15
