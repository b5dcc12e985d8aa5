from pyspark.sql import functions as F

from hearlog.functions.identity import digest
from hearlog.operators import refine
from hearlog.params import Params
from hearlog.sources.export_format import PLAY_KEY
from tests.plays import fact_plays, raw_plays


def test_copies_and_near_copies(spark):
    plays = raw_plays(
        spark,
        {"track_uri": "u1", "platform": "b"},
        {"track_uri": "u1", "platform": "a"},
        {"track_uri": "u1", "platform": "a"},
        {"ms_played": 1},
        {"ms_played": 2},
        {"ts": None, "ms_played": None},
        {"ts": None, "ms_played": None},
    )
    kept = refine.drop_copies(plays, PLAY_KEY)
    assert kept.count() == 4
    assert [r["platform"] for r in kept.filter("track_uri = 'u1'").collect()] == ["a"]
    assert refine.drop_copies(kept, PLAY_KEY).count() == 4
    assert tuple(refine.copy_counts(plays, PLAY_KEY).first()) == (7, 4, 3)


def test_copy_reduction_happens_before_the_shuffle(spark):
    plan = refine.drop_copies(raw_plays(spark, {}), PLAY_KEY)._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange hashpartitioning"):]
    assert "partial_min" in before_shuffle
    assert "Window" not in plan


def test_identity_is_stable_and_injective(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a|1:b", None), (None, "a"), ("a", None)], "x string, y string")
    ids = [bytes(r[0]) for r in rows.select(digest(F.col("x"), F.col("y"))).collect()]
    assert len(set(ids)) == 5 and all(len(i) == 16 for i in ids)
    again = [bytes(r[0]) for r in rows.repartition(3).select(digest(F.col("x"), F.col("y"))).collect()]
    assert set(ids) == set(again)


def test_refine_labels_and_identity_before_cleaning(spark):
    fact = refine.refine(raw_plays(
        spark,
        {"track_uri": "t", "track_name": "Song ★", "conn_country": "MX"},
        {"track_name": "Song"},
        {"episode_uri": "e"},
        {"audiobook_uri": "b"},
    ))
    rows = {(r["content_type"], r["track_name"]) for r in fact.collect()}
    assert rows == {("music", "Song"), ("unknown", "Song"), ("podcast", None), ("audiobook", None)}
    assert fact.select("play_id").distinct().count() == 4


def test_running_number_identity(spark):
    fact = refine.with_play_id(raw_plays(spark, {}, {}), PLAY_KEY, reproducible=False)
    assert fact.select("play_id").distinct().count() == 2


def test_dimensions(spark):
    fact = refine.refine(raw_plays(spark, {"ms_played": 1}, {"ms_played": 2}, {"ts": "2023-01-01T05:00:00Z"}))
    sizes = {name: extract(fact).count() for name, extract in refine.DIMENSIONS.items()}
    assert sizes == {"dim_time": 2, "dim_art": 3, "dim_location": 3, "dim_user": 3, "dim_playback": 3, "dim_keys": 3}
    locations = refine.dim_location(fact)
    assert refine.enrich_country(fact, locations) is fact
    bare = refine.enrich_country(fact.drop("country_name"), locations)
    assert bare.filter("country_name = 'Desconocido'").count() == 3


def test_year_filter_and_privacy(spark):
    fact = fact_plays(spark, {"year": 2022}, {"year": 2023})
    assert refine.only_years(fact, [2022]).count() == 1
    assert refine.only_years(fact, []).count() == 2
    plays = raw_plays(spark, {"ip_addr": "1.1.1.1", "incognito_mode": True}, {"ip_addr": "1.1.1.1"})
    assert refine.without_incognito(plays).count() == 1
    assert {r["ip_addr"] for r in refine.with_hashed_address(plays).collect()} == {
        "f1412386aa8db2579aff2636cb9511cacc5fd9880ecab60c048508fbe26ee4d9"
    }


def test_listener_keys_keep_listeners_apart(spark):
    plays = raw_plays(spark, {}, {}).withColumn("listener_id", F.monotonically_increasing_id())
    assert refine.refine(plays, Params(listener_keys=("listener_id",))).count() == 2
