import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from hearlog.operators import clusters, evaluate, fatigue, origin, sequence, weekly
from hearlog.params import Params
from hearlog.plans import layers
from hearlog.plans.layers import run_models
from hearlog.sources import tables as tables_
from tests.plays import fact_plays

LIGHT = Params(forest_trees=4, boost_rounds=2, boost_depth=2, folds=3, search_starts=2, final_starts=2, max_clusters=3)


def history(spark, weeks=24, per_week=16):
    rng = random.Random(5)
    rows = []
    for week in range(weeks):
        for play in range(per_week):
            loud = week % 2
            rows.append({
                "year": 2023, "month": 1 + week * 7 // 28, "day": 1 + week * 7 % 28, "hour": rng.randrange(24),
                "weekday": 1 + play % 7, "start_ms": week * 604_800_000 + play * 240_000,
                "ms_played": rng.choice([5_000, 60_000, 200_000]) * (1 + 3 * loud),
                "track_uri": f"t{rng.randrange(40 if loud else 4)}", "track_name": "x",
                "artist_name": f"a{rng.randrange(20 if loud else 2)}",
                "reason_start": rng.choice(["clickrow", "trackdone", "other", None]),
                "skipped": rng.random() < 0.3, "shuffle": rng.random() < 0.5,
            })
    return fact_plays(spark, *rows)


def test_stratified_parts_are_exact_and_reproducible(spark):
    rows = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 10 < 3).cast("int").alias("label"))
    parts = evaluate.stratified_parts(rows, "label", "key", [0.8, 0.2], 1, "part")
    sizes = {(r["label"], r["part"]): r["count"] for r in parts.groupBy("label", "part").count().collect()}
    assert sizes == {(0, 0): 560, (0, 1): 140, (1, 0): 240, (1, 1): 60}
    again = evaluate.stratified_parts(rows.repartition(7), "label", "key", [0.8, 0.2], 1, "part")
    assert parts.exceptAll(again).isEmpty()
    folds = evaluate.stratified_parts(rows, "label", "key", [0.2] * 5, 2, "fold")
    assert {r["count"] for r in folds.groupBy("label", "fold").count().collect()} == {140, 60}


def test_class_weights_balance(spark):
    rows = spark.range(100).select((F.col("id") < 20).cast("int").alias("label"))
    weights = evaluate.balanced_weights(rows, "label").groupBy("label").agg(F.sum("weight")).collect()
    assert {round(r[1], 9) for r in weights} == {50.0}


def test_origin_tables(spark):
    fact = fact_plays(
        spark,
        *[{"reason_start": "clickrow", "track_uri": f"u{i % 3}", "artist_name": "a"} for i in range(6)],
        *[{"reason_start": "trackdone", "skipped": None, "artist_name": None}] * 2,
        {"reason_start": "other"}, {"reason_start": "fwdbtn", "ms_played": None})
    plays = origin.origin_plays(fact)
    assert plays.count() == 8
    assert [tuple(r)[:4] for r in origin.comparison(plays).collect()] == [(0, 2, 1.0, 0.0), (1, 6, 1.0, 0.0)]
    found = {r["origin_name"]: (r["unique_tracks"], r["plays"], r["repeat_ratio"]) for r in origin.diversity(plays).collect()}
    assert found == {"Elección Activa": (3, 6, 2.0), "Algoritmo (Spotify)": (1, 2, 2.0)}
    assert [tuple(r) for r in origin.artists_by_origin(plays).collect()] == [("a", 0, 6, 6, 0.0)]
    assert tuple(origin.shares(plays).first()) == (0.75, 0.25, 8)
    only_active = origin.origin_plays(fact_plays(spark, {"reason_start": "clickrow"}))
    assert origin.diversity(only_active).count() == 2
    assert origin.fit_origin_model(only_active, LIGHT) is None


@pytest.mark.parametrize("accuracy, rates, start", [
    (0.5, (0.1, 0.9), "El modelo"), (0.7, (0.1, 0.9), "Escuchas"), (0.7, (0.5, 0.52), "El algoritmo")])
def test_origin_verdict(spark, accuracy, rates, start):
    scores = spark.createDataFrame([(accuracy,)], "accuracy double")
    compared = spark.createDataFrame(list(enumerate(rates)), "origin int, complete_rate double")
    assert origin.verdict(scores, compared).first()["verdict"].startswith(start)


def test_week_spanning_two_months_counts_twice(spark):
    fact = fact_plays(spark, *[{"month": 1, "day": 31}] * 3, *[{"month": 2, "day": 1}] * 3)
    weeks = weekly.week_vectors(fact).withColumns({"cluster": F.lit(0), "profile": F.lit("p")})
    assert weeks.count() == 1
    assert [tuple(r) for r in weekly.profiles_by_month(weeks, fact).collect()] == [(1, 0, "p", 1), (2, 0, "p", 1)]


def test_profile_names_follow_the_rules(spark):
    columns = ["cluster", *weekly.FEATURES]
    rows = [
        # cluster, hours, artists, diversity, skip, complete, active, music, podcast, hour
        (0, 1.0, 1.0, 0.1, 0.1, 0.5, 0.5, 0.5, 0.5, 12.0),
        (1, 50.0, 1.0, 0.9, 0.1, 0.5, 0.5, 1.0, 0.0, 12.0),
        (2, 5.0, 1.0, 0.5, 0.9, 0.5, 0.5, 1.0, 0.0, 12.0),
        (3, 0.5, 1.0, 0.2, 0.1, 0.5, 0.5, 1.0, 0.0, 12.0),
        (4, 5.0, 1.0, 0.3, 0.1, 0.5, 0.1, 1.0, 0.0, 12.0),
    ]
    found = weekly.cluster_profiles(spark.createDataFrame(rows, columns)).orderBy("cluster").collect()
    assert [r["profile"].split(" ", 1)[1] for r in found] == [
        "Semana de Podcasts", "Maratón Exploratorio", "Modo Shuffle Activo", "Semana de Poco Uso",
        "Semana Pasiva (Algoritmo)"]


def test_silhouette_has_one_measure_at_all_sizes(spark):
    rng = random.Random(1)
    points = [(i % 3, [rng.gauss(i % 3, 0.7), rng.gauss(0, 1)]) for i in range(60)] + [(3, [9.0, 9.0])]

    def score(points):
        df = spark.createDataFrame([(c, Vectors.dense(v)) for c, v in points], ["cluster", "features"])
        return weekly.silhouette(df)

    def one(c, v):
        means = {}
        for other in range(4):
            same = [w for d, w in points if d == other and w is not v]
            means[other] = sum(math.dist(v, w) ** 2 for w in same) / len(same) if same else None
        if means[c] is None:
            return 0.0
        near = min(m for k, m in means.items() if k != c)
        return (near - means[c]) / max(near, means[c])

    assert score(points) == pytest.approx(sum(one(c, v) for c, v in points) / len(points), abs=1e-9)
    # Every point fifty times: own distances grow by (n - 1) / n only, past any fixed size.
    assert score(points * 50) == pytest.approx(score(points * 25), abs=0.01)


def test_scaling_of_constant_feature(spark):
    rows = weekly.scaled_weeks(weekly.week_vectors(history(spark)))
    row = rows.agg(F.max(F.abs("z_podcast_rate")), F.stddev_pop("z_week_hours"), F.avg("z_week_hours")).first()
    assert row[0] == 0 and row[1] == pytest.approx(1) and row[2] == pytest.approx(0, abs=1e-9)


def test_models_end_to_end(spark):
    tables = run_models(history(spark), LIGHT)
    for name in ("origin_importance", "skip_importance"):
        assert sum(r["importance"] for r in tables[name].collect()) == pytest.approx(1)
    plays = tables["origin_comparison"].agg(F.sum("plays")).first()[0]
    assert tables["origin_confusion"].agg(F.sum("plays")).first()[0] == pytest.approx(plays * 0.2, abs=1)
    weeks = tables["week_profiles"].count()
    assert weeks == 24 == tables["week_profiles_by_year"].agg(F.sum("weeks")).first()[0]
    assert all(-1 <= r["silhouette"] <= 1 for r in tables["week_silhouette"].collect())
    # Loud, varied weeks and quiet, repetitive ones alternate.
    assert tables["week_result"].first()["best_k"] == 2
    matrix = tables["skip_result"].first()["confusion_matrix"]
    assert [len(row) for row in matrix] == [2, 2]
    assert tables["skip_result"].first()["top_feature"] in fatigue.FEATURES


def test_too_little_data(spark):
    assert set(run_models(history(spark, weeks=2, per_week=6), LIGHT)) == {
        "origin_comparison", "origin_diversity", "origin_trend", "origin_artists", "origin_result"}


def test_verdict_for_unknown_feature(spark):
    ranked = spark.createDataFrame([("other", 0.9), ("hour", 0.1)], "feature string, importance double")
    assert fatigue.top_feature_verdict(ranked).first()["verdict"] == "El factor más influyente es 'other'."


def test_skip_tables_drop_small_groups(spark):
    context = sequence.skip_context(fact_plays(spark, *[{"start_ms": i * 3_600_000} for i in range(12)]))
    assert [tuple(r) for r in fatigue.skip_by_position(context).collect()] == [(0, 0.0, 12)]
    assert fatigue.skip_by_position(context, Params(min_bucket_plays=13)).isEmpty()


def listeners(spark, sizes):
    """Each listener's weeks: loud and quiet ones alternate; one key is null."""
    fact = None
    for name, weeks in sizes.items():
        one = history(spark, weeks=weeks).withColumn("listener_id", F.lit(name).cast("string"))
        fact = one if fact is None else fact.union(one)
    return fact


def test_each_listener_has_clusters_of_their_own(spark):
    fact, params = listeners(spark, {"a": 24, "b": 18, None: 12, "few": 8}), replace(LIGHT, listener_keys=("listener_id",))
    tables = weekly.weekly_tables(fact, params)
    results = {r["listener_id"]: r for r in tables["week_result"].collect()}
    assert {k: r["weeks_analysed"] for k, r in results.items()} == {"a": 24, "b": 18, None: 12}
    assert all(r["best_k"] == 2 and len(r["profiles"]) == 2 and "2" in r["verdict"] for r in results.values())
    assert tables["week_profiles"].count() == 54 and tables["week_profiles"].where("profile IS NULL").isEmpty()
    assert tables["week_profiles_by_year"].agg(F.sum("weeks")).first()[0] == 54
    assert {r["listener_id"] for r in tables["week_centres"].collect()} == {"a", "b", None}
    # A listener's tables do not depend on who else is stored, nor on how rows are dealt.
    alone = weekly.weekly_tables(listeners(spark, {"b": 18}).repartition(5), params)["week_profiles"]
    columns = ["year", "week", "cluster", "profile"]
    assert alone.select(*columns).exceptAll(tables["week_profiles"].where("listener_id = 'b'").select(*columns)).isEmpty()
    assert weekly.weekly_tables(listeners(spark, {"few": 8}), params) == {}


def test_written_models_per_listener(spark, tmp_path):
    fact, params = listeners(spark, {"a": 12, "b": 12}), replace(LIGHT, listener_keys=("listener_id",))
    layers.write_models(fact, str(tmp_path), params)
    assert tables_.read_table(spark, f"{tmp_path}/week_result").count() == 2
    assert spark.read.json(f"{tmp_path}/summary").first()["week_result"].asDict() == {"listeners": 2, "weeks_analysed": 24}


def test_rounds_of_lloyd_by_hand():
    points = np.array([[0.0], [1.0], [9.0], [10.0], [11.0]])
    own, centres = clusters.lloyd(points, np.array([[[0.0], [1.0], [50.0]]]), rounds=1)
    assert own.tolist() == [[0, 1, 1, 1, 1]] and centres.ravel().tolist() == [0.0, 7.75, 50.0]
    own, centres = clusters.lloyd(points, np.array([[[0.0], [1.0], [50.0]]]))
    assert own.tolist() == [[0, 0, 1, 1, 1]] and centres.ravel().tolist() == [0.5, 10.0, 50.0]
    same = np.zeros((6, 2))
    assert clusters.best_fit(same, 3, range(4)).tolist() == [0] * 6
    assert clusters.mean_silhouette(same, np.array([0, 0, 0, 1, 1, 1])) == 0


def test_silhouette_of_groups_equals_the_distributed_one(spark):
    rng = np.random.default_rng(2)
    points, own = rng.normal(size=(60, 9)), rng.integers(0, 4, 60)
    own[7] = 9
    rows = [(int(c), Vectors.dense(p)) for c, p in zip(own, points, strict=True)]
    distributed = weekly.silhouette(spark.createDataFrame(rows, ["cluster", "features"]))
    assert clusters.mean_silhouette(points, own) == pytest.approx(distributed, abs=1e-9)


def test_weeks_are_counted_without_tripling_the_plays(spark):
    """Distinct counts go over artists and tracks of a week, not over its plays."""
    plan = weekly.week_vectors(history(spark))._jdf.queryExecution().optimizedPlan().toString()
    expanded = plan[plan.index("Expand"):]
    assert "Aggregate" in expanded and "artist_name" in expanded
