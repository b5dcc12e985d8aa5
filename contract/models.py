"""Model tables (M): origin, weekly profiles, fatigue; and the joins around them.

Fitted models run with the library's own settings. Their numbers depend on the random draws
of the fitting, so their queries return what is determined all the same (test rows, names,
totals) and whether the rest agrees with itself: scores with the cells they come from,
verdicts with their rule, the chosen k with its silhouette. Each model is fitted once per
session and data set. The steps around the fits have rows of their own on deterministic
predictions, with oracles for every value.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from contract.marts import MUSIC_CONTEXT
from contract.tables import half_even, history, on_history
from hearlog.operators import evaluate, fatigue, origin, sequence, weekly
from hearlog.params import Params
from hearlog.plans.layers import model_summary
from hearlog.sources.tables import model_input
from hearlog.vocabulary import (
    ORIGIN_MODEL,
    ORIGIN_NAMES,
    ORIGIN_NAMES_SHORT,
    SHUFFLE_NAMES,
    SKIP_MODEL,
    SKIP_VERDICT_OTHER,
    SKIP_VERDICTS,
    WEEK_PROFILES,
    WEEK_VERDICT,
)

P = Params()
FULL = Params(listener_keys=("listener_id",), parallel_fits=8)

_fitted: dict[tuple, object] = {}


def once(name, fit):
    """``fit(spark, sf)``, run once per session and data set."""

    def query(spark, sf):
        key = name, spark.sparkContext.applicationId, sf
        if key not in _fitted:
            _fitted[key] = fit(spark, sf)
        return _fitted[key]

    return query


def plays(spark, sf):
    return origin.origin_plays(model_input(history(spark, sf)), P)


def context(spark, sf):
    return sequence.skip_context(model_input(history(spark, sf)), FULL)


def weeks(spark, sf):
    return weekly.week_vectors(model_input(history(spark, sf)), FULL)


def _on_plays(table, *args):
    return lambda spark, sf: table(plays(spark, sf), *args)


def _on_cube(table):
    return lambda spark, sf: table(origin.origin_cube(plays(spark, sf), FULL))


def _on_context(table, *args):
    return lambda spark, sf: table(context(spark, sf), *args)


def ruled_weeks(spark, sf):
    """Weeks put into four groups by rule, in place of a fitted model."""
    return weeks(spark, sf).withColumn("cluster", F.pmod(F.col("unique_artists"), F.lit(4)).cast("int"))


def ruled_named_weeks(spark, sf):
    grouped = ruled_weeks(spark, sf)
    return weekly.named_weeks(grouped, weekly.cluster_profiles(grouped))


def split_sizes(spark, sf):
    """Class sizes of the train and test part."""
    rows = origin.training_rows(plays(spark, sf), FULL)
    return rows.groupBy("label", "part").agg(F.count("*").alias("plays"))


def fold_sizes(spark, sf):
    rows = origin.training_rows(plays(spark, sf), FULL)
    return rows.groupBy("label", "fold").agg(F.count("*").alias("plays"))


def class_weights(spark, sf):
    rows = origin.training_rows(plays(spark, sf), FULL)
    return rows.groupBy("label").agg(F.max("weight").alias("weight"))


origin_fit = once("origin", lambda spark, sf: origin.fit_origin_model(plays(spark, sf), FULL))


def _agreement(cells, scores):
    """Test rows, and whether the scores are those of the confusion cells.

    Accuracy is the share on the diagonal; weighted F1 is the mean of 2 tp / (actual +
    predicted) over the classes, weighted by their actual rows.
    """
    side = lambda kind, value: F.sum(F.when(F.col(kind) == value, F.col("plays")).otherwise(0))
    hit = lambda v: F.sum(F.when((F.col("actual") == v) & (F.col("predicted") == v), F.col("plays")).otherwise(0))
    total = F.sum("plays")
    f1 = sum(2 * hit(v) / (side("actual", v) + side("predicted", v)) * side("actual", v) / total for v in (0, 1))
    own = cells.agg(
        total.alias("test_rows"), ((hit(0) + hit(1)) / total).alias("_accuracy"), f1.alias("_f1"),
    )
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 0.0001
    return own.crossJoin(scores).select(
        "test_rows", near("accuracy", "_accuracy").alias("accuracy_of_cells"), near("f1_weighted", "_f1").alias("f1_of_cells"),
        (F.col("cv_f1_mean").between(0, 1) & F.col("cv_f1_std").between(0, 1)).alias("cross_validated"),
    )


def _importance(fit):
    """The named features; importances are not negative and sum to one."""

    def query(spark, sf):
        whole = F.sum("importance").over(Window.partitionBy())
        return fit(spark, sf)[0].select(
            "feature", (F.col("importance") >= 0).alias("not_negative"), (F.abs(whole - 1) < 1e-9).alias("sum_is_one")
        )

    return query


def origin_verdict(spark, sf):
    """The result document; its verdict against the rule on the document's own accuracy."""
    rows = plays(spark, sf)
    compared = origin.comparison(rows)
    result = origin.origin_result(rows, compared, origin_fit(spark, sf))
    ruled = origin.verdict(result.select(F.col("accuracy"), F.col("verdict").alias("own")), compared)
    return result.crossJoin(ruled.select((F.col("own") == F.col("verdict")).alias("verdict_by_rule"))).select(
        "active_share", "recommender_share", "plays", "model", F.concat_ws(",", "feature_names").alias("feature_names"),
        F.aggregate(F.flatten("confusion_matrix"), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("test_rows"), "verdict_by_rule",
    )


def verdict_rule(spark, sf):
    """The verdict for every share of active plays of an artist taken as an accuracy."""
    rows = plays(spark, sf)
    shares = rows.filter(F.col("artist_name").isNotNull()).groupBy("artist_name").agg(
        F.avg("origin").alias("accuracy")
    )
    return origin.verdict(shares, origin.comparison(rows))


def confusion_cells(spark, sf):
    """Actual against guessed skips, the guess being that own picks are not skipped."""
    rows = plays(spark, sf).select(F.col("skip").alias("label"), (1 - F.col("origin")).alias("prediction"))
    return evaluate.confusion(rows)


clustered = once("weeks", lambda spark, sf: weekly.cluster_weeks(weeks(spark, sf), FULL))


def silhouettes(spark, sf):
    """The numbers of clusters tried."""
    _, scores = clustered(spark, sf)
    return scores.select("k", F.col("silhouette").between(-1, 1).alias("is_silhouette"))


def best_k(spark, sf):
    """The clusters of the final fit: as many as the best silhouette says, all named by the rules."""
    grouped, scores = clustered(spark, sf)
    best = scores.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"))
    profiles = weekly.rounded_profiles(weekly.cluster_profiles(grouped))
    names = [F.lit(name) for name in WEEK_PROFILES.values()]
    found = profiles.agg(F.count("*").alias("n"), F.bool_and(F.col("profile").isin(*names)).alias("profiles_known"))
    return found.crossJoin(best).select((F.col("n") == F.col("k")).alias("k_is_best"), "profiles_known")


def clustered_weeks(spark, sf):
    """Every week, in one of the clusters."""
    grouped, _ = clustered(spark, sf)
    inside = F.col("cluster").between(0, FULL.max_clusters - 1)
    artists = F.col("unique_artists").cast("bigint").alias("unique_artists")
    return grouped.select("listener_id", "year", "week", "week_plays", artists, inside.alias("in_cluster"))


def week_outputs(spark, sf):
    """The result document: weeks, and figures that agree with each other."""
    grouped, scores = clustered(spark, sf)
    profiles = weekly.cluster_profiles(grouped)
    result = weekly.week_result(weekly.named_weeks(grouped, profiles), profiles, scores)
    best = scores.agg(F.max("silhouette").alias("s"), F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"))
    return result.crossJoin(best).select(
        "weeks_analysed", (F.col("best_k") == F.col("k")).alias("k_is_best"),
        (F.size("profiles") == F.col("k")).alias("a_profile_each"),
        (F.abs(F.col("silhouette_score") - F.col("s")) < 0.0001).alias("score_is_best"),
        (F.col("verdict") == F.format_string(WEEK_VERDICT, "k")).alias("verdict_by_rule"),
    )


def ruled_week_outputs(spark, sf):
    """The result document of the groups by rule, taken as the clusters found."""
    grouped = ruled_weeks(spark, sf)
    profiles = weekly.cluster_profiles(grouped)
    scores = spark.createDataFrame([(2, 0.25), (4, 0.51239)], "k int, silhouette double")
    result = weekly.week_result(weekly.named_weeks(grouped, profiles), profiles, scores)
    return result.select(
        "weeks_analysed", "silhouette_score", "best_k", "verdict",
        F.concat_ws(",", F.transform("profiles", lambda p: F.concat_ws(":", p["cluster"], p["profile"]))).alias("profiles"),
    )


def scaled(spark, sf):
    z = [f"z_{f}" for f in weekly.FEATURES]
    rows = weekly.scaled_weeks(weeks(spark, sf))
    return rows.select("listener_id", "year", "week", *[F.round(c, 6).alias(c) for c in z])


skip_fit = once("skip", lambda spark, sf: fatigue.fit_skip_model(context(spark, sf), FULL))


def _evaluation(fit):
    return lambda spark, sf: _agreement(*fit(spark, sf)[1:])


def skip_verdict(spark, sf):
    """The result document; its verdict against the rule on the fitted importances."""
    fitted = skip_fit(spark, sf)
    result = fatigue.skip_result(context(spark, sf), fitted)
    ruled = fatigue.top_feature_verdict(fitted[0]).withColumnsRenamed({"top_feature": "t", "verdict": "v"})
    return result.crossJoin(ruled).select(
        "skip_rate", "model", F.concat_ws(",", "feature_names").alias("feature_names"),
        F.aggregate(F.flatten("confusion_matrix"), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("test_rows"),
        ((F.col("top_feature") == F.col("t")) & (F.col("verdict") == F.col("v"))).alias("verdict_by_rule"),
    )


def guess_scores(spark, sf):
    """Accuracy and weighted F1 of a guess: own picks are not skipped."""
    guess = plays(spark, sf).select(
        F.col("skip").cast("double").alias("label"), (1 - F.col("origin")).cast("double").alias("prediction")
    )
    accuracy, f1 = evaluate.accuracy_and_f1(guess)
    return spark.range(1).select(F.round(F.lit(accuracy), 9).alias("accuracy"), F.round(F.lit(f1), 9).alias("f1_weighted"))


RULES = (2, 3, 5, 6)


def _rules_silhouette(k: int):
    """Silhouette of k groups by rule."""

    def query(spark, sf):
        grouped = weekly.assembled_weeks(
            weeks(spark, sf).withColumn("cluster", F.pmod(F.col("unique_artists"), F.lit(k)).cast("int"))
        )
        score = weekly.silhouette(grouped.select("cluster", "features"))
        return spark.range(1).select(F.round(F.lit(score), 6).alias("silhouette"))

    return query


ruled_silhouette = _rules_silhouette(4)


def clustered_totals(spark, sf):
    """Weeks, plays and years the fitted clusters cover together."""
    grouped, _ = clustered(spark, sf)
    return grouped.agg(F.count("*").alias("weeks"), F.sum("week_plays").alias("plays"))


def _test_rows(fit):
    """Test plays by actual class, from the confusion cells of the fitted model."""

    def query(spark, sf):
        cells = fit(spark, sf)[1]
        return cells.groupBy(F.col("actual").alias("label")).agg(F.sum("plays").alias("plays"))

    return query


def skip_split_sizes(spark, sf):
    rows = fatigue.training_rows(context(spark, sf), FULL)
    return rows.groupBy("label", "part").agg(F.count("*").alias("plays"))


def skip_verdict_rule(spark, sf):
    """The verdict for each feature as the most important one, and for one without a text."""
    names = [*fatigue.FEATURES, "ms_before"]
    result = None
    means = context(spark, sf).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names])
    ranked = means.unpivot([], names, "feature", "importance")
    for top in names:
        raised = ranked.withColumn("importance", F.col("importance") + F.when(F.col("feature") == top, 1e12).otherwise(0.0))
        one = fatigue.top_feature_verdict(raised)
        result = one if result is None else result.union(one)
    return result


def all_models(spark, sf):
    """The summary of all models, from the fits above."""
    rows, skips = plays(spark, sf), context(spark, sf)
    grouped, scores = clustered(spark, sf)
    profiles = weekly.cluster_profiles(grouped)
    results = {
        "origin_result": origin.origin_result(rows, origin.comparison(rows), origin_fit(spark, sf)),
        "week_result": weekly.week_result(weekly.named_weeks(grouped, profiles), profiles, scores),
        "skip_result": fatigue.skip_result(skips, skip_fit(spark, sf)),
    }
    return model_summary(results, spark).select(
        F.col("origin_result.plays").alias("origin_plays"), F.col("week_result.weeks_analysed").alias("weeks_analysed"),
        F.col("skip_result.skip_rate").alias("skip_rate"),
    )


QUERIES = {
    "m1_1_comparison": _on_plays(origin.comparison),
    "m1_2_diversity": _on_plays(origin.diversity),
    "m1_3_trend": _on_plays(origin.trend),
    "m1_4_artists_by_origin": _on_plays(origin.artists_by_origin),
    "m1_1_comparison_of_each_listener": _on_plays(origin.comparison, FULL),
    "m1_2_diversity_of_each_listener": _on_plays(origin.diversity, FULL),
    "m1_3_trend_of_each_listener": _on_plays(origin.trend, FULL),
    "m1_4_artists_of_each_listener": _on_plays(origin.artists_by_origin, FULL),
    "m1_9_shares_of_each_listener": _on_plays(origin.shares, FULL),
    "m1_1_comparison_of_cube": _on_cube(origin.comparison),
    "m1_3_trend_of_cube": _on_cube(origin.trend),
    "m1_4_artists_of_cube": _on_cube(origin.artists_by_origin),
    "m1_9_shares_of_cube": _on_cube(origin.shares),
    "m1_5_split_sizes": split_sizes,
    "m1_5_class_weights": class_weights,
    "m1_6_fold_sizes": fold_sizes,
    "m1_6_confusion_cells": confusion_cells,
    "m1_6_test_rows": _test_rows(origin_fit),
    "m1_6_evaluation": _evaluation(origin_fit),
    "m1_6_scores_of_guess": guess_scores,
    "m1_7_importance": _importance(origin_fit),
    "m1_8_verdict_rule": verdict_rule,
    "m1_8_verdict": origin_verdict,
    "m1_9_shares": _on_plays(origin.shares),
    "m2_1_week_vectors": weeks,
    "m2_2_scaled_weeks": scaled,
    "m2_3_silhouette_by_k": silhouettes,
    **{f"m2_3_silhouette_of_{k}_rules": _rules_silhouette(k) for k in RULES},
    "m2_4_clustered_totals": clustered_totals,
    "m2_4_clustered_weeks": clustered_weeks,
    "m2_5_profile_rules": lambda s, sf: weekly.rounded_profiles(weekly.cluster_profiles(ruled_weeks(s, sf))),
    "m2_5_profiles": best_k,
    "m2_6_profiles_by_year": lambda s, sf: weekly.profiles_by_year(ruled_named_weeks(s, sf)),
    "m2_7_profiles_by_month":
        lambda s, sf: weekly.profiles_by_month(ruled_named_weeks(s, sf), history(s, sf), FULL),
    "m2_8_silhouette_of_rules": ruled_silhouette,
    "m2_9_week_result": week_outputs,
    "m2_9_week_result_of_rules": ruled_week_outputs,
    "j2_named_weeks": lambda s, sf: ruled_named_weeks(s, sf).select("listener_id", "year", "week", "cluster", "profile"),
    "j3_weeks_by_month": lambda s, sf: weekly.weeks_by_month(weeks(s, sf), history(s, sf), FULL).select(
        "listener_id", "year", "week", "month", "week_plays"
    ),
    "m3_1_skip_context": lambda s, sf: context(s, sf).select(
        "play_id", "session_id", "position", "minutes_before", "skips_before", "skip", "shuffle_on", "active",
        "hour", "weekday", "month",
    ),
    "m3_2_split_sizes": skip_split_sizes,
    "m3_3_test_rows": _test_rows(skip_fit),
    "m3_3_evaluation": _evaluation(skip_fit),
    "m3_4_importance": _importance(skip_fit),
    "m3_4_verdict_rule": skip_verdict_rule,
    "m3_4_verdict": skip_verdict,
    "m3_5_skip_by_position": _on_context(fatigue.skip_by_position),
    "m3_6_skip_by_minutes": _on_context(fatigue.skip_by_minutes),
    "m3_7_skip_by_hour": _on_context(fatigue.skip_by_hour),
    "m3_8_skip_by_shuffle": _on_context(fatigue.skip_by_shuffle),
    "m3_9_skip_by_origin": _on_context(fatigue.skip_by_origin),
    "m3_10_skip_rates": _on_context(fatigue.skip_rates),
    "m3_5_skip_by_position_of_each_listener": _on_context(fatigue.skip_by_position, FULL),
    "m3_6_skip_by_minutes_of_each_listener": _on_context(fatigue.skip_by_minutes, FULL),
    "m3_7_skip_by_hour_of_each_listener": _on_context(fatigue.skip_by_hour, FULL),
    "m3_8_skip_by_shuffle_of_each_listener": _on_context(fatigue.skip_by_shuffle, FULL),
    "m3_9_skip_by_origin_of_each_listener": _on_context(fatigue.skip_by_origin, FULL),
    "m3_10_skip_rates_of_each_listener": _on_context(fatigue.skip_rates, FULL),
    "m3_11_all_models": all_models,
}

ORIGIN_CTE = """
plays AS (
  SELECT * FROM (
    SELECT *, CAST(CASE WHEN reason_start IN ('clickrow', 'playbtn', 'remote', 'backbtn') THEN 1
        WHEN reason_start IN ('trackdone', 'autoplay', 'fwdbtn') THEN 0 END AS INTEGER) AS origin,
      CAST(ms_played >= 30000 AS INTEGER) AS complete, CASE WHEN skipped THEN 1 ELSE 0 END AS skip
    FROM history WHERE content_type = 'music' AND ms_played IS NOT NULL
  ) WHERE origin IS NOT NULL
)
"""


def case(column: str, names: dict) -> str:
    return f"CASE {column}" + "".join(f" WHEN {k} THEN '{v}'" for k, v in names.items()) + " END"


def mean(column: str) -> str:
    return f"CAST(sum({column}) AS BIGINT) / count({column})"


def on_plays(body: str, more: str = "") -> str:
    return on_history(body, ORIGIN_CTE + ("," + more if more else ""))


WEEKS_CTE = f"""
dated AS (
  SELECT *, concat(CAST(year AS VARCHAR), '-W', lpad(CAST(weekofyear(make_date(year, month, day)) AS VARCHAR), 2, '0')) AS week
  FROM history
),
weeks AS (
  SELECT *, {half_even('unique_tracks / greatest(week_plays, 1)', 3)} AS diversity,
    CAST(unique_artists % 4 AS INTEGER) AS cluster
  FROM (
    SELECT listener_id, year, week, coalesce(sum(ms_played), 0) / 3600000 AS week_hours, count(ms_played) AS week_plays,
      count(DISTINCT artist_name) AS unique_artists, count(DISTINCT track_uri) AS unique_tracks,
      {mean('CASE WHEN skipped THEN 1 ELSE 0 END')} AS skip_rate,
      {mean('CASE WHEN ms_played >= 30000 THEN 1 ELSE 0 END')} AS complete_rate,
      {mean("CASE WHEN reason_start IN ('clickrow', 'playbtn', 'remote', 'backbtn') THEN 1 ELSE 0 END")} AS active_rate,
      {mean("CASE WHEN content_type = 'music' THEN 1 ELSE 0 END")} AS music_rate,
      {mean("CASE WHEN content_type = 'podcast' THEN 1 ELSE 0 END")} AS podcast_rate,
      {mean('hour')} AS mean_hour
    FROM dated GROUP BY listener_id, year, week
  ) WHERE week_plays >= 5
)
"""
PROFILES_CTE = f"""
centres AS (SELECT cluster, {", ".join(f"avg({f}) AS {f}" for f in weekly.FEATURES)} FROM weeks GROUP BY cluster),
cuts AS (
  SELECT quantile_cont(week_hours, 0.25) AS h25, quantile_cont(week_hours, 0.75) AS h75, quantile_cont(diversity, 0.5) AS d50,
    quantile_cont(diversity, 0.75) AS d75, quantile_cont(skip_rate, 0.75) AS s75, quantile_cont(active_rate, 0.5) AS a50
  FROM centres
),
profiles AS (
  SELECT c.*, CASE
    WHEN podcast_rate > 0.3 THEN '{WEEK_PROFILES["podcasts"]}'
    WHEN week_hours > h75 AND diversity > d50 THEN '{WEEK_PROFILES["explorer_marathon"]}'
    WHEN week_hours > h75 THEN '{WEEK_PROFILES["loop_marathon"]}'
    WHEN diversity > d75 THEN '{WEEK_PROFILES["exploration"]}'
    WHEN skip_rate > s75 THEN '{WEEK_PROFILES["skipping"]}'
    WHEN week_hours < h25 THEN '{WEEK_PROFILES["quiet"]}'
    WHEN active_rate < a50 THEN '{WEEK_PROFILES["passive"]}'
    ELSE '{WEEK_PROFILES["regular"]}' END AS profile
  FROM centres c, cuts
),
named AS (SELECT w.*, profile FROM weeks w LEFT JOIN profiles USING (cluster)),
months AS (SELECT DISTINCT listener_id, year, week, month FROM dated)
"""


def on_weeks(body: str) -> str:
    return on_history(body, WEEKS_CTE + "," + PROFILES_CTE)


def skip_by(key: str, tail: str = "", more: str = "") -> str:
    return on_history(
        f"SELECT {key}, {mean('skip')} AS skip_rate, count(*) AS plays{more} FROM skip_context GROUP BY {key} {tail}",
        MUSIC_CONTEXT,
    )


def _z(feature: str) -> str:
    return (f"coalesce(round(CASE WHEN stddev_pop({feature}) OVER () > 0 THEN ({feature} - avg({feature}) OVER ()) "
            f"/ stddev_pop({feature}) OVER () END, 6), 0) AS z_{feature}")


def split_sql(source: str, label: str) -> str:
    """Class sizes of a split. Row i of n (from 1) is in the train part when (i - 0.5) / n
    does not exceed its share."""
    return (
        f"SELECT * FROM (SELECT {label} AS label, CAST(CASE WHEN (i - 0.5) / n <= 0.8 THEN 0 ELSE 1 END AS INTEGER) AS part, "
        f"count(*) AS plays FROM (SELECT {label}, row_number() OVER (PARTITION BY {label}) AS i, "
        f"count(*) OVER (PARTITION BY {label}) AS n FROM {source}) GROUP BY 1, 2)"
    )


TEST_ROWS = "SELECT label, plays FROM ({}) WHERE part = 1"
Z = [f"CASE WHEN stddev_pop({f}) OVER () > 0 THEN ({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () ELSE 0 END"
     for f in weekly.FEATURES]
SILHOUETTE = f"""
, points AS (SELECT row_number() OVER () AS id, unique_artists % {{k}} AS cluster, [{", ".join(Z)}] AS v FROM weeks),
reach AS (
  SELECT a.id, a.cluster AS own, b.cluster AS other, count(*) AS size,
    sum(list_distance(a.v, b.v) ** 2) AS total
  FROM points a, points b GROUP BY ALL
),
sides AS (
  SELECT id, max(size) FILTER (own = other) AS size, max(total) FILTER (own = other) AS total,
    min(total / size) FILTER (own <> other) AS b FROM reach GROUP BY id
)
SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - total / (size - 1)) / greatest(b, total / (size - 1)) END), 6) AS silhouette
FROM sides
"""

AGREEMENT = ("SELECT CAST(sum(plays) AS BIGINT) AS test_rows, true AS accuracy_of_cells, true AS f1_of_cells, "
             "true AS cross_validated FROM ({}) WHERE part = 1")


def _importance_sql(features: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, true AS not_negative, true AS sum_is_one" for f in features)


def skip_of_listeners(key: str, tail: str = "", more: str = "") -> str:
    return on_history(
        f"SELECT listener_id, {key}, {mean('skip')} AS skip_rate, count(*) AS plays{more} FROM skip_context GROUP BY listener_id, {key} {tail}",
        MUSIC_CONTEXT,
    )


OF_LISTENER = {
    "m1_1_comparison_of_each_listener": on_plays(
        f"SELECT listener_id, origin, count(ms_played) AS plays, {half_even(mean('complete'), 3)} AS complete_rate, "
        f"{half_even(mean('skip'), 3)} AS skip_rate, {half_even(mean('ms_played'), 0)} AS mean_ms, "
        f"{half_even('sum(ms_played) / 3600000', 2)} AS hours, {case('origin', ORIGIN_NAMES)} AS origin_name "
        "FROM plays GROUP BY listener_id, origin"
    ),
    "m1_2_diversity_of_each_listener": on_plays(
        f"SELECT listener_id, {case('o', ORIGIN_NAMES_SHORT)} AS origin_name, count(DISTINCT track_uri) FILTER (origin = o) AS unique_tracks, "
        "count(*) FILTER (origin = o) AS plays, "
        f"{half_even('count(*) FILTER (origin = o) / greatest(count(DISTINCT track_uri) FILTER (origin = o), 1)', 2)} AS repeat_ratio "
        "FROM plays, range(2) r(o) GROUP BY listener_id, o"
    ),
    "m1_3_trend_of_each_listener": on_plays(
        f"SELECT listener_id, year, month, {half_even(mean('origin'), 3)} AS active_share, count(*) AS plays FROM plays GROUP BY listener_id, year, month"
    ),
    "m1_4_artists_of_each_listener": on_plays(
        "SELECT * FROM (SELECT listener_id, artist_name, count(*) FILTER (origin = 0) AS via_recommender, "
        "count(*) FILTER (origin = 1) AS via_active, count(*) AS plays, "
        f"{half_even('count(*) FILTER (origin = 0) / count(*)', 3)} AS recommender_share "
        "FROM plays WHERE artist_name IS NOT NULL GROUP BY listener_id, artist_name HAVING count(*) >= 5) "
        "QUALIFY row_number() OVER (PARTITION BY listener_id ORDER BY recommender_share DESC, plays DESC, artist_name) <= 30"
    ),
    "m1_9_shares_of_each_listener": on_plays(
        f"SELECT listener_id, {half_even(mean('origin'), 4)} AS active_share, {half_even('1 - ' + mean('origin'), 4)} AS recommender_share, "
        "count(*) AS plays FROM plays GROUP BY listener_id"
    ),
    "m3_5_skip_by_position_of_each_listener": skip_of_listeners(
        "position", "HAVING count(*) >= 10 QUALIFY row_number() OVER (PARTITION BY listener_id ORDER BY position) <= 30"
    ),
    "m3_6_skip_by_minutes_of_each_listener": skip_of_listeners("minute_bucket", "HAVING count(*) >= 10"),
    "m3_7_skip_by_hour_of_each_listener": skip_of_listeners("hour"),
    "m3_8_skip_by_shuffle_of_each_listener": skip_of_listeners("shuffle_on", more=f", {case('shuffle_on', SHUFFLE_NAMES)} AS mode"),
    "m3_9_skip_by_origin_of_each_listener": skip_of_listeners("active", more=f", {case('active', ORIGIN_NAMES)} AS origin_name"),
    "m3_10_skip_rates_of_each_listener": on_history(
        "SELECT listener_id, " + ", ".join(
            half_even(f"CAST(sum(skip){f} AS BIGINT) / count(*){f}", 4) + f" AS {n}" for n, f in {
                "skip_rate": "",
                "skip_rate_shuffle_on": " FILTER (shuffle_on = 1)",
                "skip_rate_shuffle_off": " FILTER (shuffle_on = 0)",
                "skip_rate_active": " FILTER (active = 1)",
                "skip_rate_recommender": " FILTER (active = 0)",
            }.items()) + " FROM skip_context GROUP BY listener_id", MUSIC_CONTEXT
    ),
}

ORACLES = {
    **OF_LISTENER,
    "m1_1_comparison": on_plays(
        f"SELECT origin, count(ms_played) AS plays, {half_even(mean('complete'), 3)} AS complete_rate, "
        f"{half_even(mean('skip'), 3)} AS skip_rate, {half_even(mean('ms_played'), 0)} AS mean_ms, "
        f"{half_even('sum(ms_played) / 3600000', 2)} AS hours, {case('origin', ORIGIN_NAMES)} AS origin_name "
        "FROM plays GROUP BY origin"
    ),
    "m1_2_diversity": on_plays(
        f"SELECT {case('origin', ORIGIN_NAMES_SHORT)} AS origin_name, count(DISTINCT track_uri) AS unique_tracks, "
        f"count(*) AS plays, {half_even('count(*) / greatest(count(DISTINCT track_uri), 1)', 2)} AS repeat_ratio "
        "FROM plays GROUP BY origin"
    ),
    "m1_3_trend": on_plays(
        f"SELECT year, month, {half_even(mean('origin'), 3)} AS active_share, count(*) AS plays FROM plays GROUP BY year, month"
    ),
    "m1_4_artists_by_origin": on_plays(
        "SELECT artist_name, count(*) FILTER (origin = 0) AS via_recommender, count(*) FILTER (origin = 1) AS via_active, "
        f"count(*) AS plays, {half_even('count(*) FILTER (origin = 0) / count(*)', 3)} AS recommender_share "
        "FROM plays WHERE artist_name IS NOT NULL GROUP BY artist_name HAVING count(*) >= 5 "
        "ORDER BY recommender_share DESC, plays DESC, artist_name LIMIT 30"
    ),
    "m1_5_split_sizes": on_plays(split_sql("plays", "origin")),
    "m1_5_class_weights": on_plays(
        "SELECT origin AS label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM plays GROUP BY origin"
    ),
    "m1_6_test_rows": on_plays(TEST_ROWS.format(split_sql("plays", "origin"))),
    "m2_4_clustered_totals": on_weeks("SELECT count(*) AS weeks, CAST(sum(week_plays) AS BIGINT) AS plays FROM weeks"),
    "m2_8_silhouette_of_rules": on_weeks(SILHOUETTE.format(k=4)),
    **{f"m2_3_silhouette_of_{k}_rules": on_weeks(SILHOUETTE.format(k=k)) for k in RULES},
    "m2_3_silhouette_by_k": "SELECT CAST(k AS INTEGER) AS k, true AS is_silhouette FROM range(2, 7) r(k)",
    "m2_4_clustered_weeks": on_weeks(
        "SELECT listener_id, year, week, week_plays, unique_artists, true AS in_cluster FROM weeks"
    ),
    "m2_5_profiles": "SELECT true AS k_is_best, true AS profiles_known",
    "m2_9_week_result": on_weeks(
        "SELECT count(*) AS weeks_analysed, true AS k_is_best, true AS a_profile_each, true AS score_is_best, "
        "true AS verdict_by_rule FROM weeks"
    ),
    "m2_9_week_result_of_rules": on_weeks(
        "SELECT (SELECT count(*) FROM weeks) AS weeks_analysed, CAST(0.5124 AS DOUBLE) AS silhouette_score, "
        f"CAST(count(*) AS INTEGER) AS best_k, replace('{WEEK_VERDICT}', '%d', CAST(count(*) AS VARCHAR)) AS verdict, "
        "string_agg(concat(cluster, ':', profile), ',' ORDER BY cluster) AS profiles FROM profiles"
    ),
    "m1_6_evaluation": on_plays(AGREEMENT.format(split_sql("plays", "origin"))),
    "m1_6_scores_of_guess": on_plays(
        "SELECT (SELECT round(avg(CAST(skip = 1 - origin AS INTEGER)), 9) FROM plays) AS accuracy, round(sum(weight * f1), 9) AS f1_weighted "
        "FROM (SELECT count(*) FILTER (skip = v) / count(*) AS weight, 2 * count(*) FILTER (skip = v AND 1 - origin = v) "
        "/ (count(*) FILTER (skip = v) + count(*) FILTER (1 - origin = v)) AS f1 FROM plays, range(2) r(v) GROUP BY v)"
    ),
    "m1_7_importance": _importance_sql(origin.FEATURES),
    "m1_8_verdict": on_plays(
        f"SELECT {half_even(mean('origin'), 4)} AS active_share, {half_even('1 - ' + mean('origin'), 4)} AS recommender_share, "
        f"count(*) AS plays, '{ORIGIN_MODEL}' AS model, '{','.join(origin.FEATURES)}' AS feature_names, "
        f"(SELECT CAST(sum(plays) AS BIGINT) FROM ({TEST_ROWS.format(split_sql('plays', 'origin'))})) AS test_rows, "
        "true AS verdict_by_rule FROM plays"
    ),
    "m3_3_evaluation": on_history(AGREEMENT.format(split_sql("skip_context", "skip")), MUSIC_CONTEXT),
    "m3_4_importance": _importance_sql(fatigue.FEATURES),
    "m3_4_verdict": on_history(
        f"SELECT {half_even('CAST(sum(skip) AS BIGINT) / count(*)', 4)} AS skip_rate, '{SKIP_MODEL}' AS model, "
        f"'{','.join(fatigue.FEATURES)}' AS feature_names, "
        f"(SELECT CAST(sum(plays) AS BIGINT) FROM ({TEST_ROWS.format(split_sql('skip_context', 'skip'))})) AS test_rows, "
        "true AS verdict_by_rule FROM skip_context", MUSIC_CONTEXT
    ),
    "m3_11_all_models": on_history(
        "SELECT (SELECT count(*) FROM plays) AS origin_plays, (SELECT count(*) FROM weeks) AS weeks_analysed, "
        f"{half_even('CAST(sum(skip) AS BIGINT) / count(*)', 4)} AS skip_rate FROM skip_context",
        MUSIC_CONTEXT + "," + ORIGIN_CTE + "," + WEEKS_CTE
    ),
    "m3_2_split_sizes": on_history(split_sql("skip_context", "skip"), MUSIC_CONTEXT),
    "m3_3_test_rows": on_history(TEST_ROWS.format(split_sql("skip_context", "skip")), MUSIC_CONTEXT),
    "m3_4_verdict_rule": " UNION ALL ".join(
        f"SELECT '{f}' AS top_feature, '" + (SKIP_VERDICTS.get(f) or SKIP_VERDICT_OTHER % f).replace("'", "''") + "' AS verdict"
        for f in [*fatigue.FEATURES, "ms_before"]
    ),
    "m1_6_fold_sizes": on_plays(
        "SELECT origin AS label, CAST(CASE WHEN (i - 0.5) / n <= 0.2 THEN 0 WHEN (i - 0.5) / n <= 0.4 THEN 1 "
        "WHEN (i - 0.5) / n <= 0.6 THEN 2 WHEN (i - 0.5) / n <= 0.8 THEN 3 ELSE 4 END AS INTEGER) AS fold, count(*) AS plays "
        "FROM (SELECT origin, row_number() OVER (PARTITION BY origin) AS i, count(*) OVER (PARTITION BY origin) AS n FROM plays) "
        "GROUP BY 1, 2"
    ),
    "m1_6_confusion_cells": on_plays(
        "SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted, "
        "(SELECT count(*) FROM plays WHERE skip = a AND 1 - origin = p) AS plays FROM range(2) x(a), range(2) y(p)"
    ),
    "m1_8_verdict_rule": on_plays(
        "SELECT artist_name, accuracy, CASE WHEN accuracy < 0.58 THEN '{alike}' WHEN gap > 0.05 THEN '{own_picks}' "
        "ELSE '{context}' END AS verdict FROM (SELECT artist_name, {acc} AS accuracy FROM plays WHERE artist_name IS NOT NULL GROUP BY 1), "
        "(SELECT abs(max(r) FILTER (origin = 1) - max(r) FILTER (origin = 0)) AS gap FROM "
        "(SELECT origin, {rate} AS r FROM plays GROUP BY origin))".format(
            **origin.ORIGIN_VERDICTS, acc=mean("origin"), rate=half_even(mean("complete"), 3))
    ),
    "m1_9_shares": on_plays(
        f"SELECT {half_even(mean('origin'), 4)} AS active_share, {half_even('1 - ' + mean('origin'), 4)} AS recommender_share, "
        "count(*) AS plays FROM plays"
    ),
    "m2_1_week_vectors": on_weeks("SELECT * EXCLUDE cluster FROM weeks"),
    "m2_2_scaled_weeks": on_weeks(
        f"SELECT listener_id, year, week, {', '.join(_z(f) for f in weekly.FEATURES)} FROM weeks"
    ),
    "m2_5_profile_rules": on_weeks(
        f"SELECT cluster, profile, {', '.join(f'{half_even(f, 3)} AS {f}' for f in weekly.FEATURES)} FROM profiles"
    ),
    "m2_6_profiles_by_year": on_weeks("SELECT year, cluster, profile, count(*) AS weeks FROM named GROUP BY ALL"),
    "m2_7_profiles_by_month": on_weeks(
        "SELECT month, cluster, profile, count(*) AS weeks FROM named LEFT JOIN months USING (listener_id, year, week) GROUP BY ALL"
    ),
    "j2_named_weeks": on_weeks("SELECT listener_id, year, week, cluster, profile FROM named"),
    "j3_weeks_by_month": on_weeks(
        "SELECT listener_id, year, week, month, week_plays FROM weeks LEFT JOIN months USING (listener_id, year, week)"
    ),
    "m3_1_skip_context": on_history(
        "SELECT play_id, session_id, position, minutes_before, skips_before, skip, shuffle_on, active, hour, weekday, month "
        "FROM skip_context", MUSIC_CONTEXT
    ),
    "m3_5_skip_by_position": skip_by("position", "HAVING count(*) >= 10 ORDER BY position LIMIT 30"),
    "m3_6_skip_by_minutes": skip_by("minute_bucket", "HAVING count(*) >= 10"),
    "m3_7_skip_by_hour": skip_by("hour"),
    "m3_8_skip_by_shuffle": skip_by("shuffle_on", more=f", {case('shuffle_on', SHUFFLE_NAMES)} AS mode"),
    "m3_9_skip_by_origin": skip_by("active", more=f", {case('active', ORIGIN_NAMES)} AS origin_name"),
    "m3_10_skip_rates": on_history(
        "SELECT " + ", ".join(
            half_even(f"CAST(sum(skip){f} AS BIGINT) / count(*){f}", 4) + f" AS {n}" for n, f in {
                "skip_rate": "",
                "skip_rate_shuffle_on": " FILTER (shuffle_on = 1)",
                "skip_rate_shuffle_off": " FILTER (shuffle_on = 0)",
                "skip_rate_active": " FILTER (active = 1)",
                "skip_rate_recommender": " FILTER (active = 0)",
            }.items()) + " FROM skip_context", MUSIC_CONTEXT
    ),
}

ORACLES |= {
    f"{name}_of_cube": ORACLES[row] for name, row in {
        "m1_1_comparison": "m1_1_comparison", "m1_3_trend": "m1_3_trend", "m1_4_artists": "m1_4_artists_by_origin",
        "m1_9_shares": "m1_9_shares",
    }.items()
}
