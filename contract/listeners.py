"""Weekly profiles fitted per listener (M2.2 to M2.9): queries and oracles.

A fit of its own belongs to every listener with enough weeks. What follows from the weeks
alone (scaling, one round from given centres, groups by rule, result figures) is compared
value by value; of the fits themselves, that they are complete, best by their own scores and
fixpoints of a round.
"""

import numpy as np
from pyspark.sql import functions as F

from contract.models import PROFILES_CTE, WEEKS_CTE, once
from contract.tables import history, on_history
from hearlog.operators import clusters, weekly
from hearlog.params import Params
from hearlog.sources.tables import model_input
from hearlog.vocabulary import WEEK_PROFILES, WEEK_VERDICT

KEYS = ("listener_id",)
EACH = Params(listener_keys=KEYS, min_week_plays=1)
Z = [f"z_{f}" for f in weekly.FEATURES]
#: Centres that the checked round starts from: a listener's first weeks.
GIVEN = 3


def weeks(spark, sf):
    return weekly.week_vectors(model_input(history(spark, sf)), EACH)


def ruled(spark, sf):
    return weeks(spark, sf).withColumn("cluster", F.pmod(F.col("unique_artists"), F.lit(4)).cast("int"))


def ruled_profiles(spark, sf):
    return weekly.cluster_profiles(ruled(spark, sf), KEYS)


def ruled_named(spark, sf):
    return weekly.named_weeks(ruled(spark, sf), ruled_profiles(spark, sf), KEYS)


clustered = once("weeks of each listener", lambda spark, sf: weekly.cluster_listeners(weeks(spark, sf), EACH))


def scaled(spark, sf):
    rows = weekly.scaled_weeks(weeks(spark, sf), KEYS)
    return rows.select("listener_id", "year", "week", *[(F.round(c, 6) + 0.0).alias(c) for c in Z])


def silhouettes(spark, sf):
    scores = clustered(spark, sf)[1]
    return scores.select("listener_id", "k", F.col("silhouette").between(-1, 1).alias("is_silhouette"))


def clustered_weeks(spark, sf):
    rows, scores = clustered(spark, sf)
    most = scores.groupBy("listener_id").agg(F.max("k").alias("most"))
    inside = F.col("cluster").between(0, F.col("most") - 1)
    return rows.join(most, "listener_id").select("listener_id", "year", "week", "week_plays", inside.alias("in_cluster"))


def _one_round(points: np.ndarray) -> dict:
    own, centres = clusters.lloyd(points, points[None, :GIVEN], rounds=1)
    return {"clusters": own[0].astype(np.int32), "centres": centres.ravel()}


def _after_one_round(spark, sf):
    groups = weekly.listener_groups(weeks(spark, sf), EACH)
    return clusters.fitted(groups, clusters.each(_one_round), {"clusters": "int", "centres": "double"})


def assigned_once(spark, sf):
    rows = weekly.one_per_week(_after_one_round(spark, sf), weeks(spark, sf), KEYS)
    return rows.select("listener_id", "year", "week", "cluster")


def moved_once(spark, sf):
    width = len(Z)
    number = F.explode(F.sequence(F.lit(0), F.lit(GIVEN - 1))).alias("cluster")
    rows = _after_one_round(spark, sf).select("listener_id", number, "centres")
    return rows.select("listener_id", "cluster", *[
        F.round(F.get("centres", F.col("cluster") * width + i), 6).alias(z) for i, z in enumerate(Z)
    ])


def fixpoints(spark, sf):
    """Whether no week of a listener is nearer to another cluster's mean than to its own's."""
    rows = weekly.scaled_weeks(clustered(spark, sf)[0], KEYS)
    means = rows.groupBy("listener_id", F.col("cluster").alias("other")).agg(*[F.avg(z).alias(f"mean_{z}") for z in Z])
    apart = sum((F.col(z) - F.col(f"mean_{z}")) * (F.col(z) - F.col(f"mean_{z}")) for z in Z)
    reach = rows.join(means, "listener_id").withColumn("apart", apart).groupBy("listener_id", "year", "week").agg(
        F.min("apart").alias("least"), F.min(F.when(F.col("cluster") == F.col("other"), F.col("apart"))).alias("own")
    )
    return reach.groupBy("listener_id").agg(F.bool_and(F.col("own") <= F.col("least") + 1e-9).alias("is_fixpoint"))


def best_k(spark, sf):
    rows, scores = clustered(spark, sf)
    best = scores.groupBy("listener_id").agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"))
    names = [F.lit(name) for name in WEEK_PROFILES.values()]
    found = weekly.cluster_profiles(rows, KEYS).groupBy("listener_id").agg(
        F.count("*").alias("n"), F.bool_and(F.col("profile").isin(*names)).alias("profiles_known")
    )
    return found.join(best, "listener_id").select("listener_id", (F.col("n") == F.col("k")).alias("k_is_best"), "profiles_known")


def _rule_silhouette(points: np.ndarray) -> dict:
    return {"score": np.array([clusters.mean_silhouette(points[:, :-1], points[:, -1])])}


def silhouette_of_rules(spark, sf):
    rows = weekly.scaled_weeks(ruled(spark, sf), KEYS)
    groups = clusters.in_groups(rows, list(KEYS), ["year", "week"], [*Z, "cluster"])
    scores = clusters.fitted(groups, clusters.each(_rule_silhouette), {"score": "double"})
    return scores.select("listener_id", F.round(F.get("score", F.lit(0)), 6).alias("silhouette"))


def week_results(spark, sf):
    rows, scores = clustered(spark, sf)
    profiles = weekly.cluster_profiles(rows, KEYS)
    result = weekly.week_result(weekly.named_weeks(rows, profiles, KEYS), profiles, scores, KEYS)
    best = scores.groupBy("listener_id").agg(
        F.max("silhouette").alias("s"), F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k")
    )
    return result.join(best, "listener_id").select(
        "listener_id", "weeks_analysed", (F.col("best_k") == F.col("k")).alias("k_is_best"),
        (F.size("profiles") == F.col("k")).alias("a_profile_each"),
        (F.abs(F.col("silhouette_score") - F.col("s")) < 0.0001).alias("score_is_best"),
        (F.col("verdict") == F.format_string(WEEK_VERDICT, "k")).alias("verdict_by_rule"),
    )


def week_results_of_rules(spark, sf):
    profiles = ruled_profiles(spark, sf)
    scores = weeks(spark, sf).groupBy("listener_id").agg((F.count("*") / 100).alias("silhouette")).withColumn("k", F.lit(4))
    result = weekly.week_result(ruled_named(spark, sf), profiles, scores, KEYS)
    return result.select(
        "listener_id", "weeks_analysed", "silhouette_score", "best_k", "verdict",
        F.concat_ws(",", F.transform("profiles", lambda p: F.concat_ws(":", p["cluster"], p["profile"]))).alias("profiles"),
    )


QUERIES = {
    "m2_1_weeks_of_each_listener": weeks,
    "m2_2_scaled_weeks_of_each_listener": scaled,
    "m2_3_silhouettes_of_each_listener": silhouettes,
    "m2_4_clustered_weeks_of_each_listener": clustered_weeks,
    "m2_4_assigned_once_of_each_listener": assigned_once,
    "m2_4_moved_once_of_each_listener": moved_once,
    "m2_4_fixpoints_of_each_listener": fixpoints,
    "m2_5_profile_rules_of_each_listener": lambda s, sf: ruled_profiles(s, sf).select(
        "listener_id", "cluster", "profile", *[F.round(f, 9).alias(f) for f in weekly.FEATURES]
    ),
    "m2_5_profiles_of_each_listener": best_k,
    "m2_6_profiles_by_year_of_each_listener": lambda s, sf: weekly.profiles_by_year(ruled_named(s, sf), KEYS),
    "m2_7_profiles_by_month_of_each_listener":
        lambda s, sf: weekly.profiles_by_month(ruled_named(s, sf), history(s, sf), EACH, KEYS),
    "m2_8_silhouette_of_rules_of_each_listener": silhouette_of_rules,
    "m2_9_week_results_of_each_listener": week_results,
    "m2_9_week_results_of_rules_of_each_listener": week_results_of_rules,
}

OWN = "OVER (PARTITION BY listener_id)"
SCALED = [
    f"coalesce(CASE WHEN stddev_pop({f}) {OWN} > 0 THEN ({f} - avg({f}) {OWN}) / stddev_pop({f}) {OWN} END, 0)"
    for f in weekly.FEATURES
]
EACH_CTE = WEEKS_CTE.replace("week_plays >= 5", "week_plays >= 1") + "," + PROFILES_CTE.replace(
    "SELECT cluster, avg", "SELECT listener_id, cluster, avg").replace("GROUP BY cluster", "GROUP BY listener_id, cluster").replace(
    "AS a50\n  FROM centres", "AS a50, listener_id\n  FROM centres GROUP BY listener_id").replace(
    "FROM centres c, cuts", "FROM centres c JOIN cuts USING (listener_id)").replace(
    "SELECT c.*, CASE", "SELECT c.*, CASE").replace("USING (cluster)", "USING (listener_id, cluster)") + f"""
, enough AS (SELECT listener_id, count(*) AS n FROM weeks GROUP BY listener_id HAVING count(*) >= 10),
points AS (
  SELECT listener_id, year, week, cluster, row_number() OVER (PARTITION BY listener_id ORDER BY year, week) AS id, [{", ".join(SCALED)}] AS v
  FROM weeks
),
usable AS (SELECT * FROM points SEMI JOIN enough USING (listener_id)),
given AS (SELECT listener_id, CAST(id - 1 AS INTEGER) AS cluster, v FROM usable WHERE id <= {GIVEN}),
assigned AS (
  SELECT p.listener_id, p.year, p.week, any_value(p.v) AS v,
    min({{'d': list_distance(p.v, g.v), 'c': g.cluster}})['c'] AS cluster
  FROM usable p JOIN given g ON p.listener_id = g.listener_id GROUP BY ALL
),
reach AS (
  SELECT a.listener_id, a.id, a.cluster AS own, b.cluster AS other, count(*) AS size, sum(list_distance(a.v, b.v) ** 2) AS total
  FROM points a JOIN points b ON a.listener_id = b.listener_id GROUP BY ALL
),
sides AS (
  SELECT listener_id, id, max(size) FILTER (own = other) AS size, max(total) FILTER (own = other) AS total,
    min(total / size) FILTER (own <> other) AS b FROM reach GROUP BY ALL
)
"""


def on_each(body: str) -> str:
    return on_history(body, EACH_CTE)


_SCORE = "CASE WHEN size = 1 OR b IS NULL THEN 0 ELSE (b - total / (size - 1)) / greatest(b, total / (size - 1)) END"
ORACLES = {
    "m2_1_weeks_of_each_listener": on_each("SELECT * EXCLUDE cluster FROM weeks"),
    "m2_2_scaled_weeks_of_each_listener": on_each(
        "SELECT listener_id, year, week, " + ", ".join(f"round({z}, 6) + 0.0 AS {name}" for z, name in zip(SCALED, Z, strict=True)) + " FROM weeks"
    ),
    "m2_3_silhouettes_of_each_listener": on_each(
        "SELECT listener_id, CAST(k AS INTEGER) AS k, true AS is_silhouette FROM enough, range(2, 7) ks(k) WHERE k < n // 3"
    ),
    "m2_4_clustered_weeks_of_each_listener": on_each(
        "SELECT listener_id, year, week, week_plays, true AS in_cluster FROM weeks SEMI JOIN enough USING (listener_id)"
    ),
    "m2_4_assigned_once_of_each_listener": on_each("SELECT listener_id, year, week, cluster FROM assigned"),
    "m2_4_moved_once_of_each_listener": on_each(
        "SELECT g.listener_id, g.cluster, "
        + ", ".join(f"round(coalesce(avg(a.v[{i + 1}]), any_value(g.v[{i + 1}])), 6) AS {z}" for i, z in enumerate(Z))
        + " FROM given g LEFT JOIN assigned a ON g.listener_id = a.listener_id AND g.cluster = a.cluster GROUP BY 1, 2"
    ),
    "m2_4_fixpoints_of_each_listener": on_each("SELECT listener_id, true AS is_fixpoint FROM enough"),
    "m2_5_profile_rules_of_each_listener": on_each(
        f"SELECT listener_id, cluster, profile, {', '.join(f'round({f}, 9) AS {f}' for f in weekly.FEATURES)} FROM profiles"
    ),
    "m2_5_profiles_of_each_listener": on_each("SELECT listener_id, true AS k_is_best, true AS profiles_known FROM enough"),
    "m2_6_profiles_by_year_of_each_listener": on_each(
        "SELECT listener_id, year, cluster, profile, count(*) AS weeks FROM named GROUP BY ALL"
    ),
    "m2_7_profiles_by_month_of_each_listener": on_each(
        "SELECT listener_id, month, cluster, profile, count(*) AS weeks FROM named LEFT JOIN months USING (listener_id, year, week) GROUP BY ALL"
    ),
    "m2_8_silhouette_of_rules_of_each_listener": on_each(
        f"SELECT listener_id, round(avg({_SCORE}), 6) AS silhouette FROM sides GROUP BY listener_id"
    ),
    "m2_9_week_results_of_each_listener": on_each(
        "SELECT listener_id, n AS weeks_analysed, true AS k_is_best, true AS a_profile_each, true AS score_is_best, "
        "true AS verdict_by_rule FROM enough"
    ),
    "m2_9_week_results_of_rules_of_each_listener": on_each(
        "SELECT listener_id, n AS weeks_analysed, n / 100 AS silhouette_score, best_k, "
        f"replace('{WEEK_VERDICT}', '%d', CAST(best_k AS VARCHAR)) AS verdict, profiles "
        "FROM (SELECT listener_id, count(*) AS n FROM weeks GROUP BY listener_id) JOIN (SELECT listener_id, CAST(count(*) AS INTEGER) AS best_k, "
        "string_agg(concat(cluster, ':', profile), ',' ORDER BY cluster) AS profiles FROM profiles GROUP BY listener_id) USING (listener_id)"
    ),
}
