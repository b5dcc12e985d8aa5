"""Weekly listening profiles: one vector per week, clustered and named."""

from functools import reduce

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearlog.functions import labels
from hearlog.functions.calendar import week_label
from hearlog.functions.rounding import MS_PER_HOUR, half_even
from hearlog.operators import clusters
from hearlog.params import Params
from hearlog.session import at_once, durable, sized
from hearlog.vocabulary import (
    PODCAST_WEEK_ABOVE,
    WEEK_MODEL,
    WEEK_PROFILES,
    WEEK_VERDICT,
)

FEATURES = ["week_hours", "unique_artists", "diversity", "skip_rate", "complete_rate",
            "active_rate", "music_rate", "podcast_rate", "mean_hour"]

#: Weeks that one task of a fit goes over; a round over so many takes it about 0.1 s.
WEEKS_PER_TASK = 100_000


def dated_plays(fact: DataFrame) -> DataFrame:
    """Plays with their week; plays without a date belong to no week."""
    has_date = F.col("year").isNotNull() & F.col("month").isNotNull() & F.col("day").isNotNull()
    label = week_label(F.col("year"), F.col("month"), F.col("day"))
    return fact.filter(has_date).withColumn("week", label)


def week_vectors(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per week with enough plays. Plays are summed up per artist and track first,
    so what counts distinct ones goes over far fewer rows."""
    keys = [*params.listener_keys, "year", "week"]
    per_play = {
        "skip_rate": labels.flag(F.col("skipped")),
        "complete_rate": F.coalesce(labels.is_complete(F.col("ms_played"), params.complete_ms), F.lit(0)),
        "active_rate": labels.is_active(F.col("reason_start")),
        "music_rate": (F.col("content_type") == "music").cast("int"),
        "podcast_rate": (F.col("content_type") == "podcast").cast("int"),
        "mean_hour": F.col("hour"),
    }
    tracks = dated_plays(fact).groupBy(*keys, "artist_name", "track_uri").agg(
        F.sum("ms_played").alias("ms"),
        F.count("ms_played").alias("plays"),
        *[F.sum(value).alias(f"sum_{name}") for name, value in per_play.items()],
        *[F.count(value).alias(f"n_{name}") for name, value in per_play.items()],
    )
    weeks = tracks.groupBy(*keys).agg(
        (F.coalesce(F.sum("ms"), F.lit(0)) / MS_PER_HOUR).alias("week_hours"),
        F.sum("plays").alias("week_plays"),
        F.countDistinct("artist_name").alias("unique_artists"),
        F.countDistinct("track_uri").alias("unique_tracks"),
        *[F.try_divide(F.sum(f"sum_{name}"), F.sum(f"n_{name}")).alias(name) for name in per_play],
    )
    per_track = F.col("unique_tracks") / F.greatest(F.col("week_plays"), F.lit(1))
    return weeks.filter(F.col("week_plays") >= params.min_week_plays).withColumn(
        "diversity", half_even(per_track, 3)
    )


def scaled_weeks(weeks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The nine features with mean 0 and population deviation 1; constant ones become 0.

    With ``keys``, within each of their values. A key's weeks are few, as the calendar has.
    """
    filled = weeks.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES})
    if keys:
        own = Window.partitionBy(*keys)
        moments = filled.withColumns(
            {f"_mean_{f}": F.avg(f).over(own) for f in FEATURES} | {f"_dev_{f}": F.stddev_pop(f).over(own) for f in FEATURES}
        )
    else:
        moments = filled.crossJoin(F.broadcast(filled.agg(
            *[F.avg(f).alias(f"_mean_{f}") for f in FEATURES],
            *[F.stddev_pop(f).alias(f"_dev_{f}") for f in FEATURES],
        )))
    return (
        moments
        .withColumns({
            f"z_{f}": F.coalesce(
                F.try_divide(F.col(f) - F.col(f"_mean_{f}"), F.col(f"_dev_{f}")), F.lit(0.0)
            )
            for f in FEATURES
        })
        .drop(*[f"_mean_{f}" for f in FEATURES], *[f"_dev_{f}" for f in FEATURES])
    )


def assembled_weeks(weeks: DataFrame) -> DataFrame:
    """Weeks with their scaled features as one vector."""
    assembler = VectorAssembler(inputCols=[f"z_{f}" for f in FEATURES], outputCol="features")
    return assembler.transform(scaled_weeks(weeks)).drop(*[f"z_{f}" for f in FEATURES])


def _best_fits(
    vectors: DataFrame, ks: list[int], starts: int, params: Params
) -> dict[int, KMeansModel]:
    """Per k, the fit with the smallest within-cluster cost over several seeded starts."""

    def fit(k: int, start: int):
        kmeans = KMeans(k=k, seed=params.seed + start, predictionCol="cluster")
        return lambda: (k, kmeans.fit(vectors))

    tasks = [fit(k, start) for k in ks for start in range(starts)]
    fits = at_once(vectors.sparkSession, tasks, params.parallel_fits)
    return {
        k: min((m for fitted, m in fits if fitted == k), key=lambda m: m.summary.trainingCost)
        for k in ks
    }


def silhouette(clustered: DataFrame) -> float:
    """Mean silhouette with squared Euclidean distance, at linear cost for any number of weeks."""
    return ClusteringEvaluator(predictionCol="cluster").evaluate(clustered)


def cluster_weeks(
    weeks: DataFrame, params: Params = Params()
) -> tuple[DataFrame, DataFrame] | None:
    """Weeks with their cluster, and the silhouette of every k tried; None when too few.

    k is the one with the best silhouette, the smaller one on a tie.
    """
    weeks = durable(weeks)
    size = weeks.count()
    ks = range(2, min(params.max_clusters + 1, size // 3))
    if size < params.min_weeks or not ks:
        return None
    # A fit is some 25 short jobs, each of them with as many tasks as there are parts.
    vectors = sized(assembled_weeks(weeks), size, WEEKS_PER_TASK).persist()
    models = _best_fits(vectors, list(ks), params.search_starts, params)
    scores = [(k, float(silhouette(model.transform(vectors)))) for k, model in models.items()]
    best_k = max(scores, key=lambda s: (s[1], -s[0]))[0]
    model = _best_fits(vectors, [best_k], params.final_starts, params)[best_k]
    # Every table below reads the same assignment, so it is written down once.
    clustered = durable(model.transform(vectors).drop("features"))
    vectors.unpersist()
    return clustered, weeks.sparkSession.createDataFrame(scores, "k int, silhouette double")


def listener_groups(weeks: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per listener with enough weeks: the weeks, and their scaled features as points."""
    keys = params.listener_keys
    scaled = scaled_weeks(weeks, keys)
    groups = clusters.in_groups(scaled, list(keys), ["year", "week"], [f"z_{f}" for f in FEATURES])
    return groups.filter((F.size("points") >= params.min_weeks) & (F.floor(F.size("points") / 3) > 2))


def cluster_listeners(weeks: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Each listener's weeks in clusters of their own, and the silhouette of every k tried.

    Listeners with too few weeks have no rows. All are fitted in one pass, whatever their
    number; nothing about a listener reaches the driver.
    """
    keys = params.listener_keys
    fit = clusters.searched(params.max_clusters, params.search_starts, params.final_starts, params.seed)
    found = durable(clusters.fitted(
        listener_groups(weeks, params), fit, {"clusters": "int", "ks": "int", "silhouettes": "double"}
    ))
    return one_per_week(found, weeks, keys), found.select(
        *keys, F.explode(F.arrays_zip("ks", "silhouettes")).alias("s")
    ).select(*keys, F.col("s.ks").alias("k"), F.col("s.silhouettes").alias("silhouette"))


def one_per_week(found: DataFrame, weeks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The weeks of fitted groups, each with its cluster."""
    rows = found.select(*keys, F.explode(F.arrays_zip("rows", "clusters")).alias("w"))
    columns = [F.col(f"w.rows.{c}").alias(c) for c in weeks.columns if c not in keys]
    return rows.select(*keys, *columns, F.col("w.clusters").alias("cluster"))


def cluster_profiles(clustered: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Centre of every cluster in original units, and its name, for each value of ``keys``.

    A value has at most ``max_clusters`` rows here, so quartiles over them are cheap.
    """
    centres = clustered.groupBy(*keys, "cluster").agg(
        *[F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in FEATURES]
    )

    def over_centres(feature: str, share: float):
        return F.percentile(feature, share).over(Window.partitionBy(*keys))

    marathon = F.col("week_hours") > F.col("_hours_q75")
    name = (
        F.when(F.col("podcast_rate") > PODCAST_WEEK_ABOVE, WEEK_PROFILES["podcasts"])
        .when(marathon & (F.col("diversity") > F.col("_diversity_q50")), WEEK_PROFILES["explorer_marathon"])
        .when(marathon, WEEK_PROFILES["loop_marathon"])
        .when(F.col("diversity") > F.col("_diversity_q75"), WEEK_PROFILES["exploration"])
        .when(F.col("skip_rate") > F.col("_skip_q75"), WEEK_PROFILES["skipping"])
        .when(F.col("week_hours") < F.col("_hours_q25"), WEEK_PROFILES["quiet"])
        .when(F.col("active_rate") < F.col("_active_q50"), WEEK_PROFILES["passive"])
        .otherwise(WEEK_PROFILES["regular"])
    )
    return centres.select(
        "*",
        over_centres("week_hours", 0.25).alias("_hours_q25"),
        over_centres("week_hours", 0.75).alias("_hours_q75"),
        over_centres("diversity", 0.5).alias("_diversity_q50"),
        over_centres("diversity", 0.75).alias("_diversity_q75"),
        over_centres("skip_rate", 0.75).alias("_skip_q75"),
        over_centres("active_rate", 0.5).alias("_active_q50"),
    ).select(*keys, "cluster", name.alias("profile"), *FEATURES)


def named_weeks(clustered: DataFrame, profiles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Weeks with cluster and profile name."""
    if not keys:
        return clustered.join(F.broadcast(profiles.select("cluster", "profile")), "cluster", "left")
    on = (*keys, "cluster")
    names = profiles.select(*[F.col(c).alias(f"_{c}") for c in on], "profile")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
    return clustered.join(names, same, "left").drop(*[f"_{c}" for c in on])


def profiles_by_year(weeks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return (
        weeks.groupBy(*keys, "year", "cluster", "profile")
        .agg(F.count("*").alias("weeks"))
        .orderBy(*keys, "year", "cluster")
    )


def weeks_by_month(weeks: DataFrame, fact: DataFrame, params: Params = Params()) -> DataFrame:
    """Weeks with their month, twice for a week that spans two."""
    keys = [*params.listener_keys, "year", "week"]
    months = dated_plays(fact).select(*keys, "month").distinct()
    return weeks.join(months, keys, "left")


def profiles_by_month(
    weeks: DataFrame, fact: DataFrame, params: Params = Params(), keys: tuple[str, ...] = ()
) -> DataFrame:
    """Weeks per month and profile; a week that spans two months counts in both."""
    return (
        weeks_by_month(weeks, fact, params)
        .filter(F.col("month").isNotNull())
        .groupBy(*keys, "month", "cluster", "profile")
        .agg(F.count("*").alias("weeks"))
        .orderBy(*keys, "month", "cluster")
    )


def rounded_profiles(profiles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return profiles.select(
        *keys, "cluster", "profile", *[half_even(F.col(f), 3).alias(f) for f in FEATURES]
    ).orderBy(*keys, "cluster")


def week_result(
    weeks: DataFrame, profiles: DataFrame, scores: DataFrame, keys: tuple[str, ...] = ()
) -> DataFrame:
    """The result document of the weekly profiles: one row, or one per value of ``keys``."""
    best = scores.groupBy(*keys).agg(half_even(F.max("silhouette"), 4).alias("silhouette_score"))
    found = rounded_profiles(profiles, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("cluster", "profile", *FEATURES))).alias("profiles"),
        F.count("*").cast("int").alias("best_k"),
    )
    counted = weeks.groupBy(*keys).agg(F.count("*").alias("weeks_analysed"))
    if keys:
        # A listener has a row in all three or in none.
        counted = counted.unionByName(best, True).unionByName(found, True).groupBy(*keys).agg(*[
            F.first(c, ignorenulls=True).alias(c) for c in ("weeks_analysed", "silhouette_score", "profiles", "best_k")
        ])
    else:
        counted = counted.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(found))
    return (
        counted
        .withColumn("model", F.lit(WEEK_MODEL))
        .withColumn("verdict", F.format_string(WEEK_VERDICT, F.col("best_k")))
    )


def weekly_tables(fact: DataFrame, params: Params = Params()) -> dict[str, DataFrame]:
    """The tables of the weekly profiles: of one listener, or of each where there are keys."""
    keys = params.listener_keys
    vectors = week_vectors(fact, params)
    found = cluster_listeners(vectors, params) if keys else cluster_weeks(vectors, params)
    if found is None or keys and found[1].isEmpty():
        return {}
    clustered, scores = found
    profiles = cluster_profiles(clustered, keys)
    weeks = named_weeks(clustered, profiles, keys)
    columns = [*keys, "year", "week", "cluster", "profile", *FEATURES]
    return {
        "week_profiles": weeks.select(*columns),
        "week_centres": rounded_profiles(profiles, keys),
        "week_silhouette": scores,
        "week_profiles_by_year": profiles_by_year(weeks, keys),
        "week_profiles_by_month": profiles_by_month(weeks, fact, params, keys),
        "week_result": week_result(weeks, profiles, scores, keys),
    }
