"""Own choice against recommender: how music the listener picked compares with music
that was put on for them. Groups without a key are left out of these tables."""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearlog.functions import labels
from hearlog.functions.calendar import literal_map
from hearlog.functions.rounding import MS_PER_HOUR, half_even, ratio
from hearlog.operators.evaluate import (
    assemble,
    balanced_weights,
    confusion_matrix,
    importances,
    stratified_parts,
    train_and_score,
)
from hearlog.params import Params
from hearlog.session import durable
from hearlog.vocabulary import (
    ALIKE_BELOW_ACCURACY,
    ORIGIN_MODEL,
    ORIGIN_NAMES,
    ORIGIN_NAMES_SHORT,
    ORIGIN_VERDICTS,
    OWN_PICKS_ABOVE_GAP,
)

FEATURES = ["ms_played", "complete", "skip", "hour", "weekday", "shuffle_on"]


def origin_plays(fact: DataFrame, params: Params = Params()) -> DataFrame:
    """Music plays whose start reason tells their origin."""
    origin = labels.origin(F.col("reason_start"))
    return fact.filter(
        (F.col("content_type") == "music") & F.col("ms_played").isNotNull() & origin.isNotNull()
    ).withColumns({
        "origin": origin,
        "complete": labels.is_complete(F.col("ms_played"), params.complete_ms),
        "skip": labels.flag(F.col("skipped")),
        "shuffle_on": labels.flag(F.col("shuffle")),
    })


def origin_cube(plays: DataFrame, params: Params = Params()) -> DataFrame:
    """Counts and sums per origin, month and artist. The tables below read the plays or this
    pre-aggregate, which one scan makes for all of them; only ``diversity`` needs the plays."""
    return plays.groupBy(*params.listener_keys, "origin", "year", "month", "artist_name").agg(
        F.count("*").alias("plays"),
        F.sum("complete").alias("complete_plays"),
        F.sum("skip").alias("skips"),
        F.sum("ms_played").alias("ms_total"),
    )


def _count(df: DataFrame) -> Column:
    return F.sum("plays") if "plays" in df.columns else F.count(F.lit(1))


def _mean(df: DataFrame, column: str, total: str | None = None) -> Column:
    """The mean over plays, of a value per play or of totals (of the value itself by default)."""
    if "plays" not in df.columns:
        return F.avg(column)
    return F.try_divide(F.sum(total) if total else F.sum(F.col(column) * F.col("plays")), F.sum("plays"))


def comparison(plays: DataFrame, params: Params = Params()) -> DataFrame:
    listened = F.sum("ms_total" if "ms_total" in plays.columns else "ms_played")
    return (
        plays.groupBy(*params.listener_keys, "origin")
        .agg(
            _count(plays).alias("plays"),
            half_even(_mean(plays, "complete", "complete_plays"), 3).alias("complete_rate"),
            half_even(_mean(plays, "skip", "skips"), 3).alias("skip_rate"),
            half_even(_mean(plays, "ms_played", "ms_total"), 0).alias("mean_ms"),
            half_even(ratio(listened, MS_PER_HOUR), 2).alias("hours"),
        )
        .withColumn("origin_name", F.try_element_at(literal_map(ORIGIN_NAMES), F.col("origin")))
        .orderBy(*params.listener_keys, "origin")
    )


def diversity(plays: DataFrame, params: Params = Params()) -> DataFrame:
    """Plays per different track, for both origins even when one has no plays."""
    spark, keys = plays.sparkSession, list(params.listener_keys)
    origins = spark.range(2).select(
        F.col("id").cast("int").alias("origin"),
        F.try_element_at(literal_map(ORIGIN_NAMES_SHORT), F.col("id").cast("int")).alias("origin_name"),
    )
    if keys:  # one row per listener and origin
        origins = plays.select(*keys).distinct().crossJoin(F.broadcast(origins))
    counts = plays.groupBy(*[F.col(k).alias(f"_own_{k}") for k in keys], F.col("origin").alias("_origin")).agg(
        F.countDistinct("track_uri").alias("unique_tracks"), F.count("*").alias("plays")
    )
    same = F.col("origin") == F.col("_origin")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_own_{key}"))
    filled = origins.join(counts, same, "left").fillna(0, ["unique_tracks", "plays"])
    repeats = F.col("plays") / F.greatest(F.col("unique_tracks"), F.lit(1))
    return filled.select(
        *keys, "origin_name", "unique_tracks", "plays", half_even(repeats, 2).alias("repeat_ratio")
    )


def trend(plays: DataFrame, params: Params = Params()) -> DataFrame:
    return (
        plays.filter(F.col("year").isNotNull() & F.col("month").isNotNull())
        .groupBy(*params.listener_keys, "year", "month")
        .agg(half_even(_mean(plays, "origin"), 3).alias("active_share"), _count(plays).alias("plays"))
        .orderBy(*params.listener_keys, "year", "month")
    )


def artists_by_origin(plays: DataFrame, params: Params = Params()) -> DataFrame:
    """Artists heard most through the recommender."""
    counts = (
        plays.filter(F.col("artist_name").isNotNull())
        .groupBy(*params.listener_keys, "artist_name")
        .pivot("origin", [0, 1])
        .agg(_count(plays))
        .select(
            *params.listener_keys,
            "artist_name",
            F.coalesce("0", F.lit(0)).alias("via_recommender"),
            F.coalesce("1", F.lit(0)).alias("via_active"),
        )
        .withColumn("plays", F.col("via_recommender") + F.col("via_active"))
    )
    share = half_even(F.col("via_recommender") / F.col("plays"), 3)
    found = counts.filter(F.col("plays") >= params.min_artist_plays).withColumn("recommender_share", share)
    order = [F.desc("recommender_share"), F.desc("plays"), "artist_name"]
    if not params.listener_keys:
        return found.orderBy(*order).limit(params.top_artists)
    place = F.row_number().over(Window.partitionBy(*params.listener_keys).orderBy(*order))
    return found.withColumn("_place", place).filter(F.col("_place") <= params.top_artists).drop("_place")


def shares(plays: DataFrame, params: Params = Params()) -> DataFrame:
    mean = _mean(plays, "origin")
    return plays.groupBy(*params.listener_keys).agg(
        half_even(mean, 4).alias("active_share"),
        half_even(1 - mean, 4).alias("recommender_share"),
        F.coalesce(_count(plays), F.lit(0)).alias("plays"),
    )


def training_rows(plays: DataFrame, params: Params = Params()) -> DataFrame:
    """Feature vectors with label, class weight, train/test part and fold.

    The vectors are written down before they are counted and split, so the plays are
    scanned once.
    """
    rows = durable(assemble(
        plays.withColumn("label", F.col("origin")).withColumn("identity", F.col("play_id")),
        FEATURES,
        ["label", "identity"],
    ))
    rows = balanced_weights(rows, "label")
    rows = stratified_parts(
        rows, "label", "identity", [1 - params.test_share, params.test_share], params.seed, "part"
    )
    return stratified_parts(
        rows, "label", "identity", [1 / params.folds] * params.folds, params.seed + 1, "fold"
    )


def forest(params: Params = Params()) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=params.forest_trees,
        maxDepth=params.forest_depth,
        weightCol="weight",
        seed=params.seed,
    )


def verdict(scores: DataFrame, compared: DataFrame) -> DataFrame:
    """Text for the analyst, from the accuracy and the gap between complete rates."""
    gap = compared.agg(
        F.abs(
            F.max(F.when(F.col("origin") == 1, F.col("complete_rate")))
            - F.max(F.when(F.col("origin") == 0, F.col("complete_rate")))
        ).alias("_gap")
    )
    text = (
        F.when(F.col("accuracy") < ALIKE_BELOW_ACCURACY, ORIGIN_VERDICTS["alike"])
        .when(F.col("_gap") > OWN_PICKS_ABOVE_GAP, ORIGIN_VERDICTS["own_picks"])
        .otherwise(ORIGIN_VERDICTS["context"])
    )
    return scores.crossJoin(F.broadcast(gap)).withColumn("verdict", text).drop("_gap")


def fit_origin_model(
    plays: DataFrame, params: Params = Params()
) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Importances, confusion cells and scores of the forest; None with too little data."""
    counts = plays.groupBy("origin").agg(F.count("*").alias("n")).collect()  # two rows at most
    size = sum(r["n"] for r in counts)
    if len(counts) < 2 or size < params.min_model_rows:
        return None
    model, cells, scores = train_and_score(forest(params), durable(training_rows(plays, params)), params)
    spark = plays.sparkSession
    score_row = spark.createDataFrame(
        [tuple(scores.values())], ", ".join(f"{k} double" for k in scores)
    )
    return importances(model, FEATURES, spark), cells, score_row


def origin_result(
    plays: DataFrame,
    compared: DataFrame,
    fitted: tuple[DataFrame, DataFrame, DataFrame] | None,
) -> DataFrame:
    """One-row result document; model fields only when a model was fitted."""
    row = shares(plays).withColumn("model", F.lit(ORIGIN_MODEL))
    if fitted is None:
        return row
    _, cells, scores = fitted
    model_part = verdict(scores, compared).crossJoin(F.broadcast(confusion_matrix(cells)))
    return row.crossJoin(F.broadcast(model_part)).withColumn(
        "feature_names", F.array(*[F.lit(f) for f in FEATURES])
    )


def origin_tables(fact: DataFrame, params: Params = Params()) -> dict[str, DataFrame]:
    plays = origin_plays(fact, params)
    cube = durable(origin_cube(plays, params))
    compared = comparison(cube)
    fitted = fit_origin_model(plays, params)
    tables = {
        "origin_comparison": comparison(cube, params) if params.listener_keys else compared,
        "origin_diversity": diversity(plays, params),
        "origin_trend": trend(cube, params),
        "origin_artists": artists_by_origin(cube, params),
        "origin_result": origin_result(cube, compared, fitted),
    }
    if fitted is not None:
        tables["origin_importance"] = fitted[0]
        tables["origin_confusion"] = fitted[1]
    return tables
