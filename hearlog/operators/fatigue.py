"""When music gets skipped: position and time in the session, hour, shuffle, origin."""

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearlog.functions.calendar import literal_map
from hearlog.functions.rounding import half_even
from hearlog.operators.evaluate import (
    assemble,
    confusion_matrix,
    importances,
    stratified_parts,
    train_and_score,
)
from hearlog.operators.sequence import skip_context
from hearlog.params import Params
from hearlog.session import durable
from hearlog.vocabulary import (
    ORIGIN_NAMES,
    SHUFFLE_NAMES,
    SKIP_GOAL,
    SKIP_MODEL,
    SKIP_VERDICT_OTHER,
    SKIP_VERDICTS,
)

FEATURES = ["position", "minutes_before", "skips_before", "hour", "weekday", "shuffle_on",
            "active", "month"]


def _skip_by(context: DataFrame, params: Params, key: str) -> DataFrame:
    return context.groupBy(*params.listener_keys, key).agg(
        F.avg("skip").alias("skip_rate"), F.count("*").alias("plays")
    )


def skip_by_position(context: DataFrame, params: Params = Params()) -> DataFrame:
    """Positions with enough plays, the first of them; a listener's own where there are keys."""
    keys = params.listener_keys
    found = _skip_by(context, params, "position").filter(F.col("plays") >= params.min_bucket_plays)
    if not keys:
        return found.orderBy("position").limit(params.top_positions)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    return found.withColumn("_place", place).filter(F.col("_place") <= params.top_positions).drop("_place")


def skip_by_minutes(context: DataFrame, params: Params = Params()) -> DataFrame:
    return (
        _skip_by(context, params, "minute_bucket")
        .filter(F.col("plays") >= params.min_bucket_plays)
        .orderBy(*params.listener_keys, "minute_bucket")
    )


def skip_by_hour(context: DataFrame, params: Params = Params()) -> DataFrame:
    return _skip_by(context, params, "hour").orderBy(*params.listener_keys, "hour")


def skip_by_shuffle(context: DataFrame, params: Params = Params()) -> DataFrame:
    name = F.try_element_at(literal_map(SHUFFLE_NAMES), F.col("shuffle_on"))
    return _skip_by(context, params, "shuffle_on").withColumn("mode", name).orderBy(*params.listener_keys, "shuffle_on")


def skip_by_origin(context: DataFrame, params: Params = Params()) -> DataFrame:
    name = F.try_element_at(literal_map(ORIGIN_NAMES), F.col("active"))
    return _skip_by(context, params, "active").withColumn("origin_name", name).orderBy(*params.listener_keys, "active")


def skip_rates(context: DataFrame, params: Params = Params()) -> DataFrame:
    def rate(condition: Column) -> Column:
        return half_even(F.avg(F.when(condition, F.col("skip"))), 4)

    return context.groupBy(*params.listener_keys).agg(
        half_even(F.avg("skip"), 4).alias("skip_rate"),
        rate(F.col("shuffle_on") == 1).alias("skip_rate_shuffle_on"),
        rate(F.col("shuffle_on") == 0).alias("skip_rate_shuffle_off"),
        rate(F.col("active") == 1).alias("skip_rate_active"),
        rate(F.col("active") == 0).alias("skip_rate_recommender"),
    )


def training_rows(context: DataFrame, params: Params = Params()) -> DataFrame:
    rows = durable(assemble(
        context.withColumn("label", F.col("skip")).withColumn("identity", F.col("play_id")),
        FEATURES,
        ["label", "identity"],
    ))
    rows = stratified_parts(
        rows, "label", "identity", [1 - params.test_share, params.test_share], params.seed, "part"
    )
    return stratified_parts(
        rows, "label", "identity", [1 / params.folds] * params.folds, params.seed + 1, "fold"
    )


def boosting(params: Params = Params()) -> GBTClassifier:
    """Boosted trees; checkpoints keep the lineage of the running residuals short."""
    return GBTClassifier(
        maxIter=params.boost_rounds,
        maxDepth=params.boost_depth,
        stepSize=params.boost_rate,
        subsamplingRate=params.boost_subsample,
        checkpointInterval=10,
        cacheNodeIds=False,
        seed=params.seed,
    )


def top_feature_verdict(ranked: DataFrame) -> DataFrame:
    """The most important feature and what it says about the listener."""
    top = ranked.orderBy(F.desc("importance"), "feature").limit(1)
    known = F.try_element_at(literal_map(SKIP_VERDICTS), F.col("feature"))
    other = F.format_string(SKIP_VERDICT_OTHER, F.col("feature"))
    return top.select(F.col("feature").alias("top_feature"), F.coalesce(known, other).alias("verdict"))


def fit_skip_model(
    context: DataFrame, params: Params = Params()
) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Importances, confusion cells and scores of the boosted trees; None with too little data."""
    counts = context.groupBy("skip").agg(F.count("*").alias("n")).collect()  # two rows at most
    size = sum(r["n"] for r in counts)
    if len(counts) < 2 or size < params.min_model_rows:
        return None
    model, cells, scores = train_and_score(boosting(params), durable(training_rows(context, params)), params)
    spark = context.sparkSession
    score_row = spark.createDataFrame(
        [tuple(scores.values())], ", ".join(f"{k} double" for k in scores)
    )
    return importances(model, FEATURES, spark), cells, score_row


def skip_result(
    context: DataFrame, fitted: tuple[DataFrame, DataFrame, DataFrame]
) -> DataFrame:
    """One-row result document of the skip model."""
    ranked, cells, scores = fitted
    row = skip_rates(context)
    for part in (scores, confusion_matrix(cells), top_feature_verdict(ranked)):
        row = row.crossJoin(F.broadcast(part))
    return row.withColumns({
        "model": F.lit(SKIP_MODEL),
        "goal": F.lit(SKIP_GOAL),
        "feature_names": F.array(*[F.lit(f) for f in FEATURES]),
    })


def fatigue_tables(fact: DataFrame, params: Params = Params()) -> dict[str, DataFrame]:
    context = skip_context(fact, params)
    fitted = fit_skip_model(context, params)
    if fitted is None:
        return {}
    return {
        "skip_by_position": skip_by_position(context, params),
        "skip_by_minutes": skip_by_minutes(context, params),
        "skip_by_hour": skip_by_hour(context, params),
        "skip_by_shuffle": skip_by_shuffle(context, params),
        "skip_by_origin": skip_by_origin(context, params),
        "skip_importance": fitted[0],
        "skip_confusion": fitted[1],
        "skip_result": skip_result(context, fitted),
    }
