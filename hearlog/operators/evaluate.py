"""Splits, fits and scores shared by the classifiers.

A tree sees a feature through its bins only, so rows alike in their bins and label are one
cell with a count. Fits and scores go over the cells, whose number the bins bound.
"""

from pyspark.ml import Model
from pyspark.ml.base import Estimator
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearlog.params import Params
from hearlog.session import at_once, durable

#: Hash buckets per class: at least so many, and enough to keep a bucket at about so many rows.
HASH_BUCKETS = 1 << 14
BUCKET_ROWS = 1_000_000
#: Bins per feature, as the trees have by default.
BINS = 32
#: Blocks of equal rows that a fit draws from, about; up to so many rows each is a block.
BLOCKS = 100_000
BLOCKS_PER_TASK = 40_000


def stratified_parts(
    rows: DataFrame, label: str, identity: str, shares: list[float], seed: int, name: str
) -> DataFrame:
    """Number the rows 0, 1, … by share, exactly so within each class, reproducibly.

    Rows of a class are ordered by a seeded hash. The position of a row is its place in
    its hash bucket plus the sizes of the buckets before, so a class of any size is
    ranked by many tasks. Only the buckets' counts are broadcast, one per million rows.
    """
    buckets = max(HASH_BUCKETS, rows.count() // BUCKET_ROWS)
    hashed = rows.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(identity))).withColumn(
        "_bucket", F.pmod("_hash", F.lit(buckets))
    )
    in_class = Window.partitionBy("_label").orderBy("_bucket")
    earlier = in_class.rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        hashed.groupBy(F.col(label).alias("_label"), F.col("_bucket").alias("_b"))
        .agg(F.count("*").alias("_n"))
        .withColumnRenamed("_b", "_bucket")
    )
    sizes = sizes.select(
        "_label",
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_label")).alias("_class_size"),
    )
    in_bucket = Window.partitionBy(label, "_bucket").orderBy("_hash", identity)
    placed = (
        hashed.withColumn("_row", F.row_number().over(in_bucket))
        .join(
            F.broadcast(sizes),
            (F.col(label) == F.col("_label")) & (F.col("_bucket") == F.col("_b")),
        )
        .withColumn("_place", (F.col("_before") + F.col("_row") - 0.5) / F.col("_class_size"))
    )
    part, border = F.lit(len(shares) - 1), sum(shares[:-1])
    for index in range(len(shares) - 2, -1, -1):
        part = F.when(F.col("_place") <= border, index).otherwise(part)
        border -= shares[index]
    return placed.withColumn(name, part).drop(
        "_hash", "_bucket", "_row", "_label", "_b", "_before", "_class_size", "_place"
    )


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """Weights that give every class the same total, whatever its size."""
    sizes = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    everything = Window.partitionBy()
    weights = sizes.select(
        "_label",
        (F.sum("_n").over(everything) / (F.count("*").over(everything) * F.col("_n"))).alias("weight"),
    )
    return rows.join(F.broadcast(weights), F.col(label) == F.col("_label")).drop("_label")


def assemble(rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Feature vector, nulls as 0, beside the columns to keep."""
    filled = rows.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    assembler = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="features")
    return assembler.transform(filled).select(*keep, "features")


def bin_borders(rows: DataFrame, width: int, bins: int = BINS) -> list[list[float]]:
    """Per feature the upper borders of its bins, the largest value last.

    Up to ``bins`` distinct values have a bin each. Of more, a value that fills bins has one
    of its own, and the others share the rest evenly.
    """
    values = rows.select(vector_to_array("features").alias("v"))
    item = [F.get("v", F.lit(i)) for i in range(width)]
    shares = [i / bins for i in range(1, bins)]
    seen = values.agg(*[c for i, x in enumerate(item) for c in (
        F.percentile_approx(x, shares, 10_000).alias(f"cuts_{i}"), F.max(x).alias(f"max_{i}"),
        F.approx_count_distinct(x, 0.02).alias(f"distinct_{i}"),
    )]).first()
    full, wanted = {}, [F.count("*")]
    for i, x in enumerate(item):
        if seen[f"distinct_{i}"] <= bins * 5 // 4:
            wanted.append(F.collect_set(x).alias(f"set_{i}"))
        cuts = seen[f"cuts_{i}"]
        full[i] = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
        left = bins - 1 - 2 * len(full[i])
        if full[i]:
            rest = F.when(~x.isin(full[i]), x)
            wanted.append(F.percentile_approx(rest, [j / (left + 1) for j in range(1, left + 1)], 10_000).alias(f"rest_{i}"))
            wanted += [F.max(F.when(x < v, x)).alias(f"below_{i}_{at}") for at, v in enumerate(full[i])]
    more = values.agg(*wanted).first().asDict()
    borders = []
    for i in range(width):
        own = more.get(f"set_{i}")
        if own is None or len(own) > bins:
            own = seen[f"cuts_{i}"]
            if full[i]:
                below = [more[f"below_{i}_{at}"] for at in range(len(full[i]))]
                own = [*full[i], *(more[f"rest_{i}"] or []), *[b for b in below if b is not None]]
            own = [*own, seen[f"max_{i}"]]
        borders.append(sorted(set(own)))
    return borders


def binned(value: Column, borders: list[float]) -> Column:
    """The upper border of the bin that ``value`` is in, found by halving."""
    if len(borders) == 1:
        return F.lit(borders[0])
    middle = len(borders) // 2
    return F.when(value <= borders[middle - 1], binned(value, borders[:middle])).otherwise(binned(value, borders[middle:]))


def cells(rows: DataFrame, folds: int) -> DataFrame:
    """Rows with equal label, weight and bins as one row: ``features`` (the bins' borders) and
    how many rows of each part and fold there are."""
    width = len(rows.select("features").first()[0])
    borders = bin_borders(rows, width)
    own = ["label", *(["weight"] if "weight" in rows.columns else [])]
    names = [f"_b{i}" for i in range(width)]
    values = rows.withColumn("_v", vector_to_array("features"))
    shown = values.select(*own, "part", "fold", *[binned(F.get("_v", F.lit(i)), borders[i]).alias(n) for i, n in enumerate(names)])
    counted = shown.groupBy(*own, *names).agg(
        *[F.count_if(F.col("part") == part).alias(f"part_{part}") for part in (0, 1)],
        *[F.count_if(F.col("fold") == fold).alias(f"fold_{fold}") for fold in range(folds)],
    )
    return durable(VectorAssembler(inputCols=names, outputCol="features").transform(counted).drop(*names))


def blocks(found: DataFrame, count: Column, most: int) -> DataFrame:
    """``count`` rows of each cell as blocks of at most ``most`` equal rows, with ``rows_weight``.

    Draws of a fit (bootstraps, subsamples) take a block as they would a row.
    """
    number = F.ceil(count / most)
    weight = count / number * (F.col("weight") if "weight" in found.columns else F.lit(1.0))
    parts = found.filter(count > 0).select(
        F.col("label"), "features", weight.alias("rows_weight"), F.explode(F.sequence(F.lit(1), number)).alias("_block")
    )
    tasks = max(1, parts.count() // BLOCKS_PER_TASK)
    order = ["label", "_hash", "_block"]
    dealt = parts.withColumn("_hash", F.xxhash64(F.array_join(vector_to_array("features"), ",")))
    return dealt.repartition(tasks, *order).sortWithinPartitions(*order).select("label", "features", "rows_weight")


def accuracy_and_f1(predicted: DataFrame, count: str | None = None) -> tuple[float, float]:
    """Of rows, or of rows that stand for ``count`` each."""
    settings = {"weightCol": count} if count else {}
    return tuple(
        MulticlassClassificationEvaluator(labelCol="label", metricName=metric, **settings).evaluate(predicted)
        for metric in ("accuracy", "f1")
    )


def fitted_on(estimator: Estimator, found: DataFrame, count: Column, most: int) -> Model:
    """The model of ``count`` rows of each cell."""
    rows = blocks(found, count, most).persist()
    model = estimator.copy({estimator.weightCol: "rows_weight"}).fit(rows)
    rows.unpersist()
    return model


def scored_on(model: Model, found: DataFrame, count: Column) -> DataFrame:
    """Cells with their prediction and ``plays``, the ``count`` rows they stand for."""
    return model.transform(found.withColumn("plays", count.cast("double")).filter("plays > 0"))


def confusion(predicted: DataFrame, count: str | None = None) -> DataFrame:
    """Actual by predicted counts, all four cells present; of ``count`` rows each, if given."""
    spark = predicted.sparkSession
    four = spark.range(4).select(
        F.floor(F.col("id") / 2).cast("int").alias("actual"), (F.col("id") % 2).cast("int").alias("predicted")
    )
    counts = predicted.groupBy(
        F.col("label").cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted")
    ).agg((F.sum(count).cast("bigint") if count else F.count("*")).alias("plays"))
    return four.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("plays", F.lit(0)).alias("plays")
    )


def confusion_matrix(cells: DataFrame) -> DataFrame:
    """One row: the cells as a nested array, rows actual, columns predicted."""
    return (
        cells.groupBy("actual")
        .agg(F.array_sort(F.collect_list(F.struct("predicted", "plays"))).alias("_row"))
        .agg(F.array_sort(F.collect_list(F.struct("actual", F.col("_row.plays").alias("row")))).alias("_all"))
        .select(F.col("_all.row").alias("confusion_matrix"))
    )


def importances(model: Model, features: list[str], spark) -> DataFrame:
    """One row per feature, most important first."""
    values = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(values, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def train_and_score(
    estimator: Estimator, rows: DataFrame, params: Params
) -> tuple[Model, DataFrame, dict[str, float]]:
    """Fit on part 0, score on part 1, cross-validate on everything.

    Returns the model, the four counts of its confusion matrix and the scores. All rows count
    in every fit. Beyond ``BLOCKS`` rows, equal ones are drawn in blocks of some.
    """
    found = cells(rows, params.folds)
    folds = [F.col(f"fold_{fold}") for fold in range(params.folds)]
    everything = sum(folds[1:], folds[0])
    size = found.agg(F.sum(everything)).first()[0]
    most = max(1, -(-size // BLOCKS))

    def whole():
        model = fitted_on(estimator, found, F.col("part_0"), most)
        predicted = scored_on(model, found, F.col("part_1"))
        counts = [(r["actual"], r["predicted"], r["plays"]) for r in confusion(predicted, "plays").collect()]
        return model, counts, accuracy_and_f1(predicted, "plays")

    def score(fold: Column):
        def run() -> float:
            model = fitted_on(estimator, found, everything - fold, most)
            return accuracy_and_f1(scored_on(model, found, fold), "plays")[1]

        return run

    tasks = [whole, *[score(fold) for fold in folds]]
    (model, counts, (accuracy, f1)), *held_out = at_once(rows.sparkSession, tasks, params.parallel_fits)
    mean = sum(held_out) / params.folds
    std = (sum((s - mean) ** 2 for s in held_out) / params.folds) ** 0.5
    matrix = rows.sparkSession.createDataFrame(counts, "actual int, predicted int, plays bigint")
    scores = {"accuracy": accuracy, "f1_weighted": f1, "cv_f1_mean": mean, "cv_f1_std": std}
    return model, matrix, {k: round(v, 4) for k, v in scores.items()}
