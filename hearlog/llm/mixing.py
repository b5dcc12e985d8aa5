"""Mixing sources to target weights by Pareto order sampling (operator 10)."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearlog.llm.common import running_total, word_count
from hearlog.session import durable


def source_targets(sized: DataFrame, source_col: str, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """Per source: ``source_size`` and ``target``, in words.

    Sources in code-point order, null last, get the weights in turn and share the size of
    the whole corpus by them. No target is above ``max_repeats`` times its source; what
    that takes away is shared again by weight among the others until none is above. So
    every target is min(limit, level * weight) for one common level. With the sources
    ordered by limit / weight, the level is the largest that some source gives which the
    sources before it leave below its own limit.

    Works on one row per source.
    """
    sources = sized.groupBy(source_col).agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col(source_col).asc_nulls_last())
    by_limit = Window.orderBy("ratio", "place")
    ahead = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sources.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(cycle, F.col("place") % len(weights)))
        .withColumn("most", F.col("source_size").cast("double") * max_repeats)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn(
            "candidate",
            (F.col("total") - F.coalesce(F.sum("most").over(ahead), F.lit(0.0))) / F.sum("weight").over(rest),
        )
        .withColumn(
            "level", F.max(F.when(F.col("candidate") <= F.col("ratio"), F.col("candidate"))).over(everything)
        )
        .select(
            F.col(source_col),
            "source_size",
            F.least(F.col("most"), F.coalesce("level", "ratio") * F.col("weight")).alias("target"),
        )
    )


def pareto_mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    max_repeats: int = 3,
    seed: int = 42,
    preference_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: ``size``, ``source_size``, ``target``, ``taken`` words.

    A document is expected target / source_size times in the mix, times its preference
    over the source's mean preference where ``preference_col`` is given (null or not
    positive: 1), at most ``max_repeats`` times. The whole part of that number are certain
    copies; its fraction is the document's inclusion probability for one more copy. These
    copies are drawn by Pareto order sampling: documents are ranked by the odds of a
    reproducible random number divided by the odds of inclusion, and taken in that order
    until the source's target is met. The sample size is fixed in words: the last document
    taken is cut to meet the target to the word. (Preferences that push documents to the
    limit of repeats can leave a source below its target.)

    Random numbers are digests of seed, id and source, so reruns agree. Null or empty
    texts have size 0 and nothing taken; null is a source of its own; rows with equal ids
    are documents of their own. Extra columns of ``docs`` are not read.

    The texts are read once, for their sizes. A source may hold any share of the rows:
    ranks are sums over ranges (``running_total``), and only rows per source are joined.
    """
    preference = F.lit(1.0)
    if preference_col is not None:
        given = F.col(preference_col).cast("double")
        preference = F.when(given > 0, given).otherwise(1.0)
    sized = durable(docs.select(
        F.col(id_col).alias("doc"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), preference.alias("preference"),
    ))
    targets = source_targets(sized, "source", weights, max_repeats).join(
        sized.groupBy(F.col("source").alias("s")).agg(
            F.try_divide(F.sum(F.col("preference") * F.col("size")), F.sum("size")).alias("mean_preference")
        ),
        F.col("source").eqNullSafe(F.col("s")),
    ).drop("s").withColumnRenamed("source", "s")
    expected = F.least(
        F.lit(float(max_repeats)),
        F.coalesce(
            F.try_divide(F.col("target"), F.col("source_size")) * F.col("preference") / F.col("mean_preference"), F.lit(0.0)
        ),
    )
    digest = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("doc").cast("string"), "source"))
    draw = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    planned = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("certain", F.floor(expected + 1e-12))
        .withColumn("chance", F.greatest(F.lit(0.0), expected - F.col("certain")))
        .withColumn("odds", draw / (1 - draw) * (1 - F.col("chance")) / F.greatest(F.col("chance"), F.lit(1e-12)))
        .withColumn("may_repeat", F.when(F.col("certain") < max_repeats, F.col("size")).otherwise(0))
    )
    ranked = running_total(planned, ["source"], ["odds", "doc", "size"], F.col("may_repeat"))
    certain = ranked.groupBy(F.col("source").alias("s")).agg(
        F.sum(F.col("certain") * F.col("size")).alias("certain_words")
    )
    left = F.round(F.col("target")).cast("long") - F.col("certain_words") - F.col("before")
    return (
        ranked.join(certain, F.col("source").eqNullSafe(F.col("s")))
        .select(
            F.col("doc").alias(id_col),
            F.col("source").alias(source_col),
            "size", "source_size", "target",
            (
                F.col("certain") * F.col("size")
                + F.greatest(F.lit(0), F.least(F.col("may_repeat"), left))
            ).cast("long").alias("taken"),
        )
    )
