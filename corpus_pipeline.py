"""A training-data pipeline over ``documents``: STAGES, run() and its SQL, where SQL can say it.

Every stage takes the documents its predecessor kept. Documents are matched with an
operator's result by id, null ids included; what the result says of the text (digest,
length) is compared as well, so that rows which share an id are told apart. The names of
the columns that a stage adds meanwhile are drawn, so all columns of documents come through.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearlog.llm import queries
from hearlog.llm.decontaminate import leaks
from hearlog.llm.exact import content_sort
from hearlog.llm.mixing import pareto_mix
from hearlog.llm.quality import judge
from hearlog.llm.shingles import near_copies
from hearlog.session import durable

#: Rows that go up to which they are sent to every executor (about 100 bytes each); beyond
#: it, the documents are shuffled to them.
BROADCAST_ROWS = 500_000


def _digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def _matched(docs: DataFrame, rows: DataFrame, keys: list[Column], how: str) -> DataFrame:
    """``docs`` joined ``how`` with ``rows``, whose columns equal ``keys`` of ``docs`` null-safe."""
    rows = durable(rows.toDF(*[f"_{uuid.uuid4().hex}" for _ in keys]).distinct())
    same = F.lit(True)
    for key, column in zip(keys, rows.columns, strict=True):
        same = same & key.eqNullSafe(F.col(column))
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, same, how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of trusted text rejects go."""
    judged = judge(docs, queries.trusted(spark, sf_dir))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    gone = judged.where("NOT kept").select("doc_id", "lang", F.col("bytes").cast("long"))
    return _matched(docs, gone, [F.col("doc_id"), F.col("lang"), size], "left_anti")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the largest id, repeated rows once."""
    marks = durable(
        content_sort(docs, keep="largest").groupBy("doc_id", "text_sha256")
        .agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
    )
    keys = [F.col("doc_id"), _digest()]
    single = _matched(docs, marks.where("NOT stays OR rows > 1").select("doc_id", "text_sha256"), keys, "left_anti")
    repeated = _matched(docs, marks.where("stays AND rows > 1").select("doc_id", "text_sha256"), keys, "left_semi")
    turn = f"_{uuid.uuid4().hex}"
    first = Window.partitionBy(*keys).orderBy(F.to_json(F.struct(*docs.columns)))
    return single.union(repeated.withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1).drop(turn))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near copies, directly or over others, the smallest id stays.

    Near are five-word shingles of Jaccard similarity 0.8 or more, and what SimHash links.
    """
    gone = near_copies(docs).where("NOT kept").select("doc_id", "text_sha256")
    return _matched(docs, gone, [F.col("doc_id"), _digest()], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    gone = leaks(docs, queries.table(spark, sf_dir, "benchmark")).select("doc", "text_sha256")
    return _matched(docs, gone, [F.col("doc_id"), _digest()], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return pareto_mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
]

#: The quality model and the fingerprints cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries.with_shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
