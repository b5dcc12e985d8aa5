"""Reading and writing of tables and of the small result documents beside them."""

import contextlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace a Parquet table.

    Partitioned tables get rows of one partition together before the write, in pieces
    whose size the adaptive rebalance picks, so a partition that holds a third of the
    rows is written by many tasks and a small one makes one file.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    (
        df.hint("rebalance", *[F.col(c) for c in partition_by])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    with contextlib.suppress(AnalysisException):
        return spark.read.parquet(path)
    return None


def write_document(row: DataFrame, path: str) -> None:
    """Write a one-row result as a JSON document."""
    row.coalesce(1).write.mode("overwrite").json(path)


def layer_document(
    spark: SparkSession, layer: str, location: str, total_records: int, tables: list[str]
) -> DataFrame:
    """One row that says what a layer run wrote."""
    return spark.range(1).select(
        F.lit(layer).alias("layer"),
        F.lit(location).alias("location"),
        F.lit(total_records).cast("bigint").alias("total_records"),
        F.current_timestamp().alias("written_at"),
        F.array(*[F.lit(t) for t in tables]).alias("tables"),
    )


def model_input(fact: DataFrame) -> DataFrame:
    """The play table as models read it: numbers coerced, missing flags false."""
    numbers = {"hour": "int", "weekday": "int", "month": "int", "year": "int", "ms_played": "bigint"}
    flags = ["shuffle", "skipped", "offline"]
    changes = {c: F.expr(f"try_cast(`{c}` AS {kind})") for c, kind in numbers.items() if c in fact.columns}
    changes |= {c: F.coalesce(F.col(c), F.lit(False)) for c in flags if c in fact.columns}
    return fact.withColumns(changes)
