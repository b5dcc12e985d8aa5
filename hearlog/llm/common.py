"""What several text operators share: word counts, distributed ranks, blocks of documents."""

import ctypes
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearlog.session import durable

WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one block of documents holds, unless a single document is longer.
BLOCK_BYTES = 16 << 20


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the controls 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts: Column | int | str) -> Column:
    """A reproducible number strictly between 0 and 1 from a 52-bit digest."""
    columns = [part if isinstance(part, Column) else F.lit(part) for part in parts]
    bits = F.xxhash64(*columns).bitwiseAND(F.lit((1 << 52) - 1))
    return (bits.cast("double") + 0.5) / float(1 << 52)


def running_total(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows ahead in the group.

    A group may hold any share of the rows: ranges of (groups, order) are summed on their
    own, and each range gets the total of the group's earlier ranges. Groups compare
    null-safe. Rows that are equal in ``groups`` and ``order`` follow in any order.
    """
    ranged = durable(
        df.withColumn("_value", value)
        .repartitionByRange(*[F.col(c) for c in (*groups, *order)])
        .withColumn("_range", F.spark_partition_id())
    )
    ahead = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        ranged.groupBy(*groups, "_range").agg(F.sum("_value").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
        .select(*[F.col(c).alias(f"_g_{c}") for c in groups], F.col("_range").alias("_r"), "_offset")
    )
    same = F.col("_range") == F.col("_r")
    for c in groups:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    inside = (
        Window.partitionBy("_range", *groups).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(ranges, same)
        .withColumn("before", F.col("_offset") + F.col("_inside"))
        .select(*df.columns, "before")
    )


def record_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows from tuples in the order of ``schema``.

    After the last one the task gives its memory back (see ``trimmed``).
    """
    batch: list[tuple] = []
    for row in rows:
        batch.append(row)
        if len(batch) >= size:
            yield _batch(batch, schema)
            batch = []
    if batch:
        yield _batch(batch, schema)
    trimmed(None)


def trimmed[T](result: T) -> T:
    """``result``, after memory that this process holds but no longer uses went to the system.

    Spark keeps a task's Python worker for later tasks and stages. What the allocators keep
    of its largest task would count against the executor all that time.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
    return result


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.record_batch(
        [pa.array(column, type=field.type) for column, field in zip(columns, schema, strict=True)],
        schema=schema,
    )
