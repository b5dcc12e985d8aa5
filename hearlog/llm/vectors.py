"""Vectors in tasks: matrices from array columns, integer components, blocks of vectors."""

import hashlib
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components saturate here, so that squared distances of a few hundred components
#: fit 64 bits. Components below 2^18 in size are exact.
LARGEST = 1 << 26

#: Vectors that a task holds and compares at a time.
BLOCK = 8192

#: Groups (labels, clusters) up to which their totals are sent to every executor.
BROADCAST_GROUPS = 1_000_000


def matrix(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and components of the arrays that have ``size`` finite components, none null."""
    offsets = column.offsets.to_numpy()
    present = column.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(present & (np.diff(offsets) == size))
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = values[offsets[at][:, None] + np.arange(size)] if len(at) else np.empty((0, size))
    finite = np.isfinite(rows).all(axis=1)
    return at[finite], rows[finite]


def scaled(rows: np.ndarray, scale: int) -> np.ndarray:
    """Components as integers floor(scale * x)."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * rows), -LARGEST, LARGEST).astype(np.int64)


def finite(vector: Column) -> Column:
    """Whether an array column has components, all of them finite."""
    def number(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce((F.size(vector) > 0) & F.forall(vector.cast("array<double>"), number), F.lit(False))


def blocks(batches: Iterable[pa.RecordBatch], size: int, scale: int, block: int) -> Iterator[tuple]:
    """(columns before the vectors as a table, integer components) of up to ``block`` rows.

    The vectors are the last column; rows whose vector has not ``size`` finite components
    are left out.
    """
    tables, parts, held = [], [], 0
    for batch in batches:
        at, rows = matrix(batch.column(batch.num_columns - 1), size)
        rest = pa.Table.from_batches([batch.select(batch.schema.names[:-1])]).take(pa.array(at))
        whole = scaled(rows, scale)
        while held + len(whole) >= block:
            cut = block - held
            yield pa.concat_tables([*tables, rest.slice(0, cut)]), np.concatenate([*parts, whole[:cut]])
            rest, whole, tables, parts, held = rest.slice(cut), whole[cut:], [], [], 0
        if len(whole):
            tables.append(rest)
            parts.append(whole)
            held += len(whole)
    if held:
        yield pa.concat_tables(tables), np.concatenate(parts)


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one piece of bytes."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
        return {name: arrays[name] for name in arrays.files}


def digest(components: np.ndarray) -> str:
    """SHA-256 of integers in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, components.ravel().tolist())).encode()).hexdigest()


def summed(partial: DataFrame, groups: list[str]) -> list[tuple]:
    """Rows ``(*groups, sum, n)`` of totals over ``partial(*groups, sum, n)``, exact at any size.

    For a number of groups that is a parameter's (centres times components).
    """
    exact = partial.groupBy(*groups).agg(
        F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n")
    )
    return [tuple(map(int, row)) for row in exact.collect()]


def total(column: str) -> Column:
    """A sum of longs that stops at the largest long."""
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit((1 << 63) - 1)).cast("long")


def with_total(df: DataFrame, group: str, column: str, name: str, limit: int = BROADCAST_GROUPS) -> DataFrame:
    """``df`` with ``name``: the sum of ``column`` over the rows of equal ``group``, nulls together."""
    totals = df.groupBy(F.col(group).alias("_group")).agg(total(column).alias(name))
    if totals.count() <= limit:
        totals = F.broadcast(totals)
    return df.join(totals, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
