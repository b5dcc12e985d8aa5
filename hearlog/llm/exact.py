"""Exact duplicates by sorting the content (operator 9).

Sampled splitters cut the normalised bytes into ranges, an external sort puts equal texts
next to each other, and each row is compared with its neighbour.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearlog.session import durable

#: Bytes of a text that a sampled splitter holds; texts that open alike are split by digest.
SPLITTER_BYTES = 32

#: Pieces that one text's copies are cut into, so that no task gets them all.
PIECES = 64


def content_sort(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
) -> DataFrame:
    """One row per document: ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``normalise`` maps the text column to the text that is compared (default: no change);
    null counts as the empty text. Of equal texts the row with the ``smallest`` (or
    ``largest``) id is kept; where that id itself repeats, one of its rows. A null id ranks
    as the smallest and is kept only if the whole group has no other. Other columns of
    ``docs`` are not read. An empty table gives no rows.

    The ranges are cut on (opening bytes, digest, piece), so that the sample of splitters,
    which passes through the driver, holds no whole texts. A piece is a share of one text's
    copies, so a text that a third of all rows hold is spread over tasks. Within a range
    the whole texts are sorted and compared. Every piece ends in one row
    that knows the piece's size and its kept candidate; only these rows, which have a
    digest in place of the text, are aggregated over the pieces and joined back. The text
    moves once.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is {keep!r}; it has to be smallest or largest")
    text = F.coalesce(F.col(text_col), F.lit(""))
    if normalise is not None:
        text = F.coalesce(normalise(text), F.lit(""))
    best_first = F.col("doc").desc_nulls_last() if keep == "largest" else F.col("doc").asc_nulls_last()
    ranged = docs.select(
        F.col(id_col).alias("doc"),
        text.alias("content"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(PIECES)).cast("int").alias("piece"),
    ).withColumns({
        "opening": F.substring(F.col("content").cast("binary"), 1, SPLITTER_BYTES),
        "text_sha256": F.sha2(F.col("content").cast("binary"), 256),
    }).repartitionByRange("opening", "text_sha256", "piece")
    run = Window.partitionBy("opening", "text_sha256", "piece", "content").orderBy(best_first)
    sorted_rows = durable(
        ranged.select(
            "doc", "piece",
            F.row_number().over(run).alias("place"),
            F.lead(F.lit(False), 1, True).over(run).alias("last"),
            "text_sha256",
        )
    )
    candidate = F.struct(
        F.col("doc").isNull().alias("no_id"),
        (-F.col("doc") if keep == "largest" else F.col("doc")).alias("rank"),
    )
    # A table of its own, so that the join below can split the rows of a hot text.
    pieces = durable(sorted_rows.groupBy("text_sha256").agg(
        F.sum(F.when(F.col("last"), F.col("place"))).cast("long").alias("group_size"),
        F.min(F.when(F.col("place") == 1, F.struct(candidate.alias("order"), "doc", "piece"))).alias("best"),
    ))
    return sorted_rows.join(pieces, "text_sha256").select(
        F.col("doc").alias(id_col),
        F.col("best.doc").alias("keep_id"),
        "group_size",
        (
            (F.col("place") == 1)
            & F.col("doc").eqNullSafe(F.col("best.doc"))
            & (F.col("piece") == F.col("best.piece"))
        ).alias("kept"),
        "text_sha256",
    )
