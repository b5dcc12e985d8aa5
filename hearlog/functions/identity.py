"""Reproducible row identity."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*columns: Column) -> Column:
    """128-bit digest of the columns as 16 bytes.

    Every part carries its length, and null has a mark of its own, so different values
    never run together. 128 bits, because with 10^12 plays a 64-bit hash would give
    tens of thousands of plays the same identity.
    """
    parts = [
        F.coalesce(
            F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")),
            F.lit("-"),
        )
        for c in columns
    ]
    return F.unhex(F.md5(F.concat_ws("|", *parts)))
