"""Cleaning of display text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols (category So) and everything above U+FFFF go; the code points
# listed by number are symbols too, but newer than the Unicode tables of common JVMs.
REMOVED = (
    r"[\p{So}\x{10000}-\x{10FFFF}"
    r"\x{2FFC}-\x{2FFF}\x{31EF}\x{FD40}-\x{FD4F}\x{FDCF}\x{FDFE}\x{FDFF}]"
)

# The characters trimmed from both ends.
TRIMMED = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ASCII_TRIMMED = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "


def clean_text(text: Column) -> Column:
    """Text without symbols and emoji, trimmed; null when nothing is left.

    Text with as many bytes as characters is ASCII, which has no such symbols and few
    characters to trim, so the search and the long trim list are left to the rest.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    searched = F.regexp_replace(text, F.lit(REMOVED), F.lit(""))
    kept = F.when(ascii_only, F.btrim(text, F.lit(ASCII_TRIMMED))).otherwise(
        F.btrim(searched, F.lit(TRIMMED))
    )
    return F.nullif(kept, F.lit(""))
