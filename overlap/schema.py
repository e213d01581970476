"""Data model: the three input shapes and the parameter rules shared by every method."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# people(pid), locations(pid, locations array), interests(pid, interest)
PEOPLE = T.StructType([T.StructField("pid", T.StringType(), False)])
LOCATIONS = T.StructType([
    T.StructField("pid", T.StringType(), False),
    T.StructField("locations", T.ArrayType(T.StringType(), True), False),
])
INTERESTS = T.StructType([
    T.StructField("pid", T.StringType(), False),
    T.StructField("interest", T.StringType(), False),
])

BLANK_MODES = ("drop", "keep")


def lg_nominal(nominal_entries: int) -> int:
    """Nominal entries (e.g. 4096, 16384, 32736) -> theta lgNomEntries, rounded up."""
    if nominal_entries <= 0:
        nominal_entries = 4096
    lg = max(4, math.ceil(math.log2(nominal_entries)))
    if lg > 26:
        raise ValueError(f"nominal_entries {nominal_entries} above 2^26")
    return lg


def key_column(df: DataFrame, key: str, blank: str = "drop", as_string: bool = True):
    """The key as used by every method: cast to string (both sides must hash alike)."""
    if blank not in BLANK_MODES:
        raise ValueError(f"blank must be one of {BLANK_MODES}")
    c = F.col(key)
    return c.cast("string") if as_string else c


def key_predicate(key: str, blank: str = "drop"):
    """Rows whose key takes part in counting, as a filter on the *raw* column.

    ``blank="drop"`` skips null, "" and whitespace-only keys, so exact, approximate, theta
    and HLL paths all count the same population (joins and sketches skip null anyway).
    ``blank="keep"`` counts "" and "  " as keys, like ``count(distinct)``; the value is
    then prefixed for sketches, which would otherwise skip the empty string.
    Filtering before the projection lets Parquet receive ``IsNotNull(key)``.
    """
    if blank not in BLANK_MODES:
        raise ValueError(f"blank must be one of {BLANK_MODES}")
    c = F.col(key)
    if blank == "drop":
        return c.isNotNull() & ~is_blank(c.cast("string"))
    return c.isNotNull()


BLANK = "^\\p{javaWhitespace}*$"


def is_blank(c):
    """True for "" and strings of white space only (tabs, line breaks, Unicode spaces too).

    A string that begins with a printing ASCII character is told without the pattern.
    """
    return ~F.ascii(c).between(33, 126) & c.rlike(BLANK)


def sketch_input(c, blank: str = "drop"):
    """Value fed to a theta/HLL sketch: the key's UTF-8 bytes.

    The sketch library hashes a string as its UTF-8 bytes, so binary input gives
    byte-identical (fully mergeable) sketches while skipping a per-row String decode and
    re-encode. Under blank="keep" the key is sentinel-prefixed so "" is not skipped.
    """
    if blank == "keep":
        c = F.concat(F.lit("k:"), c)
    return c.cast("binary")
