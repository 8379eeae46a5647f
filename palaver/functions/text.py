"""Column functions for text, numbers and times that Spark's built-ins don't give as they are needed here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end: Java's \\s, vertical tab, Unicode separators and the byte order mark. trim() knows blanks only.
EDGE_SPACE = r"^[\s\x0B\p{Z}\x{FEFF}]+|[\s\x0B\p{Z}\x{FEFF}]+$"


def ws_trim(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def non_blank(c: Column) -> Column:
    """The trimmed text; null if nothing is left."""
    return F.nullif(ws_trim(c), F.lit(""))


def non_empty(c: Column) -> Column:
    """The text as it is; null if it is empty."""
    return F.nullif(c, F.lit(""))


def round3(c: Column) -> Column:
    """Three decimals, halves upwards on the binary product (round() works on decimals and differs)."""
    return F.floor(c * 1000 + 0.5) / 1000


def iso_ms(c: Column) -> Column:
    """UTC with milliseconds; the session's time zone must be UTC."""
    return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_seconds(c: Column) -> Column:
    """Seconds since 1970 of an ISO text, cut to milliseconds; null if it is no time."""
    return F.unix_millis(F.try_to_timestamp(c)) / 1000.0


def segment_name(n: Column) -> Column:
    """seg_001 and on; numbers above 999 keep all digits."""
    return F.format_string("seg_%03d", n)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def prefixed_id(prefix: str, *keys: Column) -> Column:
    """An id of 26 characters after a prefix that depends on the keys alone, so a retried task makes the same one."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *[k.cast("string") for k in keys]), 256), 1, 26))


def with_extension(name: Column, extension: str) -> Column:
    """A file name with its last extension replaced; a name without one stays as it is."""
    return F.regexp_replace(name, r"\.[^.]+$", "." + extension)


def shortened(c: Column, most: int = 300) -> Column:
    return F.left(c, F.lit(most))
