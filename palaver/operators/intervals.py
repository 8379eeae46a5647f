"""Pairs of intervals that overlap, by time bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds of a bin: about the length of an utterance, so that a bin holds a few of each side.
BIN_S = 5.0


def _binned(df: DataFrame, name: str, on: str, start: str, end: str, width: float) -> DataFrame:
    """df as a struct column `name`, once for each bin that [start, end) reaches; empty and unordered intervals go."""
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    rows = df.filter(F.col(end) > F.col(start)).select(F.col(on), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), first.alias(f"_{name}"), F.explode(F.sequence(first, last)).alias("_bin"))
    return rows


def candidates(left: DataFrame, right: DataFrame, on: str, width: float = BIN_S) -> DataFrame:
    """Pairs that share a bin, `l` and `r`, each pair once: in the later of their first bins."""
    pairs = _binned(left, "l", on, "start", "end", width).join(_binned(right, "r", on, "start", "end", width), [on, "_bin"])
    return pairs.filter(F.col("_bin") == F.greatest("_l", "_r")).drop("_l", "_r", "_bin")


def overlapping(left: DataFrame, right: DataFrame, on: str, width: float = BIN_S) -> DataFrame:
    """(on, l, r, overlap) of rows with equal `on` whose [start, end) overlap.

    An equi-join on the key and the bin, so that a key with n intervals a side makes pairs in proportion to n and to how
    many meet in a bin, in many tasks, and not n * n in one. An interval is copied to every bin that it reaches.
    """
    overlap = F.least("l.end", "r.end") - F.greatest("l.start", "r.start")
    return candidates(left, right, on, width).withColumn("overlap", overlap).filter("overlap > 0")
