"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

Rows fall into parts by a keyed hash. A matrix says how many rows of each part go to each shard; drawn part by part
from the shards' free places it is multivariate hypergeometric, as in a uniform shuffle of all rows. Parts form areas:
the driver draws the lines of at most AREAS areas, and each area's line is drawn on for its own parts in a task, which
is the same law. Each part deals a random permutation of its rows out by its line of the matrix, rows are exchanged,
and each shard is permuted again. Many rows with the same keys are numbered, and go to parts by key and number.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palaver.operators.ranking import numbered

from .common import stash, table

SHARDS = 24
#: Rows that a part holds on average, and parts of an area. The driver holds one line of the matrix for each of AREAS areas.
PART_ROWS = 4096
AREAS = 1024
#: A part of more than so many times PART_ROWS holds many rows with the same keys, as a keyed hash deals others evenly.
CROWDED = 4
SEED = 4_021
#: numpy draws from populations below this.
LARGE = 10**9


def draw(rng: np.random.Generator, good: int, bad: int, wanted: int) -> int:
    """How many of `good` are among `wanted` out of good + bad, of any size: an exact hypergeometric draw.

    Large populations are drawn from the mode outwards; the values left out, 16 deviations away, have no weight in doubles.
    """
    if not wanted or not good:
        return 0
    if not bad:
        return wanted
    if good < LARGE and bad < LARGE:
        return int(rng.hypergeometric(good, bad, wanted))
    lo, hi, n = max(0, wanted - bad), min(good, wanted), good + bad
    mode = min(hi, max(lo, (wanted + 1) * (good + 1) // (n + 2)))
    reach = int(16 * sqrt(wanted * (good / n) * (bad / n) * (n - wanted) / max(1, n - 1))) + 64
    up = np.arange(mode, min(hi, mode + reach), dtype=float)
    down = np.arange(mode, max(lo, mode - reach), -1, dtype=float)
    above = np.cumprod((good - up) * (wanted - up) / ((up + 1) * (bad - wanted + up + 1)))
    below = np.cumprod(down * (bad - wanted + down) / ((good - down + 1) * (wanted - down + 1)))
    upto = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return mode - len(below) + min(int(np.searchsorted(upto, rng.random() * upto[-1], "right")), len(upto) - 1)


def deal(counts: dict[int, int], free: np.ndarray, seed: list[int]) -> dict[int, list[int]]:
    """Rows that each part sends to each shard, from the shards' free places, which all the counts fill."""
    free, out = np.array(free, np.int64), {}
    for part in sorted(counts):
        rng, wanted, left, line = np.random.default_rng([*seed, part]), counts[part], int(free.sum()), []
        for places in free.tolist():
            left -= places
            line.append(draw(rng, places, left, wanted))
            wanted -= line[-1]
        free -= line
        out[part] = line
    return out


def communication_matrix(counts: dict[int, int], shards: int, seed: int) -> dict[int, list[int]]:
    """Rows that each part sends to each shard. Shards get floor or ceiling of an equal share; counts are per part."""
    total = sum(counts.values())
    free = np.full(shards, total // shards, np.int64)
    free[: total % shards] += 1
    return deal(counts, free, [seed])


_LINE = "_s_part long, _s_upto array<long>"
_LINE_ARROW = pa.schema([("_s_part", pa.int64()), ("_s_upto", pa.list_(pa.int64()))])


def _lines(matrix: dict[int, list[int]], seed: int):
    """An area's parts and their counts -> how many rows of each part go to each shard or one before it."""

    def run(t: pa.Table) -> pa.Table:
        area = t["area"][0].as_py()
        lines = deal(dict(zip(t["_s_part"].to_pylist(), t["n"].to_pylist(), strict=True)), matrix[area], [seed, area])
        return pa.Table.from_pydict({"_s_part": list(lines), "_s_upto": [np.cumsum(x).tolist() for x in lines.values()]}, schema=_LINE_ARROW)

    return run


def _apart(placed: DataFrame, crowded: DataFrame, keys: list[str], same: Column) -> DataFrame:
    """placed with _s_number: of rows in crowded parts the number among those with the same keys, from 0; else 0.

    Only the rows of crowded parts are sorted and written, by ranges, so that no task holds a group.
    """
    inside = placed.join(crowded, "_s_part", "left_semi").select(F.struct("*").alias("row"), same.alias("same"))
    inside = numbered(inside, "same", [F.col("row")[k] for k in keys], "number").select("row.*", (F.col("number") - 1).alias("_s_number"))
    return placed.join(crowded, "_s_part", "left_anti").withColumn("_s_number", F.lit(0).cast("long")).unionByName(inside)


def shard_rows(df: DataFrame, keys: list[str], *, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df with shard (0 to shards - 1; counts at most one apart) and slot (its place there, gapless from 0).

    The order of rows comes from a hash of `keys` alone, so reruns agree; rows that agree in all keys get neighbouring
    places in any order, and of more than PART_ROWS of them the others get places anywhere. Nulls in keys count as a
    value. Empty input gives no rows. Columns of df named shard or slot are replaced; those beginning with _s_ are
    refused, as that is where it keeps its own.
    """
    if taken := [c for c in df.columns if c.startswith("_s_")]:
        raise ValueError(f"columns that begin with _s_ are reserved: {taken}")
    df = df.drop("shard", "slot")
    hashed = lambda what, *more: F.xxhash64(F.lit(seed), F.lit(what), *keys, *more)
    late = F.col("_s_number") >= PART_ROWS
    spread = lambda what: F.when(late, hashed(what, "_s_number")).otherwise(hashed(what))
    n = df.count()
    parts = max(1, -(-n // PART_ROWS))
    area = F.pmod("_s_part", F.lit(AREAS)).cast("int").alias("area")
    counted = lambda rows: stash(rows.groupBy("_s_part").agg(F.count("*").alias("n")).select("_s_part", "n", area), "shard-parts")
    placed = df.withColumn("_s_part", F.pmod(hashed("part"), F.lit(parts)))
    counts = counted(placed)
    crowded = counts.filter(F.col("n") > CROWDED * PART_ROWS).select("_s_part")
    if crowded.isEmpty():
        placed = placed.withColumn("_s_number", F.lit(0).cast("long"))
    else:
        placed, stretch = _apart(placed, crowded, keys, hashed("same")), F.floor(F.col("_s_number") / PART_ROWS)
        placed = placed.withColumn("_s_part", F.when(late, F.pmod(hashed("part", stretch), F.lit(parts))).otherwise(F.col("_s_part")))
        counts = counted(placed)
    areas = {r[0]: r[1] for r in counts.groupBy("area").agg(F.sum("n")).collect()}  # AREAS rows at most
    lines = counts.groupBy("area").applyInArrow(_lines(communication_matrix(areas, shards, seed), seed), _LINE)
    first = W.partitionBy("_s_part").orderBy(spread("first"), *keys, "_s_number")
    dealt = placed.withColumn("_s_place", F.row_number().over(first)).join(lines, "_s_part")
    dealt = dealt.withColumn("shard", F.size(F.filter("_s_upto", lambda x: x < F.col("_s_place"))).cast("int"))
    # The second permutation: a shard's rows by hash range, then by hash; ranges give every row its place without a
    # task that holds a whole shard.
    ranges = max(1, parts // shards)
    dealt = dealt.withColumn("_s_range", F.pmod(spread("range"), F.lit(ranges)).cast("int"))
    sizes = dealt.groupBy("shard", "_s_range").agg(F.count("*").alias("_s_n"))
    before = F.coalesce(F.sum("_s_n").over(W.partitionBy("shard").orderBy("_s_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("shard", "_s_range", before.alias("_s_before"))
    second = W.partitionBy("shard", "_s_range").orderBy(spread("second"), *keys, "_s_number")
    out = dealt.withColumn("_s_row", F.row_number().over(second)).join(starts, ["shard", "_s_range"])
    return out.withColumn("slot", F.col("_s_before") + F.col("_s_row") - 1).select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot")


def op4_shard(spark, sf_dir: str) -> DataFrame:
    """All `documents` in 24 shards by the law `rows`: counts at most one apart, every row's place uniformly random.

    Equal texts (equal text_crc32) are not kept together: a uniform shuffle treats rows alike, and a group may be
    larger than a shard. A null text has size 8 and a null checksum.
    """
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32")
    )
    out = shard_rows(docs, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
