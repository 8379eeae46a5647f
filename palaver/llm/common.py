"""What several operators of this subpackage share: tables, durable intermediate results, raw text buffers, hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.sources.shared import fresh_path

U64 = np.uint64
#: Bytes of text that the vectorised helpers work on at once; their temporary arrays take about 60 times as much.
BLOCK = 1 << 20
#: Rows in an Arrow batch of texts, so that a batch of long texts stays small.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts vary in length, so hand them to Python in batches of BATCH_ROWS at most."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: the lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the rows that no classifier may learn from; a null id is not held out but not learnt from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, and the n + 1 places where its texts begin and end; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def blocks(at: np.ndarray, most: int = BLOCK):
    """Cut n texts into runs (i, j) of about `most` bytes; a longer text stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of an odd base and of its inverse, modulo 2 ** 64; kept for the next call up to 2 * BLOCK."""
    if len(_POWERS[0]) > n:
        return _POWERS[0], _POWERS[1]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        out = np.full(n + 1, base, U64)
        out[0] = 1
        made.append(np.multiply.accumulate(out))
    if n <= 2 * BLOCK:
        _POWERS[:] = made
    return made[0], made[1]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[32, 9, 10, 11, 12, 13]] = True


def _long_word(data: np.ndarray, lower: bool) -> np.ndarray:
    """The hash of one word of many bytes, BLOCK of them at a time."""
    total, ahead, power = 0, 1, powers(BLOCK)[0]
    for i in range(0, len(data), BLOCK):
        piece = data[i : i + BLOCK]
        total += ahead * int((((_LOWER[piece] if lower else piece).astype(U64) + U64(1)) * power[: len(piece)]).sum())
        ahead = ahead * pow(_BASE, BLOCK, 1 << 64) % (1 << 64)
    return mix(np.array([(total + len(data) * 0xD6E8FEB86659FD93) % (1 << 64)], U64))


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of texts that lie end to end in data: a 64-bit hash of each, its text, first byte and end.

    A text of more than 2 * BLOCK bytes that stands alone is read about BLOCK at a time, cut between words.
    """
    data = data[at[0] : at[-1]]
    at = at - at[0]
    n = len(data)
    if len(at) == 2 and n > 2 * BLOCK:
        parts, i = [], 0
        while i < n:
            j = min(n, i + BLOCK)
            while j < n and not _BREAK[data[j]]:
                near = np.flatnonzero(_BREAK[data[j : j + BLOCK]])
                j = min(n, j + (int(near[0]) if len(near) else BLOCK))
            piece = data[i:j]
            if j - i > 2 * BLOCK:
                inside = np.flatnonzero(_BREAK[piece])
                k = int(inside[-1]) + 1 if len(inside) else 0  # the piece's last word is the long one
                if k:
                    parts.append((i, *word_hashes(piece[:k], np.array([0, k]), lower)))
                one = np.zeros(1, np.int64)
                parts.append((i, _long_word(piece[k:], lower), one, one + k, one + (j - i)))
            else:
                parts.append((i, *word_hashes(piece, np.array([0, j - i]), lower)))
            i = j
        return tuple(np.concatenate([p[k] + (p[0] if k > 2 else 0) for p in parts]) for k in range(1, 5))
    none = np.zeros(0, np.int64)
    if not n:
        return none.astype(U64), none, none, none
    inside = ~_BREAK[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = powers(n)
    total = np.zeros(n + 1, U64)
    np.cumsum(((_LOWER[data] if lower else data).astype(U64) + U64(1)) * power[:n], out=total[1:])
    h = mix((total[end] - total[first]) * inverse[first] + (end - first).astype(U64) * U64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(at, first, "right") - 1, first, end
