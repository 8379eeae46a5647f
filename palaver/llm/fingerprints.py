"""Document fingerprints from closed syncmers.

A window of K bytes is a closed syncmer if the smallest of its inner S-byte substrings (by hash) is its first or its
last. That depends on the window alone, so two texts pick the same anchors wherever they agree. A fingerprint is all of
a text's anchors in the order in which they stand there, as often as they stand there; the column holds it whole, four
bytes an anchor in base 64, so that read() and likeness() give from two columns what compare() gives from two texts.
The likeness of two fingerprints is the number of anchors that both have in one order over the number that either has;
the second occurrence of an anchor is matched with the second, the third with the third, and so on.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode, b64encode
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, U64, blocks, buffers, mix, powers, small_batches, table

K, S = 15, 4
#: Bytes of text in one stretch of the order by id, and the most stretches.
STRETCH_BYTES, MOST_STRETCHES = 12 << 20, 1 << 16


def _syncmers(data: np.ndarray, at: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash (32 bits) and text of every closed syncmer of texts that lie end to end, in order."""
    size = len(data)
    if size < k:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    power, inverse = powers(size)
    total = np.zeros(size + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[:size], out=total[1:])
    width = k - s + 1
    inner = np.zeros(size - s + 1, np.uint32)
    for j in range(s):
        inner = inner * np.uint32(0x01000193) ^ data[j : size - s + 1 + j]
    inner = (inner ^ (inner >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    inner ^= inner >> np.uint32(13)
    least, span = inner, 1
    while span < width:  # sliding minimum by doubling
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    starts = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    of = np.searchsorted(at, starts, "right") - 1
    inside = starts + k <= at[of + 1]
    starts, of = starts[inside], of[inside]
    return (mix((total[starts + k] - total[starts]) * inverse[starts]) >> U64(32)).astype(np.uint32), of


def anchors(data: np.ndarray, at: np.ndarray, k: int = K, s: int = S) -> list[np.ndarray]:
    """The fingerprint of each of n texts that lie end to end: anchor hashes (uint32) in text order, repeats included.

    A text without anchors, such as one of fewer than k bytes, has the hash of the whole text as its only one; an
    empty text has none. A long text that stands alone is read BLOCK bytes at a time.
    """
    data, at = data[at[0] : at[-1]], at - at[0]
    n, size = len(at) - 1, len(data)
    if n == 1 and size > 2 * BLOCK:
        pieces = [data[i : i + BLOCK + k - 1] for i in range(0, size - k + 1, BLOCK)]
        h = np.concatenate([_syncmers(p, np.array([0, len(p)]), k, s)[0] for p in pieces])
        return [h if len(h) else _short(data)]
    h, of = _syncmers(data, at, k, s)
    cut = np.searchsorted(of, np.arange(n + 1))
    out = [h[cut[i] : cut[i + 1]] for i in range(n)]
    for i in np.flatnonzero((np.diff(cut) == 0) & (np.diff(at) > 0)):
        out[i] = _short(data[at[i] : at[i + 1]])
    return out


def _short(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(data.tobytes(), digest_size=4).digest(), np.uint32)


def written(fingerprint: np.ndarray) -> str:
    """The column's form: big-endian anchors in base 64; nothing for an empty text."""
    return b64encode(fingerprint.astype(">u4").tobytes()).decode()


def read(column: str) -> np.ndarray:
    """The fingerprint that written() wrote."""
    return np.frombuffer(b64decode(column), ">u4").astype(np.uint32)


def _numbered(fingerprint: np.ndarray) -> np.ndarray:
    """Every anchor with the number of equal ones before it, as one number; all of them differ."""
    order, n = np.argsort(fingerprint, kind="stable"), np.arange(len(fingerprint))
    h = fingerprint[order]
    first = np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]][: len(h)], n, 0))
    out = np.empty(len(h), U64)
    out[order] = h.astype(U64) | (n - first).astype(U64) << U64(32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1. Shared anchors count only as far as both have them in one order; two empty fingerprints are alike."""
    return _alike(_numbered(a), _numbered(b))


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    """likeness() of numbered anchors."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    places = order[at]
    places = places[b[places] == a]  # of the shared anchors in b, in the order of a
    either = len(a) + len(b) - len(places)
    tails: list[int] = []  # of the longest increasing runs of places
    for i in places.tolist():
        if not tails or i > tails[-1]:
            tails.append(i)
        else:
            tails[bisect_left(tails, i)] = i
    return len(tails) / either


def _fingerprints(texts: list[str]) -> list[np.ndarray]:
    data, at = buffers(pa.array(texts, pa.string()))
    return [f for i, j in blocks(at) for f in anchors(data, at[i : j + 1])]


def edited(text: str, follower: str) -> str:
    """The text with its last third (rounded down) replaced by the beginning of the follower."""
    k = len(text) // 3
    return text[: len(text) - k] + follower[:k]


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (place, head, id, tie, text) such that sorting a place's rows by head, id descending and tie puts every row
    right before the one that follows it by descending id; head marks the row that begins the next place.

    Ids are cut into places at quantiles, about one for every STRETCH_BYTES of text. Only the places' largest ids, at
    most MOST_STRETCHES numbers, go through the driver. Null ids come after all others; equal ids are ordered by a
    hash of the text, so repeated rows are neighbours.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(MOST_STRETCHES, max(16, total // STRETCH_BYTES)))
    bounds = sorted(set(rows.filter("id is not null").approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []))
    cuts = [-float("inf"), *bounds, float("inf")]
    placed = rows.withColumn("real", F.col("id").cast("double"))
    if bounds:
        placed = Bucketizer(splits=cuts, inputCol="real", outputCol="bucket", handleInvalid="keep").transform(placed)
    else:
        placed = placed.withColumn("bucket", F.lit(0.0))
    placed = placed.withColumn("place", F.when(F.col("id").isNull(), F.lit(len(cuts))).otherwise(len(cuts) - 1 - F.col("bucket")).cast("int"))
    placed = placed.select("place", "id", F.xxhash64("text").alias("tie"), "text")
    heads = [(r["place"], r["id"]) for r in placed.groupBy("place").agg(F.max("id").alias("id")).orderBy("place").collect()]
    if not heads:
        return placed.select("place", F.lit(False).alias("head"), "id", "tie", "text")
    moves = spark.createDataFrame([(p, i, heads[k - 1][0]) for k, (p, i) in enumerate(heads)], "place int, id long, before int")
    a, b = placed.alias("a"), F.broadcast(moves).alias("b")
    copies = a.join(b, (F.col("a.place") == F.col("b.place")) & F.col("a.id").eqNullSafe(F.col("b.id")))
    copies = copies.groupBy("before").agg(F.min_by(F.struct("a.id", "tie", "text"), "tie").alias("r"))
    copies = copies.select(F.col("before").alias("place"), F.lit(True).alias("head"), F.col("r.id"), F.col("r.tie"), F.col("r.text"))
    every = placed.select("place", F.lit(False).alias("head"), "id", "tie", "text").unionByName(copies)
    return every.repartition(max(n, 1), "place").sortWithinPartitions("place", "head", F.col("id").desc_nulls_last(), "tie")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of in_order() -> a row for each but the heads, compared with its edited text and its follower."""
    last: tuple | None = None
    for b in batches:
        rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
        if last is not None:
            rows.insert(0, last)
        if not rows:
            continue
        last = rows[-1]
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0]]
        if not pairs:
            continue
        texts = [r[3] for r in rows]
        own = _fingerprints(texts)
        each = [_numbered(f) for f in own]
        new = [edited(texts[i], texts[i + 1]) for i in pairs]
        cols: list[list] = [[] for _ in _OUT]
        for i, e, f in zip(pairs, new, _fingerprints(new), strict=True):
            for c, v in zip(cols, (rows[i][2], len(texts[i]), hashlib.sha256(e.encode()).hexdigest(), written(own[i]), written(f), _alike(each[i], _numbered(f)), _alike(each[i], each[i + 1])), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)


def compare(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row is the one with the next smaller key, after the last the first; a single row follows itself. Null
    texts are empty. Equal keys are ordered by text. Empty input gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = in_order(docs, key, text).select("place", "head", "id", "text")
    out = rows.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("doc_id", key)


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, compared with its edited text and the next document."""
    return compare(table(spark, sf_dir, "documents"))
