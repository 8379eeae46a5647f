"""Periodic runs in texts: stretches of words that repeat with a period, and texts with the repeats taken out.

A suffix automaton is built over the words. Its states are visited from the longest string to the shortest, and the
ordered sets of places where their strings end are merged up the suffix links, the smaller set into the larger one. When
two ends become neighbours at a state, no further apart than the state's string is long, that string stands twice in a
square: the seed of a run, which is then extended as far as its period holds.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, powers, small_batches, table

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
WORD = r"[^\x20\x09-\x0D]+"


def suffix_automaton(word: Sequence[int]) -> tuple[array, array, bytearray]:
    """Of each state the length of its longest string, its suffix link (-1 at the root), and whether it is a prefix of word.

    Nearly every state has one way on, which is kept in two flat arrays; further ones are in a dictionary by state.
    """
    length, link, letter, target = array("i", [0]), array("i", [-1]), array("i", [-1]), array("i", [0])
    prefix, more, last = bytearray(1), {}, 0
    for c in word:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        letter.append(-1)
        target.append(0)
        prefix.append(1)
        p, q = last, -1
        while p >= 0:
            if letter[p] == c:
                q = target[p]
                break
            if letter[p] < 0:
                letter[p], target[p] = c, new
            else:
                ways = more.setdefault(p, {})
                if (q := ways.get(c, -1)) >= 0:
                    break
                ways[c] = new
            p = link[p]
        last = new
        if p < 0:
            continue
        if length[p] + 1 == length[q]:
            link[new] = q
            continue
        copy = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        letter.append(letter[q])
        target.append(target[q])
        prefix.append(0)
        if q in more:
            more[copy] = dict(more[q])
        while p >= 0:
            if letter[p] == c:
                if target[p] != q:
                    break
                target[p] = copy
            else:
                ways = more[p]
                if ways[c] != q:
                    break
                ways[c] = copy
            p = link[p]
        link[q] = link[new] = copy
    return length, link, prefix


def _same_until(word: np.ndarray, i: int, period: int) -> int:
    """The first place from i on whose word differs from the one a period before it."""
    n, step = len(word), 64
    while i < n:
        j = min(n, i + step)
        odd = np.flatnonzero(word[i:j] != word[i - period : j - period])
        if len(odd):
            return i + int(odd[0])
        i, step = j, min(2 * step, 1 << 16)
    return n


def _same_from(word: np.ndarray, i: int, period: int) -> int:
    """The first place of those up to i that all agree with the word a period after them."""
    step = 64
    while i > 0:
        j = max(0, i - step)
        odd = np.flatnonzero(word[j:i] != word[j + period : i + period])
        if len(odd):
            return j + int(odd[-1]) + 1
        i, step = j, min(2 * step, 1 << 16)
    return 0


class _Stretches:
    """Stretches of equal period, each extended once: a seed that lies in a known one is passed over."""

    def __init__(self, word: np.ndarray):
        self.word, self.known = word, {}

    def seed(self, first: int, last: int, period: int) -> None:
        starts, ends = self.known.setdefault(period, ([], []))
        k = bisect_right(starts, first)
        if k and last < ends[k - 1]:
            return
        start, end = _same_from(self.word, first, period), _same_until(self.word, last + 1, period)
        k = bisect_left(starts, start)
        starts.insert(k, start)
        ends.insert(k, end)

    def runs(self, least: int, times: int) -> Iterator[tuple[int, int, int]]:
        """Runs (start, length, period). A stretch may have been seeded with a multiple of its period; it has the smallest
        one as well then, with the same ends."""
        smallest: dict[tuple[int, int], int] = {}
        for period, (starts, ends) in self.known.items():
            for a, b in zip(starts, ends, strict=True):
                if b - a >= max(least, times * period):
                    smallest[a, b] = min(period, smallest.get((a, b), period))
        return ((a, b - a, period) for (a, b), period in smallest.items())


def _seeded(word: np.ndarray, shortest: int) -> _Stretches:
    """All squares of strings of `shortest` words or more, extended."""
    length, link, prefix = suffix_automaton(word.tolist())
    lengths = np.frombuffer(length, np.int32)
    found, ends = _Stretches(word), {}
    # Ends are kept negated: states come by falling length, so a state's own end then goes to the end of its set.
    for v in np.argsort(-lengths, kind="stable").tolist():
        size = length[v]
        if size < shortest:
            break
        own = ends.pop(v, None) or []
        if prefix[v]:
            if own and size - 1 + own[-1] >= -size:
                found.seed(0, -own[-1], -own[-1] - size + 1)
            own.append(1 - size)
        up = link[v]
        if length[up] < shortest:
            continue
        if up not in ends:
            ends[up] = own
            continue
        small, large, reach = own, ends[up], length[up]
        if len(small) > len(large):
            small, large = large, small
        for x in small:
            k = bisect_left(large, x)
            if k and x - large[k - 1] <= reach:
                found.seed(-x - reach + 1, -large[k - 1], x - large[k - 1])
            if k < len(large) and large[k] - x <= reach:
                found.seed(-large[k] - reach + 1, -x, large[k] - x)
            large.insert(k, x)
        ends[up] = large
    return found


def _recurring(word: np.ndarray, width: int, times: int) -> list[tuple[int, int]]:
    """Stretches [a, b) outside of which no run has a word: all their words lie in strings of `width` words that recur
    within a third of the stretch. Equal strings have equal hashes, so none is missed."""
    n = len(word) - width + 1
    power, inverse = powers(len(word))
    total = np.zeros(len(word) + 1, U64)
    np.cumsum((word.astype(U64) + U64(1)) * power[: len(word)], out=total[1:])
    h = (total[width:] - total[:n]) * inverse[:n]
    by = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[by[1:]] == h[by[:-1]])
    if not len(same):
        return []
    far = np.full(n, len(word), np.int64)
    gap = by[same + 1] - by[same]
    far[by[same]] = gap
    far[by[same + 1]] = np.minimum(far[by[same + 1]], gap)
    return [(a, b) for a, b, nearest in _covered(np.flatnonzero(far * times <= len(word)), far, width) if times * nearest <= b - a]


def _covered(at: np.ndarray, far: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """What strings of `width` words that begin at these places cover, and the least distance to a like string in it."""
    if not len(at):
        return
    cut = np.flatnonzero(np.diff(at) > width) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1
    yield from zip(at[first].tolist(), (at[last] + width).tolist(), np.minimum.reduceat(far[at], first).tolist(), strict=True)


def periodic_runs(words: Sequence, *, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Every run (start, length, period) of the words, by start and then period, and which words collapsing keeps.

    A run is a stretch with smallest period q of max(least, times * q) words or more that no neighbour extends; times is
    2 or more. The first q words of each run stay, unless another one drops them.

    A run repeats a string of `shortest` words or more at the distance of its period. Only stretches of such recurring
    strings go into an automaton, and only states as long take part in merging.
    """
    kept = np.ones(len(words), bool)
    if len(words) < least:
        return [], kept
    shortest = max(1, min(max(least - q, (times - 1) * q) for q in range(1, least + 1)))
    number: dict = {}
    word = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return [], kept
    found = []
    for a, b in _recurring(word, shortest, times):
        found += [(a + s, size, q) for s, size, q in _seeded(word[a:b], shortest).runs(least, times)]
    for s, size, q in found:
        kept[s + q : s + size] = False
    return sorted(found, key=lambda r: (r[0], r[2])), kept


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for b in batches:
        runs, texts = [], []
        for text in b.column(b.num_columns - 1).cast(pa.large_binary()):
            words = (text.as_py() or b"").split()  # at \x20 and \x09-\x0D, as WORD does
            found, kept = periodic_runs(words)
            runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
            texts.append(b" ".join(words if kept.all() else [w for w, k in zip(words, kept.tolist(), strict=True) if k]).decode())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(runs, pa.list_(run)), pa.array(texts, pa.string())], [*b.schema.names[:-1], "runs", "collapsed"])


def collapse(docs: DataFrame, *, key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """One row per row of docs: key, runs (array of start, length, period in words), collapsed (the words that no run
    repeats, joined by one space).

    Null and empty texts have no runs and collapse to nothing; a text of one word a million times is one run of period 1.
    Repeated rows and ids repeat; null keys stay; other columns, whatever their names, are left out. A text is one
    task's work: some 100 bytes a word, and 100 more for words in recurring stretches.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(_detect, f"key {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string").withColumnRenamed("key", key)


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a period planted, where the remainder of the id's checksum by ten is 0; fixed by the contract."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # The outer transform gives the words a name, so that they are taken once and not for each of them.
    return F.when((h % 10 == 0) & text.rlike(WORD), F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), repeat)[0]).otherwise(text)


def op13_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document: how many, the one with the greatest exponent, digests of all and of the collapsed text."""
    found = collapse(table(spark, sf_dir, "documents"), text=planted(F.col("doc_id"), F.col("text")))
    best = F.aggregate("runs", F.expr("cast(null as struct<start:bigint,length:bigint,period:bigint>)"), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
