"""N-gram Jaccard join: exact self-join of documents on their sets of word shingles, by prefix trees.

1. Every text becomes its set of 5-word shingles (64-bit hashes). Documents with equal sets are one class.
2. Shingles are counted over all classes: packed runs of hashes are exchanged by hash range, so a range is a numpy sort.
   A shingle of one class only can't be shared; a class with fewer than 75 % shared shingles has no partner and is done.
3. The others order their shingles from rare to frequent. Two linked sets share one of their first n - ceil(0.75 n) + 1,
   so linking each set with the smallest one under every such shingle gathers all candidates in blocks (components).
4. A block's sets are stored in a trie, frequent shingles first, that shares their common beginnings. A set walks down
   it; overlaps counted at a node serve all sets below, and a subtree is left as soon as the shingles that remain there
   can't reach the overlap needed. Each step links whatever passes; sets that are already joined with the largest
   component of their block need no walk of their own, since every missing link has an end outside it.
5. A block too large for one task is dealt out in chunks, joined with each other in a second pass (see `_across`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, blocks, buffers, mix, small_batches, stash, table, word_hashes
from .components import components

WORDS = 5
#: Stand for a null key: before all keys in the exchanged ids, after them where the smallest is chosen.
NO_KEY, NULL_KEY = -(1 << 63), (1 << 63) - 1
#: Linked from 100 * intersection >= PERCENT * union on.
PERCENT = 75
#: Sets that one trie holds at most.
CHUNK = 1024
#: Bytes of text whose shingles one hash range counts, and the number of ranges.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 12 << 20, 48, 1 << 16
#: Shingles that a task collects before it sends them out.
RUN = 1_000_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U64)


def shingles(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of n texts, repeats included, and the text that each belongs to."""
    h, text, _, _ = word_hashes(data, at)
    n = len(at) - 1
    held = np.bincount(text, minlength=n)
    if len(h) >= words:
        whole = sum(h[k : len(h) - words + 1 + k] * _FACTORS[k] for k in range(words))
        inside = text[: len(h) - words + 1] == text[words - 1 :]
        out, of = [mix(whole[inside])], [text[: len(inside)][inside]]
    else:
        out, of = [], []
    if (short := (held > 0) & (held < words)).any():  # the whole sequence is the shingle
        pick = short[text]
        first = np.cumsum(held) - held
        place = np.arange(len(h))[pick] - first[text[pick]]
        sums = np.zeros(n, U64)
        np.add.at(sums, text[pick], h[pick] * _FACTORS[place])
        out.append(mix(sums[short] + held[short].astype(U64) * U64(0x2545F4914F6CDD1D)))
        of.append(np.flatnonzero(short))
    return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, U64), np.zeros(0, np.int64))


def distinct(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (hash, text) pairs, the number for each text, and a 64-bit key of each text's set (0: empty)."""
    order = np.lexsort((of, h))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    size = np.bincount(of, minlength=n)
    key = np.zeros(n, U64)
    np.add.at(key, of, mix(h ^ U64(0x5851F42D4C957F2D)))
    key = mix(key + size.astype(U64) * U64(0x14057B7EF767814F))
    key[size == 0] = 0
    return h, of, size, key


# Rows between the steps. kind 0: documents (ids, sizes, keys); kind 1: shingles of a range.
_ROW = "kind int, part int, ids binary, texts binary, sizes binary, keys binary, hashes binary, counts binary"
_ROW_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *[(c, pa.binary()) for c in ("ids", "texts", "sizes", "keys", "hashes", "counts")]])


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _explode_texts(parts: int):
    """(id, hash of text, text) -> packed rows: each document's size and key, and each range's shingles, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        held = 0

        def send() -> Iterator[pa.RecordBatch]:
            ids, texts, size, key, h = (np.concatenate([w[k] for w in waiting]) for k in range(5))
            base = np.cumsum([0] + [len(w[0]) for w in waiting[:-1]])
            of = np.concatenate([w[5] + b for w, b in zip(waiting, base, strict=True)])
            yield _rows([{"kind": 0, "part": int(mix(ids[:1].astype(U64))[0] % U64(parts)), "ids": ids.tobytes(), "texts": texts.tobytes(), "sizes": size.astype(np.int64).tobytes(), "keys": key.tobytes()}], _ROW_ARROW)
            _, one = np.unique(key, return_index=True)
            keep = np.zeros(len(key), bool)
            keep[one] = True
            keep &= size > 0
            names = np.cumsum(keep) - 1
            picked = keep[of]
            h, of = h[picked], names[of[picked]]
            key, size = key[keep], size[keep].astype(np.uint32)
            part = ((h >> U64(48)) * U64(parts) >> U64(16)).astype(np.int32)
            order = np.lexsort((of, part))
            h, of, part = h[order], of[order], part[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            out = []
            for p in range(parts):
                i, j = cut[p], cut[p + 1]
                if i == j:
                    continue
                used, count = np.unique(of[i:j], return_counts=True)
                out.append({"kind": 1, "part": p, "sizes": size[used].tobytes(), "keys": key[used].tobytes(), "hashes": h[i:j].tobytes(), "counts": count.astype(np.uint32).tobytes()})
                if len(out) >= 64:
                    yield _rows(out, _ROW_ARROW)
                    out = []
            if out:
                yield _rows(out, _ROW_ARROW)

        for batch in batches:
            data, at = buffers(batch.column(2))
            ids, texts = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for i, j in blocks(at):
                h, of, size, key = distinct(*shingles(data, at[i : j + 1]), j - i)
                waiting.append((ids[i:j], texts[i:j], size, key, h, of))
                held += len(h)
                if held >= RUN:
                    yield from send()
                    waiting, held = [], 0
        if waiting:
            yield from send()

    return run


_SHARED = "kind int, ids binary, texts binary, sizes binary, keys binary, grp int, counts binary, tokens binary, df binary"
_SHARED_ARROW = pa.schema([("kind", pa.int32()), ("ids", pa.binary()), ("texts", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("grp", pa.int32()), ("counts", pa.binary()), ("tokens", pa.binary()), ("df", pa.binary())])


def _count_range(groups: int):
    """One hash range -> its documents' rows as they came, and for each group of classes the shingles that others share."""

    def run(t: pa.Table) -> pa.Table:
        out, toks, keys, sizes = [], [], [], []
        for r in t.to_pylist():
            if r["kind"] == 0:
                out.append({"kind": 0, "ids": r["ids"], "texts": r["texts"], "sizes": r["sizes"], "keys": r["keys"]})
                continue
            count = np.frombuffer(r["counts"], np.uint32)
            toks.append(np.frombuffer(r["hashes"], U64))
            keys.append(np.repeat(np.frombuffer(r["keys"], U64), count))
            sizes.append(np.repeat(np.frombuffer(r["sizes"], np.uint32), count))
        if toks:
            tok, key, size = np.concatenate(toks), np.concatenate(keys), np.concatenate(sizes)
            order = np.argsort(tok, kind="stable")
            tok, key, size = tok[order], key[order], size[order]
            same = np.zeros(len(tok) + 1, bool)
            same[1:-1] = tok[1:] == tok[:-1]
            several = same[1:] | same[:-1]  # most shingles occur once and go here
            tok, key, size = tok[several], key[several], size[several]
            order = np.lexsort((key, tok))
            tok, key, size = tok[order], key[order], size[order]
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])
            tok, key, size = tok[new], key[new], size[new]
            _, which, df = np.unique(tok, return_inverse=True, return_counts=True)
            df = df[which]
            several = df > 1
            tok, key, size, df = tok[several], key[several], size[several], df[several].astype(np.uint32)
            grp = (key % U64(groups)).astype(np.int64)
            order = np.lexsort((key, grp))
            tok, key, size, df, grp = tok[order], key[order], size[order], df[order], grp[order]
            cut = np.searchsorted(grp, np.arange(groups + 1))
            for g in np.unique(grp):
                i, j = cut[g], cut[g + 1]
                one, first, count = np.unique(key[i:j], return_index=True, return_counts=True)
                out.append({"kind": 1, "grp": int(g), "sizes": size[i:j][first].tobytes(), "keys": one.tobytes(), "counts": count.astype(np.uint32).tobytes(), "tokens": tok[i:j].tobytes(), "df": df[i:j].tobytes()})
        return pa.Table.from_pylist(out, schema=_SHARED_ARROW)

    return run


_SET = "key long, size long, tokens binary, prefix array<long>"
_SET_ARROW = pa.schema([("key", pa.int64()), ("size", pa.int64()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def _survivors(percent: int):
    """A group's shared shingles -> the classes that may have a partner: shingles frequent first, and the rare prefix."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        key = np.concatenate([np.repeat(np.frombuffer(r["keys"], U64), np.frombuffer(r["counts"], np.uint32)) for r in rows])
        size = np.concatenate([np.repeat(np.frombuffer(r["sizes"], np.uint32), np.frombuffer(r["counts"], np.uint32)) for r in rows]).astype(np.int64)
        tok = np.concatenate([np.frombuffer(r["tokens"], U64) for r in rows])
        df = np.concatenate([np.frombuffer(r["df"], np.uint32) for r in rows])
        order = np.lexsort((tok, df, key))
        key, size, tok = key[order], size[order], tok[order]
        one, first, count = np.unique(key, return_index=True, return_counts=True)
        out = []
        for k, i, c in zip(one, first, count, strict=True):
            n = int(size[i])
            if 100 * c >= percent * n:
                own = n - c  # shingles of this class alone come first in the order and meet nobody
                upto = n - -(-percent * n // 100) + 1 - own
                out.append({"key": int(np.int64(k.view(np.int64))), "size": n, "tokens": tok[i : i + c][::-1].tobytes(), "prefix": tok[i : i + upto].view(np.int64).tolist()})
        return pa.Table.from_pylist(out, schema=_SET_ARROW)

    return run


class Trie:
    """Sets in one order of shingles, stored as a tree of runs: what several sets begin with is held, and counted, once."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.runs: list[np.ndarray] = []
        self.below: list[list[int]] = []
        self.ends: list[list[int]] = []  # sets that end at a node
        self.rest: list[int] = []  # most shingles after a node on any path
        self.small: list[int] = []
        self.large: list[int] = []  # sizes of the smallest and largest set below
        self.sets, self.sizes = sets, sizes
        self.roots = self._grow(order, 0) if order else []

    def _node(self, run: np.ndarray) -> int:
        self.runs.append(run)
        self.below.append([])
        self.ends.append([])
        self.rest.append(0)
        self.small.append(0)
        self.large.append(0)
        return len(self.runs) - 1

    def _grow(self, order: list[int], depth: int) -> list[int]:
        """Nodes for sorted sets that agree in their first `depth` shingles; without recursion, as paths may be long."""
        made: list[int] = []
        todo = [(order, depth, made)]
        born: list[int] = []
        while todo:
            group, depth, into = todo.pop()
            i = 0
            while i < len(group):
                first = self.sets[group[i]]
                j = i + 1
                while j < len(group) and self.sets[group[j]][depth] == first[depth]:
                    j += 1
                last = self.sets[group[j - 1]]  # sorted: what the first and the last share, all share
                m = min(len(first), len(last))
                differ = np.flatnonzero(first[depth:m] != last[depth:m])
                upto = depth + int(differ[0]) if len(differ) else m
                node = self._node(first[depth:upto])
                born.append(node)
                into.append(node)
                k = i
                while k < j and len(self.sets[group[k]]) == upto:
                    self.ends[node].append(group[k])
                    k += 1
                if k < j:
                    todo.append((group[k:j], upto, self.below[node]))
                i = j
        for node in reversed(born):  # children were born after their parents
            down = self.below[node]
            self.rest[node] = max([0, *(len(self.runs[x]) + self.rest[x] for x in down)])
            sizes = [int(self.sizes[i]) for i in self.ends[node]]
            self.small[node] = min([*sizes, *(self.small[x] for x in down)])
            self.large[node] = max([*sizes, *(self.large[x] for x in down)])
        return made

    def walk(self, tokens: np.ndarray, size: int, percent: int) -> list[int]:
        """All sets whose overlap with `tokens` (sorted by value) makes a link with a set of `size` shingles."""
        found = []
        stack = [(x, 0) for x in self.roots]
        while stack:
            node, overlap = stack.pop()
            if 100 * self.large[node] < percent * size or 100 * size < percent * self.small[node]:
                continue
            # overlap >= percent / (100 + percent) * (size + other), other >= the larger of the smallest size below and percent % of size
            needed = -(-percent * (size + max(self.small[node], -(-percent * size // 100))) // (100 + percent))
            run = self.runs[node]
            if overlap + min(len(run) + self.rest[node], len(tokens) - overlap) < needed:
                continue
            overlap += int(_member(run, tokens).sum())
            if overlap + min(self.rest[node], len(tokens) - overlap) < needed:
                continue
            found += [i for i in self.ends[node] if (100 + percent) * overlap >= percent * (size + int(self.sizes[i]))]
            stack += [(x, overlap) for x in self.below[node]]
        return found


def _member(run: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = np.searchsorted(tokens, run)
    at[at == len(tokens)] = 0
    return tokens[at] == run


def join_sets(keys: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect whatever sets are connected, at most one fewer than sets."""
    n = len(sets)
    trie = Trie(sets, sizes)
    head, members = list(range(n)), {i: [i] for i in range(n)}
    links = []
    todo = set(range(n))
    main = 0
    while todo and len(members) > 1:
        i = next((x for x in todo if head[x] != main), None)
        if i is None:
            break  # what is left is joined with the largest component; its links to others were found from the other end
        todo.discard(i)
        for j in trie.walk(np.sort(sets[i]), int(sizes[i]), percent):
            a, b = head[i], head[j]
            if a != b:
                links.append((int(keys[i]), int(keys[j])))
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                for x in members.pop(b):
                    head[x] = a
                    members[a].append(x)
                if main == b or len(members[a]) > len(members.get(main, ())):
                    main = a
    return links


def join_pair(keys: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], component: np.ndarray, probe: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links of the probes with the other sets, which alone are in the trie, as far as they join components."""
    inner = np.flatnonzero(~probe)
    trie = Trie([sets[i] for i in inner], sizes[inner])
    one, of = np.unique(component, return_inverse=True)
    head = list(range(len(one)))

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = x = head[head[x]]
        return x

    links = []
    for i in np.flatnonzero(probe):
        if len(links) == len(one) - 1:
            break
        for j in inner[trie.walk(np.sort(sets[i]), int(sizes[i]), percent)]:
            a, b = find(int(of[i])), find(int(of[j]))
            if a != b:
                head[a] = b
                links.append((int(keys[i]), int(keys[j])))
    return links


_LINK = "u long, v long"
_LINK_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _join_blocks(percent: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("block", "ascending"), ("chunk", "ascending"), ("key", "ascending")])
        block, chunk, key, size = (t[c].to_numpy() for c in ("block", "chunk", "key", "size"))
        tokens = t["tokens"].to_pylist()
        cut = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1]), True])
        out: list[tuple[int, int]] = []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if j - i > 1:
                out += join_sets(key[i:j], size[i:j], [np.frombuffer(x, U64) for x in tokens[i:j]], percent)
        return pa.Table.from_pydict({"u": [a for a, _ in out], "v": [b for _, b in out]}, schema=_LINK_ARROW)

    return run


def _join_pairs(percent: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("probe", "ascending")])
        key, size, component = (t[c].to_numpy() for c in ("key", "size", "component"))
        probe = t["probe"].to_numpy(zero_copy_only=False).astype(bool)
        out = join_pair(key, size, [np.frombuffer(x, U64) for x in t["tokens"].to_pylist()], component, probe, percent)
        return pa.Table.from_pydict({"u": [a for a, _ in out], "v": [b for _, b in out]}, schema=_LINK_ARROW)

    return run


def _joined(sets: DataFrame, percent: int, groups: int) -> DataFrame:
    """sets (key, size, tokens, block, chunk) -> links found within each (block, chunk)."""
    packed = sets.withColumn("task", F.pmod(F.xxhash64("block", "chunk"), F.lit(groups)).cast("int"))
    return packed.groupBy("task").applyInArrow(_join_blocks(percent), _LINK)


def _named(placed: DataFrame, links: DataFrame) -> DataFrame:
    """(key, block, chunk, component) of the sets of large blocks, as far as they are linked."""
    found = components(links, "block-components").withColumnRenamed("node", "key")
    named = placed.select("key", "block", "chunk").join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
    return stash(named, "block-names")


def _largest(named: DataFrame, *by: str) -> DataFrame:
    return named.groupBy(*by, "component").count().groupBy(*by).agg(F.max_by("component", F.struct("count", "component")).alias("component"))


def _pieces(n: str, chunk: int):
    return F.ceil(F.col(n) / chunk).cast("long")


def _pairs(placed: DataFrame, prefixes: DataFrame, named: DataFrame, chunk: int) -> DataFrame:
    """What may still be linked, as (key, size, tokens, block, component, chunk, other, probe).

    Two linked sets share a shingle of their prefixes, so a missing link has one that several components hold, and only
    sets with such a shingle are open. One end of the link is outside the main component: the open sets outside it are
    dealt out to chunks of probes, all open sets to chunks of a trie, and every two of these chunks make a pair.
    """
    token = prefixes.join(named.select("key", "component"), "key")
    spans = token.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("token")
    open_ = named.join(token.join(spans, "token", "left_semi").select("key").distinct(), "key", "left_semi")
    main = _largest(named, "block").withColumnRenamed("component", "main")
    open_ = stash(open_.join(main, "block").select("key", "block", "component", (F.col("component") != F.col("main")).alias("outside")), "open-sets")
    held = open_.groupBy("block").agg(F.count("*").alias("n"), F.count_if("outside").alias("m")).select("block", _pieces("n", chunk).alias("tries"), _pieces("m", chunk).alias("probes")).filter("probes > 0")
    sets = open_.join(held, "block").join(placed.select("key", "size", "tokens"), "key")

    def dealt(df: DataFrame, own: str, own_n: str, other: str, other_n: str, probe: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("key", F.lit(own)), F.col(own_n)).alias(own)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_n) - 1)).alias(other)
        return df.select("key", "size", "tokens", "block", "component", mine, every, F.lit(probe).alias("probe"))

    return dealt(sets.filter("outside"), "other", "probes", "chunk", "tries", True).unionByName(dealt(sets, "chunk", "tries", "other", "probes", False))


def _across(placed: DataFrame, prefixes: DataFrame, links: DataFrame, percent: int, chunk: int, groups: int) -> DataFrame:
    """Links between the chunks of large blocks, besides those given.

    Chunk-wise joins leave one large component in each chunk. A few members of each are joined, then a few of the
    largest component of every `few` chunks, of every `few` times `few`, and so on up to the whole block, so that what
    is well connected becomes one main component of the block. Links that are still missing are found in pairs of chunks.
    """
    few = max(2, chunk // 64)
    keep = max(1, chunk // few)
    links = stash(links.join(placed.select(F.col("key").alias("u")), "u", "left_semi"), "links")
    named = _named(placed, links)
    width, most = 1, placed.agg(F.max("chunks")).first()[0]
    while width < most:
        parts = named.withColumn("part", F.floor(F.col("chunk") / width))
        order = Window.partitionBy("block", "part").orderBy(F.xxhash64("key", F.lit("few")), "key")
        chosen = parts.join(_largest(parts, "block", "part"), ["block", "part", "component"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
        width *= few
        sample = chosen.select("key").join(placed, "key").select("key", "size", "tokens", "block", F.floor(F.col("chunk") / width).alias("chunk"))
        links = stash(links.union(_joined(sample, percent, groups)), "links")
        named = _named(placed, links)
    last = _pairs(placed, prefixes, named, chunk).groupBy("block", "chunk", "other").applyInArrow(_join_pairs(percent), _LINK)
    return links.union(last)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """(key, n_shingles, component_id) for every row of docs.

    Two texts are linked when 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    key that links reach. Null and wordless texts have no shingles and stand alone. Equal sets are linked by their
    equality. Repeated rows come back as often as they came, with one component; rows with a null key are left out of
    no step but count as key null: their component is the smallest key of their class, or null if there is none.
    Keys must be whole numbers. Other columns of docs are ignored. Empty input gives no rows. Two shingles are equal if
    their 64-bit hashes are.
    """
    found = _placed_rows(docs, key, text, words, percent, chunk)
    own = F.when(F.col("id") > NO_KEY, F.col("id"))
    first = F.when(F.col("head.id") < NULL_KEY, F.col("head.id"))
    return found.select(own.alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, first).otherwise(own).alias("component_id"))


def _placed_rows(docs: DataFrame, key: str, text: str, words: int, percent: int, chunk: int) -> DataFrame:
    """(id, text_hash, n_shingles, head) for every row of docs; head is the smallest (id, text_hash) of its component.

    A null key is NO_KEY in id and, so that it comes last, NULL_KEY in head. Rows without shingles have no head.
    """
    spark = docs.sparkSession
    small_batches(spark)
    thin = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    total = thin.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(MOST_RANGES, max(LEAST_RANGES, total // RANGE_BYTES)))
    rows = thin.mapInArrow(_explode_texts(parts), _ROW)
    counted = stash(rows.groupBy("part").applyInArrow(_count_range(parts), _SHARED), "shingle-counts")
    sets = stash(counted.filter("kind = 1").groupBy("grp").applyInArrow(_survivors(percent), _SET), "shingle-sets")

    one = sets.select("key", F.explode("prefix").alias("token"))
    hub = one.groupBy("token").agg(F.min("key").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("token", "hub")
    block = components(one.join(hub, "token").filter("key <> hub").select(F.col("key").alias("u"), F.col("hub").alias("v")), "candidate-blocks")
    held = block.groupBy("component").agg(F.count("*").alias("n")).select(F.col("component"), F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    placed = sets.drop("prefix").join(block.withColumnRenamed("node", "key"), "key").join(held, "component").withColumnRenamed("component", "block")
    placed = stash(placed.withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks").cast("long")), "shingle-blocks")
    links = stash(_joined(placed.select("key", "size", "tokens", "block", "chunk"), percent, parts), "links")
    if not placed.filter("chunks > 1").isEmpty():
        links = stash(_across(placed.filter("chunks > 1"), one, links, percent, chunk, parts).unionByName(links), "links")
    joined = components(links, "near-duplicates").withColumnRenamed("node", "set_key")

    ids = counted.filter("kind = 0").select("ids", "texts", "sizes", "keys").mapInArrow(_unpack, "id long, text_hash long, n_shingles long, set_key long")
    row = F.struct(F.when(F.col("id") > NO_KEY, F.col("id")).otherwise(NULL_KEY).alias("id"), "text_hash")
    classes = ids.filter("n_shingles > 0").groupBy("set_key").agg(F.min(row).alias("first"))
    named = classes.join(joined, "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    reach = named.groupBy("component").agg(F.min("first").alias("head"))
    named = named.join(reach, "component").select("set_key", "head")
    return ids.join(named, "set_key", "left").select("id", "text_hash", "n_shingles", "head")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for packed in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in packed], names=["id", "text_hash", "n_shingles", "set_key"])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """One row of each component of near_duplicates(): its smallest key's, null keys last; of several the smallest hash of the text.

    Rows are told apart by key and text, so of rows that share a key those that are copies of nothing stay. Of rows that
    repeat key and text one stays, the smallest by a hash of all columns. Rows without words are copies of nothing and all stay.
    """
    found = _placed_rows(docs, key, text, words, percent, chunk)
    heads = found.filter("n_shingles > 0").select("head.*").distinct().select(F.col("id").alias("_id"), F.col("text_hash").alias("_text"))
    has_words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = docs.filter(has_words).select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("_id"), F.xxhash64(text).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = named.join(heads, ["_id", "_text"], "left_semi").groupBy("_id", "_text").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return kept.select("_row.*").unionByName(docs.filter(~has_words))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
