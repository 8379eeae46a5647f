"""Lexical retrieval packing: sequences of related documents with almost no padding.

Texts become token ids. A document's full windows are sequences of their own; what remains of it is packed. Remainders
are routed to shards so that lexically close ones tend to meet (by the sides on which they lie of the medians of their
weighted terms' principal components, evened out to SHARD documents each). A shard holds an inverted index of its remainders with BM25 weights from
the whole corpus. A seed document opens a window; the index returns its unused neighbours, which fill the window up;
the one that crosses its end is cut and opens the next. Only a shard's last sequence has room left.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash, table

WINDOW = 2048
END = 1
VOCABULARY = 1 << 16
#: Remainders in a shard's index, on average; bits of the routing key.
SHARD = 384
KEY_BITS = 16
#: Remainders that the components are learnt from, about, by hash of id and ids; terms that they are learnt for. Every
#: remainder is routed and indexed.
SAMPLE, SAMPLE_TERMS = 1024, 4096
K1, B = 1.2, 0.75
SEED = 77
# Fixed value: the pre-tokenizer of byte_bpe_50k, without the branch that only runs of white space need.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_ASCII_SPACES = "".join(filter(str.isascii, _SPACES))
#: Characters of a word beyond which the faster form would take time out of proportion.
LONG_WORD = 20_000
_SPECIAL = "<|endoftext|>"
_LOADED: dict[str, tuple] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _load(path: str) -> tuple:
    """The tokenizer itself and a faster form of the same vocabulary for texts in which no white space runs."""
    if path not in _LOADED:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        whole = Tokenizer.from_file(path)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        with open(path, encoding="utf-8") as f:
            words = json.load(f)["model"]["vocab"]
        ranks = {bytes(byte[c] for c in w): i for w, i in words.items() if w != _SPECIAL}
        # No text with the special token comes here, but without one the search for it would find nothing at every byte, which takes as long as the rest.
        _LOADED[path] = whole, tiktoken.Encoding("packing", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={_SPECIAL: words.get(_SPECIAL, len(words))})
    return _LOADED[path]


def _runs(text: str) -> bool:
    """Whether two white spaces stand together, told in less time than a search by pattern takes."""
    held = [c for c in (_ASCII_SPACES if text.isascii() else _SPACES) if c in text]
    return any(a + b in text for a in held for b in held)


def _long_word(text: str) -> bool:
    """Whether a word has more than LONG_WORD characters; it would fill a stretch of half as many."""
    half = LONG_WORD // 2
    full = any(len(text[i : i + half].split(None, 1)) < 2 for i in range(0, len(text) - half + 1, half))
    return full and max(map(len, text.split()), default=0) > LONG_WORD


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each text (uint16) as the tokenizer of `path` gives them without special tokens, then END."""
    whole, fast = _load(path)
    out = []
    for t in texts:
        if _runs(t) or _SPECIAL in t or _long_word(t):
            ids = np.array(whole.encode(t, add_special_tokens=False).ids, np.uint16)
        else:
            ids = fast.encode_to_numpy(t, disallowed_special=()).astype(np.uint16)
        out.append(np.append(ids, np.uint16(END)))
    return out


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_TOKENS = "kind int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, counts binary"
_TOKENS_ARROW = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")], ("ids", pa.binary()), ("counts", pa.binary())])


def _tokenize(path: str, window: int):
    """(id, text) -> kind 0: a full window; kind 1: a remainder with its ids; kind 2: a task's document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, tokens = np.zeros(VOCABULARY, np.int64), 0, 0
        for b in batches:
            rows = []
            for key, ids in zip(b.column(0).to_pylist(), token_ids([t or "" for t in b.column(1).to_pylist()], path), strict=True):
                m = len(ids)
                seen = np.zeros(VOCABULARY, bool) if m > 8192 else None
                if seen is None:
                    df[np.unique(ids)] += 1
                else:
                    seen[ids] = True
                    df += seen
                n, tokens = n + 1, tokens + m
                full = m // window * window
                rows += [(0, key, s, window, checksum(ids[s : s + window]), m, None, None) for s in range(0, full, window)]
                if full < m:
                    rows.append((1, key, full, m - full, 0, m, ids[full:].tobytes(), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TOKENS_ARROW, strict=True)], schema=_TOKENS_ARROW) if rows else pa.RecordBatch.from_pylist([], schema=_TOKENS_ARROW)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_pylist([{"kind": 2, "length": n, "doc_tokens": tokens, "ids": used.astype(np.uint16).tobytes(), "counts": df[used].tobytes()}], schema=_TOKENS_ARROW)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.uint16).astype(np.int32)), pa.array(np.frombuffer(counts, np.int64))], names=["term", "df"])


def corpus_statistics(tokens: DataFrame) -> tuple[np.ndarray, float]:
    """BM25's inverse document frequency of every id of the vocabulary, and the mean length, over all documents."""
    n, total = tokens.filter("kind = 2").agg(F.sum("length"), F.sum("doc_tokens")).first()
    summed = tokens.filter("kind = 2").select("ids", "counts").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # one row per id of the vocabulary
    df = np.zeros(VOCABULARY)
    for term, count in summed:
        df[term] = count
    n = n or 0
    return np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), (total or 0) / max(1, n)


def _weighted(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms and their saturated weights, as a vector of length 1."""
    t, c = np.unique(ids, return_counts=True)
    v = idf[t] * (c / (c + K1))
    return t, v / max(float(np.sqrt(v @ v)), 1e-9)


def components(docs: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The KEY_BITS first principal components of the documents' weighted terms: terms, a row of components for each, and
    the components' medians. Components that there are not, are zero."""
    vectors = [_weighted(d, idf) for d in docs]
    seen = np.zeros(VOCABULARY)
    for t, v in vectors:
        seen[t] += v * v
    terms = np.sort(np.argsort(-seen, kind="stable")[: min(SAMPLE_TERMS, int((seen > 0).sum()))])
    x = np.zeros((len(docs), len(terms)), np.float32)
    for row, (t, v) in zip(x, vectors, strict=True):
        known = np.isin(t, terms, assume_unique=True)
        row[np.searchsorted(terms, t[known])] = v[known]
    middle = x.mean(0)
    y = (x - middle) @ np.random.default_rng(SEED).standard_normal((len(terms), 2 * KEY_BITS)).astype(np.float32)
    for _ in range(4):  # subspace iteration
        q = np.linalg.qr(y)[0]
        y = (x - middle) @ ((x - middle).T @ q)
    axes = np.linalg.svd(np.linalg.qr(y)[0].T @ (x - middle), full_matrices=False)[2][:KEY_BITS].T
    axes = np.pad(axes, ((0, 0), (0, KEY_BITS - axes.shape[1])))
    return terms, axes, np.median(x @ axes, axis=0)


_AXES = pa.schema([("terms", pa.binary()), ("axes", pa.binary()), ("medians", pa.binary())])


def routing(rest: DataFrame, mark: Column, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of KEY_BITS weights for each id of the vocabulary, and the medians, learnt in one task from about SAMPLE
    different remainders."""

    def learn(t: pa.Table) -> pa.Table:
        ids = sorted(t["ids"].to_pylist())
        out = components([np.frombuffer(x, np.uint16) for x in ids], idf)
        return pa.Table.from_arrays([pa.array([x.tobytes()]) for x in (out[0].astype(np.uint16), out[1].astype(np.float32), out[2].astype(np.float32))], schema=_AXES)

    u = F.pmod(mark, F.lit(1 << 30)) / float(1 << 30)
    chosen = rest.filter(u < SAMPLE / max(1, rest.count())).groupBy(mark.alias("mark")).agg(F.min("ids").alias("ids"))
    weights, medians = np.zeros((VOCABULARY, KEY_BITS), np.float32), np.zeros(KEY_BITS, np.float32)
    for r in chosen.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "terms binary, axes binary, medians binary").collect():  # one row at most
        weights[np.frombuffer(r["terms"], np.uint16)] = np.frombuffer(r["axes"], np.float32).reshape(-1, KEY_BITS)
        medians = np.frombuffer(r["medians"], np.float32)
    return weights, medians


def _routed(idf: np.ndarray, weights: np.ndarray, medians: np.ndarray):
    """Adds the routing key of a remainder: a bit for each component that is above its median, the first one leading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for ids in b.column("ids").to_pylist():
                t, v = _weighted(np.frombuffer(ids, np.uint16), idf)
                keys.append(int((v.astype(np.float32) @ weights[t] > medians) @ (1 << np.arange(KEY_BITS)[::-1])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int32())], names=[*b.schema.names, "key"])

    return run


def fill_windows(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pack one shard: (document, start, length, sequence, offset) of every piece, in order."""
    n = len(docs)
    terms, tf, owner = [], [], []
    for i, ids in enumerate(docs):
        t, c = np.unique(ids, return_counts=True)
        terms.append(t)
        tf.append(c)
        owner.append(np.full(len(t), i, np.int32))
    own = terms
    size = np.array([len(d) for d in docs], np.float32)
    t, c, o = np.concatenate(terms), np.concatenate(tf).astype(np.float32), np.concatenate(owner)
    weight = idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * size[o] / max(mean, 1.0)))
    order = np.argsort(t, kind="stable")
    t, o, weight = t[order], o[order], weight[order]
    held = np.bincount(t, minlength=VOCABULARY)
    begin = np.cumsum(held) - held

    def scores_of(i: int) -> np.ndarray:
        """BM25 of every document for all distinct terms of document i."""
        a, many = begin[own[i]], held[own[i]]
        hits = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.bincount(o[hits], weight[hits], minlength=n)

    unused = np.ones(n, bool)
    lead = np.argsort(-size, kind="stable")  # seeds: the longest first
    at_lead = 0
    out: list[tuple[int, int, int, int, int]] = []
    sequence, offset = 0, 0

    def put(i: int) -> None:
        nonlocal sequence, offset
        start = 0
        while start < len(docs[i]):
            take = min(len(docs[i]) - start, window - offset)
            out.append((i, start, take, sequence, offset))
            start, offset = start + take, offset + take
            if offset == window:
                sequence, offset = sequence + 1, 0
        unused[i] = False

    left = n
    seed = int(lead[0])
    put(seed)
    left -= 1
    while left:
        scores = scores_of(seed)
        scores[~unused] = -1
        ranked = iter(np.argsort(-scores, kind="stable"))
        now, i = sequence, seed
        while left and sequence == now:
            i = int(next(ranked))
            put(i)
            left -= 1
        if offset:
            seed = i  # its rest has opened the next window
        elif left:
            while not unused[lead[at_lead]]:
                at_lead += 1
            seed = int(lead[at_lead])
            put(seed)
            left -= 1
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _pack(idf: np.ndarray, mean: float, window: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "start", "doc_tokens", "ids")])
        docs = [np.frombuffer(x, np.uint16) for x in t["ids"].to_pylist()]
        pieces = fill_windows(docs, idf, mean, window)
        i, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
        rows = t.take(pa.array(i))
        crc = [checksum(docs[a][s : s + n]) for a, s, n, _, _ in pieces]
        base = int(t["shard"][0].as_py()) << 32
        return pa.Table.from_arrays([rows["doc_id"], pa.array(rows["start"].to_numpy() + start), pa.array(length), pa.array(crc, pa.int64()), rows["doc_tokens"], pa.array(base + sequence), pa.array(offset)], schema=_PIECES_ARROW)

    return run


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of docs is a document of its own, also if its key repeats or is null; a null or empty text is one id.
    Each id lies in one piece; sequences hold `window` ids but for the last of each shard. Empty input gives no rows;
    other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tokens = stash(rows.mapInArrow(_tokenize(tokenizer or tokenizer_path(), window), _TOKENS).withColumn("row", F.monotonically_increasing_id()), "tokens")
    idf, mean = corpus_statistics(tokens)
    rest = tokens.filter("kind = 1").select("doc_id", "start", "length", "doc_tokens", "ids", "row")
    mark = F.xxhash64("doc_id", "start", "doc_tokens", "ids")
    weights, medians = routing(rest, mark, idf)
    keyed = rest.withColumn("mark", mark).mapInArrow(_routed(idf, weights, medians), "doc_id long, start long, length long, doc_tokens long, ids binary, row long, mark long, key int")
    keyed = stash(keyed, "keyed")
    counts = sorted((r["key"], r["count"]) for r in keyed.groupBy("key").count().collect())  # 2 ** KEY_BITS rows at most
    before = np.concatenate([[0], np.cumsum([c for _, c in counts])])
    # A key's documents are spread evenly over its stretch of the count, so no shard grows with a key; rows that repeat
    # id and text as well.
    lines = docs.sparkSession.createDataFrame([(k, int(a), int(c)) for (k, c), a in zip(counts, before, strict=False)], "key int, before long, n long")
    twins = keyed.groupBy("mark").count().filter("count > 1")
    spread = F.xxhash64("mark", F.when(F.col("count").isNotNull(), F.col("row")))
    u = F.pmod(spread, F.lit(1 << 30)) / float(1 << 30)
    shard = F.floor((F.col("before") + u * F.col("n")) / SHARD).cast("long")
    sharded = keyed.join(F.broadcast(lines), "key").join(twins, "mark", "left").select("doc_id", "start", "doc_tokens", "ids", shard.alias("shard"))
    packed = sharded.groupBy("shard").applyInArrow(_pack(idf, mean, window), _PIECES)
    own = F.lit(1 << 62) + F.monotonically_increasing_id()
    full = tokens.filter("kind = 0").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", own.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full).withColumnRenamed("doc_id", key)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return pack(table(spark, sf_dir, "documents"))
