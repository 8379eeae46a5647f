"""Exact top-k search as a Voronoi join.

Queries and data fall into the Voronoi cells of pivots. A cell is summed up by its rows, its radius, its longest vector
and the distances of its nearest rows to the pivot. From two cells' summaries follow bounds of every score between
their vectors: the k-th largest lower bound over all data cells is a floor that each query of a query cell is sure to
reach, and a data cell is needed only if its upper bound reaches the floor. Vectors of needed cells then raise the floor
and are bounded one by one; those that may still reach it are copied to the query cell. Neighbouring query cells that
need much the same data form groups. Groups are solved locally, a bounded number of queries and of data at a time, and
the best of all are merged.

Many rows may hold one vector. Of equal data vectors in a task only the k + 1 smallest ids go on, since no others can
be among any row's best; equal query vectors are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import mix, stash, table

TOP = 5
EVERY = 50
SCALE = 256
#: Pivots are drawn from the data by hash: the square root of the number of rows, between these.
LEAST_PIVOTS, MOST_PIVOTS = 16, 1024
#: Distinct queries, and data vectors on average, that meet in one task.
GROUP, SHARE = 1024, 8192
#: Queries that are multiplied with a piece of data at once, and data vectors that are bounded at once.
LINES, ROWS = 128, 2048
#: Products of pairs that cost as much as a copy of a vector.
COPY = 256
#: Beyond this magnitude sums of products might leave the integers that doubles hold exactly; there Python's are used.
EXACT = float(1 << 53)

_VECTORS = "tag long, id long, dim int, cell int, query boolean, vector binary, length double, distance double"
_VECTORS_ARROW = pa.schema([("tag", pa.int64()), ("id", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("query", pa.bool_()), ("vector", pa.binary()), ("length", pa.float64()), ("distance", pa.float64())])


def whole_numbers(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """A column of lists of doubles -> by length of list: places, and floor(SCALE * x) of the components as rows.

    Left out: null and empty lists, and those that hold null or non-finite components."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE  # null components become nan
    ends = np.cumsum(sizes)
    out = {}
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        x = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
        fine = np.isfinite(x).all(1)
        if fine.any():
            out[int(dim)] = at[fine], np.floor(x[fine]) + 0.0  # no negative zeros
    return sizes, out


def _bytes(x: np.ndarray) -> list[bytes]:
    """Each row as bytes: 4 a component where all of the row are whole numbers of 32 bits, else 8."""
    narrow = np.abs(x).max(1, initial=0) < 1 << 31
    return [row.astype(np.int32).tobytes() if n else row.tobytes() for row, n in zip(x, narrow, strict=True)]


def _stack(vectors: list[bytes], dim: int) -> np.ndarray:
    if all(len(v) == 4 * dim for v in vectors):
        return np.frombuffer(b"".join(vectors), np.int32).reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(v, np.int32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in vectors])


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and the distance from it."""
    cell = ((pivots * pivots).sum(1) / 2 - x @ pivots.T).argmin(1)
    return cell, _lengths(x - pivots[cell])


def _read(pivots: dict[int, np.ndarray], every: int, k: int):
    """(tag, id, vector) -> rows with their cells. Data rows of one vector: the k + 1 smallest ids of a batch, and where a
    batch has more than that, of the task. Query rows come besides, marked so, all of them."""

    def rows(tag, ids, dim, cell, query, x, length, distance) -> pa.RecordBatch:
        n = len(tag)
        return pa.RecordBatch.from_arrays([pa.array(tag), pa.array(ids), pa.array(np.full(n, dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(np.full(n, query)), pa.array(_bytes(x), pa.binary()), pa.array(length), pa.array(distance)], schema=_VECTORS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: dict[tuple, list] = {}  # vectors that a batch held more than k + 1 times: their smallest (id, tag)
        for b in batches:
            tags, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            for dim, (at, x) in whole_numbers(b.column(2))[1].items():
                tag, ids = tags[at], keys[at]
                cell, distance = _nearest(x, pivots[dim] if dim in pivots else np.zeros((1, dim)))
                length = _lengths(x)
                q = ids % every == 0
                if q.any():
                    yield rows(tag[q], ids[q], dim, cell[q], True, x[q], length[q], distance[q])
                _, first, of = np.unique(x.view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
                order = np.lexsort((tag, ids, of))
                start = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
                rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
                keep = order[rank <= k]
                many = np.bincount(of) > k + 1
                hot = {c: (dim, x[first[c]].tobytes()) for c in np.flatnonzero(many)}
                if common:
                    hot |= {c: key for c in range(len(first)) if (key := (dim, x[first[c]].tobytes())) in common}
                for c, key in hot.items():
                    own = keep[of[keep] == c]
                    common[key] = sorted([*common.get(key, []), *zip(ids[own].tolist(), tag[own].tolist(), cell[own].tolist(), length[own].tolist(), distance[own].tolist(), strict=True)])[: k + 1]
                if hot:
                    keep = keep[~np.isin(of[keep], list(hot))]
                if len(keep):
                    yield rows(tag[keep], ids[keep], dim, cell[keep], False, x[keep], length[keep], distance[keep])
        for (dim, vector), held in common.items():
            ids, tag, cell, length, distance = (np.array(c) for c in zip(*held, strict=True))
            yield rows(tag, ids, dim, cell, False, np.tile(np.frombuffer(vector), (len(ids), 1)), length, distance)

    return run


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, places, vectors) of a batch."""
    dims, vectors = b.column("dim").to_numpy(), b.column("vector").to_pylist()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, _stack([vectors[i] for i in at], int(dim))


_CELLS = "dim int, cell int, query boolean, n long, radius double, longest double, nearest array<double>"
_CELLS_ARROW = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("query", pa.bool_()), ("n", pa.int64()), ("radius", pa.float64()), ("longest", pa.float64()), ("nearest", pa.list_(pa.float64()))])


def _summaries(k: int):
    """A task's part of each cell's summary: rows, largest distance from the pivot, longest vector, k + 1 smallest distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for b in batches:
            t = pa.Table.from_batches([b]).to_pandas()
            for key, g in t.groupby(["dim", "cell", "query"]):
                n, radius, longest, near = held.get(key, (0, 0.0, 0.0, []))
                held[key] = (n + len(g), max(radius, g["distance"].max()), max(longest, g["length"].max()), sorted([*near, *g["distance"].nsmallest(k + 1)])[: k + 1])
        out = [{"dim": int(d), "cell": int(c), "query": bool(q), "n": n, "radius": r, "longest": m, "nearest": near} for (d, c, q), (n, r, m, near) in held.items()]
        yield pa.RecordBatch.from_pylist(out, schema=_CELLS_ARROW)

    return run


class Cells:
    """The pivots of one dimension, the summaries of their query and data cells, and what follows from them."""

    def __init__(self, pivots: np.ndarray, rows: list, k: int):
        n = len(pivots)
        self.pivots = pivots
        self.queries, self.rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.reach, q_longest, self.radius, longest = (np.zeros(n) for _ in range(4))
        near = np.full((n, k + 1), np.inf)
        for r in rows:
            c = r["cell"]
            if r["query"]:
                self.queries[c], self.reach[c], q_longest[c] = r["n"], r["radius"], r["longest"]
            else:
                self.rows[c], self.radius[c], longest[c] = r["n"], r["radius"], r["longest"]
                near[c, : len(r["nearest"])] = r["nearest"]
        size = _lengths(pivots)
        middle = pivots @ pivots.T
        # q = pivot + e, x = pivot + f: their product is middle + pivot * f + e * x, and half of |q|^2 + |x|^2 - |q - x|^2.
        off = np.outer(size, self.radius) + np.outer(self.reach, longest)
        apart = np.stack([_lengths(p - pivots) for p in pivots])
        gap = np.maximum(0, apart - self.reach[:, None] - self.radius)
        squares = (q_longest**2)[:, None] + longest**2
        high = np.minimum(middle + off, (squares - gap**2) / 2) + (np.abs(middle) + off + squares) * 1e-9 + 1e-3
        self.floor = np.full(n, -np.inf)
        for a in np.flatnonzero(self.queries):
            with np.errstate(invalid="ignore"):
                low = middle[a][:, None] - size[a] * near - self.reach[a] * (size[:, None] + near)
                low = low - (np.abs(middle[a])[:, None] + size[a] * near + self.reach[a] * (size[:, None] + near)) * 1e-9 - 1e-3
            low = low[np.isfinite(near)]
            if len(low) > k:
                self.floor[a] = np.partition(low, -(k + 1))[-(k + 1)]
        self.high = high
        self.needed = (high >= self.floor[:, None]) & (self.queries > 0)[:, None] & (self.rows > 0)

    def scores(self, cell: np.ndarray, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores between data vectors (rows) and all queries of each cell (columns); minus
        infinity where the cell does not need the vector's cell."""
        middle, off = x @ self.pivots.T, np.outer(lengths, self.reach)
        slack = (np.abs(middle) + off) * 1e-9 + 1e-3
        needed = self.needed[:, cell].T
        return np.where(needed, middle - off - slack, -np.inf), np.where(needed, middle + off + slack, -np.inf)

    def group(self, most: int) -> list[list[int]]:
        """Query cells, neighbours by neighbours, in groups of `most` queries at most or of one cell.

        A cell joins its neighbour's group if the data rows that need not be copied twice outweigh the pairs that are
        multiplied in vain; a copied row is worth COPY pairs.
        """
        left = np.flatnonzero(self.queries).tolist()
        out: list[list[int]] = []
        held, union = 0, np.zeros(len(self.rows), bool)
        now = left.pop(0)
        while True:
            n, need = int(self.queries[now]), self.needed[now]
            both = int(self.rows[union | need].sum())
            a, b = int(self.rows[union].sum()), int(self.rows[need].sum())
            if out and held + n <= most and (a + b - both) * COPY >= held * (both - a) + n * (both - b):
                out[-1].append(now)
                held, union = held + n, union | need
            else:
                out.append([now])
                held, union = n, need.copy()
            if not left:
                return out
            now = left.pop(int(_lengths(self.pivots[left] - self.pivots[now]).argmin()))


def _pieces(b: pa.RecordBatch, cells: dict[int, Cells]) -> Iterator[tuple[int, Cells, np.ndarray, np.ndarray, tuple]]:
    """(dim, cells, places in the batch, vectors, their bounds), some rows at a time."""
    of, lengths = b.column("cell").to_numpy(), b.column("length").to_numpy()
    for dim, at, x in _by_dim(b):
        if own := cells.get(dim):
            for i in range(0, len(at), ROWS):
                some = at[i : i + ROWS]
                yield dim, own, some, x[i : i + ROWS], own.scores(of[some], x[i : i + ROWS], lengths[some])


def _floors(cells: dict[int, Cells], k: int):
    """Data -> for each query cell the k + 1 largest lower bounds that a task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: np.full((k + 1, len(c.pivots)), -np.inf) for d, c in cells.items()}
        for b in batches:
            for dim, _, _, _, (low, _) in _pieces(b, cells):
                best[dim] = np.partition(np.concatenate([best[dim], low]), -(k + 1), axis=0)[-(k + 1) :]
        for dim, low in best.items():
            _, a = np.nonzero(np.isfinite(low))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), dim, np.int32)), pa.array(a.astype(np.int32)), pa.array(low[np.isfinite(low)])], names=["dim", "cell", "low"])

    return run


_AIMED = "grp int, share int, n long, tags binary, ids binary, vectors binary"
_AIMED_ARROW = pa.schema([("grp", pa.int32()), ("share", pa.int32()), ("n", pa.int64()), ("tags", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary())])
Groups = dict[int, list[tuple[int, list[int], int]]]


def _aim(cells: dict[int, Cells], groups: Groups):
    """Data -> a copy for each group with a cell whose floor a vector may reach; groups are (name, cells, shares) by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tags, ids = b.column("tag").to_numpy(), b.column("id").to_numpy()
            for dim, own, at, x, (_, high) in _pieces(b, cells):
                reached = high >= np.maximum(own.floor, np.finfo(float).min)
                share = int(mix(tags[at[:1]].astype(np.uint64))[0] >> np.uint64(1))
                packed = x.astype(np.int32) if np.abs(x).max() < 1 << 31 else x
                out = []
                for name, members, shares in groups[dim]:
                    need = reached[:, members].any(1)
                    if need.any():
                        out.append({"grp": name, "share": share % shares, "n": int(need.sum()), "tags": tags[at[need]].tobytes(), "ids": ids[at[need]].tobytes(), "vectors": packed[need].tobytes()})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_AIMED_ARROW)

    return run


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; int64 or, where doubles might not hold these, Python integers."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] >= EXACT:
        exact = lambda m: np.array([[int(v) for v in row] for row in m], object)
        return exact(q) @ exact(x).T
    return (q @ x.T).astype(np.int64)


_FOUND = "query long, tag long, vec_id long, score long"
_FOUND_ARROW = pa.schema([("query", pa.int64()), ("tag", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _solve(k: int):
    """Some queries of a cell and a share of its data -> each query's best k + 1 there."""

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(queries) and len(data):
            dim, names = queries["dim"][0].as_py(), queries["query"].to_numpy()
            q = _stack(queries["vector"].to_pylist(), dim)
            for tags, ids, n, vectors in zip(*(data[c].to_pylist() for c in ("tags", "ids", "n", "vectors")), strict=True):
                ids, tags = np.frombuffer(ids, np.int64), np.frombuffer(tags, np.int64)
                x = np.frombuffer(vectors, np.int32 if len(vectors) == 4 * dim * n else np.float64).reshape(-1, dim).astype(np.float64)
                order = np.lexsort((tags, ids))
                ids, tags, x = ids[order], tags[order], x[order]
                for first in range(0, len(q), LINES):
                    for name, line in zip(names[first : first + LINES], products(q[first : first + LINES], x), strict=True):
                        near = np.arange(len(ids)) if len(ids) <= k + 1 else np.flatnonzero(line >= np.partition(line, -(k + 1))[-(k + 1)])
                        best = near[np.argsort(-line[near], kind="stable")][: k + 1]
                        for c, v in zip(out, (np.full(len(best), name), tags[best], ids[best], np.array([int(s) for s in line[best]], np.int64)), strict=True):
                            c.append(v)
        return pa.Table.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in out], schema=_FOUND_ARROW)

    return run


def _pivots(plain: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Pivots by dimension: the vectors of n rows drawn by hash, MOST_PIVOTS at most."""
    many = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, n**0.5)))
    drawn = plain.orderBy(F.xxhash64("id", "v", F.lit("pivot")), "id").limit(many).select("v").collect()
    found = whole_numbers(pa.array([r["v"] for r in drawn], pa.list_(pa.float64())))[1]
    return {d: np.unique(x, axis=0) for d, (_, x) in found.items()}


def top_k(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = TOP, every: int = EVERY, group: int = GROUP, share: int = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose key `every` divides, the k other rows that score best.

    Components count as floor(256 * x). Ties go to the smaller key. Vectors that are null or empty or hold null or
    non-finite components take no part, nor do null keys; only vectors of one length are compared. Rows that repeat a
    key are rows of their own, also as queries: each has ranks of its own, and the others of its key are candidates.
    Scores beyond 64 bits are an error. Empty input gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    pivots = _pivots(plain, plain.count())
    tagged = plain.select(F.monotonically_increasing_id().alias("tag"), "id", "v")  # written below, so a row keeps its tag
    read = stash(tagged.mapInArrow(_read(pivots, every, k), _VECTORS), "vectors")
    data = read.filter("not query")

    # A row for each cell of each kind, MOST_PIVOTS cells at most for each dimension.
    partial = read.select("dim", "cell", "query", "length", "distance").mapInArrow(_summaries(k), _CELLS)
    summed = partial.groupBy("dim", "cell", "query").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("longest").alias("longest"), F.slice(F.array_sort(F.flatten(F.collect_list("nearest"))), 1, k + 1).alias("nearest"))
    by_dim: dict[int, list] = {}
    for r in summed.collect():
        by_dim.setdefault(r["dim"], []).append(r)
    cells = {d: Cells(pivots[d] if d in pivots else np.zeros((1, d)), rows, k) for d, rows in by_dim.items() if any(r["query"] for r in rows)}
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    # The query's own row may be among the best, so the floor is the (k + 1)th largest lower bound.
    low = data.mapInArrow(_floors(cells, k), "dim int, cell int, low double")
    ranked = low.withColumn("r", F.row_number().over(W.partitionBy("dim", "cell").orderBy(F.desc("low")))).filter(F.col("r") == k + 1)
    for r in ranked.collect():
        cells[r["dim"]].floor[r["cell"]] = max(cells[r["dim"]].floor[r["cell"]], r["low"])

    for c in cells.values():
        c.needed &= c.high >= c.floor[:, None]

    # Equal query vectors are one query. A group of several cells is one part; a large cell's queries are dealt out by hash.
    queries = read.filter("query").select("tag", "id", "dim", "cell", "vector")
    distinct = stash(queries.select("dim", "cell", "vector").distinct().withColumn("query", F.monotonically_increasing_id()), "query-vectors")
    for c in cells.values():
        c.queries[:] = 0
    for r in distinct.groupBy("dim", "cell").count().collect():
        cells[r["dim"]].queries[r["cell"]] = r["count"]
    groups: Groups = {}
    lines, name = [], 0
    for d, c in cells.items():
        for members in c.group(group):
            shares = int(max(1, -(-c.rows[c.needed[members].any(0)].sum() // share)))
            groups.setdefault(d, []).append((name, members, shares))
            lines += [(d, a, name, int(-(-c.queries[members].sum() // group)), shares) for a in members]
            name += 1
    spread = spark.createDataFrame(lines, "dim int, cell int, grp int, parts int, shares int")
    number = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = distinct.join(F.broadcast(spread), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int")).withColumn("share", number("shares"))
    aimed = data.mapInArrow(_aim(cells, groups), _AIMED).join(F.broadcast(spread.select("grp", "parts").distinct()), "grp").withColumn("part", number("parts"))
    by = ["grp", "part", "share"]
    found = asked.select(*by, "dim", "query", "vector").groupBy(*by).cogroup(aimed.select(*by, "n", "tags", "ids", "vectors").groupBy(*by)).applyInArrow(_solve(k), _FOUND)
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "tag")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    lists = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "tag", "vec_id", "score"))).alias("best"))
    own = queries.join(distinct, ["dim", "cell", "vector"]).select("query", F.col("tag").alias("own"), F.col("id").alias("query_id"))
    others = F.slice(F.filter("best", lambda b: b["tag"] != F.col("own")), 1, k)
    out = own.join(lists, "query").select("query_id", F.posexplode(others).alias("p", "b"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), "b.vec_id", "b.score")


def op6_knn(spark, sf_dir: str) -> DataFrame:
    """The 5 best rows for every row of `embeddings` whose vec_id 50 divides."""
    return top_k(table(spark, sf_dir, "embeddings"))
