"""Merkle manifest of a dataset: one root over all documents, and for each document the proof that it belongs there.

Documents are leaves of a tree of their group (a source), whose roots are leaves of one more tree. A tree is cut into
aligned blocks of ARITY ** LEVELS leaves. Roots of blocks are the leaves of the next blocks above, up to the top. Proofs come on
the way down: within a block by fractal traversal, which emits the authentication path of one leaf after the other from
the subtrees it has stacked, while it builds those that it will need next; what its block's root needs above is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table

#: Children of a node, and levels of a block and of each of its subtrees.
ARITY, LEVELS, HEIGHT = 3, 6, 2
PATH = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_over(n: int) -> int:
    """Levels between n leaves and their root; none for one leaf."""
    levels = 0
    while n > 1:
        levels, n = levels + 1, -(-n // ARITY)
    return levels


class Subtree:
    """The nodes of levels low to high - 1 over the leaves [first, end) of a block, built one leaf at a time.

    Besides these nodes only those are held that wait for the rest of their run: less than ARITY a level.
    """

    def __init__(self, leaves: Sequence[str], first: int, low: int, high: int):
        self.leaves, self.at, self.low, self.high = leaves, first, low, high
        self.end = min(len(leaves), first + ARITY**high)
        self.nodes: dict[tuple[int, int], str] = {}
        self.waiting: list[list[str]] = [[] for _ in range(high)]

    def grow(self) -> bool:
        """Take in the next leaf; False when there is none left."""
        if self.at >= self.end:
            return False
        node, i, of = self.leaves[self.at], self.at, len(self.leaves)
        self.at += 1
        for level in range(self.high):
            if level >= self.low:
                self.nodes[level, i] = node
            run = self.waiting[level]
            run.append(node)
            if i % ARITY != ARITY - 1 and i != of - 1:
                return True
            if level + 1 < self.high:
                node = digest("".join(run))
            run.clear()
            i, of = i // ARITY, -(-of // ARITY)
        return True


def root_of(leaves: Sequence[str], levels: int) -> str:
    tree = Subtree(leaves, 0, levels, levels + 1)
    while tree.grow():
        pass
    return tree.nodes[levels, 0]


def traverse(leaves: Sequence[str], levels: int, height: int = HEIGHT) -> Iterator[list[dict[str, str]]]:
    """For each leaf in turn the siblings left and right of its path at every level, the lowest first.

    Per tier of `height` levels there is the existing subtree that the path runs through and the desired one to its right,
    which grows by one leaf for each path emitted and so is whole when the path enters it.
    """
    tiers = [(low, min(levels, low + height)) for low in range(0, levels, height)]
    existing = [Subtree(leaves, 0, low, high) for low, high in tiers]
    for tree in existing:
        while tree.grow():
            pass
    desired = [Subtree(leaves, tree.end, tree.low, tree.high) for tree in existing]
    for leaf in range(len(leaves)):
        path = []
        for k, (low, high) in enumerate(tiers):
            if leaf and leaf % ARITY**high == 0:
                existing[k] = desired[k]
                desired[k] = Subtree(leaves, existing[k].end, low, high)
            desired[k].grow()
            nodes = existing[k].nodes
            for level in range(low, high):
                i = leaf // ARITY**level
                first = i - i % ARITY
                path.append({"left": "".join(nodes[level, j] for j in range(first, i)), "right": "".join(nodes[level, j] for j in range(i + 1, first + ARITY) if (level, j) in nodes)})
        yield path


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with place (from 0 within the group, by `order`, nulls first) and n (rows of the group), without a window over a
    group: rows are dealt by ranges of group and order, so that a hot group spreads, and counted by range."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    # Rows that agree in all keys are alike for the tree; a number spreads them over ranges.
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row")
    dealt = stash(dealt.drop("_row").withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(part.alias("_part"), F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    over = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", "_group", "_first", before.alias("_before"), F.sum("_n").over(over).alias("n"))
    joined = dealt.join(counts, (part == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_group", "_first", "_before")


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
    """The rows of a batch of blocks one by one, so that one block's leaves are Python objects at a time."""
    for k in range(b.num_rows):
        yield k, b.slice(k, 1).to_pylist()[0]


def up(nodes: DataFrame, name: str, deep: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """nodes (group, place, n, digest and others) -> tables of blocks from the lowest to the highest, and (group, digest) of
    every group's root. A block has `deep` levels, and its row holds its leaves: ARITY ** deep at most."""
    block = ARITY**deep
    levels: list[DataFrame] = []
    more = [c for c in nodes.columns if c not in ("group", "place", "n", "digest")]
    while True:
        leaf = F.struct("place", "digest", *more)
        blocks = nodes.groupBy("group", F.floor(F.col("place") / block).alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(leaf)).alias("leaves"))
        blocks = stash(blocks, f"{name}-{len(levels)}")
        levels.append(blocks)

        def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(-(-r["n"] // block), root_of([x["digest"] for x in r["leaves"]], min(deep, levels_over(r["n"])))) for _, r in _rows(b)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["group", "place", "n", "digest"])

        kind = blocks.schema["group"].dataType.simpleString()
        nodes, more = blocks.select("group", "block", "n", F.transform("leaves", lambda x: F.struct(x["digest"].alias("digest"))).alias("leaves")).mapInArrow(roots, f"group {kind}, place long, n long, digest string"), []
        nodes = stash(nodes, f"{name}-roots-{len(levels)}")
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return levels, nodes.select("group", "digest")


def down(levels: list[DataFrame], above: DataFrame, deep: int = LEVELS) -> DataFrame:
    """Blocks as `up` gives them and, for each group, what its root has above: (group, path and others). Every leaf's
    columns with its whole path and these others."""
    above = above.withColumn("place", F.lit(0).cast("long"))
    carried = [c for c in above.columns if c not in ("group", "place", "path")]
    for blocks in reversed(levels):
        top = above.select(F.col("group").alias("_group"), F.col("place").alias("_block"), F.col("path").alias("_above"), *carried)
        leaf = blocks.schema["leaves"].dataType.elementType
        inner = [f.name for f in leaf.fields]
        # Paths within the block come from Python; the leaves themselves stay where they are.
        plain = blocks.select("group", "block", "n", "leaves", F.transform("leaves", lambda x: x["digest"]).alias("_digests"))

        def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.schema.names.index("_digests")
                for k, r in _rows(b.select(["n", "_digests"])):
                    one = b.slice(k, 1)
                    yield one.set_column(at, "_paths", pa.array([list(traverse(r["_digests"], min(deep, levels_over(r["n"]))))], pa.list_(_PATH)))

        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
        found = plain.mapInArrow(paths, f"{kind}, _paths array<{PATH}>")
        joined = found.join(top, F.col("group").eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block")))
        each = joined.select("group", "_above", *carried, F.inline(F.arrays_zip(F.col("leaves"), F.col("_paths"))))
        above = each.select("group", *[F.col(f"leaves.{c}").alias(c) for c in inner], F.concat("_paths", "_above").alias("path"), *carried)
    return above


def manifest(leaves: DataFrame, *, deep: int = LEVELS, name: str = "manifest") -> DataFrame:
    """leaves (group, key, digest and others) -> the same with subroot, root and path.

    Within a group leaves ascend by key, rows of one key by digest; groups ascend with null first, strings by their bytes.
    A null key comes first; a lone leaf is its subroot, and a lone subroot the root. Rows that repeat are leaves of their
    own, and those that agree in key and digest may swap places, which changes no root. An empty table has no rows and
    no root. Columns named place, n, path, subroot or root are refused, as are names that begin with `_`.
    """
    if clash := [c for c in leaves.columns if c in ("place", "n", "path", "subroot", "root") or c.startswith("_")]:
        raise ValueError(f"reserved names: {clash}")
    levels, subroots = up(placed(leaves, "group", ["key", "digest"], f"{name}-order"), name, deep)
    tops = placed(subroots.select(F.lit(0).alias("all"), "group", "digest"), "all", ["group"], f"{name}-tops")
    above, root = up(tops.select(F.col("all").alias("group"), "place", "n", "digest", F.col("group").alias("source")), f"{name}-tops", deep)
    told = down(above, root.select("group", F.col("digest").alias("root"), F.expr(f"cast(array() as {PATH})").alias("path")), deep)
    return down(levels, told.select(F.col("source").alias("group"), F.col("digest").alias("subroot"), "root", "path"), deep).drop("place")


def encoded(c: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, a colon and the value."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and digest of the proof of every document, and what a proof says of a text that lost its line feeds."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    other = F.when(touched, leaf_of(*fields, F.translate("text", "\n", "")))
    leaves = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("key"), leaf_of(*fields, F.col("text")).alias("digest"), other.alias("tampered"))
    out = manifest(stash(leaves, "leaves")).withColumn("folded_root", folded(F.coalesce("tampered", "digest"), F.col("path")))
    proof = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    return out.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
