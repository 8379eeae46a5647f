"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions alone.

Sources get target sizes from weights. Every source's documents fall into blocks by a keyed hash, which is its random
permutation. The blocks that a source's target takes, repeats included, are its quota; a binary tree over the output
shards splits all quotas at once, each node by exact multivariate-hypergeometric draws, so that shards differ by one
block at most and hold a uniformly random choice of blocks. Each shard then takes its own run of the source's permuted
blocks and is put into a random order within itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stash, table

#: Blocks of a source, whatever its size; the tables of blocks and shards have sources x BLOCKS x repeats rows at most.
BLOCKS = 256
SHARDS = 16
#: Stretches of the order of a block that a target cuts, each summed up by itself.
CUT_PARTS = 4096
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20_311


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Target size of each source, from (mix_source, source_size); mix_source is `s` and the name, or `n` for null.

    Sources in order of code points (null last) weigh `weights`, repeating. All sizes are shared out by weight; a target stops at
    `most` times its source's size and the excess goes to the others by weight. That is one level L with
    sum(min(most * size, weight * L)) = total: sources ordered by most * size / weight reach their limit one after the
    other, and running sums give L. One row per source passes through these windows, never documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(W.orderBy(F.col("mix_source") == "n", "mix_source")) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * float(most))
    by = W.orderBy(F.col("limit") / F.col("weight"), "mix_source")
    whole = W.partitionBy()
    ranked = (
        ranked.withColumn("full_before", F.coalesce(F.sum("limit").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(whole))
    )
    level = (F.col("total") - F.col("full_before")) / F.col("weight_left")
    fits = level * F.col("weight") <= F.col("limit")
    ranked = ranked.withColumn("level", F.min(F.when(fits, F.struct(F.col("limit") / F.col("weight"), "mix_source", level.alias("level")))).over(whole)["level"])
    return ranked.select("mix_source", "source_size", F.least("limit", F.coalesce(F.col("weight") * F.col("level"), F.col("limit"))).alias("target"))


def _let(value: Column, f) -> Column:
    """f(value) with value worked out once; it also keeps expressions small, which grow fast where a name is used twice."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted so that its error stays under 1e-9."""
    shift = lambda z: F.log((z - 1) * (z - 2) * (z - 3) * (z - 4) * (z - 5) * (z - 6) * (z - 7))
    return _let(n.cast("double") + 8.0, lambda z: (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) - shift(z))


def hypergeometric(all_: Column, good: Column, drawn: Column, u: Column) -> Column:
    """An exact draw: how many of `good` among `all_` are among `drawn`. u in (0, 1) is spent from the mode outwards."""
    zero = F.lit(0).cast("long")
    given = F.struct(all_.alias("n"), good.alias("k"), drawn.alias("d"), F.greatest(zero, drawn + good - all_).alias("lo"), F.least(drawn, good).alias("hi"), u.alias("u"))
    most_likely = lambda p: F.least(p["hi"], F.greatest(p["lo"], F.floor((p["d"] + 1) * (p["k"] + 1) / (p["n"] + 2)).cast("long")))

    def inverse(p: Column, m: Column) -> Column:
        logs = F.transform(F.array(p["k"], p["n"] - p["k"], p["d"], p["n"] - p["d"], m, p["k"] - m, p["d"] - m, p["n"] - p["k"] - p["d"] + m, p["n"]), _log_factorial)
        peak = F.exp(F.aggregate(F.zip_with(logs, F.array(*[F.lit(float(x)) for x in (1, 1, 1, 1, -1, -1, -1, -1, -1)]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))

        def step(s: Column, _: Column) -> Column:
            """Take the likelier of the two values next to those already spent."""
            up = F.when(s["b"] < p["hi"], s["pb"] * (p["k"] - s["b"]) * (p["d"] - s["b"]) / ((s["b"] + 1) * (p["n"] - p["k"] - p["d"] + s["b"] + 1))).otherwise(-1.0)
            down = F.when(s["a"] > p["lo"], s["pa"] * s["a"] * (p["n"] - p["k"] - p["d"] + s["a"]) / ((p["k"] - s["a"] + 1) * (p["d"] - s["a"] + 1))).otherwise(-1.0)
            right = lambda t: F.struct((s["u"] - t["up"]).alias("u"), s["a"].alias("a"), s["pa"].alias("pa"), (s["b"] + 1).alias("b"), t["up"].alias("pb"), (s["b"] + 1).alias("at"))
            left = lambda t: F.struct((s["u"] - t["down"]).alias("u"), (s["a"] - 1).alias("a"), t["down"].alias("pa"), s["b"].alias("b"), s["pb"].alias("pb"), (s["a"] - 1).alias("at"))
            move = _let(F.struct(up.alias("up"), down.alias("down")), lambda t: F.when(t["up"] >= t["down"], right(t)).otherwise(left(t)))
            return F.when(s["u"] < 0, s).otherwise(move)

        begin = _let(peak, lambda q: F.struct((p["u"] - q).alias("u"), m.alias("a"), q.alias("pa"), m.alias("b"), q.alias("pb"), m.alias("at")))
        return F.aggregate(F.sequence(F.lit(1).cast("long"), p["hi"] - p["lo"]), begin, step, lambda s: s["at"])

    return _let(given, lambda p: F.when(p["hi"] > p["lo"], _let(most_likely(p), lambda m: inverse(p, m))).otherwise(p["lo"]))


def _uniform(*on: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*on), 12).cast("double") + 0.5) / float(1 << 52)


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(mix_source, quota) -> (shard, mix_source, first, blocks): exact numbers of blocks, and where the shard's run begins.

    A node stands for a range of shards and holds the blocks of each source that go there. Its left half gets as many
    blocks as its share of shards (the remainder by rounding down), drawn source by source from what is left: a
    multivariate hypergeometric draw. A node has one number per source; there are 2 * shards - 1 nodes in all.
    """
    zero = F.lit(0).cast("long")
    named = quotas.agg(F.array_sort(F.collect_list(F.struct("mix_source", "quota"))).alias("s"))
    node = lambda lo, hi, left: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), left.alias("left_"))

    def draw(n: Column, want: Column) -> Column:
        """Blocks of each source that go to the left half, one source after the other."""

        def one(s: Column, good: Column) -> Column:
            u = _uniform(F.lit(seed), n["lo"], n["hi"], F.size(s["out"]))
            return _let(hypergeometric(s["all_"], good, s["want"], u), lambda x: F.struct((s["all_"] - good).alias("all_"), (s["want"] - x).alias("want"), F.concat(s["out"], F.array(x)).alias("out")))

        begin = F.struct(F.aggregate(n["left_"], zero, lambda a, x: a + x).alias("all_"), want.alias("want"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(n["left_"], begin, one, lambda s: s["out"])

    def split(nodes: Column, n: Column) -> Column:
        mid = F.floor((n["lo"] + n["hi"]) / 2)
        want = F.floor(F.aggregate(n["left_"], zero, lambda a, x: a + x) * (mid - n["lo"]) / (n["hi"] - n["lo"])).cast("long")
        return _let(draw(n, want), lambda g: F.concat(nodes, F.array(node(n["lo"], mid, g), node(mid, n["hi"], F.zip_with(n["left_"], g, lambda a, b: a - b)))))

    # Nodes in order of their level: each that stands for several shards adds its halves at the end.
    root = F.array(node(F.lit(0), F.lit(shards), F.transform("s", lambda x: x["quota"])))
    grown = F.aggregate(F.sequence(F.lit(0), F.lit(2 * shards - 2)), root, lambda nodes, i: _let(F.get(nodes, i), lambda n: F.when(n["hi"] - n["lo"] > 1, split(nodes, n)).otherwise(nodes)))
    node = named.select(F.expr("transform(s, x -> x.mix_source)").alias("names"), F.inline(F.filter(grown, lambda n: n["hi"] - n["lo"] == 1)))
    cells = node.select(F.col("lo").alias("shard"), F.inline(F.arrays_zip(F.col("names").alias("mix_source"), F.col("left_").alias("blocks"))))
    run = W.partitionBy("mix_source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return cells.withColumn("first", F.coalesce(F.sum("blocks").over(run), zero))


def placed(docs: DataFrame, size: Column, key: str, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """Adds size, keyed hash and block: the hash of key and text orders a source's documents at random, its residue is the block."""
    name = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    hashed = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in (key, "text") if c in docs.columns])
    return docs.withColumns({"mix_source": name, "mix_size": size, "mix_hash": hashed, "mix_block": F.pmod(hashed, F.lit(blocks)).cast("int")})


def _part() -> Column:
    """Which stretch of its block's order a document is in."""
    return F.pmod(F.shiftrightunsigned("mix_hash", 20), F.lit(CUT_PARTS)).cast("int")


def plan(thin: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Quotas of blocks and their places in the shards, from (mix_source, mix_block, mix_hash, mix_size) of all documents.

    A source's blocks in a permuted order, anew for each pass over the source, are its sequence; its quota is the number
    of them that its target takes. The tree splits all quotas among the shards, and the sequence, permuted once more up to
    the quota, is dealt out in the shards' runs. The first result has a row for every block: source_size, target, units
    (epoch, shard, cut: one for each time that a shard takes the block) and most, the words that are taken of it where
    the target cuts it. The second gives the words of cut blocks before each of their CUT_PARTS parts.

    From the sums of blocks on, everything is sources x blocks x passes rows, whatever the corpus; one task plans it.
    """
    held = stash(thin.groupBy("mix_source", "mix_block").agg(F.sum("mix_size").alias("words")), "mix-blocks").coalesce(1)
    aims = targets(held.groupBy("mix_source").agg(F.sum("words").alias("source_size")), weights, most)
    epochs = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("target") / F.greatest("source_size", F.lit(1))).cast("int") - 1, F.lit(0)))
    sized = held.join(aims, "mix_source")
    units = sized.withColumn("epoch", F.explode(epochs))
    turn = W.partitionBy("mix_source").orderBy("epoch", F.xxhash64(F.lit(seed), F.lit("turn"), "mix_block", "epoch"), "mix_block")
    before = F.coalesce(F.sum("words").over(turn.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    units = units.withColumn("before", before).filter((F.col("before") < F.col("target")) | (F.col("source_size") == 0))
    units = units.withColumn("most", F.when(F.col("before") + F.col("words") > F.col("target"), F.col("target") - F.col("before")))
    order = W.partitionBy("mix_source").orderBy(F.xxhash64(F.lit(seed), F.lit("rank"), "mix_block", "epoch"), "mix_block", "epoch")
    units = units.withColumn("rank", F.row_number().over(order) - 1)
    tree = splitting_tree(units.groupBy("mix_source").agg(F.count("*").alias("quota")), shards, seed)
    a, b = units.alias("a"), tree.alias("b")
    on = (F.col("a.mix_source") == F.col("b.mix_source")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("blocks"))
    dealt = a.join(b, on).select("a.mix_source", "mix_block", F.struct("epoch", "shard", F.col("most").isNotNull().alias("cut")).alias("unit"), "most")
    dealt = dealt.groupBy("mix_source", "mix_block").agg(F.sort_array(F.collect_list("unit")).alias("units"), F.max("most").alias("most"))
    blocks = stash(sized.select("mix_source", "mix_block", "source_size", "target").join(dealt, ["mix_source", "mix_block"], "left"), "mix-plan")
    cut = thin.join(blocks.filter("most is not null").select("mix_source", "mix_block"), ["mix_source", "mix_block"])
    sums = cut.groupBy("mix_source", "mix_block", _part().alias("mix_part")).agg(F.sum("mix_size").alias("words"))
    so_far = W.partitionBy("mix_source", "mix_block").orderBy("mix_part").rowsBetween(W.unboundedPreceding, -1)
    parts = sums.select("mix_source", "mix_block", "mix_part", F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("part_before"))
    return blocks, stash(parts, "mix-cuts")


def _with_cuts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with mix_in: whether a document belongs to what is taken of its block where that is cut.

    Only blocks that are cut, at most one of a source, need running sums of their documents, each part of one by itself.
    """
    run = W.partitionBy("mix_source", "mix_block", "mix_part").orderBy("mix_hash", "mix_size").rowsBetween(W.unboundedPreceding, 0)
    cut = rows.filter("most is not null").withColumn("mix_part", _part()).join(parts, ["mix_source", "mix_block", "mix_part"])
    cut = cut.withColumn("mix_in", F.col("part_before") + F.sum("mix_size").over(run) - F.col("mix_size") / 2 <= F.col("most"))
    return rows.filter("most is null").withColumn("mix_in", F.lit(False)).unionByName(cut.drop("mix_part", "part_before"))


def mix(docs: DataFrame, size: Column, *, key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """The mix: one row for each time that a document is taken, with docs' columns and mix_size, mix_source_size,
    mix_target, mix_epoch (the pass, from 0), mix_block, mix_shard, mix_order (sort a shard by it: its local shuffle).

    Whole passes over a source come first; the last pass takes blocks in an order drawn for it, and of the block that
    crosses the target the documents in their order up to the one that lands nearest. Nulls: a null source is a source
    of its own, null ids and texts count like any other value. Documents without words ride along with their block.
    Repeated rows are separate documents. Empty input gives no rows. Columns of docs that begin with mix_ are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    rows = placed(docs, size, key, blocks, seed)
    held, parts = plan(stash(rows.select("mix_source", "mix_block", "mix_hash", "mix_size"), "mix-sizes"), weights, most, shards, seed)
    own = ["most", "units", "source_size", "target", "unit"]
    named = {c: f"mix_own_{c}" for c in own if c in docs.columns}
    out = _with_cuts(rows.withColumnsRenamed(named).join(held.filter("units is not null"), ["mix_source", "mix_block"]), parts)
    out = out.withColumn("unit", F.explode("units")).filter(F.col("mix_in") | ~F.col("unit.cut"))
    return out.select(
        *[F.col(f"`{named.get(c, c)}`").alias(c) for c in docs.columns], "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("unit.epoch").alias("mix_epoch"), "mix_block",
        F.col("unit.shard").alias("mix_shard"), F.xxhash64(F.lit(seed), F.lit("order"), "unit.shard", "unit.epoch", "mix_hash").alias("mix_order"),
    )


def taken(docs: DataFrame, size: Column, *, key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """The mix by document, with those that it leaves out: docs' columns, size, source_size, target, taken, shards.

    `taken` is the sum over the shards' blocks of the document's words there, repeats included; `shards` lists the shards
    of its block, once per pass. Same rules as mix(); columns of docs with the new names are replaced. docs is written
    once with its sizes, so give few columns.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "shards") and not c.startswith("mix_")]
    made = placed(docs.withColumn("size", size).select(*[F.col(f"`{c}`") for c in keep], "size"), F.col("size"), key, blocks, seed)
    held = {c: f"mix_own_{c}" for c in ("most", "units") if c in keep}
    rows = stash(made.withColumnsRenamed(held), "mix-sizes")
    planned, parts = plan(rows.select("mix_source", "mix_block", "mix_hash", "mix_size"), weights, most, shards, seed)
    out = _with_cuts(rows.join(planned, ["mix_source", "mix_block"]), parts)
    times = F.coalesce(F.aggregate("units", F.lit(0).cast("long"), lambda n, u: n + F.when(F.col("mix_in") | ~u["cut"], 1).otherwise(0)), F.lit(0).cast("long"))
    in_shards = F.coalesce(F.transform("units", lambda u: u["shard"]), F.array().cast("array<int>"))
    return out.select(*[F.col(f"`{held.get(c, c)}`").alias(c) for c in keep], "size", "source_size", "target", (times * F.col("size")).alias("taken"), in_shards.alias("shards"))


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken (and the shards of its block) of every document, for the mix of `documents`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text"), word_count(F.col("text")).alias("size"))
    return taken(docs, F.col("size")).select("doc_id", "size", "source_size", "target", "taken", "shards")
