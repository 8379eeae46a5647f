from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from palaver.llm import merkle
from pyspark.sql import functions as F

from .conftest import KIND, edge_rows


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for nodes in levels[:-1]:
        first = i - i % 3
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
        i //= 3
    return out


def fold(leaf: str, steps) -> str:
    for left, right in steps:
        leaf = sha(left + leaf + right)
    return leaf


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 243, 244, 728, 729])
@pytest.mark.parametrize("height", [1, 2, 3, 6])
def test_traversal_emits_every_path(n, height):
    leaves = [sha(str(i)) for i in range(n)]
    levels = tree(leaves)
    assert merkle.levels_over(n) == len(levels) - 1
    assert merkle.root_of(leaves, len(levels) - 1) == levels[-1][0]
    got = [[(p["left"], p["right"]) for p in steps] for steps in merkle.traverse(leaves, len(levels) - 1, height)]
    assert got == [path(levels, i) for i in range(n)]


def test_traversal_of_the_last_block_of_a_larger_tree():
    """Runs of one go on being hashed up to the block's root."""
    for n in (1, 2, 4, 28, 100):
        leaves = [sha(str(i)) for i in range(n)]
        for levels in (5, 6):
            root = merkle.root_of(leaves, levels)
            assert all(fold(x, [(p["left"], p["right"]) for p in steps]) == root and len(steps) == levels for x, steps in zip(leaves, merkle.traverse(leaves, levels), strict=True))


def test_traversal_holds_little(monkeypatch):
    """Never more subtrees than two a tier, and no leaf taken in more than once a tier."""
    taken = []

    class Counted(list):
        def __getitem__(self, i):
            taken.append(i)
            return super().__getitem__(i)

    leaves = Counted(sha(str(i)) for i in range(729))
    made = []
    real = merkle.Subtree.__init__
    monkeypatch.setattr(merkle.Subtree, "__init__", lambda self, *a: (made.append(self), real(self, *a))[1])
    for _ in merkle.traverse(leaves, 6, 2):
        pass
    assert len(taken) <= 3 * 729 and max(len(t.nodes) for t in made) <= 9 + 3 and all(len(run) < 3 for t in made for run in t.waiting)


def brute(rows):
    """Rows (doc_id, text, lang, source, n_chars) -> the query's rows."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s, n: sha("".join(map(enc, (i, s, lang, n, t))))
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    trees = {s: tree([x[2] for x in sorted(v, key=lambda x: x[:3])]) for s, v in groups.items()}
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for s in order:
        for i, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = path(trees[s], i) + path(top, order.index(s))
            touched = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            root = fold(leaf(r[0], r[1].replace("\n", ""), *r[2:]) if touched else own, steps)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), root, root == top[-1][0]))
    return sorted(out, key=repr)


def answer(spark, tmp_path, rows, more=lambda df: df):
    more(spark.createDataFrame(rows, KIND)).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op12_merkle(spark, str(tmp_path)).collect()), key=repr)


def test_query_on_edge_rows(spark, tmp_path, clashing):
    rows = [(*r[:1], None if r[1] is None else r[1].replace(" ", "\n", 2), *r[2:]) for r in edge_rows()]
    got = answer(spark, tmp_path, rows, clashing)
    assert got == brute(rows) and {r[-1] for r in got} == {True, False}


def test_query_on_a_hot_source_and_many_small_ones(spark, tmp_path):
    """More than one block, and more than one block of blocks' roots, in a source; more sources than a run."""
    rng = random.Random(2)
    rows = [(i, f"text {i}\n" * (i % 3), "en", "hot" if i < 2500 else rng.choice([None, "ä", "z", "Z", "", "\U0001f600", "￿", *map(str, range(30))]), i) for i in range(3000)]
    rng.shuffle(rows)
    assert answer(spark, tmp_path, rows) == brute(rows)


def test_one_row_and_none(spark, tmp_path):
    row = (7, "a\nb", "en", "s", 3)
    assert answer(spark, tmp_path / "one", [row]) == brute([row])
    assert answer(spark, tmp_path / "none", []) == []


def test_blocks_of_blocks(spark):
    """Blocks of nine leaves: three levels of blocks over 700 leaves."""
    df = spark.range(700).select(F.lit("g").alias("group"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    levels = tree([sha(str(i)) for i in range(700)])
    for r in merkle.manifest(df, deep=2).collect():
        assert (r["subroot"], r["root"], [(p["left"], p["right"]) for p in r["path"]]) == (levels[-1][0], levels[-1][0], path(levels, r["key"]))


def test_reserved_names_are_refused(spark):
    with pytest.raises(ValueError, match="place"):
        merkle.manifest(spark.createDataFrame([], "group string, key long, digest string, place int"))
