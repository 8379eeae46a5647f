from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from palaver.llm import ngram_join as J

from .conftest import KIND, edge_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows):
    out = []
    for r in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        out.append(frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4))) if w else frozenset())
    return out


def linked(rows):
    """Sets of all rows, and for each row a row that stands for its component."""
    sets, head = sets_of(rows), list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                head[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def brute(rows):
    sets, head = linked(rows)
    least = {}
    for h, r in zip(head, rows, strict=True):
        if r[0] is not None:
            least[h] = min(least.get(h, r[0]), r[0])
    return sorted(((r[0], len(s), least.get(h) if s else r[0]) for h, r, s in zip(head, rows, sets, strict=True)), key=str)


def brute_kept(rows):
    """(id, text) of the rows that keep_one leaves, where no two texts of a component share its smallest id."""
    sets, head = linked(rows)
    first = {}
    for h, r, s in zip(head, rows, sets, strict=True):
        if s and (h not in first or (r[0] is None, r[0]) < (first[h][0] is None, first[h][0])):
            first[h] = r[:2]
    return Counter([*first.values(), *(r[:2] for r, s in zip(rows, sets, strict=True) if not s)])


def result(df, **how):
    return sorted((tuple(r) for r in J.near_duplicates(df, **how).collect()), key=str)


def test_edge_rows_against_brute_force(spark, edge, clashing):
    assert result(clashing(edge)) == brute(edge_rows())


@pytest.mark.parametrize("chunk", [3, 8, 64])
def test_blocks_larger_than_a_chunk(spark, chunk):
    """A chain of near copies, each linked with its neighbours only, and clusters around several templates."""
    rng, rows = random.Random(chunk), []
    words = prose(rng, 100).split(" ")
    for i in range(40):
        rows.append((i, " ".join(words), None, None, 0))
        words[(i * 7) % 100] = f"new{i}"
    for t in range(3):
        base = prose(rng, 60).split(" ")
        for k in range(25):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(60)] = f"t{t}k{k}r{rng.randrange(99)}"
            rows.append((1000 * (t + 1) + k, " ".join(w), None, None, 0))
    rng.shuffle(rows)
    assert result(spark.createDataFrame(rows, KIND), chunk=chunk) == brute(rows)


def test_tries_of_a_large_block_stay_small(spark, tmp_path, monkeypatch):
    """20 chunks: one connected group, a second one and single texts, in one block by a passage that some of each hold."""
    rng, chunk, rows = random.Random(9), 128, []
    passage = prose(rng, 6)
    for first, copies in ((0, 2100), (5000, 300), *((9000 + i, 1) for i in range(30))):
        base = [f"b{first}w{i}" for i in range(100)]
        for k in range(copies):
            w = list(base)
            w[rng.randrange(100)] = f"k{k}"
            rows.append((first + k, " ".join([*w, passage] if k < 10 else w), None, None, 0))
    log = str(tmp_path / "tries")

    def watched(made):
        def outer(percent):
            run = made(percent)

            def inner(t):
                from palaver.llm import ngram_join as W

                held = W.Trie

                class Noted(held):
                    def __init__(self, sets, sizes):
                        with open(log, "a") as f:
                            f.write(f"{len(sets)}\n")
                        super().__init__(sets, sizes)

                W.Trie = Noted
                try:
                    return run(t)
                finally:
                    W.Trie = held

            return inner

        return outer

    for name in ("_join_blocks", "_join_pairs"):
        if hasattr(J, name):
            monkeypatch.setattr(J, name, watched(getattr(J, name)))
    got = {r[0]: r[2] for r in result(spark.createDataFrame(rows, KIND), chunk=chunk)}
    assert got == {r[0]: 0 if r[0] < 5000 else 5000 if r[0] < 9000 else r[0] for r in rows}
    with open(log) as f:
        tries = [int(x) for x in f]
    assert len(tries) > 20 and max(tries) < 1.5 * chunk


def test_trie_walk_finds_every_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 60, 400).astype(np.uint64)
    sets = [np.unique(np.r_[base[(k := rng.integers(0, 300)) : k + rng.integers(5, 40)], rng.integers(0, 60, 4).astype(np.uint64)]) for _ in range(120)]
    sizes = np.array([len(s) + rng.integers(0, 3) for s in sets])
    trie = J.Trie(sets, sizes)
    for i in range(len(sets)):
        want = {j for j in range(len(sets)) if 175 * len(np.intersect1d(sets[i], sets[j])) >= 75 * (sizes[i] + sizes[j])}
        assert set(trie.walk(sets[i], int(sizes[i]), 75)) == want


def test_no_rows(empty):
    assert result(empty) == []


def test_keep_one_leaves_a_row_of_each_group(edge, clashing):
    rows = edge_rows()
    assert Counter((r["doc_id"], r["text"]) for r in J.keep_one(clashing(edge)).collect()) == brute_kept(rows)


@pytest.mark.parametrize("turn", [1, -1])
def test_keep_one_tells_rows_of_one_key_apart(spark, turn):
    """A key that carries a near copy and a unique text, null keys, repeated rows and rows without words."""
    words = [f"w{i}" for i in range(60)]
    a, near, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(f"u{i}" for i in range(40))
    rows = [(1, a, "en", "s", 0), (3, near, "en", "s", 0), (3, other, "en", "s", 0), (None, near, "en", "s", 0), (None, a + " more", "en", "s", 0), (None, "alone in the world", None, None, 0), (4, "twice told", "en", "x", 0), (4, "twice told", "en", "y", 0), (5, "", None, None, 0), (5, "", None, None, 0), (None, None, None, None, 0), (None, None, None, None, 0)]
    got = Counter((r[0], r[1]) for r in J.keep_one(spark.createDataFrame(rows[::turn], KIND)).collect())
    assert got == {(1, a): 1, (3, other): 1, (None, "alone in the world"): 1, (4, "twice told"): 1, (5, ""): 2, (None, None): 2}


def test_a_group_of_near_copies_makes_few_probes(spark, monkeypatch):
    """900 near copies of one text in chunks of 16: what is joined by samples needs no pair of chunks."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join([*base[: (p := rng.randrange(100))], f"k{k}", *base[p + 1 :]]), None, None, 0) for k in range(900)]
    probes = []
    held = J._pairs

    def counted(*args):
        out = held(*args)
        probes.append((out.filter("probe").count(), out.filter("not probe").count()))
        return out

    monkeypatch.setattr(J, "_pairs", counted)
    got = result(spark.createDataFrame(rows, KIND), chunk=16)
    assert {r[2] for r in got} == {0} and len(got) == 900
    assert len(probes) == 1 and sum(probes[0]) <= 2 * 900, probes


def test_a_long_text_in_few_bytes_at_a_time(spark):
    """20 MB in one text, and a near copy of it."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 10**6, 2_900_000)
    long = " ".join(map(str, words.tolist()))
    got = result(spark.createDataFrame([(1, long, None, None, 0), (2, long + " end", None, None, 0), (3, "x" * 3_000_000, None, None, 0)], KIND).repartition(3))
    assert len(long) > 19_000_000 and [r[2] for r in got] == [1, 1, 3] and got[1][1] == got[0][1] + 1 and got[2][1] == 1


def test_five_words_and_three_quarters_are_the_bounds(spark):
    a = " ".join(f"w{i}" for i in range(12))  # 8 shingles
    b = " ".join(f"w{i}" for i in range(11))  # 7 of them
    c = " ".join(f"w{i}" for i in range(10))  # 6: with a exactly 6 / 8
    got = result(spark.createDataFrame([(1, a, None, None, 0), (2, b, None, None, 0), (3, c, None, None, 0), (4, " ".join(f"w{i}" for i in range(9)), None, None, 0)], KIND))
    assert [r[2] for r in got] == [1, 1, 1, 1] and [r[1] for r in got] == [8, 7, 6, 5]
