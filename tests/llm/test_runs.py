from __future__ import annotations

import hashlib
import random
import time
import zlib

import pytest
from palaver.llm import runs


def brute(words, least=24, times=3):
    """Every period tried at every place; of equal stretches the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def with_periods(rng: random.Random, n: int, letters: int) -> list[int]:
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a, p = rng.randrange(n), 1 + rng.randrange(12)
        for i in range(a + p, rng.randrange(a, n) + 1):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("least, times", [(24, 3), (6, 2), (10, 3), (1, 2), (30, 5)])
@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_runs_against_every_period(least, times, letters):
    rng = random.Random(letters * 100 + least)
    for _ in range(150):
        w = with_periods(rng, 1 + rng.randrange(110), letters)
        found, kept = runs.periodic_runs(w, least=least, times=times)
        assert found == brute(w, least, times)
        gone = {i for s, size, q in found for i in range(s + q, s + size)}
        assert [i for i, k in enumerate(kept) if not k] == sorted(gone)


def test_runs_inside_long_prose_with_repeated_passages():
    rng = random.Random(5)
    passage = [f"p{rng.randrange(400)}" for _ in range(60)]
    w = [f"w{rng.randrange(900)}" for _ in range(600)]
    w[100:100] = passage
    w[400:400] = passage * 4 + passage[:17]
    w[50:50] = ["ha"] * 30 + ["ho", "ha"] * 20
    assert runs.periodic_runs(w)[0] == brute(w) != []


def test_links_and_lengths_of_an_automaton():
    length, link, prefix = runs.suffix_automaton([0, 1, 1, 1])  # abbb
    longest = sorted(zip(length, prefix, strict=True))
    assert longest == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (3, 1), (4, 1)]
    assert all(length[link[v]] < length[v] for v in range(1, len(length)))


@pytest.mark.parametrize("word", [["a"] * 400_000, [f"w{i % 50_000}" for i in range(200_000)], [f"w{i % 7}" for i in range(200_000)]])
def test_long_periodic_texts_in_time_near_linear(word):
    start = time.time()
    found = runs.periodic_runs(word)[0]
    assert found == [(0, len(word), len(set(word)))] and time.time() - start < 20


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digests(words):
    found = brute(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = None
    for s, size, q in found:
        if best is None or size * best[2] > best[1] * q:
            best = (s, size, q)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_brute_force(spark, tmp_path, clashing):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{x}" for x in with_periods(rng, 1 + rng.randrange(120), 30)) if i % 7 else "\t".join(map(str, range(i * 3)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n\x0b "), (203, "x " * 500), (None, "na " * 40), (204, "a b\u0085c " * 30), (203, "x " * 500), (205, "Ha ha " * 20), (206, "é \U0001f600 " * 15)]
    clashing(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in runs.op13_runs(spark, str(tmp_path)).collect()]
    want = [(i, *digests(planted(i, [w for w in (t or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]))) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in got) > 30


def test_collapsing_nothing_and_keys_of_any_type(spark):
    assert runs.collapse(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    r = runs.collapse(spark.createDataFrame([("k", "la " * 30, 1)], "name string, body string, runs int"), key="name", text="body").first()
    assert (r["name"], r["collapsed"], [tuple(x) for x in r["runs"]]) == ("k", "la", [(0, 30, 1)])
