from __future__ import annotations

import base64
import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from palaver.llm import fingerprints, knn, language, mixing, packing, pii, quality, sharding
from palaver.llm.components import components
from pyspark.sql import functions as F

from .conftest import KIND, edge_rows, prose


# ---- mixing


def water_fill(sizes: list[int], weights: list[float], most: float) -> list[float]:
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * level > most * sizes[i]}
        if not full:
            for i in open_:
                target[i] = weights[i] * level
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1000, 1, 2, 500, 0], [5], [100, 1, 1, 1, 1, 1]])
def test_targets_stop_at_the_limit_and_reshare(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "mix_source string, source_size long")
    got = [r["target"] for r in mixing.targets(df).orderBy("mix_source").collect()]
    assert got == pytest.approx(water_fill(sizes, [1.0, 2.0, 3.0] * 9, 3), abs=1e-6)


def test_mix_by_document_and_by_row_agree(spark, edge, clashing):
    size = mixing.word_count(F.col("text"))
    by_doc = mixing.taken(edge.select("doc_id", "source", "text"), size).collect()
    assert len(by_doc) == edge.count()
    total = sum(r["size"] for r in by_doc)
    per = defaultdict(int)
    for r in by_doc:
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        per[r["source"]] += r["taken"]
    largest = {s: max(r["size"] for r in by_doc if r["source"] == s) for s in per}
    target = {r["source"]: r["target"] for r in by_doc}
    assert sum(target.values()) == pytest.approx(total)
    assert all(abs(per[s] - target[s]) <= largest[s] for s in per)
    rows = mixing.mix(clashing(edge), size).collect()
    assert sum(r["mix_size"] for r in rows) == sum(per.values())
    again = mixing.mix(clashing(edge), size).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    assert set(clashing(edge).columns) - {"mix_size", "mix_block"} <= set(rows[0].asDict()) and rows[0]["size"] == "x"


@pytest.mark.parametrize(("blocks", "shards"), [(4, 3), (16, 5), (256, 16)])
def test_taken_against_a_plain_mix(spark, edge, clashing, blocks, shards):
    """taken, target and the shards' quotas from the block sums on, one source after the other in plain Python."""
    size = mixing.word_count(F.col("text"))
    rows = [r.asDict() for r in mixing.placed(edge, size, "doc_id", blocks).withColumn("part", mixing._part()).collect()]
    turns = spark.range(blocks).withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(F.col("id").cast("int").alias("b"), "e")
    turn = {(r["b"], r["e"]): r["t"] for r in turns.select("b", "e", F.xxhash64(F.lit(mixing.SEED), F.lit("turn"), "b", "e").alias("t")).collect()}
    names = sorted({r["mix_source"] for r in rows}, key=lambda s: (s == "n", s))
    sizes = [sum(r["mix_size"] for r in rows if r["mix_source"] == s) for s in names]
    target = dict(zip(names, water_fill(sizes, [1.0, 2.0, 3.0] * 9, 3), strict=False))
    want, quota = Counter(), {}
    for s, total in zip(names, sizes, strict=True):
        own = [r for r in rows if r["mix_source"] == s]
        used, n = 0, 0
        for e in range(3):
            for b in sorted({r["mix_block"] for r in own}, key=lambda b: (turn[b, e], b)):
                if used >= target[s] and total:
                    continue
                held, n = [r for r in own if r["mix_block"] == b], n + (e == 0 or total > 0)
                words, room, run = sum(r["mix_size"] for r in held), target[s] - used, 0
                for r in sorted(held, key=lambda r: (r["part"], r["mix_hash"], r["mix_size"])):
                    run += r["mix_size"]
                    if words <= room or run - r["mix_size"] / 2 <= room:
                        want[(r["doc_id"], r["text"], r["source"])] += r["mix_size"]
                used += words
        quota[s] = n
    got, per = Counter(), Counter()
    df = clashing(edge).withColumns({"target": F.lit("x"), "taken": F.lit("x"), "most": F.lit(1), "units": F.lit(2)})
    for r in mixing.taken(df, size, blocks=blocks, shards=shards).collect():
        got[(r["doc_id"], r["text"], r["source"])] += r["taken"]
        assert r["target"] == pytest.approx(target["n" if r["source"] is None else "s" + r["source"]]) and r["most"] == 1
    assert +got == +want
    seen = {(r["mix_shard"], r["mix_source_size"], r["mix_block"], r["mix_epoch"]) for r in mixing.mix(df, size, blocks=blocks, shards=shards).collect()}
    for shard, *_ in seen:
        per[shard] += 1
    assert sum(per.values()) <= sum(quota.values()) and max(per.values()) <= -(-sum(quota.values()) // shards) + 2


def test_mix_of_nothing(empty):
    assert mixing.mix(empty, mixing.word_count(F.col("text"))).count() == 0
    assert mixing.taken(empty.select("doc_id", "source", "text"), mixing.word_count(F.col("text"))).count() == 0


def test_tree_deals_exact_quotas_evenly(spark):
    quotas = {"a": 37, "b": 0, "c": 101, "d": 1}
    rows = mixing.splitting_tree(spark.createDataFrame(list(quotas.items()), "mix_source string, quota long"), 5).collect()
    per_source, per_shard = Counter(), Counter()
    for r in rows:
        assert r["blocks"] >= 0
        per_source[r["mix_source"]] += r["blocks"]
        per_shard[r["shard"]] += r["blocks"]
    assert {k: per_source[k] for k in quotas} == quotas
    assert sum(per_shard.values()) == 139 and max(per_shard.values()) - min(per_shard.values()) <= 2


def test_hypergeometric_draws_follow_the_law(spark):
    n, k, d = 40, 13, 17
    u = (F.col("id") + 0.5) / 4000
    got = Counter(r[0] for r in spark.range(4000).select(mixing.hypergeometric(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(d).cast("long"), u)).collect())
    from math import comb

    for x in range(k + 1):
        assert got[x] / 4000 == pytest.approx(comb(k, x) * comb(n - k, d - x) / comb(n, d), abs=2e-3)


# ---- sharding


def test_shards_are_exact_and_slots_gapless(spark, edge, clashing):
    rows = sharding.shard_rows(clashing(edge), ["doc_id", "text"], shards=7).collect()
    held = defaultdict(list)
    for r in rows:
        held[r["shard"]].append(r["slot"])
    assert len(rows) == edge.count() and set(held) == set(range(7))
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1


def test_matrix_has_its_margins():
    rng = random.Random(3)
    counts = {i: rng.randrange(0, 50) for i in range(30)}
    m = sharding.communication_matrix(counts, 7, 1)
    assert {i: sum(x) for i, x in m.items()} == counts
    columns = np.sum(list(m.values()), 0)
    assert columns.max() - columns.min() <= 1 and columns.sum() == sum(counts.values())


def test_matrix_of_many_rows():
    """Beyond 10 ** 9 rows, where numpy's own draw ends; by the same law as it."""
    counts = {i: 5 * 10**9 // 40 + i for i in range(40)}
    m = sharding.communication_matrix(counts, 24, 1)
    columns = np.sum(list(m.values()), 0)
    assert {i: sum(x) for i, x in m.items()} == counts and min(map(min, m.values())) >= 0
    assert columns.max() - columns.min() <= 1


def test_large_draws_follow_the_law(monkeypatch):
    from math import comb

    monkeypatch.setattr(sharding, "LARGE", 1)
    rng = np.random.default_rng(3)
    got = Counter(sharding.draw(rng, 13, 27, 17) for _ in range(20000))
    for x in range(14):
        assert got[x] / 20000 == pytest.approx(comb(13, x) * comb(27, 17 - x) / comb(40, 17), abs=0.01)


def test_shards_against_a_plain_deal(spark, monkeypatch):
    """Shard and slot of every row: parts, matrix and both permutations one after the other in plain Python."""
    monkeypatch.setattr(sharding, "PART_ROWS", 7)
    monkeypatch.setattr(sharding, "AREAS", 5)
    df = spark.range(400).withColumnRenamed("id", "doc_id")
    h = lambda what: F.xxhash64(F.lit(sharding.SEED), F.lit(what), "doc_id").alias(what)
    rows = [r.asDict() for r in df.select("doc_id", *[h(w) for w in ("part", "first", "range", "second")]).collect()]
    parts = -(-400 // 7)
    held, areas = defaultdict(list), Counter()
    for r in rows:
        held[r["part"] % parts].append(r)
        areas[r["part"] % parts % 5] += 1
    coarse, places = sharding.communication_matrix(areas, 6, sharding.SEED), defaultdict(list)
    for area, line in coarse.items():
        own = {p: len(x) for p, x in held.items() if p % 5 == area}
        for p, to in sharding.deal(own, np.array(line), [sharding.SEED, area]).items():
            order = iter(sorted(held[p], key=lambda r: r["first"]))
            for shard, n in enumerate(to):
                places[shard] += [next(order) for _ in range(n)]
    want = {}
    for shard, own in places.items():
        for slot, r in enumerate(sorted(own, key=lambda r: (r["range"] % (parts // 6), r["second"]))):
            want[r["doc_id"]] = (shard, slot)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(df, ["doc_id"], shards=6).collect()} == want


def test_rows_with_the_same_keys_spread_over_parts(spark, monkeypatch):
    """A third of all rows agree in the keys: no part holds them all, places are whole, and reruns agree."""
    monkeypatch.setattr(sharding, "PART_ROWS", 20)
    seen, stash = [], sharding.stash
    monkeypatch.setattr(sharding, "stash", lambda df, name: seen.append(stash(df, name)) or seen[-1])
    same = F.col("id") < 600
    df = spark.range(1800).select(F.when(~same, F.col("id")).alias("doc_id"), F.when(same, 7).alias("size"), F.lit("x").alias("_part"))
    runs = [sharding.shard_rows(d, ["doc_id", "size"], shards=6).collect() for d in (df, df.repartition(5))]
    first, again = (Counter((r["doc_id"], r["shard"], r["slot"]) for r in x) for x in runs)
    assert first == again and sum(first.values()) == 1800
    held = defaultdict(list)
    for i, shard, slot in first:
        held[shard].append((slot, i is None))
    assert all(sorted(s for s, _ in v) == list(range(300)) for v in held.values())
    copies = [sum(c for _, c in v) for v in held.values()]
    assert sum(copies) == 600 and max(copies) < 150 and all(sum(c for s, c in v if s < 150) > 25 for v in held.values())
    before, after = (d.agg(F.max("n")).first()[0] for d in seen[:2])
    assert before >= 600 and after < 120


def test_reserved_names_are_refused(spark):
    with pytest.raises(ValueError, match="_s_part"):
        sharding.shard_rows(spark.range(3).withColumn("_s_part", F.lit(1)), ["id"])


def test_sharding_nothing_and_less_than_a_row_each(spark, empty):
    assert sharding.shard_rows(empty, ["doc_id"]).count() == 0
    assert sharding.shard_rows(spark.range(3), ["id"]).count() == 3


# ---- fingerprints


def test_follower_and_edit_as_by_sorting(spark, edge, clashing):
    rows = edge_rows()
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.compare(clashing(edge)).collect())
    assert sum(got.values()) == len(rows)
    ties = {r[0]: r[1] for r in edge_rows() if [x[0] for x in rows].count(r[0]) == 1}
    order = sorted((i for i in ties if i is not None), reverse=True)
    for a, b in zip(order, order[1:], strict=False):
        if any(b < i < a for i in [3]):
            continue
        x, y = ties[a] or "", ties[b] or ""
        k = len(x) // 3
        assert got[(a, len(x), hashlib.sha256((x[: len(x) - k] + y[:k]).encode()).hexdigest())] == 1


def test_small_places_chain_up(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "STRETCH_BYTES", 200)
    rng = random.Random(1)
    rows = [(i * i, prose(rng, rng.randrange(0, 30)), None, None, 0) for i in range(80)]
    got = {r["doc_id"]: r for r in fingerprints.compare(spark.createDataFrame(rows, KIND)).collect()}
    order = sorted(rows, reverse=True)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        k = len(a[1]) // 3
        assert got[a[0]]["edited_sha256"] == hashlib.sha256((a[1][: len(a[1]) - k] + b[1][:k]).encode()).hexdigest()


def test_one_row_follows_itself_and_none_gives_none(spark, empty):
    one = fingerprints.compare(spark.createDataFrame([(1, "abc", None, None, 0)], KIND)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"aba").hexdigest() and one["near_next"] == 1
    assert fingerprints.compare(empty).count() == 0


def plain_anchors(text: str, k: int = fingerprints.K, s: int = fingerprints.S) -> list[bytes]:
    """The closed syncmers of a text, window by window."""

    def inner(x: bytes) -> int:
        h = 0
        for c in x:
            h = (h * 0x01000193 ^ c) % (1 << 32)
        h = (h ^ (h >> 15)) * 0x85EBCA6B % (1 << 32)
        return h ^ (h >> 13)

    data, out = text.encode(), []
    for i in range(len(data) - k + 1):
        window = data[i : i + k]
        order = [inner(window[j : j + s]) for j in range(k - s + 1)]
        if min(order) in (order[0], order[-1]):
            out.append(window)
    return out


def plain_hash(window: bytes) -> int:
    """A window's anchor: a polynomial of its bytes, its bits spread, the upper half."""
    h = sum((c + 1) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, c in enumerate(window)) % (1 << 64)
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD % (1 << 64)
    h = (h ^ h >> 29) * 0xC4CEB9FE1A85EC53 % (1 << 64)
    return (h ^ h >> 32) >> 32


def plain_likeness(a: list, b: list) -> float:
    """Longest common subsequence over union, by the usual table; equal anchors are told apart by their number."""
    a, b = ([(x, c[:i].count(x)) for i, x in enumerate(c)] for c in (a, b))
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1] / len(set(a) | set(b))


def test_query_against_windows_and_common_subsequences(spark):
    """fingerprint, edited_fingerprint, near_edited and near_next of op3 from a loop over all windows."""
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (40, 2, 300, 41, 5, 120)] + ["", "tiny", "äöü " * 30]
    texts += [texts[2] + " and " + texts[0], "\n".join([texts[0]] * 5), texts[0]]
    got = {r["doc_id"]: r for r in fingerprints.compare(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], KIND)).collect()}

    def digits(t: str) -> str:
        """The column, from windows alone."""
        own = [plain_hash(w).to_bytes(4) for w in plain_anchors(t)]
        if not own and t:
            own = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "little").to_bytes(4)]
        return base64.b64encode(b"".join(own)).decode()

    anchor = lambda t: plain_anchors(t) or ([t] if t else [])
    for i, t in enumerate(texts):
        new = fingerprints.edited(t, texts[i - 1])
        assert [got[i]["fingerprint"], got[i]["edited_fingerprint"]] == [digits(t), digits(new)]
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(anchor(t), anchor(new)))
        assert got[i]["near_next"] == pytest.approx(plain_likeness(anchor(t), anchor(texts[i - 1])))
        own, changed, follower = (fingerprints.read(x) for x in (got[i]["fingerprint"], got[i]["edited_fingerprint"], got[(i or len(texts)) - 1]["fingerprint"]))
        assert (got[i]["near_edited"], got[i]["near_next"]) == (fingerprints.likeness(own, changed), fingerprints.likeness(own, follower))


def test_repeats_count():
    """A passage is little like ten of it, and ten are just like ten."""
    one = prose(random.Random(5), 50)
    a, b, c = fingerprints._fingerprints([one, "\n".join([one] * 10), "\n".join([one] * 11)])
    assert fingerprints.likeness(a, b) < 0.11 and fingerprints.likeness(b, b) == 1 and 0.9 < fingerprints.likeness(b, c) < 0.92


def test_anchors_do_not_depend_on_neighbours():
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (0, 1, 2, 5, 40, 300)]
    got = fingerprints._fingerprints(texts)
    for t, f in zip(texts, got, strict=True):
        assert np.array_equal(f, fingerprints._fingerprints([t])[0])
    a, b = fingerprints._fingerprints([texts[5], texts[5] + " and a little more"])
    assert fingerprints.likeness(a, b) > 0.8 and fingerprints.likeness(a, a) == 1
    assert fingerprints.likeness(got[4], got[5]) < 0.3 and fingerprints.likeness(got[0], got[0]) == 1 and fingerprints.likeness(got[0], got[4]) == 0


def test_anchors_depend_on_their_window_alone():
    """A common passage gives common anchors wherever it stands."""
    rng = random.Random(4)
    passage = prose(rng, 60)
    a, b = (set(fingerprints.anchors(*_bytes(p + " " + passage + " tail"))[0].tolist()) for p in ("x y z", prose(rng, 9)))
    own = set(fingerprints.anchors(*_bytes(passage))[0].tolist())
    assert own <= a and own <= b


def _bytes(text):
    d = np.frombuffer(text.encode(), np.uint8)
    return d, np.array([0, len(d)])


# ---- quality


def test_quality_tells_junk_on_held_out_rows(spark, clashing):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        t = prose(rng, rng.randrange(20, 80))
        rows.append((i, t if good else " ".join(w + rng.choice(["%%%", "$$$", "###"]) for w in t.split(" ")), None, None, 0))
        labels.append((i, int(good), 0))
    docs = clashing(spark.createDataFrame([*rows, (None, None, None, None, None), (1000, "", None, None, 0)], KIND))
    labels = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(got) == 602 and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[i]["predicted"] == truth[i] for i in held if i not in (1, 2)]) > 0.97


def test_quality_without_labels_or_documents(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(edge, none)
    assert {r["score"] for r in quality.score(edge, model).collect()} == {0.5}
    assert quality.score(empty, quality.fit(empty, none)).count() == 0


def test_isotonic_never_falls():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    kx, ky = quality.isotonic(x, (x + rng.normal(size=300) > 0).astype(float))
    assert (np.diff(ky) >= 0).all() and (np.diff(kx) > 0).all()


def test_long_texts_are_read_a_block_at_a_time(monkeypatch):
    """Words, anchors, statistics and vectors of a text are the same whatever the block; words longer than a block as well."""
    from palaver.llm import common

    rng = np.random.default_rng(1)
    data = rng.integers(65, 123, 60_000).astype(np.uint8)
    data[rng.random(60_000) < 0.15] = 32
    data[20_000:45_000] = 120
    at = np.array([0, len(data)])
    read = lambda: (*common.word_hashes(data, at), fingerprints.anchors(data, at)[0], quality.statistics(data, at), language.vectors(data, at))
    want = read()
    for block in (1000, 7001):
        for module in (common, fingerprints, quality, language):
            monkeypatch.setattr(module, "BLOCK", block)
        monkeypatch.setattr(common, "_POWERS", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
        for a, b in zip(want, read(), strict=True):
            assert a == pytest.approx(b)


def test_statistics_do_not_depend_on_neighbours():
    texts = [r[1] or "" for r in edge_rows()]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    whole = quality.statistics(data, at)
    for i in range(len(texts)):
        assert whole[i] == pytest.approx(quality.statistics(data, at[i : i + 2])[0])


# ---- top-k


def brute_top(rows, k=5, every=50):
    kept = []
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, [int(np.floor(256 * float(np.float32(c)))) for c in v]))
    out = []
    for a, (i, x) in enumerate(kept):
        if i % every == 0:
            s = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), j) for b, (j, y) in enumerate(kept) if a != b and len(y) == len(x))
            out += [(i, r + 1, j, -v) for r, (v, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize(("group", "share"), [(3, 100), (1000, 8192)])
def test_top_k_is_exact(spark, group, share):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, 8))
    rows = [(i, [float(np.float32(c)) for c in centres[i % 9] + 0.3 * rng.normal(size=8)]) for i in range(700)]
    rows += [(1000, rows[5][1]), (1050, rows[5][1]), (1051, None), (1100, [None] * 8), (1101, [float("nan")] * 8), (1150, [float("inf")] * 8), (1200, [0.0] * 8), (1250, [1.0, 2.0]), (1251, [2.0, 1.0]), (None, [0.1] * 8), (1300, [])]
    rows += [(50, rows[7][1]), (50, rows[7][1]), (50, rows[50][1]), (51, rows[3][1]), (51, rows[4][1]), (1350, [1e7] + [0.0] * 7), (1351, [-1e6] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in knn.top_k(df, group=group, share=share).collect()) == brute_top(rows)


def test_top_k_takes_every_row_of_a_repeated_key(spark):
    rows = [(0, [1.0]), (1, [1.0]), (1, [2.0]), (1, [3.0])]
    got = sorted(tuple(r) for r in knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(0, 1, 1, 196608), (0, 2, 1, 131072), (0, 3, 1, 65536)] == brute_top(rows)


def test_top_k_with_a_vector_of_a_third_of_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 1.0, 0.5] if i % 3 == 0 else rng.normal(size=3).astype(np.float32).tolist()) for i in range(1200)]
    rows += rows[:4]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    held = []
    read = knn.stash

    def noted(df, name):
        out = read(df, name)
        held.append((name, out.filter("not query").count() if name == "vectors" else out.count()))
        return out

    knn.stash = noted
    try:
        assert sorted(tuple(r) for r in knn.top_k(df).collect()) == brute_top(rows)
    finally:
        knn.stash = read
    assert dict(held)["vectors"] <= 810 + 6 * df.rdd.getNumPartitions()


@pytest.mark.parametrize("group", [5, 1024])
def test_clustered_vectors_go_where_they_are_needed(spark, group):
    """60 clusters far apart: a query cell needs few cells, and few vectors are copied."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16)) * 4
    rows = [(i, [float(np.float32(c)) for c in centres[i % 60] + 0.1 * rng.normal(size=16)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    shipped, held = [], knn._aim

    def noted(cells, groups):
        shipped.append([sum(int(c.rows[c.needed[m].any(0)].sum()) for _, m, _ in groups[d]) / len(groups[d]) for d, c in cells.items()])
        return held(cells, groups)

    knn._aim = noted
    try:
        assert sorted(tuple(r) for r in knn.top_k(df, group=group, share=500).collect()) == brute_top(rows)
    finally:
        knn._aim = held
    assert max(shipped[0]) < 0.4 * len(rows), shipped


def test_top_k_of_few_or_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert knn.top_k(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r) for r in knn.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], kind)).collect()] == [(0, 1, 1, 256 * 512)]
    assert knn.top_k(spark.createDataFrame([(0, [1.0])], kind)).count() == 0


# ---- packing


def check_packing(docs, pieces, window):
    texts = defaultdict(list)
    for r in docs:
        texts[r[0]].append(r[1] or "")
    tok = packing._load(packing.tokenizer_path())[0]
    want = Counter()
    for i, ts in texts.items():
        for t in ts:
            want[(i, len(tok.encode(t, add_special_tokens=False).ids) + 1)] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for p in pieces:
        got[(p["doc_id"], p["doc_tokens"])] += p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert {k: k[1] * n for k, n in want.items()} == got
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= window
    return len(sequences)


@pytest.mark.parametrize("window", [64, 2048])
def test_packing_holds_every_id_once(spark, edge, clashing, window):
    pieces = packing.pack(clashing(edge), window=window).collect()
    n = check_packing(edge_rows(), pieces, window)
    assert n * window - sum(p["length"] for p in pieces) < 2 * window
    tok, ids = packing._load(packing.tokenizer_path())[0], defaultdict(list)
    for r in edge_rows():
        ids[r[0]].append(np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4"))
    for p in pieces:  # a key may stand for several texts
        cuts = [zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) for x in ids[p["doc_id"]] if len(x) == p["doc_tokens"]]
        assert p["ids_crc32"] in cuts
    again = packing.pack(clashing(edge).repartition(5), window=window).collect()
    placed = lambda rows: Counter((*p[:5], p["sequence_id"] if p["sequence_id"] < 1 << 62 else None, p["offset"]) for p in rows)
    assert placed(pieces) == placed(again)


def test_packing_nothing(empty):
    assert packing.pack(empty).count() == 0


def test_fast_ids_are_the_tokenizers_ids():
    whole = packing._load(packing.tokenizer_path())[0]
    texts = [r[1] or "" for r in edge_rows()] + ["a  b", "a \n b", "x\n\ny", " lead", "tail ", "it's we'll 3rd", "<|endoftext|> in text", "a\u00a0b\u3000c", "tab\tx", "\n", "é\u0301 ÄÖ ß"]
    for t, got in zip(texts, packing.token_ids(texts, packing.tokenizer_path()), strict=True):
        assert got.tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1]


def test_the_fast_form_searches_for_a_token():
    """Without a special token its search matches nothing at every byte, which takes as long as all else."""
    assert packing._load(packing.tokenizer_path())[1].special_tokens_set == {"<|endoftext|>"}


def test_runs_and_long_words_are_found_as_by_plain_searches():
    import random
    import re

    r = random.Random(5)
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    texts = ["", " ", "a", *(a + b for a in spaces for b in spaces)] + ["".join(r.choices("ab\u00e9\u4e2d" + "".join(spaces), [9, 9, 9, 9, *[0.4] * len(spaces)], k=r.randrange(40))) for _ in range(3000)]
    assert [packing._runs(t) for t in texts] == [bool(re.search(r"\s\s", t)) for t in texts]
    n = packing.LONG_WORD
    words = ["x" * n, "x" * (n + 1), " " + "x" * n + " ", "ab " * 5000 + "x" * (n + 1), "ab " * 5000 + "x" * (n + 1) + " ab" * 9000, "ab " * 5001 + "x" * n + "\n" + "y" * (n // 2)]
    assert [packing._long_word(t) for t in words] == [max(map(len, t.split())) > n for t in words] == [False, True, False, True, True, False]


def test_windows_fill_in_the_order_of_bm25():
    """Each window takes the unused documents by their score for all terms of its seed, from the formula term by term."""
    from math import log1p

    rng = np.random.default_rng(4)
    docs = [rng.zipf(1.3, rng.integers(20, 90)).clip(2, 3000).astype(np.uint16) for _ in range(60)]
    df = Counter(int(t) for d in docs for t in set(d.tolist()))
    idf = np.zeros(packing.VOCABULARY, np.float32)
    for t, n in df.items():
        idf[t] = log1p((len(docs) - n + 0.5) / (n + 0.5))
    mean, window = sum(map(len, docs)) / len(docs), 400

    def score(seed: int, i: int) -> float:
        tf = Counter(docs[i].tolist())
        return sum(float(idf[t]) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean)) for t in set(docs[seed].tolist()) if t in tf)

    placed = packing.fill_windows(docs, idf, mean, window)
    order = list(dict.fromkeys(p[0] for p in placed))
    used, seed, at = {order[0]}, order[0], len(docs[order[0]])
    assert len(docs[seed]) == max(map(len, docs)) and len(order) == 60
    for i in order[1:]:
        if at % window == 0:
            assert len(docs[i]) == max(len(docs[x]) for x in range(60) if x not in used)
            seed = i
        else:
            best = max(score(seed, x) for x in range(60) if x not in used)
            assert score(seed, i) == pytest.approx(best, rel=1e-5)
        used.add(i)
        if (at + len(docs[i])) // window > at // window:
            seed = i
        at += len(docs[i])


def test_components_against_a_full_decomposition():
    """Routing learns the leading principal components of the weighted terms, and their medians."""
    rng = np.random.default_rng(8)
    docs = [(rng.integers(0, 60, 50) + 100 * (i % 3) + 7).astype(np.uint16) for i in range(90)]
    idf = np.linspace(0.5, 2.0, packing.VOCABULARY).astype(np.float32)
    terms, axes, medians = packing.components(docs, idf)
    x = np.zeros((90, 400))
    for row, d in zip(x, docs, strict=True):
        t, c = np.unique(d, return_counts=True)
        row[t] = idf[t] * c / (c + 1.2)
        row /= np.sqrt((row**2).sum())
    exact = np.linalg.svd(x - x.mean(0))[2][:2]
    assert np.linalg.svd(exact[:, terms] @ axes[:, :2])[1] == pytest.approx([1, 1], abs=1e-3)
    assert medians == pytest.approx(np.median(x[:, terms] @ axes, axis=0), abs=1e-4)
    for few in ([docs[0]], docs[:2], [np.array([1], np.uint16)] * 3):
        assert packing.components(few, idf)[1].shape[1] == packing.KEY_BITS


def test_shards_hold_what_is_alike_and_spread_what_repeats(spark, monkeypatch):
    """Of four vocabularies, and of rows that repeat id and text, a shard of about 50 gets its share."""
    monkeypatch.setattr(packing, "SHARD", 50)
    rng = random.Random(3)
    rows = [(i, " ".join(f"{'abcd'[i % 4]}{rng.randrange(40)}{'wxyz'[i % 4]}" for _ in range(60))) for i in range(400)]
    held = defaultdict(Counter)
    for p in packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        held[p["sequence_id"] >> 32][p["doc_id"] % 4] += 1
    assert len(held) == 8 and sum(max(c.values()) for c in held.values()) > 0.9 * sum(sum(c.values()) for c in held.values())
    same = packing.pack(spark.createDataFrame([(None, "one and the same")] * 600, "doc_id long, text string")).collect()
    shards = Counter(p["sequence_id"] >> 32 for p in same)
    assert sum(p["length"] for p in same) == 600 * same[0]["doc_tokens"] and len(shards) == 12 and max(shards.values()) < 100


def test_neighbours_share_windows():
    """Of two kinds of documents with words of their own, windows hold one kind wherever they can."""
    rng = np.random.default_rng(1)
    docs = [rng.integers(k * 1000 + 10, k * 1000 + 60, 50).astype(np.uint16) for k in (1, 2) for _ in range(32)]
    idf = np.ones(packing.VOCABULARY, np.float32)
    held = defaultdict(set)
    for i, _, _, s, _ in packing.fill_windows(docs, idf, 50.0, 200):
        held[s].add(i < 32)
    assert sum(len(v) > 1 for v in held.values()) <= 2


# ---- personal data


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("write to jo.doe+x@mail.example.org now", "email:9:34"),
        ("host 10.0.0.256 or 10.0.0.25", "ip:19:28"),
        ("card 4111 1111 1111 1111 and 4111 1111 1111 1112", "card:5:24"),
        ("call +1 (389) 555-5010 please", "phone:5:22"),
        ("jo at mail dot example dot org", "email:0:30"),
        ("jo [at] mail (dot) org", "email:0:22"),
        ("jо@mаil.org with look-alikes", "email:0:11"),
        ("раураl@x.org is half plain", "email:0:12,email:5:12"),
        ("write to jane@ex\u0430mple.org", "email:9:25"),
        ("\U0001d423\U0001d41a\U0001d427\U0001d41e@example.org", "email:0:16"),
        ("call +\u0664\u0669 \u0663\u0660 123456 now", "phone:5:18"),
        ("at 10 dot 0 dot 0 dot 1 now", "ip:3:23"),
        ("ip \u2460\u2461.0.0.\u2460 there", "ip:3:11"),
        ("mail a\u200bb@x.org", "email:5:14,email:7:14"),
        ("call +four nine three zero one two three four five six", "phone:5:54"),
        ("one of the two at the door", ""),
        ("meet at noon", ""),
        ("", ""),
    ],
)
def test_spans_in_source_characters(text, spans):
    assert pii.joined(pii.find(text)[1]) == spans


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("jane at example dot com", "email:0:23"),
        ("write to Jane.Doe AT mail dot example.org now", "email:9:41"),
        ("write to Jane.Doe AT mail.example dot org now", "email:9:41"),
        ("jane at xn--bcher-kva dot xn--p1ai", "email:0:34"),
        ("jane arobase exemple point fr", "email:0:29"),
        ("jane arroba ejemplo punto es", "email:0:28"),
        ("jane ät beispiel punkt de", "email:0:25"),
        ("plus vier neun drei null eins zwei drei vier fünf sechs", "phone:0:55"),
        ("plus trois trois un deux trois quatre cinq six sept huit neuf", "phone:0:61"),
        ("más tres cuatro uno dos tres cuatro cinco seis siete ocho nueve", "phone:0:63"),
        ("jane@example . org", "email:0:18"),
        ("jane @ example.org", "email:0:18"),
        ("plus four nine three zero one two three four five six", "phone:0:53"),
        ("call plus 49 30 123456 today", "phone:5:22"),
        ("start at 3.30", ""),
        ("open at 10.30 am and one at 11.15", ""),
        ("plus 3 more", ""),
        ("call +1 (848) 555-1373 un an", "phone:5:22"),
        ("en 2003 un homme", ""),
        ("one day we looked at example.com", ""),
        ("they arrived at home.Then it rained", ""),
        ("call me at 5.30 tomorrow", ""),
        ("un point un deux", ""),
        ("uno dos tres", ""),
        ("zwei oder drei von acht", ""),
    ],
)
def test_each_disguise_alone_and_beside_others(text, spans):
    assert pii.joined(pii.find(text)[1]) == spans
    assert pii.joined(pii.find(text + " \u2013 two")[1]) == spans


PROSE = [
    "We decided at this point in time to stop.", "See you at noon point blank", "at some point during the day", "he left at one point and came back", "at that point they knew", "Look at the red dot in the corner.",
    "look at example dot com for more", "meet me at home.Then we go", "find us at example.com", "open at 9 dot in the morning", "Coffee @ noon. Then work", "See you @ this point in time", "They met at a point on the map",
    "Nous sommes at home point final", "Il est arrivé à un point de non-retour", "treffen uns at home punkt acht Uhr", "Er kam an diesem Punkt an", "estamos at casa punto en boca", "a este punto de la noche", "tom & jerry &amp; co at work &lt;b&gt;",
]


def prose_with_points(rng, n):
    """Sentences of four languages around `at ... point`, `dot`, `punkt`, `punto`, as prose has them."""
    before = ["We", "They stopped", "She looked", "He was", "work", "the train arrived", "meet", "prices stood", "nobody was", "let us meet", "Wir sind", "nous étions", "estaban"]
    host = ["this", "that", "some", "one", "a", "the same", "any given", "the very last", "home", "noon", "work", "school", "dawn", "sea"]
    dot = ["point", "dot", "punkt", "punto", "Point", "DOT"]
    after = ["in time", "during the day", "and left", "they knew", "of no return", "blank", "to be clear", "is near", "it stopped", "me and you", "no one came", "on the map", "de la noche", "en ciel", "der Reise", "so we left", "we spoke", "where it began", "is missing.", "was empty", "or later", "at last"]
    for _ in range(n):
        yield f"{rng.choice(before)} {rng.choice(['at', 'at', 'At', '@'])} {rng.choice(host)} {rng.choice(dot)} {rng.choice(after)}{rng.choice(['', '.', ', then', ' and so on'])}"


def test_prose_holds_no_addresses():
    rng = random.Random(8)
    assert [t for t in [*PROSE, *prose_with_points(rng, 10_000)] if pii.find(t)[1]] == []


def test_prose_stays_through_the_query_and_redaction(spark, tmp_path):
    rng = random.Random(9)
    texts = [*PROSE, *prose_with_points(rng, 500), " ".join(PROSE)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], KIND)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["spans"] for r in pii.op8_pii(spark, str(tmp_path)).collect()} == {""}
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()} == dict(enumerate(texts))


#: How an address is disguised, and whether it needs a word before it that announces one.
DISGUISES = [
    lambda a, h, e: f"{a} at {h} dot {e}", lambda a, h, e: f"{a} [at] {h} [dot] {e}", lambda a, h, e: f"{a} (at) {h}.{e}", lambda a, h, e: f"{a} AT {h} DOT {e}", lambda a, h, e: f"{a}&#64;{h}.{e}", lambda a, h, e: f"{a}&commat;{h}&period;{e}",
    lambda a, h, e: f"{a}&#x40;{h}&#46;{e}", lambda a, h, e: f"{a}_at_{h}_dot_{e}", lambda a, h, e: f"{a}-at-{h}-dot-{e}", lambda a, h, e: f"{a} @ {h} . {e}", lambda a, h, e: f"{a}@{h} dot {e}", lambda a, h, e: f"{a} at {h}.{e}",
    lambda a, h, e: f"{a} arobase {h} point {e}", lambda a, h, e: f"{a} arroba {h} punto {e}", lambda a, h, e: f"{a} \u00e4t {h} punkt {e}", lambda a, h, e: f"{a} at {h} punkt {e}", lambda a, h, e: f"{a}\uff20{h}\uff0e{e}", lambda a, h, e: f"{a.replace('a', chr(0x430))}@{h}.{e}",
    lambda a, h, e: f"{a}\u200b@{h}.{e}", lambda a, h, e: f"{a} {{at}} mail dot {h} dot {e}",
]


def test_recall_of_disguises():
    """Each disguise of addresses, phones, cards and IPs in prose: nine tenths at least are found, from start to end."""
    rng, hits, n, missed = random.Random(12), 0, 0, []
    names, hosts, ends = ["jane", "jane.doe", "j_smith", "hans42", "maria", "bob", "tanaka", "info", "sales"], ["example", "mail-box", "uni", "firma", "acme"], ["com", "org", "de", "net", "fr", "es", "co.uk", "io"]
    lead = ["please write to ", "Kontakt: ", "my e-mail is ", "courriel ", "contact "]
    tail = ["", ".", " today", " \u2013 thanks", ", or call"]
    digits = {v: [w for w, x in pii.SPELLED.items() if x == v] for v in "0123456789"}

    def spelled(number):
        return " ".join(rng.choice(digits[c][:1]) for c in number)

    for _ in range(4000):
        kind = rng.random()
        if kind < 0.7:
            found = rng.choice(DISGUISES)(rng.choice(names), rng.choice(hosts), rng.choice(ends))
        elif kind < 0.85:
            found = "plus " + spelled("4930" + "".join(rng.choice("123456789") for _ in range(7)))
        else:
            found = ".".join(chr(0xFF10 + int(c)) if c.isdigit() else c for c in str(rng.randrange(1, 10))) + "".join(f".{rng.randrange(256)}" for _ in range(3))
        before = rng.choice(lead)
        text = before + found + rng.choice(tail)
        n += 1
        if any(a <= len(before) and b >= len(before) + len(found.rstrip(".")) for a, b, _ in pii.find(text)[1]):
            hits += 1
        else:
            missed.append(text)
    assert hits / n >= 0.9, (hits / n, missed[:20])


def test_the_gate_drops_nothing(monkeypatch):
    """Whatever is found with the gate open is found with it."""
    rng = random.Random(4)
    parts = ["jane", "example", "com", "fünf", "punkt", " arroba ", " at ", " dot ", ".", " . ", "@", " @ ", "[at]", "( dot )", " ", "plus ", "Plus", "four", "Nine", "one", "1", "30", "555", "-", "phone"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(3, 24))) for _ in range(20000)]
    texts += [rng.choice(["", "plus "]) + rng.choice(["", " ", "-"]).join(rng.choice([*pii.SPELLED, "7", "12"]) for _ in range(12)) for _ in range(2000)]
    got = [pii.find(t)[1] for t in texts]
    monkeypatch.setattr(pii, "may_hold_signs", lambda low: True)
    monkeypatch.setattr(pii, "may_hold_digits", lambda low: True)
    want = [pii.find(t)[1] for t in texts]
    assert [x for x in zip(texts, got, want, strict=True) if x[1] != x[2]] == [] and sum(map(bool, want)) > 500


def test_plain_spans_stay_and_redaction_takes_effect(spark, edge, clashing):
    rows = [(1, "a@b.co and c [at] d [dot] org", None, None, 0), (2, None, None, None, 0), (3, "", None, None, 0), (1, "a@b.co and c [at] d [dot] org", None, None, 0)]
    df = clashing(spark.createDataFrame(rows, KIND))
    got = pii.detect(df).orderBy("doc_id").collect()
    assert len(got) == 4 and got[0]["n_email"] == 1 and got[0]["n_added"] == 1 and got[0]["spans"] == "email:0:6,email:11:29"
    assert got[0]["base_sha256"] == hashlib.sha256(b"email:0:6").hexdigest() and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    out = pii.redact(df)
    assert out.columns == df.columns and sorted("-" if r["text"] is None else r["text"] for r in out.collect()) == ["", "-", "<email> and <email>", "<email> and <email>"]


@pytest.mark.parametrize("letters", ["1.@a", "12. -+a", "a@.-_9", "+1 ()4", "0.2 5"])
def test_plain_spans_are_those_of_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 30)))
        want = [(m.start(), m.end(), k) for k, p in pii.PATTERNS.items() for m in p.finditer(text) if pii.holds(k, m[0])]
        assert pii.plain_spans(text) == sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[2]))), text


@pytest.mark.parametrize("text", ["one " + "1" * 60 + "abc", "one dot " + "x" * 200_000, "1.2.3 " + "9" * 200_000, "1.2.3." + "9" * 5000, "a@b.c " + "x" * 200_000, "+1" + " (" * 100_000, "@" * 100_000, "one " * 50_000, "1 " * 100_000 + "a one"])
def test_long_runs_are_read_once(text):
    began = time.process_time()
    pii.find(text)
    assert time.process_time() - began < 5


def test_personal_data_in_a_long_text():
    """20 MB with a disguise here and there."""
    text = ("plain words of prose " * 10_000 + "jo at mail dot org, ") * 95
    plain, every = pii.find(text)
    assert len(text) > 19_900_000 and plain == [] and len(every) == 95 and text[every[-1][0] : every[-1][1]] == "jo at mail dot org"


def test_tapes_map_back():
    t = pii.Tape("abcdef")
    assert t.span(1, 3) == (1, 3)
    t.rewrite([(1, 3, "X"), (4, 5, "")])
    t.rewrite([(0, 2, "YZ")])
    assert t.text == "YZdf" and t.span(0, 1) == (0, 3) and t.span(2, 4) == (3, 6)


def test_tapes_map_back_as_spans_of_every_character_would():
    rng = random.Random(7)
    for _ in range(500):
        t, spans = pii.Tape("".join(rng.choice("abc") for _ in range(20))), [(i, i + 1) for i in range(20)]
        for _ in range(3):
            edits, at, new = [], 0, []
            while at < len(t.text):
                j = min(len(t.text), at + rng.randrange(1, 4))
                if rng.random() < 0.3:
                    edits.append((at, j, "xyz"[: rng.randrange(3)]))
                    new += [(spans[at][0], spans[j - 1][1])] * len(edits[-1][2])
                else:
                    new += spans[at:j]
                at = j
            t.rewrite(edits)
            spans = new
        assert len(t.text) == len(spans)
        for a in range(len(spans)):
            b = rng.randrange(a + 1, len(spans) + 1)
            assert t.span(a, b) == (spans[a][0], spans[b - 1][1])


def test_disguises_through_the_query(spark, tmp_path):
    """All spans of op8 on stored documents: plain ones as their patterns give them, disguised ones where they were written."""
    forms = ["jo at mail dot org", "jo [at] mail [dot] org", "j\u043e@mail.org", "jo @ mail.org", "plus four nine three zero one two three four five six", "\uff11\uff10.0.0.1"]
    prose_ = ["we looked at example.com", "meet me at 5.30", "one of two", "", None]
    rows = [(i, f"{prose_[i % 3]}, then {f}, no. {i}", None, None, 0) for i, f in enumerate(forms)] + [(100 + i, t, None, None, 0) for i, t in enumerate(prose_)]
    spark.createDataFrame(rows, KIND).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in pii.op8_pii(spark, str(tmp_path)).collect()}
    for i, t, *_ in rows:
        want = [(m.start(), m.end(), k) for k, p in pii.PATTERNS.items() for m in p.finditer(t or "") if pii.holds(k, m[0])]
        base = pii.joined(sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[2]))))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        if i < 100:
            at = t.index(forms[i])
            assert f":{at}:{at + len(forms[i])}" in got[i]["spans"] and got[i]["n_added"] == 1
        else:
            assert got[i]["spans"] == "" and got[i]["n_added"] == 0


# ---- language


def test_language_on_held_out_rows(spark, clashing):
    rng = random.Random(5)
    parts = {"en": "the and thing er ation on", "de": "und der sch keit ung ei", "fr": "les eau ou oir ment que", "es": "el los ción ado ar que"}
    rows = [(i, " ".join("".join(rng.choice(parts[l].split()) for _ in range(rng.randrange(1, 4))) for _ in range(30)), l, "s", 0) for i in range(400) for l in [rng.choice(sorted(parts))]]
    rows += [(900, None, "en", None, 0), (901, "123 !?", "de", None, 0), (902, "", None, None, 0), (903, "\u3042", None, None, 0), (None, "the thing", "en", None, 0)]
    df = clashing(spark.createDataFrame(rows, KIND))
    got = {r["doc_id"]: r for r in language.identify(df, language.fit(df)).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] != "und"


def test_language_with_nothing_to_learn(spark, empty):
    df = spark.createDataFrame([(1, "some words", None, None, 0)], KIND)
    assert language.identify(df, language.fit(df)).first()["lang_pred"] == "und"
    assert language.identify(empty, language.fit(empty)).count() == 0


# ---- components


@pytest.mark.parametrize("few", [10, 1 << 18])
def test_components_against_union(spark, monkeypatch, few):
    from palaver.llm import components as C

    monkeypatch.setattr(C, "TASK_EDGES", few)
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            head[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(head)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
