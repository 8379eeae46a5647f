"""The learnt operators' queries, whole, against plain versions: statistics and vectors by loops, models in numpy."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from palaver.llm import language, quality

from .conftest import KIND, edge_rows, prose

WORDS = {
    "de": "der und nicht ich mit auf werden eine auch schon über Straße immer zwischen möglich".split(),
    "en": "the and not with have this that they from would which there their about other".split(),
    "nl": "het een niet van zijn ook maar voor worden naar heeft deze alle tussen mogelijk".split(),
    "es": "el los por para como pero muy también niño donde entre después porque año esto".split(),
    "fr": "le les pour dans avec mais très aussi où entre après parce déjà cette être".split(),
}


def held(i: int | None) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def folder(spark, tmp_path, rows: list[tuple], labels: list[tuple] | None = None) -> str:
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    if labels is not None:
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


# ---- quality


def plain_statistics(text: str | None) -> list[float]:
    text = text or ""
    data, split = text.encode(), lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    words, lines = split(text), [tuple(split(x)) for x in text.split("\n")]
    lines, counts, bytes_ = [x for x in lines if x], Counter(words), Counter(data)
    n, w, k = max(1, len(data)), max(1, len(words)), max(1, len(lines))
    share = lambda chars: sum(bytes_[c] for c in chars) / n
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        sum(len(x.encode()) for x in words) / w,
        len(counts) / w,
        -sum(c / n * np.log2(c / n) for c in bytes_.values()),
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        share(b"0123456789"),
        share(b".?:;"),
        share(b","),
        share(b"!"),
        share(b"#$%&*@+<=>\\^_`{}~"),
        share(b"|"),
        share(range(128, 256)),
        share(b" \t\r\n"),
        np.log1p(len(lines)),
        len(set(lines)) / k,
        np.log1p(len(words) / k),
        max(counts.values(), default=0) / w,
        sum(len(re.findall("[A-Z]", x)) >= 2 for x in words) / w,
    ]


def plain_isotonic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The non-decreasing fit at each of ascending x: greatest over beginnings of the least over ends of the mean between."""
    upto = np.r_[0, np.cumsum(y)]
    n = len(y)
    return np.array([max(min((upto[k + 1] - upto[j]) / (k + 1 - j) for k in range(i, n)) for j in range(i + 1)) for i in range(n)])


def test_quality_query_against_a_plain_model(spark, tmp_path):
    """Edge rows, repeated ids in both tables (every document with every label of its id counts), labels of none."""
    rng = random.Random(3)
    rows, labels = edge_rows(), [(0, None, 1), (3, 1, 0), (3, 0, 0), (None, 1, 0), (5, 7, 0), (99999, 1, 0)]
    for i in range(300, 700):
        good = rng.random() < 0.6
        mess = rng.random() < 0.15
        words = [x if good or mess else x.upper() + rng.choice(["!!", "##", "|", ""]) for x in prose(rng, rng.randrange(3, 70)).split(" ")]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words), None, None, 0))
        labels.append((i, int(good), 0))
    got = quality.op5_quality(spark, folder(spark, tmp_path, rows, labels)).collect()

    stats = [plain_statistics(r[1]) for r in rows]
    learnt = [(i, label, zlib.crc32(str(i).encode()) % 5, x) for r, x in zip(rows, stats, strict=True) for i, label, _ in labels if i is not None and i == r[0] and label in (0, 1) and not held(i)]
    x, y, fold = (np.array([r[k] for r in learnt], float) for k in (3, 1, 2))
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    draws = np.random.default_rng(quality.SEED)
    project = draws.normal(size=(x.shape[1], quality.FEATURES)) / np.sqrt(x.shape[1])
    phase = draws.uniform(0, 2 * np.pi, quality.FEATURES)
    features = lambda a: np.hstack([np.cos(np.clip((np.array(a) - mean) / scale, -6, 6) @ project + phase) * np.sqrt(2 / quality.FEATURES), np.ones((len(a), 1))])
    z, t = features(x[fold != 1]), y[fold != 1]
    penalty = np.sqrt(len(t) * quality.RIDGE * np.r_[np.full(quality.FEATURES, 1 / quality.FEATURES), 1e-9])
    weights = np.linalg.lstsq(np.vstack([z, np.diag(penalty)]), np.r_[t, np.zeros(len(penalty))], rcond=None)[0]  # ridge as rows of its own
    raw = features(x[fold == 1]) @ weights
    order = np.lexsort((y[fold == 1], raw))
    fit = plain_isotonic(raw[order], y[fold == 1][order])
    levels = sorted(set(np.round(fit, 12)))
    knots = [raw[order][np.abs(fit - v) < 1e-9].mean() for v in levels]
    want = np.interp(features(stats) @ weights, knots, levels)
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0], round(r[1], 4))
    a = sorted(((r["doc_id"] or -1, r["score"]) for r in got), key=key)
    b = sorted(((r[0] or -1, s) for r, s in zip(rows, want.tolist(), strict=True)), key=key)
    assert [i for i, _ in a] == [i for i, _ in b]
    assert [s for _, s in a] == pytest.approx([s for _, s in b], abs=1e-3)
    assert all(r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.3) for r in got)


# ---- language


def plain_vector(text: str) -> np.ndarray:
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    out = np.zeros(256 + 2048)
    for c in low:
        out[c] += 1
    for i in range(len(low) - 2):
        out[256 + (int.from_bytes(low[i : i + 3]) * 2654435761 % (1 << 32) >> 21)] += 1
    out = np.sqrt(out)
    return out / (np.sqrt((out * out).sum()) or 1)


def plain_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0) -> tuple[np.ndarray, float]:
    """The same loss by plain gradient steps, many of them, in double precision."""
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(4000):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * weight * y
        w, b = w - 0.2 * (w / c - 2 * (slack @ x)), b + 0.2 * 2 * slack.sum()
    return w, b


def test_language_query_against_plain_machines(spark, tmp_path):
    """Edge rows beside five languages in two families, repeated ids and rows included: each row is learnt as often as it comes."""
    rng = random.Random(6)
    rows = [r for r in edge_rows() if r[2] is None or not any(c.isalpha() for c in r[1] or "")]
    for i in range(1000, 1200):
        lang = rng.choice(list(WORDS))
        mixed = WORDS[lang] + (WORDS[rng.choice(list(WORDS))][:4] if i % 3 == 0 else [])
        rows.append((i, " ".join(rng.choice(mixed) for _ in range(rng.randrange(2, 30))), lang if i % 7 else None, None, 0))
    rows += [rows[-1], rows[-1], (1003, "der die das und auch", "de", None, 0)]
    got = language.op10_language(spark, folder(spark, tmp_path, rows)).collect()

    letters = lambda t: any(c.isalpha() for c in t or "")
    learnt = [(r[2], plain_vector(r[1])) for r in rows if r[2] is not None and r[0] is not None and not held(r[0]) and letters(r[1])]
    lang, x = [a for a, _ in learnt], np.array([v for _, v in learnt])
    families = {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"]}
    first = {f: plain_svm(x, np.array([1.0 if a in own else -1.0 for a in lang])) for f, own in families.items()}
    pairs = {}
    for own in families.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                at = [k for k, l in enumerate(lang) if l in (a, b)]
                pairs[a, b] = plain_svm(x[at], np.array([1.0 if lang[k] == a else -1.0 for k in at]))
    sure = lambda m: 1 / (1 + np.exp(-3 * m))

    def predict(text: str | None) -> tuple[str, float]:
        if not letters(text):
            return "und", 0.0
        v = plain_vector(text)
        margin = {f: v @ w + b for f, (w, b) in first.items()}
        best = max(margin, key=margin.get)
        votes, trust = Counter(), Counter()
        for (a, b), (w, bias) in pairs.items():
            if a in families[best]:
                p = sure(v @ w + bias)
                votes[a if p >= 0.5 else b] += 1
                trust[a] += p
                trust[b] += 1 - p
        winner = max(families[best], key=lambda l: (votes[l], trust[l]))
        return winner, sure(margin[best]) * trust[winner] / (len(families[best]) - 1)

    want = {(r[0], *predict(r[1])) for r in rows}
    assert len(got) == len(rows) and {r["doc_id"] for r in got} == {r[0] for r in rows}
    near = lambda r: [w for w in want if w[0] == r["doc_id"] and w[1] == r["lang_pred"] and abs(w[2] - r["score"]) < 0.02]
    assert not [r for r in got if not near(r)]
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    truth = {r[0]: r[2] for r in rows if r[0] and r[0] >= 1000 and held(r[0]) and r[2]}
    assert len(truth) > 20 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth]) > 0.9
