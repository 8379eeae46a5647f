"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Cosines of random projections approximate a Gaussian kernel over standardised statistics of a text. Partitions of the
labelled sample each sum their part of the normal equations; their total is solved for ridge weights. Scores of rows
that the weights were not fitted on are calibrated by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, U64, blocks, buffers, held_out, mix, small_batches, stash, table, word_hashes

#: Labelled rows that are learnt from, about; the sample is by hash of the id.
SAMPLE = 20_000
FEATURES = 256
RIDGE = 1e-3
THRESHOLD = 0.3
SEED = 515
#: Partitions of the sample, each with its own sum of (FEATURES + 1) ** 2 numbers.
PARTS = 6
NAMES = ("chars", "words", "word_length", "distinct_words", "entropy", "upper", "digits", "stops", "commas", "shouts", "signs", "bars", "foreign", "blanks", "lines", "distinct_lines", "words_per_line", "top_word", "caps_words")
_CLASSES = {"upper": range(65, 91), "digits": range(48, 58), "stops": b".?:;", "commas": b",", "shouts": b"!", "signs": b"#$%&*@+<=>\\^_`{}~", "bars": b"|", "foreign": range(128, 256), "blanks": b" \t\r\n"}
_MASKS = np.zeros((256, len(_CLASSES)), np.float64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _MASKS[list(_bytes), _k] = 1
_LEAD = np.ones(256)
_LEAD[128:192] = 0


def _per_text(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: how many hashes, how many distinct ones, and how often its commonest one occurs."""
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.r_[first, len(h)])
    top = np.zeros(n)
    np.maximum.at(top, of[first], runs)
    return np.bincount(of, minlength=n).astype(float), np.bincount(of[first], minlength=n).astype(float), top


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """n texts that lie end to end -> n rows of the statistics in NAMES; zeros for an empty text."""
    data, at = data[at[0] : at[-1]], at - at[0]
    n = len(at) - 1
    if n == 1:
        hist = sum((np.bincount(data[i : i + BLOCK], minlength=256) for i in range(0, len(data), BLOCK)), np.zeros(256)).reshape(1, 256)
    else:
        of = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
        hist = np.bincount(of * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    size = np.maximum(hist.sum(1), 1)
    share = hist / size[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(1)
    h, text, first, end = word_hashes(data, at, lower=False)
    words, kinds, top = _per_text(h, text, n)
    caps = np.concatenate([np.zeros(1, np.int32), np.cumsum((data >= 65) & (data <= 90), dtype=np.int32)])
    shout = np.bincount(text[(caps[end] - caps[first] >= 2)], minlength=n)
    breaks = np.flatnonzero(data == 10) + 1
    cuts = np.unique(np.r_[at[:-1][np.diff(at) > 0], breaks[breaks < len(data)]])
    line_of = np.searchsorted(at, cuts, "right") - 1
    # a line's hash is the sum of its words' hashes by place
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h + (np.arange(len(h)) - np.searchsorted(first, cuts)[np.searchsorted(cuts, first, "right") - 1]).astype(U64)))]) if len(h) else np.zeros(1, U64)
    upto = np.searchsorted(first, np.r_[cuts, len(data)])
    full = np.diff(upto) > 0
    lines, distinct_lines, _ = _per_text((total[upto[1:]] - total[upto[:-1]])[full], line_of[full], n)
    per = lambda a, b: a / np.maximum(b, 1)
    groups = share @ _MASKS
    return np.column_stack([
        np.log1p(hist @ _LEAD), np.log1p(words), per(np.bincount(text, (end - first).astype(float), minlength=n), words), per(kinds, words), entropy,
        groups, np.log1p(lines), per(distinct_lines, lines), np.log1p(per(words, lines)), per(top, words), per(shout, words),
    ])


class Model:
    """Standardisation, projection, ridge weights and calibration; its size depends on FEATURES alone."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.project = rng.normal(size=(len(mean), FEATURES)) / np.sqrt(len(mean))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.full(1, 0.5))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.project + self.phase) * np.sqrt(2 / FEATURES), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x: pooled blocks' mean x and y, to be joined by lines."""
    order = np.argsort(x, kind="stable")
    pooled: list[list[float]] = []  # sum of x, sum of y, rows
    for a, b in zip(x[order], y[order], strict=True):
        pooled.append([a, b, 1.0])
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
            last = pooled.pop()
            pooled[-1] = [u + v for u, v in zip(pooled[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pooled]), np.array([p[1] / p[2] for p in pooled])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, fold, text) -> (label, fold, statistics)."""
    for b in batches:
        data, at = buffers(b.column(2))
        for i, j in blocks(at):
            x = statistics(data, at[i : j + 1])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "fold", "x"])


def _rows_of(b: pa.RecordBatch, k: int) -> np.ndarray:
    return np.array(b.column(k).to_pylist(), float).reshape(len(b), len(NAMES))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from labelled rows that are not held out, about `sample` of them. A label other than 0 or 1 is none.

    Of a repeated key every document counts with every label, in one sample and one fold; a null key has no label.
    """
    small_batches(docs.sparkSession)
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(key, F.col(label).cast("double").alias("label"))
    n = marked.count()
    u = F.pmod(F.xxhash64(key, F.lit("quality")), F.lit(1 << 20)) / float(1 << 20)
    marked = marked.filter(u < min(1.0, sample / max(1, n)))
    fold = (F.crc32(F.col(key).cast("string").cast("binary")) % 5).cast("int")
    rows = docs.select(key, text).join(marked, key).select("label", fold.alias("fold"), F.col(text).alias("text"))
    seen = stash(rows.mapInArrow(_measure, "label double, fold int, x array<double>"), "quality-sample").repartition(PARTS)
    k = len(NAMES)
    moments = seen.agg(*[F.avg(F.get("x", F.lit(i))) for i in range(k)], *[F.stddev_pop(F.get("x", F.lit(i))) for i in range(k)]).first()
    mean, scale = np.array([v or 0.0 for v in moments[:k]]), np.array([v or 1.0 for v in moments[k:]])
    model = Model(mean, scale)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, y, rows = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for b in batches:
            z = model.features(_rows_of(b, 1))
            a, y, rows = a + z.T @ z, y + z.T @ b.column(0).to_numpy(), rows + len(b)
        yield pa.RecordBatch.from_pydict({"a": [a.tobytes()], "y": [y.tobytes()], "n": [rows]})

    # Ridge weights come from folds 2 to 4, calibration from fold 1.
    parts = seen.filter("fold <> 1").select("label", "x").mapInArrow(sums, "a binary, y binary, n long").collect()
    n = sum(r["n"] for r in parts)
    if not n:
        return model
    a = sum(np.frombuffer(bytes(r["a"])).reshape(FEATURES + 1, -1) for r in parts)
    y = sum(np.frombuffer(bytes(r["y"])) for r in parts)
    model.weights = np.linalg.solve(a / n + RIDGE * np.diag(np.r_[np.full(FEATURES, 1 / FEATURES), 1e-9]), y / n)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.raw(_rows_of(b, 1)))], names=["label", "raw"])

    fold_1 = seen.filter("fold = 1").select("label", "x").mapInArrow(raw, "label double, raw double").orderBy("raw", "label").collect()  # a quarter of the sample
    if fold_1:
        model.knots = isotonic(np.array([r["raw"] for r in fold_1]), np.array([r["label"] for r in fold_1]))
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1; higher: label 1 likelier) and predicted (1 if score >= threshold).

    Null and empty texts are scored alike, by zero statistics. Without labelled rows all scores are 0.5. Only the text
    counts; repeated rows repeat; columns of docs with the new names are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    at_column, names = docs.columns.index(text), docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = buffers(b.column(at_column))
            s = np.concatenate([np.zeros(0), *(shared.value.score(statistics(data, at[i : j + 1])) for i, j in blocks(at))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, schema + ", score double, predicted int")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
