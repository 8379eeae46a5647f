"""Language identification in two levels: the family first, then one-versus-one linear SVMs within it.

A text is a unit vector of its bytes and hashed byte trigrams (square roots of counts, ASCII letters lower-cased). One
linear SVM for each family, one against the rest, names the family; within it an SVM for each pair of languages votes.
Every SVM is trained in a task of its own on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, blocks, buffers, held_out, small_batches, stash, table

#: Families of languages by ISO 639-1 code. A language that isn't listed belongs to the family "other".
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: Labelled rows per language that are learnt from, about; the sample is by hash of the id.
SAMPLE = 1500
TRIGRAMS = 2048
WIDTH = 256 + TRIGRAMS
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SMALL = np.arange(256, dtype=np.uint32)
_SMALL[65:91] += 32


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower()[:2], "other")


def _counts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and trigrams of each text, by value."""
    n = len(at) - 1
    of = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    low = _SMALL[data]
    single = np.bincount(of * 256 + low, minlength=n * 256).reshape(n, 256)
    if len(data) < 3:
        return single, np.zeros((n, TRIGRAMS), np.int64)
    tri = ((low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]) * np.uint32(2654435761) >> np.uint32(21)
    same = of[:-2] == of[2:]
    return single, np.bincount((of[:-2] * TRIGRAMS + tri)[same], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)


def vectors(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """n texts that lie end to end -> n unit vectors of WIDTH float32; an empty text is all zeros.

    A text of more than BLOCK bytes that stands alone is counted BLOCK at a time."""
    data, at = data[at[0] : at[-1]], at - at[0]
    n, size = len(at) - 1, len(data)
    if n == 1 and size > BLOCK:
        single, many = np.zeros((1, 256), np.int64), np.zeros((1, TRIGRAMS), np.int64)
        for i in range(0, size, BLOCK):
            piece = data[i : i + BLOCK + 2]
            more = _counts(piece, np.array([0, len(piece)]))
            single += more[0]
            many += more[1]
            single[0] -= np.bincount(_SMALL[piece[BLOCK:]], minlength=256)
    else:
        single, many = _counts(data, at)
    out = np.empty((n, WIDTH), np.float32)
    out[:, :256] = np.sqrt(single)
    out[:, 256:] = np.sqrt(many)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    if len(at) == 2:
        out = np.array([_LETTER[data[at[0] : at[1]]].any()])
    else:
        out = np.diff(np.concatenate([[0], np.cumsum(_LETTER[data[at[0] : at[-1]]])])[at - at[0]]) > 0
    for i in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[i] = any(map(str.isalpha, data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def _sample_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = buffers(b.column(1))
        for i, j in blocks(at):
            v, ok = vectors(data, at[i : j + 1]), has_letter(data, at[i : j + 1])
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(keep)), pa.array([v[k].astype(np.float16).tobytes() for k in keep], pa.binary())], names=["lang", "vector"])


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss by accelerated gradient steps; y is 1 or -1, classes weigh alike."""
    n, d = x.shape
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1 / (1 / c + 4.0)  # rows are unit vectors, and the bias adds one
    w, z, bias, zb, t = np.zeros(d, np.float32), np.zeros(d, np.float32), 0.0, 0.0, 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z + zb)) * weight * y
        new, nb = z - step * (z / c - 2 * (slack @ x)), zb + step * 2 * slack.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / after * (new - w), nb + (t - 1) / after * (nb - bias)
        w, bias, t = new, nb, after
    return w.astype(np.float32), float(bias)


_MODEL_ARROW = pa.schema([("task", pa.string()), ("weights", pa.binary()), ("bias", pa.float64())])


def _train(t: pa.Table) -> pa.Table:
    column = t["vector"]
    x = np.empty((len(column), WIDTH), np.float32)
    for i, v in enumerate(column):
        x[i] = np.frombuffer(v.as_buffer(), np.float16)
    w, b = fit_svm(x, t["side"].to_numpy().astype(np.float32))
    return pa.Table.from_pylist([{"task": t["task"][0].as_py(), "weights": w.tobytes(), "bias": b}], schema=_MODEL_ARROW)


class Model:
    """The families and their languages, and a weight vector for each SVM; as many as families and pairs within them."""

    def __init__(self, langs: list[str], svms: dict[str, tuple[np.ndarray, float]]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.families.setdefault(family(lang), []).append(lang)
        self.svms = svms

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = sorted(self.families)
        margin = lambda task: x @ self.svms[task][0] + self.svms[task][1] if task in self.svms else np.zeros(len(x))
        if not names:
            return np.full(len(x), UNKNOWN, object), np.zeros(len(x))
        if len(names) > 1:
            m = np.stack([margin(f"f:{f}") for f in names], 1)
            which = m.argmax(1)
            score = _sigmoid(3 * m.max(1))
        else:
            which, score = np.zeros(len(x), int), np.ones(len(x))
        out = np.empty(len(x), object)
        for k, f in enumerate(names):
            langs, at = self.families[f], np.flatnonzero(which == k)
            votes, sure = np.zeros((len(at), len(langs))), np.zeros((len(at), len(langs)))
            for i in range(len(langs)):
                for j in range(i + 1, len(langs)):
                    p = _sigmoid(3 * margin(f"p:{langs[i]}|{langs[j]}")[at])
                    votes[:, i] += p >= 0.5
                    votes[:, j] += p < 0.5
                    sure[:, i] += p
                    sure[:, j] += 1 - p
            best = (votes + sure / (2 * max(1, len(langs)))).argmax(1) if len(langs) > 1 else np.zeros(len(at), int)
            out[at] = np.array(langs, object)[best]
            if len(langs) > 1:
                score[at] *= sure[np.arange(len(at)), best] / (len(langs) - 1)
        return out, score


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from the rows of docs with a language and a letter that are not held out, about `sample` for each language.

    Repeated rows and keys count as often as they come; a null key is not learnt from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang)).count().collect()}
    if not counts:
        return Model([], {})
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    u = F.pmod(F.xxhash64(key, F.lit("lang")), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), u.alias("u")).filter(F.col("u") < share[F.col("lang")])
    seen = stash(chosen.select("lang", "text").mapInArrow(_sample_vectors, "lang string, vector binary"), "language-sample")
    langs = [r[0] for r in seen.select("lang").distinct().collect()]
    groups = Model(langs, {}).families
    tasks = [(l, f"f:{f}", 1 if l in groups[f] else -1) for f in groups for l in langs if len(groups) > 1]
    tasks += [(l, f"p:{a}|{b}", 1 if l == a else -1) for own in groups.values() for i, a in enumerate(own) for b in own[i + 1 :] for l in (a, b)]
    if not tasks:
        return Model(langs, {})
    plan = spark.createDataFrame(tasks, "lang string, task string, side int")
    svms = seen.join(F.broadcast(plan), "lang").groupBy("task").applyInArrow(_train, "task string, weights binary, bias double").collect()
    return Model(langs, {r["task"]: (np.frombuffer(bytes(r["weights"]), np.float32), r["bias"]) for r in svms})


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1). `und` with score 0 if the text is null or holds no letter, or if nothing
    was learnt. Only the text counts. Repeated rows repeat; columns of docs with the new names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    at_column = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = buffers(b.column(at_column))
            lang, score = [np.zeros(0, object)], [np.zeros(0)]
            for i, j in blocks(at):
                found, sure = shared.value.predict(vectors(data, at[i : j + 1]))
                ok = has_letter(data, at[i : j + 1])
                lang.append(np.where(ok, found, UNKNOWN))
                score.append(np.where(ok & (found != UNKNOWN), sure, 0.0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(lang), pa.string()), pa.array(np.concatenate(score), pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, schema + ", lang_pred string, score double")


def op10_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learnt from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
