"""PCM audio in DataFrames: levels, cuts at quiet places, WAV bytes."""

from __future__ import annotations

import io
import math
import struct
import time
import wave
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palaver.functions.lookups import MOST_ATTEMPTS
from palaver.functions.text import non_empty
from palaver.operators.providers import merge_results, reply_language, turn_outcomes
from palaver.operators.intervals import overlapping
from palaver.operators.segments import chunk_speakers, eligible_turns
from palaver.operators.transcripts import longest, normalize, transcripts
from palaver.sources.shared import written

FULL_SCALE = 32768.0
SILENCE_DBFS, LEAST_S = -60.0, 0.5
CHUNK_S, SEARCH_S, WINDOW_S = 600.0, 2.0, 0.1


def rms_dbfs(mean_square: Column) -> Column:
    """Level of a mean square in full-scale units; minus infinity for silence or nothing (log10(0) is null in Spark)."""
    return F.when(F.coalesce(mean_square, F.lit(0.0)) > 0, 20 * F.log10(F.sqrt(mean_square))).otherwise(F.lit(float("-inf")))


def levels(recordings: DataFrame, samples: str = "samples") -> DataFrame:
    """recording_id, n_samples and rms_dbfs of samples in full-scale units; a partial aggregate per recording, so long
    recordings may come as many rows."""
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    by = recordings.groupBy("recording_id").agg(F.sum(square).alias("s"), F.sum(F.size(samples)).cast("long").alias("n_samples"))
    return by.select("recording_id", "n_samples", rms_dbfs(F.try_divide("s", "n_samples")).alias("rms_dbfs"))


def too_quiet(seconds: Column, dbfs: Column) -> Column:
    return (seconds < LEAST_S) | (dbfs < SILENCE_DBFS)


class Cuts:
    """Where recordings of a rate are cut: stretches of at most `longest` seconds, in whole samples.

    Each cut is the middle of the quietest window, hops of half a window apart, in the last seconds before the limit; the
    first of equals. Windows begin at multiples of `cell` samples wherever earlier cuts fell, so energies by cell are all
    that cutting needs: at 16 kHz and 10 minutes a cell is a hop of 50 ms, 800 samples.
    """

    def __init__(self, rate: int, longest: float = CHUNK_S):
        self.rate, self.longest = rate, max(1, math.floor(longest * rate))
        self.width = max(1, math.floor(rate * WINDOW_S + 0.5))
        self.hop, self.least, self.search = max(1, self.width // 2), math.floor(0.5 * rate), math.floor(SEARCH_S * rate)
        self.cell = math.gcd(self.hop, self.width, self.width // 2, self.longest, abs(self.longest - self.search), self.least)

    def energies(self, samples: np.ndarray, offset: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Cells that samples from `offset` on fall into, and their sums of squares there."""
        if not len(samples):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = offset // self.cell
        starts = np.maximum(np.arange(first, (offset + len(samples) - 1) // self.cell + 1) * self.cell - offset, 0)
        return first + np.arange(len(starts)), np.add.reduceat(samples.astype(np.int64) ** 2, starts)

    def fold(self, energy: np.ndarray, n: int) -> list[tuple[int, int]]:
        """Stretches of a recording of n samples from the energies of its cells."""
        total, out, begin = np.concatenate([[0], np.cumsum(energy)]), [], 0
        while n - begin > self.longest:
            limit = begin + self.longest
            first, last = max(begin + self.least, limit - self.search), min(n, limit) - self.width
            at = np.arange(first, last + 1, self.hop)
            best = int(at[np.argmin(total[(at + self.width) // self.cell] - total[at // self.cell])]) if len(at) else last
            end = max(begin + max(1, self.least), min(limit, best + self.width // 2))
            out.append((begin, end))
            begin = end
        return [*out, (begin, n)]


def quiet_cuts(samples: np.ndarray, rate: int, longest: float) -> list[tuple[float, float]]:
    """Cuts of one recording, in seconds."""
    c = Cuts(rate, longest)
    return [(a / rate, b / rate) for a, b in c.fold(c.energies(samples)[1], len(samples))]


#: Samples of the blocks in a task: this many at most, and where that leaves cores idle, FEW_SAMPLES at least.
FEW_SAMPLES, MANY_SAMPLES = 1 << 18, 1 << 24


def tasks_for(spark: SparkSession, n: int, few: int, many: int) -> int:
    """Tasks for n things, which are counted and not weighed, as sound compresses well: `many` in each at most; less where
    there are so few that cores would be idle, but `few` at least."""
    return max(1, -(-n // many), min(-(-n // few), 2 * spark.sparkContext.defaultParallelism))


def block_sizes(blocks: DataFrame) -> DataFrame:
    """recording_id, part and n, the samples of each block; null if they are."""
    return blocks.select("recording_id", "part", F.when(F.col("samples").isNotNull(), F.size("samples")).cast("long").alias("n"))


def placed_blocks(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks of recordings (recording_id, part, samples) with offset, the samples before each. Only sizes meet in a window;
    samples stay where they are until a join by recording and part."""
    before = F.sum("n").over(W.partitionBy("recording_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return blocks.join(sizes.select("recording_id", "part", F.coalesce(before, F.lit(0)).alias("offset")), ["recording_id", "part"])


def cell_energies(placed: DataFrame, rate: int, longest: float = CHUNK_S) -> DataFrame:
    """Blocks without their samples: recording_id, part, offset, n, square (the sum of squares) and energies, those of the
    cells that the block reaches, from offset // cell on, as int64."""
    cuts = Cuts(rate, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, at = b.column(3), b.column(2).to_pylist()
            ends, values = held.offsets.to_numpy(), held.values.to_numpy(zero_copy_only=False)
            found = [cuts.energies(values[i:j], o)[1] for i, j, o in zip(ends[:-1], ends[1:], at, strict=True)]
            added = [pa.array(np.diff(ends).astype(np.int64)), pa.array([int(e.sum()) for e in found], pa.int64()), pa.array([e.tobytes() for e in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *added], ["recording_id", "part", "offset", "n", "square", "energies"])

    part = placed.schema["part"].dataType.simpleString()
    return placed.select("recording_id", "part", "offset", "samples").mapInArrow(run, f"recording_id long, part {part}, offset long, n long, square long, energies binary")


def folded_cuts(energies: DataFrame, rate: int, longest: float = CHUNK_S) -> DataFrame:
    """The cuts of recordings from cell_energies(): recording_id, chunk_no, chunk_from, chunk_to in seconds.

    Each cut depends on the one before it, so a recording's cells meet in one row: at 16 kHz an hour is 72,000 numbers. What
    is exchanged is a row a block; cells that two blocks share are added up here."""
    cuts = Cuts(rate, longest)
    schema = pa.schema([("recording_id", pa.int64()), ("chunk_no", pa.int64()), ("chunk_from", pa.float64()), ("chunk_to", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, held in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                offset, size, found = held.values.flatten()
                n = int(size.to_numpy().sum())
                energy = np.zeros(-(-n // cuts.cell), np.int64)
                for o, e in zip(offset.to_pylist(), found.to_pylist(), strict=True):
                    energy[o // cuts.cell : o // cuts.cell + len(e) // 8] += np.frombuffer(e, np.int64)
                rows += [(i, k, a / rate, z / rate) for k, (a, z) in enumerate(cuts.fold(energy, n))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    whole = energies.groupBy("recording_id").agg(F.collect_list(F.struct("offset", "n", "energies")).alias("blocks"))
    return whole.mapInArrow(run, "recording_id long, chunk_no long, chunk_from double, chunk_to double")


def chunks(recordings: DataFrame, rate: int, longest: float = CHUNK_S) -> DataFrame:
    """recordings (recording_id, samples array<int or smallint>, and part if a recording is many rows) -> recording_id,
    chunk_no, chunk_from, chunk_to in seconds.

    Samples are reduced to energies by cell where they lie, a block at a time.
    A null among a recording's blocks counts as no samples; a recording of nulls alone has no chunks."""
    blocks = recordings if "part" in recordings.columns else recordings.withColumn("part", F.lit(0))
    blocks = blocks.filter("samples is not null").select(F.col("recording_id").cast("long").alias("recording_id"), "part", "samples")
    return folded_cuts(cell_energies(placed_blocks(blocks, block_sizes(blocks)), rate, longest), rate, longest)


def to_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def _pcm(data: bytes, kind: int, bits: int) -> np.ndarray:
    """Sample values of WAV data in 16-bit units, as float64: unsigned 8-bit, signed 16, 24 and 32-bit, 32 and 64-bit float."""
    if kind == 3:
        return np.frombuffer(data, {32: "<f4", 64: "<f8"}[bits]).astype(float) * FULL_SCALE
    if bits == 8:
        return (np.frombuffer(data, np.uint8).astype(float) - 128) * 256
    if bits == 24:
        x = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((x[:, 0] << 8 | x[:, 1] << 16 | x[:, 2] << 24) >> 8) / 256.0
    return np.frombuffer(data, {16: "<i2", 32: "<i4"}[bits]).astype(float) / {16: 1, 32: 1 << 16}[bits]


def _decoded(data: bytes) -> tuple[np.ndarray, int]:
    """Samples in 16-bit units, channels averaged, and the rate of a WAV; ValueError if it isn't one that is known."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV")
    at, form, sound = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            form = (struct.unpack("<H", body[24:26])[0] if kind == 0xFFFE and len(body) >= 26 else kind, channels, rate, bits)
        if name == b"data":
            sound = body
        at += 8 + size + size % 2
    if form is None or sound is None or form[0] not in (1, 3) or not form[1] or not form[2] or form[3] not in ((8, 16, 24, 32) if form[0] == 1 else (32, 64)):
        raise ValueError("unknown sound")
    kind, channels, rate, bits = form
    frame = channels * bits // 8
    return _pcm(sound[: len(sound) // frame * frame], kind, bits).reshape(-1, channels).mean(1), rate


def to_int16(x: np.ndarray) -> np.ndarray:
    return np.clip(np.trunc(x), -32768, 32767).astype(np.int16)


class Resampler:
    """Samples of one rate to another by a polyphase low-pass filter, a block at a time.

    An output stands at input time k * down / up; its taps are one of `up` phases of a windowed sinc that is cut at the lower
    of both rates. What the next block's outputs still need of the earlier samples is carried, so blocks of any size give
    what the whole recording would.
    """

    #: Zero crossings of the sinc on either side, and the window's shape: above 80 dB of what would fold back is removed.
    CROSSINGS, BETA = 24, 9.0

    def __init__(self, rate: int, to: int):
        both = math.gcd(rate, to)
        self.up, self.down = to // both, rate // both
        cut = min(1.0, to / rate) * 0.97
        self.half = math.ceil(self.CROSSINGS / cut)
        t = np.arange(1 - self.half, self.half + 1)[None, :] - np.arange(self.up)[:, None] / self.up
        window = np.i0(self.BETA * np.sqrt(np.clip(1 - (t / self.half) ** 2, 0, None))) / np.i0(self.BETA)
        self.taps = cut * np.sinc(cut * t) * window
        self.taps /= self.taps.sum(1, keepdims=True)
        self.held, self.first, self.given, self.read = np.zeros(self.half - 1), 1 - self.half, 0, 0

    def block(self, x: np.ndarray, end: bool = False) -> np.ndarray:
        """The outputs that these samples complete; at the end those that are left as well."""
        self.read += len(x)
        self.held = np.concatenate([self.held, x, np.zeros(self.half if end else 0)])
        upto = -(-self.read * self.up // self.down) if end else max(self.given, ((self.first + len(self.held) - self.half) * self.up - 1) // self.down + 1)
        k = np.arange(self.given, max(self.given, upto))
        out = np.zeros(len(k))
        for a in range(0, len(k), 1 << 14):
            at = k[a : a + (1 << 14)] * self.down
            rows = (at // self.up + 1 - self.half - self.first)[:, None] + np.arange(2 * self.half)
            out[a : a + (1 << 14)] = np.einsum("ij,ij->i", self.held[rows], self.taps[at % self.up])
        self.given += len(k)
        drop = max(0, min(len(self.held), self.given * self.down // self.up + 1 - self.half - self.first))
        self.held, self.first = self.held[drop:], self.first + drop
        return out


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    return x if rate == to else Resampler(rate, to).block(x, end=True)


def from_wav(data: bytes, to: int | None = None) -> tuple[np.ndarray, int]:
    """Samples (int16, channels averaged) and rate of a WAV of 8 to 32-bit integers or of floats, at another rate if asked."""
    x, rate = _decoded(data)
    return to_int16(x if to is None else np.round(resampled(x, rate, to))), to or rate


def clip(samples: np.ndarray, rate: int, start: float, end: float) -> np.ndarray:
    a, b = max(0, int(np.floor(start * rate))), min(len(samples), int(np.ceil(end * rate)))
    return samples[a : max(a, b)]


def read_wavs(spark, path: str, to: int | None = None) -> DataFrame:
    """WAV files -> path, rate, samples, at the rate `to` if it is given; a file that can't be decoded has null samples. Other
    codecs need a decoder."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    s, r = from_wav(c, to)
                except (ValueError, struct.error):
                    s, r = None, None
                yield pd.DataFrame({"path": [p], "rate": pd.array([r], "Int32"), "samples": [s]})

    return files.mapInPandas(run, "path string, rate int, samples array<smallint>")


@dataclass
class Reply:
    """What a provider answers: an HTTP status (None: no connection), and if it went well the words, the language that it
    heard, segments (start, end, text) and how many seconds it heard or billed."""

    text: str | None = None
    status: int | None = 200
    language: str | None = None
    segments: list[tuple[float, float, str]] | None = None
    duration: float | None = None
    billed_seconds: float | None = None
    timed_out: bool = False


#: A provider takes WAV bytes and gives a Reply, or the words alone; it may raise instead.
Call = Callable[[bytes], "Reply | str | None"]


def reply_error(r: Reply) -> str | None:
    """lookups.provider_error for a reply in Python."""
    if r.timed_out:
        return "provider_timeout"
    if r.status is None or r.status >= 500 or r.status == 429:
        return "provider_unavailable"
    return None if 200 <= r.status < 300 else "transcription_failed"


def replied(call: Call, wav: bytes) -> Reply:
    """The reply of one call. TimeoutError and ConnectionError are outages; an error with a `status`, `status_code` or `code`
    counts as a reply of that status; any other is a refusal, as one clip's failure is no failure of the job."""
    try:
        said = call(wav)
    except TimeoutError:
        return Reply(timed_out=True)
    except ConnectionError:
        return Reply(status=None)
    except Exception as e:
        status = next((x for x in (getattr(e, k, None) for k in ("status", "status_code", "code")) if isinstance(x, int)), 400)
        return Reply(status=status if not 200 <= status < 300 else 400)
    return said if isinstance(said, Reply) else Reply(said)


def asked_reply(call: Call, wav: bytes, wait: Callable[[float], None] = time.sleep, most: int = MOST_ATTEMPTS) -> tuple[str, Reply, int]:
    """(outcome, reply, attempts): ok, http_4xx for a refusal, or unavailable for an outage, which is tried `most` times with
    call_delay's milliseconds between."""
    for attempt in range(1, most + 1):
        r = replied(call, wav)
        error = reply_error(r)
        if error is None:
            return "ok", r, attempt
        if error == "transcription_failed":
            return "http_4xx", r, attempt
        if attempt < most:
            wait(0.25 * 4 ** (attempt - 1))
    return "unavailable", r, most


def asked(call: Call, wav: bytes, wait: Callable[[float], None] = time.sleep) -> tuple[str, str | None, int]:
    """(outcome, text, attempts) of a provider's call, see asked_reply()."""
    outcome, r, attempts = asked_reply(call, wav, wait)
    return outcome, (r.text or "") if outcome == "ok" else None, attempts


def gate(samples, rate: int) -> str | None:
    """Why a recording is not worth a call: undecodable (null, or none of its samples known), silent_recording, or None."""
    if samples is None or rate is None:
        return "undecodable"
    x = np.asarray(samples, float)
    level = float(np.mean((x / FULL_SCALE) ** 2)) if len(x) else 0.0
    dbfs = 20 * math.log10(math.sqrt(level)) if level > 0 else -math.inf
    return "silent_recording" if len(x) / rate < LEAST_S or dbfs < SILENCE_DBFS else None


#: Recordings that a task of transcribe_clips holds and asks about.
RECORDINGS_A_TASK = 64
_CLIP = {"meeting_id": "long", "turn_idx": "long", "outcome": "string", "result_text": "string", "language": "string", "attempts": "int"}


def transcribe_clips(audio: DataFrame, turns: DataFrame, call: Call, at_once: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Ask a provider for each eligible turn: meeting_id, turn_idx (from 1, among the meeting's eligible turns), outcome,
    result_text, language (the reply's), attempts.

    audio (meeting_id, rate, samples) is decoded once and meets all turns of its meeting in one row. A recording that can't
    be decoded or is silent is not sent: it gives one row with turn_idx 0, that outcome and no attempts. At most `at_once`
    calls of a meeting run at a time, see asked_reply() for failures. A retried task calls again, so a provider should
    recognise repeated clips.
    """
    clips = turns.groupBy("meeting_id").agg(F.sort_array(F.collect_list(F.struct("turn_no", "clip_from", "clip_to"))).alias("clips"))

    def run(batches):
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                for m, r, s, cs in zip(b["meeting_id"], b["rate"], b["samples"], b["clips"], strict=True):
                    if why := gate(s, None if pd.isna(r) else r):
                        rows = [(m, 0, why, None, None, 0)]
                    else:
                        pcm = np.asarray(s, np.int16)
                        said = pool.map(lambda c: asked_reply(call, to_wav(clip(pcm, int(r), c["clip_from"], c["clip_to"]), int(r)), wait), cs)  # noqa: B023
                        rows = [(m, k + 1, o, (x.text or "") if o == "ok" else None, x.language if o == "ok" else None, n) for k, (o, x, n) in enumerate(said)]
                    yield pd.DataFrame(rows, columns=list(_CLIP))

    # Calls take seconds and samples compress well, so tasks go by their number and not by their size. Sizes that Spark guesses
    # leave the samples out, by which a side of recordings would be broadcast: it is a merge whatever they say.
    n = -(-audio.select("meeting_id").count() // RECORDINGS_A_TASK) or 1
    met = audio.select("meeting_id", "rate", "samples").repartition(n, "meeting_id").hint("merge").join(clips, "meeting_id")
    return met.select("meeting_id", "rate", "samples", "clips").mapInPandas(run, ", ".join(f"{k} {v}" for k, v in _CLIP.items()))


def transcribe_turns(audio: DataFrame, turns: DataFrame, call: Call, *, hint: Column | None = None, at_once: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Transcripts by turn from call to text: for each meeting of audio (meeting_id, rate, samples) with turns (as
    segments.merge_turns gives them) outcome, turns, eligible, failed, calls, language, duration_seconds, n_segments, text.

    The outcome is ok, or why there is no transcript: undecodable, silent_recording, no_turns (none long enough), turns_failed
    (more than half), provider_unavailable (all of them outages, to be tried again). A turn that failed keeps its own words;
    one that is answered has the reply's, even none. Its language is the reply's, else its own; the meeting's is the hint, else
    the first that a segment names. The transcript is as long as the recording at least. Replies are written before they are
    used, so that each clip is asked about once.
    """
    length = audio.select("meeting_id", (F.size("samples") / F.col("rate")).alias("_seconds"), F.col("samples").isNull().alias("_null"))
    turns = written(turns, "turns")
    fit = eligible_turns(turns.join(length.filter("not _null"), "meeting_id"), F.col("_seconds"))
    results = written(transcribe_clips(audio, fit, call, at_once, wait), "replies")
    # A recording that no turn fits is not asked about, but judged all the same.
    loud = levels(audio.filter("samples is not null").select(F.col("meeting_id").alias("recording_id"), F.transform("samples", lambda x: x / FULL_SCALE).alias("samples")))
    judged = length.join(loud.select(F.col("recording_id").alias("meeting_id"), "rms_dbfs"), "meeting_id", "left")
    why = F.when(F.col("_null"), F.lit("undecodable")).when(too_quiet(F.col("_seconds"), F.col("rms_dbfs")), F.lit("silent_recording"))
    by = turn_outcomes(results.filter("turn_idx > 0")).join(results.groupBy("meeting_id").agg(F.sum("attempts").alias("calls")), "meeting_id")
    n = turns.groupBy("meeting_id").agg(F.count("*").alias("turns"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    told = judged.join(n, "meeting_id", "left").join(by, "meeting_id", "left")
    told = told.select("meeting_id", "_seconds", F.coalesce(why, F.col("outcome"), F.lit("no_turns")).alias("outcome"), zero("turns"), zero("eligible"), zero("failed"), zero("calls"))
    said = merge_results(fit, results.filter("turn_idx > 0")).withColumn("pos", F.col("turn_no"))
    heard = results.filter("turn_idx > 0 and outcome = 'ok'").select("meeting_id", "turn_idx", F.col("language").alias("_heard"))
    order = F.row_number().over(W.partitionBy("meeting_id").orderBy("turn_no")).cast("long")
    said = said.withColumn("turn_idx", order).join(heard, ["meeting_id", "turn_idx"], "left").withColumn("language", reply_language(F.col("_heard"), F.col("language")))
    good = told.filter("outcome = 'ok'")
    done = transcripts(good.select("meeting_id"), normalize(said.join(good.select("meeting_id"), "meeting_id", "left_semi")), hint)
    out = told.join(done, "meeting_id", "left")
    return out.select("meeting_id", "outcome", "turns", "eligible", "failed", "calls", "language", F.when(F.col("outcome") == "ok", longest(F.col("duration_seconds"), F.col("_seconds"))).alias("duration_seconds"), zero("n_segments"), "text")


def transcribe_whole(audio: DataFrame, call: Call, longest: float = CHUNK_S, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Ask a provider for whole recordings, a chunk between quiet places at a time: meeting_id, chunk_no, chunk_from,
    chunk_to, outcome, text, attempts.

    After the first failure of a recording no later chunk is asked for. Null samples give one row `undecodable`, a
    recording that is too short or too quiet one row `silent_recording`, both without a call.
    """
    columns = ["meeting_id", "chunk_no", "chunk_from", "chunk_to", "outcome", "text", "attempts"]

    def run(batches):
        for b in batches:
            for m, r, s in zip(b["meeting_id"], b["rate"], b["samples"], strict=True):
                if why := gate(s, None if pd.isna(r) else r):
                    yield pd.DataFrame([(m, 0, 0.0, 0.0, why, None, 0)], columns=columns)
                    continue
                pcm, rows = np.asarray(s, np.int16), []
                for k, (a, z) in enumerate(quiet_cuts(pcm, r, longest)):
                    rows.append((m, k, a, z, *asked(call, to_wav(clip(pcm, r, a, z), r), wait)))
                    if rows[-1][4] != "ok":
                        break
                yield pd.DataFrame(rows, columns=columns)

    return audio.select("meeting_id", "rate", "samples").mapInPandas(run, "meeting_id long, chunk_no long, chunk_from double, chunk_to double, outcome string, text string, attempts int")


def chunk_sounds(placed: DataFrame, places: DataFrame, cuts: DataFrame, rate: int, longest: float = CHUNK_S, tasks: int = 1) -> DataFrame:
    """placed (recording_id, part, samples), places (recording_id, part, offset, n) and cuts (as chunks() gives them) -> the
    cuts with samples, those of the chunk alone.

    Which blocks a chunk needs is told from their places; the samples meet no more than once, a chunk of them in a row."""
    spans = places.filter("n > 0").select("recording_id", "part", (F.col("offset") / rate).alias("start"), ((F.col("offset") + F.col("n")) / rate).alias("end"), "offset", "n")
    needs = overlapping(spans, cuts.withColumnsRenamed({"chunk_from": "start", "chunk_to": "end"}), "recording_id", longest)
    at = lambda c: F.round(F.col(c) * rate).cast("long")
    needs = needs.select("recording_id", "l.part", "r.chunk_no", F.col("r.start").alias("chunk_from"), F.col("r.end").alias("chunk_to"), F.greatest(F.lit(0), at("r.start") - F.col("l.offset")).alias("_first"), F.least("l.n", at("r.end") - F.col("l.offset")).alias("_upto"))
    # By number and not by size, and a merge whatever the sizes say, see transcribe_clips().
    rows = placed.select("recording_id", "part", "samples").repartition(tasks, "recording_id", "part").hint("merge").join(needs.filter("_upto > _first"), ["recording_id", "part"])
    piece = F.slice("samples", (F.col("_first") + 1).cast("int"), (F.col("_upto") - F.col("_first")).cast("int"))
    rows = rows.select("recording_id", "chunk_no", "chunk_from", "chunk_to", F.struct("part", piece.alias("x")).alias("piece")).repartition(tasks, "recording_id", "chunk_no")
    return rows.groupBy("recording_id", "chunk_no", "chunk_from", "chunk_to").agg(F.flatten(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["x"])).alias("samples"))


#: Chunks that a task asks about, one after the other: this many at most, and where that leaves cores idle, FEW_CHUNKS at least.
FEW_CHUNKS, MANY_CHUNKS = 32, 1024
_ASKED = "meeting_id long, chunk_no long, chunk_from double, chunk_to double, outcome string, text string, language string, segments array<struct<start:double,end:double,text:string>>, duration double, billed_seconds double, attempts int"


def ask_chunks(sounds: DataFrame, rate: int, call: Call, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """The provider's reply to each of sounds (meeting_id, chunk_no, chunk_from, chunk_to, samples), a stored table; null fields
    where it failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                # A row at a time, as a chunk is some 20 MB.
                pcm = b.column("samples")[i].values.to_numpy(zero_copy_only=False).astype(np.int16)
                outcome, r, attempts = asked_reply(call, to_wav(pcm, rate), wait)
                row = {k: b.column(k)[i].as_py() for k in ("meeting_id", "chunk_no", "chunk_from", "chunk_to")} | {"outcome": outcome, "attempts": attempts}
                if outcome == "ok":
                    said = None if r.segments is None else [{"start": float(a), "end": float(z), "text": t} for a, z, t in r.segments]
                    row |= {"text": r.text or "", "language": r.language, "segments": said, "duration": r.duration, "billed_seconds": r.billed_seconds}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    part = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("text", pa.string())]))
    schema = pa.schema([("meeting_id", pa.int64()), ("chunk_no", pa.int64()), ("chunk_from", pa.float64()), ("chunk_to", pa.float64()), ("outcome", pa.string()), ("text", pa.string()), ("language", pa.string()), ("segments", part), ("duration", pa.float64()), ("billed_seconds", pa.float64()), ("attempts", pa.int32())])
    # Calls take seconds and rows are few, so tasks go by their number and not by their size.
    spread = sounds.select("meeting_id", "chunk_no", "chunk_from", "chunk_to", "samples").repartition(tasks_for(sounds.sparkSession, sounds.count(), FEW_CHUNKS, MANY_CHUNKS), "meeting_id", "chunk_no")
    return spread.mapInArrow(run, _ASKED)


def whole_transcripts(blocks: DataFrame, segments: DataFrame, rate: int, call: Call, *, hint: str | None = None, longest_s: float = CHUNK_S, at_once: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Transcripts of whole recordings from call to text: for each meeting of blocks (meeting_id, part, samples int16; a
    recording is as many rows as it has parts) outcome, chunks, calls, language, duration_seconds, n_segments, text.

    Recordings are cut at quiet places and asked about by chunk, in tasks of their own. The outcome is ok, or why there is no
    transcript: undecodable (no part has samples), silent_recording, both without a call, else what became of the first chunk
    that failed: transcription_failed, or provider_unavailable, to be tried again. The first `at_once` chunks are asked about
    first, the others only if none of these failed. Speakers come from `segments` (meeting_id, pos, speaker, start, end), which
    may lack a meeting. The language is the hint, else the first that a reply names. A transcript is as long as the recording
    at least. Replies are written before they are used, so that each chunk is asked about once.
    """
    blocks = blocks.select(F.col("meeting_id").cast("long").alias("recording_id"), "part", "samples")
    # Samples compress well, so what holds them goes by their number: by size, hours of them would be one task's.
    sizes = written(block_sizes(blocks), "sizes")
    tasks = tasks_for(blocks.sparkSession, sizes.agg(F.sum("n")).first()[0] or 0, FEW_SAMPLES, MANY_SAMPLES)
    heard = blocks.filter("samples is not null").repartition(tasks, "recording_id", "part").hint("merge")
    placed = written(placed_blocks(heard, sizes.filter("n is not null")), "placed")
    energies = written(cell_energies(placed, rate, longest_s), "energies")
    loud = energies.groupBy("recording_id").agg(F.sum("n").alias("n_samples"), F.sum(F.col("square").cast("double")).alias("_s"))
    loud = loud.withColumn("rms_dbfs", rms_dbfs(F.try_divide("_s", "n_samples") / FULL_SCALE**2))
    judged = sizes.groupBy("recording_id").agg(F.count("n").alias("_blocks")).join(loud, "recording_id", "left")
    seconds = F.coalesce("n_samples", F.lit(0)) / rate
    why = F.when(F.col("_blocks") == 0, F.lit("undecodable")).when(too_quiet(seconds, F.col("rms_dbfs")), F.lit("silent_recording"))
    judged = written(judged.select("recording_id", seconds.alias("_seconds"), why.alias("_why")), "judged")

    fit = energies.join(judged.filter("_why is null").select("recording_id"), "recording_id", "left_semi")
    cuts = written(folded_cuts(fit.repartition(tasks, "recording_id"), rate, longest_s), "cuts")
    sounds = written(chunk_sounds(placed, energies, cuts, rate, longest_s, tasks).withColumnRenamed("recording_id", "meeting_id"), "sounds")
    early = written(ask_chunks(sounds.filter(F.col("chunk_no") < at_once), rate, call, wait), "replies")
    lost = early.filter("outcome <> 'ok'").select("meeting_id").distinct()
    later = sounds.filter(F.col("chunk_no") >= at_once).join(lost, "meeting_id", "left_anti")
    replies = early.unionByName(written(ask_chunks(later, rate, call, wait), "replies"))

    failed = F.min(F.when(F.col("outcome") != "ok", F.struct("chunk_no", "outcome")))["outcome"]
    told = F.min(F.when(non_empty(F.col("language")).isNotNull(), F.struct("chunk_no", "language")))["language"]
    by = replies.groupBy("meeting_id").agg(failed.alias("_failed"), F.sum("attempts").alias("calls"), told.alias("_heard"))
    by = by.join(cuts.groupBy(F.col("recording_id").alias("meeting_id")).agg(F.count("*").alias("chunks")), "meeting_id")
    became = F.when(F.col("_failed") == "unavailable", F.lit("provider_unavailable")).when(F.col("_failed").isNotNull(), F.lit("transcription_failed")).otherwise(F.lit("ok"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    ends = judged.withColumnRenamed("recording_id", "meeting_id").join(by, "meeting_id", "left")
    ends = ends.select("meeting_id", "_seconds", "_heard", F.coalesce("_why", became).alias("outcome"), zero("chunks"), zero("calls"))
    good = ends.filter("outcome = 'ok'").select("meeting_id", "_heard")
    said = chunk_speakers(replies.join(good.select("meeting_id"), "meeting_id", "left_semi"), segments).withColumn("pos", F.struct("chunk_no", "pos"))
    done = transcripts(good, normalize(said), F.coalesce(F.lit(hint), F.col("_heard")))
    out = ends.join(done, "meeting_id", "left")
    return out.select("meeting_id", "outcome", "chunks", "calls", "language", F.when(F.col("outcome") == "ok", longest(F.col("duration_seconds"), F.col("_seconds"))).alias("duration_seconds"), zero("n_segments"), "text")
