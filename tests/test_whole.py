"""Whole recordings: however they are split in rows, the provider hears the same; nulls and empty tables."""

from __future__ import annotations

import numpy as np
from palaver.operators import audio

RATE = 40
SEGMENTS = "meeting_id long, pos int, speaker string, start double, end double"


def answer(wav: bytes):
    x = audio.from_wav(wav)[0].astype(int)
    return audio.Reply(text=f"{len(x)} {x[0]} {x[-1]} {(x * np.arange(1, len(x) + 1)).sum()}")


def run(spark, recordings, block):
    rows = [(m, k, None if x is None else [int(v) for v in x[a : a + block]]) for m, x in recordings.items() for k, a in enumerate(range(0, 1 if x is None else max(1, len(x)), block))]
    blocks = spark.createDataFrame(rows, "meeting_id long, part int, samples array<smallint>")
    who = spark.createDataFrame([(1, 0, "ann", 0.0, 30.0), (1, 1, "bob", 30.0, 99.0)], SEGMENTS)
    return {r["meeting_id"]: r.asDict() for r in audio.whole_transcripts(blocks, who, RATE, answer, longest_s=20.0, wait=lambda s: None).collect()}


def test_blocks_of_any_size_give_the_same(spark):
    r = np.random.default_rng(3)
    recordings = {1: r.integers(-9000, 9000, 2600), 2: r.integers(-9000, 9000, 799), 3: None, 4: np.zeros(500, int), 5: r.integers(-9000, 9000, 10), 6: np.zeros(0, int)}
    one = run(spark, recordings, 1 << 20)
    assert run(spark, recordings, 37) == one
    assert [one[m]["outcome"] for m in range(1, 7)] == ["ok", "ok", "undecodable", *["silent_recording"] * 3]
    lines, cuts = [], audio.quiet_cuts(recordings[1].astype(np.int16), RATE, 20.0)
    for a, z in cuts:
        x = recordings[1][round(a * RATE) : round(z * RATE)]
        lines.append(f"{len(x)} {x[0]} {x[-1]} {(x * np.arange(1, len(x) + 1)).sum()}")
    assert [line.split(": ")[1] for line in one[1]["text"].split("\n")] == lines and one[1]["chunks"] == one[1]["calls"] == len(cuts) > 3
    assert one[1]["text"].startswith("ann: ") and "bob: " in one[1]["text"] and one[2]["text"].startswith("Unknown: ") and one[1]["duration_seconds"] == 65.0


def test_no_recordings(spark):
    none = spark.createDataFrame([], "meeting_id long, part int, samples array<smallint>")
    assert audio.whole_transcripts(none, spark.createDataFrame([], SEGMENTS), RATE, answer).count() == 0


def test_sound_that_compresses_well_spreads_over_tasks(spark, monkeypatch):
    """Hours of even sound take a few kB, by which one task would hold them all; tasks go by samples and by chunks instead."""
    monkeypatch.setattr(audio, "FEW_SAMPLES", 1000, raising=False)
    kept, written = {}, audio.written
    monkeypatch.setattr(audio, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    got = run(spark, {m: np.resize([900, -900], 4000) for m in range(40)}, 400)
    assert len(got) == 40 and {r["outcome"] for r in got.values()} == {"ok"}
    assert len(kept["sounds"].inputFiles()) >= 4


def test_energies_are_a_row_a_block(spark):
    blocks = spark.createDataFrame([(m, k, [m + 1] * 400) for m in range(3) for k in range(5)], "recording_id long, part int, samples array<smallint>")
    rows = audio.cell_energies(audio.placed_blocks(blocks, audio.block_sizes(blocks)), RATE, 20.0).collect()
    assert len(rows) == 15 and {(r["recording_id"], r["offset"], r["n"], r["square"]) for r in rows} == {(m, k * 400, 400, 400 * (m + 1) ** 2) for m in range(3) for k in range(5)}


def test_many_chunks_are_asked_about_in_few_tasks(spark):
    sounds = spark.range(3000).selectExpr("id as meeting_id", "0L as chunk_no", "0d as chunk_from", "1d as chunk_to", "array(1S, 2S) as samples")
    asked = audio.ask_chunks(sounds, RATE, lambda wav: str(len(wav)), wait=lambda s: None)
    tasks = asked.rdd.getNumPartitions()
    assert 3 <= tasks <= 2 * spark.sparkContext.defaultParallelism and asked.filter("text = '48'").count() == 3000
