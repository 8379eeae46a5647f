"""Streams whose state is a running aggregate: silent meetings, late rows, repeated polls, against the batch operators."""

from __future__ import annotations

import json
import time
from datetime import datetime, timedelta
from pathlib import Path

from palaver.operators import lifecycle, providers
from palaver.sources import capture
from palaver.streaming import folds, queries
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"
ENDED = "meeting_id long, seq long, provider string, live_words boolean, reason string, audio string, result string, result_text string"


def test_a_deadline_after_the_last_event_counts(spark, tmp_path):
    """The last meeting joins and falls silent, and no event of another comes 600 seconds later."""
    rows = [(0, 1, "signup"), (30, 2, "view"), (100, 1, "click"), (900, 3, "signup"), (901, 4, "click")]
    events = [(i, START + timedelta(seconds=s, microseconds=700), u, kind) for i, (s, u, kind) in enumerate(rows)]
    spark.createDataFrame(events, EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in queries.deadline_stream(spark, str(tmp_path)).collect())
    assert got == [("2-0", "waiting_for_admission", "waiting_room_timeout"), ("3-0", "joining", "meeting_join_failed")]


def moves(*said):
    """Events of (meeting, microseconds, status)."""
    return [(m, k, START + timedelta(microseconds=us), to) for k, (m, us, to) in enumerate(said)]


def by_batches(spark, tmp, rows, kind):
    """A stream of a batch for each list of rows."""
    for r in rows:
        spark.createDataFrame(r, kind).coalesce(1).write.mode("append").parquet(str(tmp))
        time.sleep(0.02)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp))


MOVES = "meeting_id string, seq long, ts timestamp, target_status string"


def test_deadlines_to_the_microsecond_over_batches(spark, tmp_path):
    """An event of the last millisecond is in time or not; one that comes late takes its place."""
    s = 600_000_000
    rows = moves(("in", 700, "joining"), ("in", s + 700, "in_progress"), ("out", 200, "joining"), ("out", s + 201, "in_progress"), ("late", 900, "joining"), ("late", 5, "waiting_for_admission"), ("none", 7, "in_progress"))
    stream = by_batches(spark, tmp_path / "in", [rows[:1], rows[1:5], rows[5:]], MOVES)
    out = queries.finish(folds.deadline_states(stream), "deadlines-test", ("meeting_id",))
    got = {r["meeting_id"]: (r["deadline"], r["status"], r["error_code"]) for r in out.collect()}
    want = {r["meeting_id"]: (r["deadline"], r["status"], r["error_code"]) for r in lifecycle.join_deadlines(spark.createDataFrame(rows, MOVES)).collect()}
    assert got == want and {m: v[2] for m, v in got.items()} == {"in": None, "out": "meeting_join_failed", "late": "waiting_room_timeout", "none": None}


def test_a_timer_in_event_time_is_exact_as_well(spark, tmp_path):
    s = 600_000_000
    rows = moves(("in", 700, "joining"), ("in", s + 700, "in_progress"), ("silent", 50, "joining"), ("clock", 3 * s, "in_progress"))
    spark.createDataFrame(rows, MOVES).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = queries.finish(folds.lifecycles(spark.readStream.schema(MOVES).parquet(str(tmp_path / "in")), deadline_s=600), "timers-test")
    assert [(r["meeting_id"], r["from_status"], r["error_code"]) for r in out.filter("error_code is not null").collect()] == [("silent", "joining", "meeting_join_failed")]


def test_snapshots_as_running_states_over_polls(spark, tmp_path):
    """Lists that polls repeat count once; an empty list, a null one and a line that is no document change nothing."""
    one = [("joining", 0), ("awaiting_admission", 1), ("active", 2), ("joining", 3), ("stopping", 4), ("failed", 5)]
    (tmp_path / "in").mkdir()
    for n, meetings in enumerate([{1: one[:2], 2: []}, {1: one[:2], 2: [("active", 9)]}, {1: one, 2: [("active", 9), ("completed", 10)]}]):
        lines = [json.dumps({"id": m, "data": {"status_transition": [{"to": s, "timestamp": f"2024-01-01T00:{at:02}:00Z"} for s, at in said]}}) for m, said in meetings.items()]
        (tmp_path / "in" / f"poll{n}.json").write_text("\n".join([*lines, '{"id": 3}', "no snapshot"]))
        time.sleep(0.02)
    out = queries.finish(folds.snapshot_states(capture.read_snapshots(spark, str(tmp_path / "in"), stream=True, most_files=1)), "snapshots-test", ("meeting_id",))
    whole = capture.status_changes(capture.read_snapshots(spark, str(tmp_path / "in"))).select(F.col("meeting_id").cast("string"), "seq", "ts", "target_status").distinct()
    want = {(r["meeting_id"], r["status"], r["n_accepted"]) for r in lifecycle.final(whole).collect()}
    assert {(r["meeting_id"], r["status"], r["n_accepted"]) for r in out.collect()} == want and len(want) == 2


def test_a_poll_is_landed_as_several_files(spark, tmp_path, monkeypatch):
    """A poll that one task wrote as one file would grow with the input; each batch reads one poll."""
    events = [(i, START + timedelta(hours=i), i % 40, ("signup", "view", "click")[i % 3]) for i in range(120)]
    spark.createDataFrame(events, EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(queries, "MEETINGS_A_FILE", 30)
    path, files = queries.landed_snapshots(spark, str(tmp_path))
    landed = [p for p in Path(path).iterdir() if p.suffix == ".txt"]
    assert files == 3 and len(landed) == 3 * files
    assert queries.snapshot_stream(spark, str(tmp_path)).count() == 64


def test_tries_to_finalize_as_running_states(spark, tmp_path, monkeypatch):
    """A result that comes late takes its place by seq, so that what was said of later ones no longer counts; equal ones count twice."""
    down = "provider_unavailable"
    row = lambda m, seq, live, result: (m, seq, "batch", live, None, "usable", result, "words")
    rows = [[row(1, 5, True, down), row(2, 1, False, down), row(4, 1, True, down), row(4, 1, True, down)], [row(1, 6, True, down), row(2, 3, False, down), row(4, 2, True, down), row(3, 9, True, "ok")], [row(1, 1, True, "ok"), row(2, 4, False, "provider_timeout"), row(2, 5, False, "ok"), row(3, 10, True, "ok")]]
    out = queries.finish(folds.finalize_states(by_batches(spark, tmp_path / "in", rows, ENDED)), "finalizing-test", ("meeting_id",)).select("meeting_id", F.inline("tries"))
    key = lambda df: sorted(str(r) for r in df.collect())
    want = key(providers.finalize_tries(spark.createDataFrame(sum(rows, []), ENDED)))
    assert key(out) == want and len(want) == 1 + 3 + 1 + 3


def test_finalize_stream_calls_no_python_for_a_meeting(spark, tmp_path, monkeypatch):
    """The query stands without its processor, whose calls for each meeting were what it cost."""
    events = [(i, START + timedelta(minutes=i), i % 40, ("purchase", "error", "view", "click", "signup")[i % 5]) for i in range(400)]
    spark.createDataFrame(events, EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.delattr(folds, "Finalizing")
    assert queries.finalize_stream(spark, str(tmp_path)).count() > 0


def test_batches_of_polls_do_not_grow_with_the_log(spark, tmp_path, monkeypatch):
    """A log of 100,000 polls in four batches and not in ten; each poll is there once."""
    spark.createDataFrame([(i * 11, START, i, "view") for i in range(9091)] + [(99_999, START, 1, "click")], EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    asked, real = {}, queries.polling.poll_stream
    monkeypatch.setattr(queries, "MOST_BATCHES", 4)
    monkeypatch.setattr(queries.polling, "poll_stream", lambda *a, **k: asked.update(k) or real(*a, **k))
    assert queries.poll_stream(spark, str(tmp_path)).count() == 9092
    assert asked["most"] == 25_000 and asked["a_task"] == 1000
