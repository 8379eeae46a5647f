from __future__ import annotations

import random

import pytest
from palaver.functions.lookups import STATUS_RANK
from palaver.operators import lifecycle
from palaver.streaming import folds
from palaver.streaming.queries import finish
from pyspark.sql import functions as F

KIND = "meeting_id string, seq long, t long, target_status string"


def events(spark, rows):
    return spark.createDataFrame(rows, KIND).withColumn("ts", F.timestamp_seconds("t")).drop("t")


def fold(targets):
    now, out = "queued", []
    for to in targets:
        after = folds.moved(now, to)
        out.append((now, to, after is not None))
        now = after or now
    return out


def sequences(n, names, seed):
    rng = random.Random(seed)
    return [[rng.choice(names) for _ in range(rng.randrange(1, 12))] for _ in range(n)]


@pytest.mark.parametrize("reopen", [False, True])
def test_windows_and_replay_equal_the_fold(spark, reopen):
    seqs = sequences(150, [*STATUS_RANK, *(["reopen", "failed", "stop"] if reopen else [])], 11)
    rows = [(f"m{i}", k, 10 * k, to) for i, s in enumerate(seqs) for k, to in enumerate(s)]
    f = lifecycle.replay if reopen else lifecycle.transitions
    got = {(r["meeting_id"], r["seq"]): (r["from_status"], r["to_status"], r["accepted"]) for r in f(events(spark, rows)).collect()}
    assert got == {(f"m{i}", k): v for i, s in enumerate(seqs) for k, v in enumerate(fold(s))}


def test_matrix():
    yes = {(a, b) for a in STATUS_RANK for b in STATUS_RANK if folds.may_move(a, b)}
    assert ("queued", "processing") in yes and ("processing", "completed") in yes and ("in_progress", "completed") not in yes
    assert ("in_progress", "cancelled") not in yes and ("waiting_for_admission", "cancelled") in yes and ("in_progress", "joining") not in yes
    assert not any(a in ("completed", "failed", "cancelled") for a, _ in yes) and all((a, "failed") in yes for a in ("queued", "joining", "waiting_for_admission", "in_progress", "processing"))


def test_streams_in_small_batches_equal_the_fold(spark, tmp_path):
    seqs = sequences(40, [*STATUS_RANK, "reopen", "failed", "stop"], 5)
    for k in range(12):
        part = [(f"m{i}", k, 10 * k, s[k]) for i, s in enumerate(seqs) if k < len(s)]
        if part:
            events(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("meeting_id string, seq long, target_status string, ts timestamp").option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    got = {(r["meeting_id"], r["seq"]): (r["from_status"], r["to_status"]) for r in finish(folds.lifecycles(stream), "t").collect()}
    want = {(f"m{i}", k): (a, folds.moved(a, b)) for i, s in enumerate(seqs) for k, (a, b, ok) in enumerate(fold(s)) if ok}
    assert got == want


def test_join_deadlines_fire_once_event_time_has_passed(spark, tmp_path):
    rows = [("late", 0, 0, "joining"), ("waits", 1, 0, "joining"), ("waits", 2, 60, "waiting_for_admission"), ("fine", 3, 0, "joining"), ("fine", 4, 300, "in_progress")]
    src = str(tmp_path / "in")
    rows = [(m, k, 100_000 + t, to) for m, k, t, to in rows]  # a watermark begins at 0 and drops what is not after it
    events(spark, rows).coalesce(1).write.parquet(src)
    events(spark, [("clock", 9, 105_000, "joining")]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("meeting_id string, seq long, target_status string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    got = {(r["meeting_id"], r["error_code"]) for r in finish(folds.lifecycles(stream, deadline_s=600), "d").filter("error_code is not null").collect()}
    assert got == {("late", "meeting_join_failed"), ("waits", "waiting_room_timeout")}
    batch = lifecycle.join_deadlines(events(spark, rows)).filter("error_code is not null").collect()
    assert {(r["meeting_id"], r["error_code"]) for r in batch} == got


def test_outbox_posts_each_row(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(i, "http://x", f"body{i}", "sig", "meeting.completed") for i in range(5)], "delivery_id long, endpoint string, payload string, signature string, event_type string").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    folds.deliver(stream, lambda e, p, h: 204 if h["X-Webhook-Delivery"] != "3" else None, out, str(tmp_path / "ck")).start().awaitTermination()
    assert {(r["delivery_id"], r["response_code"]) for r in spark.read.parquet(out).collect()} == {(i, None if i == 3 else 204) for i in range(5)}


def test_stop_and_reopen_in_the_fold():
    assert [folds.moved(s, "stop") for s in ("queued", "joining", "waiting_for_admission", "in_progress", "processing", "completed", "failed", "cancelled")] == ["cancelled"] * 3 + ["processing"] + [None] * 4
    assert folds.moved("failed", "reopen") == "processing" and folds.moved("cancelled", "reopen") is None


def test_starts_end_at_success_at_an_error_or_after_three_outages(spark):
    tries = {"a": [(None, 503), (None, None), (None, 201), (None, 201)], "b": [(None, 500), ("provider_timeout", None), ("provider_unavailable", None), (None, 200)], "c": [(None, 409), (None, 200)], "d": [("invalid_request", 503)]}
    df = spark.createDataFrame([(m, k, c, h) for m, t in tries.items() for k, (c, h) in enumerate(t)], "meeting_id string, seq int, error_code string, http int")
    got = {(r["meeting_id"], r["attempt"]): (r["action"], r["wait_ms"], r["error_code"]) for r in lifecycle.starts(df).collect()}
    again = {(m, k): ("retry", 1000 * k, None) for m in "ab" for k in (1, 2)}
    assert got == again | {("a", 3): ("sent", None, None), ("b", 3): ("fail", None, "provider_unavailable"), ("c", 1): ("fail", None, "meeting_join_failed"), ("d", 1): ("fail", None, "invalid_request")}
