"""Streams over several batches, with their timers, against the same rows at once."""

from __future__ import annotations

import json
import time

import pytest
from palaver.functions.lookups import MOST_ATTEMPTS
from palaver.operators import lifecycle, providers, ranking
from palaver.sources import capture
from palaver.streaming import folds, queries
from pyspark.sql import functions as F

ENDED = "meeting_id long, seq long, provider string, live_words boolean, reason string, audio string, result string, result_text string"


def landed(path, polls):
    """Files of snapshots, one a poll: meeting -> its whole list of (status, minute)."""
    path.mkdir(exist_ok=True)
    for n, meetings in enumerate(polls):
        lines = [json.dumps({"id": m, "data": {"status_transition": [{"to": s, "timestamp": f"2024-01-01T00:{at:02}:00Z"} for s, at in said]}}) for m, said in meetings.items()]
        (path / f"poll{n}.json").write_text("\n".join([*lines, "no snapshot"]))
        time.sleep(0.02)


def test_snapshots_of_several_polls(spark, tmp_path):
    one = [("joining", 0), ("awaiting_admission", 1), ("active", 2), ("joining", 3), ("stopping", 4), ("failed", 5)]
    polls = [{1: one[:2], 2: []}, {1: one[:2], 2: [("active", 9)]}, {1: one[:5], 2: [("active", 9)]}, {1: one, 2: [("active", 9), ("completed", 10)]}]
    landed(tmp_path / "in", polls)
    changes = queries.finish(folds.snapshot_lifecycles(capture.read_snapshots(spark, str(tmp_path / "in"), stream=True, most_files=1)), "polls", timed=True)
    got = sorted((r["meeting_id"], r["from_status"], r["to_status"]) for r in changes.collect())
    whole = capture.status_changes(capture.read_snapshots(spark, str(tmp_path / "in"))).select("meeting_id", "seq", "ts", "target_status").distinct()
    want = sorted((str(r["meeting_id"]), r["from_status"], r["to_status"]) for r in lifecycle.transitions(whole).filter("accepted").collect())
    assert got == want and len(got) == 7


def results(*said):
    return [(m, i, "batch", live, None, "usable", result, "words") for i, (m, live, result) in enumerate(said)]


def test_finalizing_counts_attempts_over_batches(spark, tmp_path):
    """A third failure falls back with words and fails without; what comes after an end is passed over."""
    down = "provider_unavailable"
    rows = results((1, True, down), (2, False, down), (3, True, "ok"), (1, True, down), (2, False, "provider_timeout"), (4, True, down), (1, True, down), (2, False, down), (3, True, down), (4, True, "ok"), (1, True, "ok"), (2, False, "ok"))
    for n in range(4):
        spark.createDataFrame(rows[3 * n : 3 * n + 3], ENDED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = spark.readStream.schema(ENDED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = queries.finish(folds.finalizing(stream), "finalizing", timed=True).filter("seq is not null")
    key = lambda df: sorted((r["meeting_id"], r["attempt"], r["seq"], r["action"], r["error_code"], r["fallback_reason"], r["retry_s"]) for r in df.collect())
    want = key(providers.finalize_tries(spark.createDataFrame(rows, ENDED)))
    assert [tuple(map(str, r)) for r in key(got)] == [tuple(map(str, r)) for r in want]
    last = {r[0]: r[3:6] for r in want}
    assert last == {1: ("fall_back", None, "provider_unavailable_after_retries"), 2: ("fail", "transcription_failed", None), 3: ("complete", None, None), 4: ("complete", None, None)}
    assert max(r[1] for r in want) == MOST_ATTEMPTS


def test_a_timer_asks_for_the_next_attempt(spark, tmp_path):
    spark.createDataFrame(results((7, True, "provider_timeout"), (8, True, "ok")), ENDED).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = folds.finalizing(spark.readStream.schema(ENDED).parquet(str(tmp_path / "in")), wait_ms=300)
    q = stream.writeStream.format("memory").queryName("asked_again").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("asked_again").filter("action = 'poll'").count():
            time.sleep(0.5)
        polls = spark.table("asked_again").filter("action = 'poll'").select("meeting_id", "attempt").collect()
    finally:
        q.stop()
    assert [tuple(r) for r in polls] == [(7, 2)]


def test_state_with_a_deadline_has_no_time_to_live(spark):
    with pytest.raises(ValueError, match="time to live"):
        folds.lifecycles(spark.range(1).select(F.lit("m").alias("meeting_id"), "id", F.current_timestamp().alias("ts")), deadline_s=1, ttl_s=1)


def test_a_batch_that_fails_halfway_posts_the_rest_alone(spark, tmp_path):
    """Some deliveries fail at first; when the batch is repeated, nothing that is in its ledger is posted or kept again."""
    rows = [(i, f"https://e/{i}", "{}", "s", "t") for i in range(40)]
    kind = "delivery_id long, endpoint string, payload string, signature string, event_type string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    posted, broken = tmp_path / "posted", tmp_path / "broken"
    posted.mkdir()
    broken.touch()
    seen, flag = str(posted), str(broken)

    def post(endpoint, payload, headers):
        import os
        import tempfile

        i = int(headers["X-Webhook-Delivery"])
        if i % 10 == 7 and os.path.exists(flag):
            time.sleep(2)
            raise RuntimeError("the network is gone")
        tempfile.mkstemp(prefix=f"{i}-", dir=seen)
        return 204

    stream = lambda: folds.deliver(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), post, str(tmp_path / "out"), str(tmp_path / "ck"), at_once=2)
    with pytest.raises(Exception, match="network|STREAM"):
        stream().start().awaitTermination()
    kept = {r["delivery_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert 0 < len(kept) < 40
    broken.unlink()
    stream().start().awaitTermination()
    codes = sorted((r["delivery_id"], r["response_code"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert codes == [(i, 204) for i in range(40)]
    times = [int(p.name.split("-")[0]) for p in posted.iterdir()]
    assert all(times.count(i) == 1 for i in kept) and set(times) == set(range(40))


def test_numbers_within_a_hot_group(spark):
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"q{i % 5}", i * 7919 % 500) for i in range(3000)]
    df = spark.createDataFrame(rows, "queue string, at long").repartition(8)
    got = {}
    for r in ranking.numbered(df, "queue", [F.col("at").asc_nulls_first()]).collect():
        got.setdefault(r["queue"], []).append((r["position"], r["at"]))
    for q, seen in got.items():
        assert sorted(seen) == [(k + 1, at) for k, at in enumerate(sorted(at for g, at in rows if g == q))]
    assert ranking.numbered(df.limit(0), "queue", [F.col("at").asc()]).count() == 0
