from __future__ import annotations

import json

import pytest
from palaver.functions import lookups
from palaver.operators import lifecycle, segments
from palaver.sources import capture
from palaver.sources.config import Settings
from pyspark.sql import functions as F

SNAP = {
    "id": 31, "status": "failed", "start_time": "2001-09-09T01:46:40.250900Z", "end_time": "2001-09-09T01:47:25.250100Z", "completion_reason": "evicted", "unknown_field": ["ignored"],
    "recordings": [
        {"id": 90, "meeting_id": 30, "media_files": []},
        {"id": 77, "meeting_id": 31, "media_files": [{"type": "video", "file_size_bytes": 5}, {"type": "audio", "file_size_bytes": 400, "storage_path": "a/1"}, {"type": "audio", "file_size_bytes": 50, "storage_path": "a/2"}]},
        {"id": 12, "meeting_id": 31},
    ],
    "data": {"completion_reason": "awaiting_admission_timeout", "status_transition": [
        {"from": "requested", "to": "joining", "timestamp": "2001-09-09T01:46:30Z"}, {"from": "joining", "to": "awaiting_admission", "timestamp": "2001-09-09T01:46:35Z"},
        {"from": "awaiting_admission", "to": "active", "timestamp": "2001-09-09T01:46:41Z"}, {"from": "active", "to": "failed", "timestamp": "2001-09-09T01:47:25Z"}]},
    "segments": [
        {"start": 1000000009.75, "end": 1000000011.0, "text": "later", "speaker": "kim", "segment_id": "turn:2:1"}, {"start": 1000000001.5, "end": 1000000004.0, "text": "draft", "segment_id": "turn:1:p0"},
        {"start": 1000000001.5, "end": 1000000005.25, "text": "first", "segment_id": "turn:1:0"}, {"start": 1000000020.0, "end": 1000000021.0, "text": "unfinished", "completed": False}],
}


@pytest.fixture
def snapshots(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(SNAP) + "\nnot json\n")
    return capture.read_snapshots(spark, str(tmp_path)).cache()


def test_snapshots_to_relative_segments(snapshots):
    assert snapshots.filter("_corrupt is not null").count() == 1
    rel = segments.rebase(segments.dedupe(capture.segments_of(snapshots.filter("id is not null"))))
    assert sorted((r["start"], r["end"], r["text"]) for r in rel.collect()) == [(1.25, 5.0, "first"), (9.5, 10.75, "later")]


def test_snapshots_to_statuses_reasons_and_recordings(snapshots):
    final = lifecycle.final(capture.status_changes(snapshots)).first()
    assert (final["status"], final["n_accepted"]) == ("failed", 4)
    assert snapshots.filter("id = 31").select(capture.completion_reason(F.col("data.completion_reason"), F.col("completion_reason"))).first()[0] == "awaiting_admission_timeout"
    rec = [(r["recording_id"], r["pos"], r["media_type"], r["raw_url"], r["size_bytes"], r["meeting_duration_s"]) for r in capture.recordings_of(snapshots).orderBy("pos").collect()]
    assert rec == [(77, 1, "audio", "a/1", 450, pytest.approx(45.0)), (12, 2, "video", None, 0, pytest.approx(45.0))]


def test_settings():
    s = Settings.read({"PALAVER_ENABLED_PLATFORMS": "jitsi, zoom", "PALAVER_POLL_SECONDS": "9"})
    assert s.enabled_platforms == ("jitsi", "zoom") and s.poll_seconds == 9 and s.most_bots == 5 and (s.turn_gap_s, s.least_turn_s, s.pad_s) == (0.75, 0.4, 0.25)
    with pytest.raises(ValueError):
        Settings.read({"PALAVER_POLL_SECONDS": "0"})


def test_fetches_that_may_work_later(spark):
    rows = [("provider_timeout", None, True), (None, 503, True), (None, 404, True), (None, 429, True), (None, 403, False), ("capture_failed", None, False), (None, None, False)]
    got = spark.createDataFrame(rows, "code string, http int, want boolean").withColumn("got", lookups.retryable_fetch(F.col("code"), F.col("http")))
    assert got.filter("got <> want").count() == 0
