"""Polling as a stream: what is admitted, what errors mean, and that a restart fetches nothing twice."""

from __future__ import annotations

import json

import pytest
from palaver.sources import polling
from palaver.sources.polling import Answer, Log


def test_errors_of_polls():
    def fetch(ref):
        if ref == "slow":
            raise TimeoutError
        if ref == "gone":
            raise ConnectionError
        return Answer(int(ref), "{}")

    want = {"slow": (None, "provider_timeout", True, None), "gone": (None, "provider_unavailable", True, None), "200": (200, None, False, "{}"), "204": (204, None, False, None), "404": (404, "meeting_not_found", True, None),
            "429": (429, "provider_unavailable", True, None), "503": (503, "provider_unavailable", True, None), "401": (401, "provider_unavailable", False, None), "302": (302, "provider_unavailable", False, None)}
    assert {r: polling.fetched(fetch, r) for r in want} == want
    with pytest.raises(ValueError):
        polling.fetched(fetch, "a fault")


def started(spark, tmp, log, fetch, most, name):
    rows = polling.poll_stream(spark, log, fetch, f"{tmp}/state", most=most, a_task=3, name=name)
    batches = []

    def keep(b, n):
        b.write.mode("overwrite").parquet(f"{tmp}/out/batch={n}")
        batches.append(spark.read.parquet(f"{tmp}/out/batch={n}").count())

    q = rows.writeStream.option("checkpointLocation", f"{tmp}/state").foreachBatch(keep).start()
    q.processAllAvailable()
    q.stop()
    return batches


def test_a_restart_fetches_each_poll_once(spark, tmp_path):
    """The log grows between runs; calls are noted by the tasks themselves."""
    (tmp_path / "due").write_text("25")
    calls = tmp_path / "calls"
    calls.mkdir()

    def fetch(ref):
        with open(calls / ref, "a") as f:
            f.write("x")
        return Answer(503) if ref.endswith("7") else Answer(200, json.dumps({"id": int(ref[1:]), "status": "active"}) if ref != "m9" else "no json")

    log = Log(lambda: int((tmp_path / "due").read_text()), lambda a, z: [f"m{i}" for i in range(a, z)])
    assert started(spark, tmp_path, log, fetch, 10, "polls_once") == [10, 10, 5]
    (tmp_path / "due").write_text("38")
    assert started(spark, tmp_path, log, fetch, 10, "polls_twice") == [10, 3]
    assert {f.name: f.read_text() for f in calls.iterdir()} == {f"m{i}": "x" for i in range(38)}
    out = spark.read.schema(polling.POLLED_DDL + ", batch long").parquet(str(tmp_path / "out"))
    assert sorted(r["position"] for r in out.collect()) == list(range(38))
    assert max(r["count"] for r in out.groupBy("batch").count().collect()) == 10
    assert sorted(r["ref"] for r in polling.again(out).collect()) == ["m17", "m27", "m37", "m7"]
    good = polling.snapshots(out)
    assert good.filter("_corrupt is not null").count() == 1 and good.filter("id = position and status = 'active'").count() == 38 - 5


def test_nothing_is_due(spark, tmp_path):
    assert sum(started(spark, tmp_path, Log(lambda: 0, lambda a, z: []), lambda r: Answer(200), 5, "polls_none")) == 0
