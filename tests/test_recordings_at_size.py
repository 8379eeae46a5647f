"""Recordings meet their clips by a merge, in tasks of a bounded number of recordings."""

from __future__ import annotations

from palaver.operators import audio
from pyspark.sql import functions as F


def clips_of(spark, n):
    sound = spark.range(n).select(F.col("id").alias("meeting_id"), F.lit(40).alias("rate"), F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: (i * 37 % 2001 - 1000).cast("smallint")).alias("samples"))
    turns = spark.range(n).select(F.col("id").alias("meeting_id"), F.lit(1).cast("long").alias("turn_no"), F.lit(0.0).alias("clip_from"), F.lit(5.0).alias("clip_to"))
    return audio.transcribe_clips(sound, turns, lambda wav: str(len(wav)), wait=lambda s: None)


def test_recordings_are_never_broadcast(spark):
    """Sizes are guessed without the samples, so a side of recordings looked small enough to be sent to everyone."""
    plan = clips_of(spark, 20)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_task_holds_a_bounded_number_of_recordings(spark, monkeypatch):
    monkeypatch.setattr(audio, "RECORDINGS_A_TASK", 4)
    out = clips_of(spark, 100).withColumn("task", F.spark_partition_id())
    rows = out.collect()
    assert len(rows) == 100 and {r["result_text"] for r in rows} == {str(44 + 400)}
    assert len({r["task"] for r in rows}) > 15
