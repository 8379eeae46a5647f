"""Tenant-scoped views of meetings and transcripts, and the changes that they see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.lookups import INTERNAL, error_type, http_status
from palaver.functions.text import iso_ms
from palaver.operators.ranking import numbered


def transcript_status(status: Column, stored: Column) -> Column:
    return F.when(stored, F.lit("completed")).when(status == "processing", status).when(status.isin("failed", "cancelled"), F.lit("unavailable")).otherwise(F.lit("pending"))


def _object(metadata: Column) -> Column:
    return F.coalesce(metadata, F.lit("{}"))


def meeting_view(meetings: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Meetings as their owners see them; null stands for an absent field. The transcript counts only once completed.

    Of bot, transcript and error the last is null unless the meeting failed with a code; a message that was not kept is
    empty. metadata is JSON, an object without fields if there is none."""
    t = transcripts.select("meeting_id", F.col("provider").alias("_provider"), F.col("fallback_from").alias("_from"), F.col("fallback_reason").alias("_why"))
    m, has = meetings, F.col("_provider").isNotNull()
    out = m.alias("m").join(t.alias("t"), (F.col("m.meeting_id") == F.col("t.meeting_id")) & (F.col("m.status") == "completed"), "left")
    code = F.col("error_code")
    error = F.when((F.col("status") == "failed") & code.isNotNull(), F.struct(error_type(code).alias("type"), code.alias("code"), F.coalesce("error_message", F.lit("")).alias("message")))
    return out.select(
        F.col("m.meeting_id").alias("id"), F.lit("meeting").alias("object"), "project_id", "status", "platform", "meeting_url",
        F.struct(F.col("bot_name").alias("name"), iso_ms(F.col("started_at")).alias("joined_at")).alias("bot"),
        F.struct(transcript_status(F.col("status"), has).alias("status")).alias("transcript"),
        *[iso_ms(F.col(c)).alias(c) for c in ("created_at", "started_at", "ended_at", "completed_at")], _object(F.col("metadata")).alias("metadata"),
        F.col("_provider").alias("transcript_provider"), F.col("_from").alias("fallback_from"), F.when(F.col("_from").isNotNull(), F.col("_why")).alias("fallback_reason"), error.alias("error"),
    )


def transcript_view(meetings: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The answer to a request for each meeting's transcript: http_status 200 with it (also its speakers, segments and
    text), 200 with the status alone if the meeting failed or was cancelled, else 202."""
    fields = ("language", "duration_seconds", "provider", "fallback_from", "speakers", "segments", "text")
    t = transcripts.select("meeting_id", *fields, "fallback_reason", iso_ms(F.col("created_at")).alias("created_at"))
    out = meetings.select("meeting_id", "project_id", "status").join(t, "meeting_id", "left")
    ready = (F.col("status") == "completed") & F.col("provider").isNotNull()
    shown = [F.when(ready, F.col(c)).alias(c) for c in (*fields, "created_at")]
    why = F.when(ready & F.col("fallback_from").isNotNull(), F.col("fallback_reason")).alias("fallback_reason")
    return out.select("meeting_id", "project_id", "status", F.when(ready | F.col("status").isin("failed", "cancelled"), F.lit(200)).otherwise(F.lit(202)).alias("http_status"), *shown, why)


def tenant_lookup(meetings: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (project_id, meeting_id) with the status, or meeting_not_found, also for another tenant's meeting."""
    out = asked.join(meetings.select("meeting_id", "project_id", "status"), ["project_id", "meeting_id"], "left")
    return out.withColumn("error_code", F.when(F.col("status").isNull(), F.lit("meeting_not_found")))


def upsert_transcripts(stored: DataFrame, writes: DataFrame) -> DataFrame:
    """The last write (by seq) of each meeting wins, but created_at stays that of the first; stored rows come before."""
    rows = stored.withColumn("seq", F.lit(-1).cast("long")).unionByName(writes)
    value = [c for c in stored.columns if c not in ("meeting_id", "created_at")]
    by = rows.groupBy("meeting_id").agg(F.max(F.struct("seq", *value)).alias("v"), F.min(F.struct("seq", "created_at"))["created_at"].alias("created_at"))
    return by.select("meeting_id", *[f"v.{c}" for c in value], "created_at")


def delete_meetings(meetings: DataFrame, transcripts: DataFrame, deliveries: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the deleted meetings and their transcripts; deliveries stay and are marked as orphans."""
    gone = deleted.select("meeting_id").distinct()
    orphan = deliveries.join(gone.withColumn("orphan", F.lit(True)), "meeting_id", "left").withColumn("orphan", F.coalesce("orphan", F.lit(False)))
    return meetings.join(gone, "meeting_id", "left_anti"), transcripts.join(gone, "meeting_id", "left_anti"), orphan


def health(probes: DataFrame) -> DataFrame:
    """probes (database_ok, queue_ok, capture_ok) with status and http_status; capture alone only degrades."""
    down = ~(F.col("database_ok") & F.col("queue_ok"))
    status = F.when(down, F.lit("error")).when(~F.col("capture_ok"), F.lit("degraded")).otherwise(F.lit("ok"))
    return probes.withColumn("status", status).withColumn("http_status", F.when(down, F.lit(503)).otherwise(F.lit(200)))


def error_body(code: Column, message: Column | None = None) -> Column:
    """struct(type, code, message, http_status); a message that is not given is empty. Codes that aren't known are internal
    errors, whose message tells nothing of their cause."""
    known = error_type(code).isNotNull()
    name = F.when(known, code).otherwise(F.lit("internal_error"))
    said = F.when(known, F.coalesce(F.lit("") if message is None else message, F.lit(""))).otherwise(F.lit(INTERNAL))
    return F.struct(error_type(name).alias("type"), name.alias("code"), said.alias("message"), http_status(name).alias("http_status"))


def error_json(code: Column, message: Column | None = None) -> Column:
    """The body of an answer that fails, as JSON."""
    e = error_body(code, message)
    return F.to_json(F.struct(F.struct(e["type"].alias("type"), e["code"].alias("code"), e["message"].alias("message")).alias("error")))


def due_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs (job_id, run_at) that are due, first due first; position from 1. Immediate jobs have a null run_at."""
    due = jobs.filter(F.col("run_at").isNull() | (F.col("run_at") <= now))
    return numbered(due, "queue", [F.col("run_at").asc_nulls_first(), F.col("job_id").asc_nulls_first()])


def queue_sizes(jobs: DataFrame) -> DataFrame:
    """Jobs of each queue that wait at once (`ready`, no run_at) or until their time (`delayed`)."""
    return jobs.groupBy("queue").agg(F.count_if(F.col("run_at").isNull()).alias("ready"), F.count_if(F.col("run_at").isNotNull()).alias("delayed"))
