"""Webhook deliveries: events, signatures, retry schedule, the latest state of each delivery."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from palaver.functions.lookups import DELIVERY_DELAYS
from palaver.functions.text import iso_ms, prefixed_id


def events(endings: DataFrame) -> DataFrame:
    """Accepted endings (meeting_id, seq, ts, status, metadata, provider, fallback_from, fallback_reason, error_code,
    error_message) -> one event each, completed or failed, with its JSON payload. Null fields are left out; metadata is
    JSON, an object without fields if there is none."""
    done, lost = F.col("status") == "completed", F.col("status") == "failed"
    error = F.when(lost & F.col("error_code").isNotNull(), F.struct(F.col("error_code").alias("code"), F.coalesce("error_message", F.lit("")).alias("message")))
    data = F.struct(
        F.col("meeting_id"), F.col("status"), F.parse_json(F.coalesce("metadata", F.lit("{}"))).alias("metadata"), F.when(done, F.col("provider")).alias("transcript_provider"), F.when(done, F.col("fallback_from")).alias("fallback_from"),
        F.when(done & F.col("fallback_from").isNotNull(), F.col("fallback_reason")).alias("fallback_reason"), error.alias("error"),
    )
    kind = F.concat(F.lit("meeting."), F.col("status"))
    out = endings.filter(done | lost).withColumn("event_id", prefixed_id("evt", F.col("meeting_id"), F.col("seq"))).withColumn("event_type", kind)
    return out.select("meeting_id", "event_id", "event_type", "ts", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), iso_ms(F.col("ts")).alias("created_at"), data.alias("data"))).alias("payload"))


def outbox(events: DataFrame, meetings: DataFrame) -> DataFrame:
    """A pending delivery for each event whose meeting names a webhook_url: the payload as it will be signed, no attempt
    yet, due at once. Meetings without an address get none."""
    to = meetings.filter(F.col("webhook_url").isNotNull() & (F.col("webhook_url") != "")).select("meeting_id", F.col("webhook_url").alias("endpoint"))
    return events.join(to, "meeting_id").select(
        prefixed_id("dlv", F.col("event_id")).alias("delivery_id"), "meeting_id", "event_id", "event_type", "endpoint", "payload",
        F.lit(0).alias("attempt"), F.lit("pending").alias("status"), F.lit(None).cast("int").alias("response_code"), F.col("ts").alias("next_attempt_at"),
    )


@F.pandas_udf(StringType())
def _hmac(secret: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series(["sha256=" + hmac.new(s.encode(), b.encode(), hashlib.sha256).hexdigest() if s is not None and b is not None else None for s, b in zip(secret, body, strict=True)])


def signed(deliveries: DataFrame, secret: str = "secret", payload: str = "payload") -> DataFrame:
    """deliveries with signature, `sha256=` and the HMAC of the payload's bytes; Spark has no HMAC of its own."""
    return deliveries.withColumn("signature", _hmac(F.col(secret), F.col(payload)))


def verified(secret: str, body: str, signature: str) -> bool:
    return hmac.compare_digest("sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest(), signature)


def schedule(attempts: DataFrame) -> DataFrame:
    """Attempts (delivery_id, attempt from 1, attempted_at, response_code) that are made, with the delivery's status after
    each and when the next is due. A 2xx delivers and ends it; five attempts end it as failed."""
    ok = F.col("response_code").between(200, 299)
    before = W.partitionBy("delivery_id").orderBy("attempt").rowsBetween(W.unboundedPreceding, -1)
    rows = attempts.filter(F.col("attempt") <= len(DELIVERY_DELAYS)).withColumn("_ok", F.coalesce(ok, F.lit(False)))
    rows = rows.withColumn("_done", F.coalesce(F.max("_ok").over(before), F.lit(False))).filter(~F.col("_done"))
    delay = F.get(F.array(*map(F.lit, DELIVERY_DELAYS)), F.col("attempt").cast("int"))
    status = F.when(F.col("_ok"), F.lit("delivered")).when(delay.isNull(), F.lit("failed")).otherwise(F.lit("pending"))
    due = F.when(status == "pending", F.col("attempted_at") + F.make_dt_interval(secs=delay))
    return rows.select("delivery_id", F.col("attempt"), "attempted_at", "response_code", status.alias("status"), due.alias("next_attempt_at"))


def latest(scheduled: DataFrame) -> DataFrame:
    """The last row of each delivery."""
    last = F.max(F.struct("attempt", "response_code", "status", "next_attempt_at"))
    return scheduled.groupBy("delivery_id").agg(last.alias("r")).select("delivery_id", "r.*")


def with_secrets(deliveries: DataFrame, meetings: DataFrame, projects: DataFrame) -> DataFrame:
    """Inner join to the meeting's project; deliveries of deleted meetings drop out and stay as they are.

    Sides are left for AQE to broadcast by the size they turn out to have."""
    return deliveries.join(meetings.select("meeting_id", "project_id"), "meeting_id").join(projects.select("project_id", "secret"), "project_id")
