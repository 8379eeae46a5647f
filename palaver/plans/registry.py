"""Every query of the engine by name, over whole tables, and its DuckDB form where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palaver.functions import lookups
from palaver.operators import audio, delivery, intake, lifecycle, providers, ranges, segments, serving, transcripts
from palaver.plans import oracles
from palaver.sources.config import Settings
from palaver.sources.shared import written
from palaver.sources.views import view

#: Settings of the queries; those of a deployment come from Settings.read().
SETTINGS = Settings(enabled_platforms=("jitsi", "google_meet"))
_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _ALL[f.__name__] = f
    return f


def _raw(spark, d):
    return view(spark, d, "segments_raw").withColumnsRenamed({"start_epoch": "start", "end_epoch": "end", "start_time_epoch": "start_time"})


def _relative(spark, d):
    return segments.rebase(segments.dedupe(_raw(spark, d)))


@_query
def segments_deduped(spark, d):
    return segments.dedupe(_raw(spark, d)).select("meeting_id", F.col("pos").cast("long"), "ord", "segment_id", "speaker", "text")


@_query
def segments_relative(spark, d):
    return _relative(spark, d).select("meeting_id", F.col("pos").cast("long"), F.col("start").alias("start_s"), F.col("end").alias("end_s"))


@_query
def segments_normalized(spark, d):
    return transcripts.normalize(_relative(spark, d)).select("meeting_id", "n", "id", "speaker_id", "speaker_name", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "text", "language")


@_query
def speakers(spark, d):
    return transcripts.speakers(transcripts.normalize(_relative(spark, d)))


def _transcripts(spark, d):
    raw = _raw(spark, d)
    return transcripts.transcripts(raw.select("meeting_id").distinct(), transcripts.normalize(segments.rebase(segments.dedupe(raw))))


_ALL["transcripts"] = _transcripts


@_query
def transcript_documents(spark, d):
    n = transcripts.normalize(_relative(spark, d))
    out = transcripts.documents(n.select("meeting_id").distinct(), n)
    return out.select("meeting_id", F.to_json("speakers").alias("speakers"), F.array_join(F.transform("segments", lambda x: F.concat_ws("/", x["id"], x["speaker_id"], x["text"])), "\n").alias("segments"))


@_query
def retry_delays(spark, d):
    """Seconds to wait after failed attempts at a call, at sending a bot and at finalizing."""
    a = view(spark, d, "delivery_attempts")
    return a.select("delivery_id", "attempt", lookups.call_delay_ms(F.col("attempt")).alias("call_ms"), lookups.start_delay_ms(F.col("attempt")).alias("start_ms"), lookups.finalize_delay_ms(F.col("attempt")).alias("finalize_ms"))


def _turns(spark, d):
    return segments.merge_turns(_relative(spark, d), SETTINGS.turn_gap_s)


@_query
def turns(spark, d):
    return _turns(spark, d).select("meeting_id", "turn_no", "speaker", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "text", "language")


def _ranged(spark, d):
    return ranges.rebase(ranges.dedupe(_raw(spark, d)))


@_query
def turns_by_ranges(spark, d):
    """turns, with no meeting in one task."""
    return ranges.merge_turns(_ranged(spark, d), SETTINGS.turn_gap_s).select("meeting_id", "turn_no", "speaker", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "text", "language")


@_query
def segments_by_ranges(spark, d):
    """segments_normalized, with no meeting in one task."""
    return ranges.normalize(_ranged(spark, d)).select("meeting_id", "n", "id", "speaker_id", "speaker_name", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "text", "language")


def _clipped(t):
    """Turns over recordings that end a second before the last turn does; the end comes from a window, so turns are derived once."""
    return segments.clipped(t.withColumn("seconds", F.max("end").over(W.partitionBy("meeting_id")) - 1.0), F.col("seconds"), SETTINGS.least_turn_s, SETTINGS.pad_s)


def _eligible(t):
    return _clipped(t).filter("eligible").drop("eligible")


@_query
def turns_eligible(spark, d):
    """Recordings end a second before the last turn does, so that clips are cut."""
    return _eligible(_turns(spark, d)).select("meeting_id", "turn_no", "clip_from", "clip_to")


@_query
def speaker_overlap(spark, d):
    """Who speaks in stretches that lie half a second off the turns."""
    spans = _turns(spark, d).select("meeting_id", "turn_no", (F.col("start") + 0.5).alias("start"), (F.col("end") + 0.5).alias("end"))
    out = segments.attribute_speakers(spans, _relative(spark, d), "turn_no")
    return out.select("meeting_id", "turn_no", "speaker", "overlap")


@_query
def chunk_rebase(spark, d):
    """Replies of one segment a turn, or of none, in chunks of ten minutes."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    one = F.array(F.struct((F.col("doc_id") % 30).cast("double").alias("start"), (F.col("doc_id") % 30 + F.col("n_chars") % 700).cast("double").alias("end"), F.lit("a").alias("text")))
    replies = docs.select(
        F.col("doc_id").alias("meeting_id"), F.lit(0).alias("chunk_no"), (F.col("doc_id") % 4 * 600.0).cast("double").alias("chunk_from"), (F.col("doc_id") % 4 * 600.0 + 600).cast("double").alias("chunk_to"),
        F.when(F.col("doc_id") % 5 == 1, F.col("n_chars").cast("double") / 100).alias("duration"), F.when(F.col("doc_id") % 5 == 2, F.lit(7.0)).alias("billed_seconds"), F.lit("b").alias("text"), F.when(F.col("doc_id") % 5 > 2, one).alias("segments"),
    )
    return segments.rebase_chunks(replies).select("meeting_id", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "text")


@_query
def platforms(spark, d):
    return intake.classify(view(spark, d, "meeting_urls")).select("page_id", "platform", "native_id", "error_code")


@_query
def platform_gate(spark, d):
    return intake.gate(intake.classify(view(spark, d, "meeting_urls")), SETTINGS.enabled_platforms).select("page_id", "platform", "accepted", "error_code")


@_query
def request_validation(spark, d):
    return intake.validate(spark.sql(oracles.REQUESTS.format(pages=f"parquet.`{d}/pages.parquet`"))).select("page_id", "error_code", "meeting_url")


@_query
def idempotency(spark, d):
    return intake.resolve_creates(view(spark, d, "create_requests")).select("seq", "project_id", "outcome", "created_seq")


@_query
def meeting_inserts(spark, d):
    """Requests after the first 1000 inserted among those, by project and key."""
    rows = view(spark, d, "create_requests").select("seq", "project_id", "idempotency_key")
    old = intake.insert_new(rows.filter("false"), rows.filter("seq < 1000"), ["project_id", "idempotency_key"], "seq")
    return intake.insert_new(old, rows.filter("seq >= 1000"), ["project_id", "idempotency_key"], "seq")


@_query
def api_key_auth(spark, d):
    users = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    key = F.concat(F.lit("sk_"), (F.col("user_id") % 7).cast("string"))
    kind, bare = F.col("event_id") % 11, (F.col("user_id") % 7).cast("string")
    said = F.when(kind == 1, F.concat(F.lit("bearer "), key)).when(kind == 2, F.concat(F.lit("Basic "), key)).when(kind == 3, F.concat(F.lit("Bearer "), bare))
    said = said.when(kind == 4, F.concat(F.lit("BEARER "), key, F.lit(" more"))).when(kind == 5, F.concat(F.lit("Bearer  "), key)).when(kind > 5, F.concat(F.lit("Bearer "), key))
    calls = users.select("event_id", said.alias("authorization"))
    keys = spark.range(5).select(F.sha2(F.concat(F.lit("sk_"), F.col("id").cast("string")), 256).alias("key_hash"), F.col("id").alias("project_id"))
    return intake.authenticate(calls, keys).select("event_id", "project_id", "error_code")


@_query
def lifecycle_transitions(spark, d):
    return lifecycle.transitions(view(spark, d, "lifecycle_events")).drop("ts")


@_query
def lifecycle_final(spark, d):
    return lifecycle.final(view(spark, d, "lifecycle_events")).select("meeting_id", "status", "n_events", "n_accepted")


@_query
def lifecycle_timestamps(spark, d):
    return lifecycle.final(view(spark, d, "lifecycle_events")).select("meeting_id", "started_at", "ended_at", "completed_at")


@_query
def lifecycle_reopened(spark, d):
    """Lifecycles in which of every nine events one asks to reopen and one to stop the meeting."""
    return lifecycle.replay(_reopening(spark, d)).select("meeting_id", "seq", "from_status", "to_status", "accepted", "error_cleared")


@_query
def lifecycle_by_ranges(spark, d):
    """The same, with a meeting's events spread over tasks."""
    return ranges.replay(_reopening(spark, d)).select("meeting_id", "seq", "from_status", "to_status", "accepted", "error_cleared")


def _reopening(spark, d):
    kind = F.when(F.col("seq") % 9 == 0, F.lit("reopen")).when(F.col("seq") % 9 == 4, F.lit("stop")).otherwise(F.col("target_status"))
    return view(spark, d, "lifecycle_events").withColumn("target_status", kind)


@_query
def join_deadlines(spark, d):
    return lifecycle.join_deadlines(view(spark, d, "lifecycle_events"), SETTINGS.join_deadline_seconds).select("meeting_id", "status", "error_code")


@_query
def terminal_events(spark, d):
    """The one accepted ending of each meeting that has one."""
    t = lifecycle.transitions(view(spark, d, "lifecycle_events"))
    return t.filter(F.col("accepted") & F.col("to_status").isin(*lookups.TERMINAL)).select("meeting_id", "seq", F.col("to_status").alias("status"))


@_query
def stop_and_recover(spark, d):
    f = lifecycle.final(view(spark, d, "lifecycle_events"))
    r = lifecycle.recovered(F.col("status"), F.col("n_events") % 2 == 0)
    return f.select("meeting_id", lifecycle.stopped(F.col("status")).alias("stopped"), r["status"].alias("recovered"), r["error_code"].alias("recover_error"))


@_query
def start_retries(spark, d):
    """Tries to send bots, by delivery attempts; some fail by a typed error."""
    n = F.col("meeting_id")
    code = F.when(n % 7 == 0, F.lit("unsupported_platform")).when((n % 5 == 0) & (F.col("seq") == 1), F.lit("provider_timeout"))
    tries = view(spark, d, "delivery_attempts").select(F.col("delivery_id").alias("meeting_id"), F.col("attempt").alias("seq"), F.col("response_code").alias("http")).withColumn("error_code", code)
    return lifecycle.starts(tries)


@_query
def failure_codes(spark, d):
    e = spark.sql(oracles.REASONS.format(events=f"parquet.`{d}/events.parquet`"))
    code = lookups.failure_code(F.col("reason"))
    body = serving.error_json(code, lookups.failure_message(F.col("reason")))
    return e.select("event_id", code.alias("error_code"), lookups.error_type(code).alias("error_type"), lookups.http_status(code).alias("http_status"), body.alias("body"))


@_query
def status_map(spark, d):
    e = spark.sql(oracles.CAPTURES.format(events=f"parquet.`{d}/events.parquet`"))
    p = F.col("platform")
    return e.select("event_id", lookups.capture_status(F.col("capture_status")).alias("status"), F.coalesce(lookups.lookup(lookups.CAPTURE_PLATFORM, p), p).alias("capture_platform"))


@_query
def call_errors(spark, d):
    """Codes of failed dispatches and provider calls by HTTP status."""
    a = view(spark, d, "delivery_attempts")
    code = lookups.provider_error(F.col("response_code"), F.col("attempt") == 6)
    sent = lookups.dispatch_error(F.when(F.col("attempt") == 1, F.lit("unsupported_platform")), F.when(F.col("response_code") == 503, 409).otherwise(F.col("response_code")))
    body = serving.error_body(F.coalesce(code, sent))
    return a.select("delivery_id", "attempt", code.alias("provider_code"), sent.alias("dispatch_code"), body["type"].alias("error_type"), body["http_status"].alias("http_status"))


@_query
def recording_usable(spark, d):
    return providers.usable_recordings(view(spark, d, "recordings")).select("meeting_id", "recording_id", "size_bytes")


@_query
def recording_source(spark, d):
    """Recordings that came with a meeting, or where none did those that are listed for it."""
    r = view(spark, d, "recordings")
    return providers.embedded_or_all(r.select("meeting_id").distinct(), r.filter("recording_id % 3 = 0 and meeting_id % 2 = 0"), r).select("meeting_id", "recording_id")


@_query
def provider_outcome(spark, d):
    return providers.turn_outcomes(view(spark, d, "provider_results"))


@_query
def result_merge(spark, d):
    return providers.merge_results(_eligible(_turns(spark, d)), view(spark, d, "provider_results")).select("meeting_id", "turn_no", "text", "from_provider")


@_query
def turn_stats(spark, d):
    return providers.turn_stats(_clipped(_turns(spark, d)), None, view(spark, d, "provider_results"))


@_query
def finalize_decisions(spark, d):
    out = providers.finalize(spark.sql(oracles.ENDED.format(events=f"parquet.`{d}/events.parquet`")))
    return out.select("event_id", "action", "error_code", "fallback_reason", "retry_s")


@_query
def finalize_tries(spark, d):
    """Four tries to finalize a meeting, as far as they are made."""
    from palaver.streaming.queries import tries

    return providers.finalize_tries(tries(spark.sql(oracles.ENDED.format(events=f"parquet.`{d}/events.parquet`"))))


@_query
def webhook_schedule(spark, d):
    return delivery.schedule(view(spark, d, "delivery_attempts")).drop("attempted_at")


@_query
def webhook_state(spark, d):
    return delivery.latest(delivery.schedule(view(spark, d, "delivery_attempts")))


def _meetings(spark, d):
    """Final lifecycles as meetings of project user_id % 5."""
    f = lifecycle.final(view(spark, d, "lifecycle_events"))
    user = F.split("meeting_id", "-")[0].cast("long")
    return f.select("*", (user % 5).alias("project_id"), F.when(F.col("status") == "failed", F.when(user % 3 > 0, F.lit("capture_failed"))).alias("error_code"))


def _kept(spark, d):
    """_meetings written once, for queries that read them more than once."""
    return written(_meetings(spark, d), "meetings")


def _transcript():
    """Which meetings have a transcript, the completed ones and some others, and who made it."""
    user = F.split("meeting_id", "-")[0].cast("long")
    back = user % 3 == 0
    made = {"provider": F.when(back, F.lit("native")).otherwise(F.lit("batch")), "fallback_from": F.when(back, F.lit("batch")), "fallback_reason": F.when(back, F.lit("no_turns"))}
    return (F.col("status") == "completed") | (user % 4 == 0), made


def _stored(meetings):
    has, made = _transcript()
    return meetings.filter(has).select("meeting_id", F.lit("en").alias("language"), (F.col("n_events") * 1.5).cast("double").alias("duration_seconds"), *[c.alias(k) for k, c in made.items()])


def _endings(meetings):
    """How meetings ended, all from the meeting's own row."""
    has, made = _transcript()
    ended = meetings.filter(F.col("ending.status").isin("completed", "failed"))
    return ended.select("meeting_id", "ending.seq", "ending.ts", "ending.status", "error_code", *[F.when(has, c).alias(k) for k, c in made.items()], F.lit(None).cast("string").alias("error_message"), _metadata().alias("metadata"))


def _metadata():
    user = F.split("meeting_id", "-")[0].cast("long")
    return F.when(user % 2 == 0, F.concat(F.lit('{"n": '), user.cast("string"), F.lit(', "team": {"id": "t"}}')))


@_query
def webhook_events(spark, d):
    return delivery.events(_endings(_meetings(spark, d))).select("meeting_id", "event_type", "payload")


@_query
def webhook_outbox(spark, d):
    """Two meetings of three name an address."""
    user = F.split("meeting_id", "-")[0].cast("long")
    m = _kept(spark, d)
    to = m.withColumn("webhook_url", F.when(user % 3 == 1, F.concat(F.lit("https://hooks.example.org/"), "meeting_id")).when(user % 3 == 2, F.lit("")).otherwise(F.lit("https://hooks.example.org/all")))
    return delivery.outbox(delivery.events(_endings(m)), to).select("meeting_id", "event_type", "endpoint", "payload", "attempt", "status", "next_attempt_at")


def _with_secrets(spark, d):
    projects = spark.range(4).select(F.col("id").alias("project_id"), F.concat(F.lit("whsec_"), F.col("id").cast("string")).alias("secret"))
    m = _kept(spark, d)
    return delivery.with_secrets(delivery.events(_endings(m)), m, projects)


@_query
def delivery_secret_join(spark, d):
    return _with_secrets(spark, d).select("meeting_id", "project_id", F.sha2("secret", 256).alias("secret_sha256"))


@_query
def webhook_signatures(spark, d):
    return delivery.signed(_with_secrets(spark, d)).select("meeting_id", "event_type", "signature")


@_query
def meeting_view(spark, d):
    user = F.split("meeting_id", "-")[0].cast("long")
    kept = _kept(spark, d)
    m = kept.withColumns({
        "platform": F.when(user % 2 == 0, F.lit("jitsi")).otherwise(F.lit("zoom")), "meeting_url": F.concat(F.lit("https://meet.example.org/"), "meeting_id"),
        "bot_name": F.when(user % 3 > 0, F.lit("Scribe")), "error_message": F.when(user % 4 == 0, F.lit("left the call")), "metadata": _metadata(),
    })
    v = serving.meeting_view(m, _stored(kept))
    flat = {"bot_name": "bot.name", "bot_joined_at": "bot.joined_at", "transcript_status": "transcript.status", "error_type": "error.type", "error_code": "error.code", "error_message": "error.message"}
    return v.select("*", *[F.col(b).alias(a) for a, b in flat.items()]).drop("bot", "transcript", "error")


@_query
def transcript_view(spark, d):
    """Stored transcripts with a speaker, a segment and a text each."""
    who = F.array(F.struct(F.lit("speaker_0").alias("id"), F.col("meeting_id").alias("name")))
    said = F.array(F.struct(F.lit("seg_001").alias("id"), F.lit("speaker_0").alias("speaker_id"), F.col("duration_seconds").alias("end")))
    m = _kept(spark, d)
    stored = _stored(m).withColumns({"speakers": who, "segments": said, "text": F.concat("meeting_id", F.lit(": yes")), "created_at": F.lit("2024-02-01 10:00:00").cast("timestamp")})
    v = serving.transcript_view(m, stored)
    one = {"speaker": F.col("speakers")[0]["name"], "segment_id": F.col("segments")[0]["id"], "segment_end": F.col("segments")[0]["end"]}
    return v.withColumns(one).drop("speakers", "segments")


@_query
def tenant_lookup(spark, d):
    """Every meeting asked for by the project of its user and by the next one."""
    m = _kept(spark, d)
    asked = m.select(F.explode(F.array("project_id", (F.col("project_id") + 1) % 5)).alias("project_id"), "meeting_id")
    return serving.tenant_lookup(m, asked).select("project_id", "meeting_id", "status", "error_code")


@_query
def transcript_upsert(spark, d):
    """Every event writes its meeting's transcript; even ones were stored before."""
    e = view(spark, d, "lifecycle_events").select("meeting_id", "seq", F.col("target_status").alias("provider"), F.col("ts").alias("created_at"))
    old = e.filter("seq % 2 = 0").groupBy("meeting_id").agg(F.max_by("provider", "seq").alias("provider"), F.max("created_at").alias("created_at"))
    return serving.upsert_transcripts(old, e.filter("seq % 2 = 1").select("meeting_id", "provider", "created_at", "seq")).select("meeting_id", "provider", "created_at")


@_query
def delete_cascade(spark, d):
    """Counts of what is left when every third user's meetings are deleted."""
    m = _kept(spark, d)
    gone = m.filter(F.split("meeting_id", "-")[0].cast("long") % 3 == 1)
    left = serving.delete_meetings(m, _stored(m), delivery.events(_endings(m)), gone)
    meetings = left[0].groupBy("project_id").agg(F.count("*").alias("n")).select(F.lit("meetings").alias("what"), "project_id", "n")
    kept = left[1].agg(F.count("*").alias("n")).select(F.lit("transcripts").alias("what"), F.lit(-1).cast("long").alias("project_id"), "n")
    orphans = left[2].filter("orphan").agg(F.count("*").alias("n")).select(F.lit("orphans").alias("what"), F.lit(-1).cast("long").alias("project_id"), "n")
    return meetings.union(kept).union(orphans)


@_query
def health_rollup(spark, d):
    p = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 5 != 0).alias("database_ok"), (F.col("event_id") % 7 != 0).alias("queue_ok"), (F.col("event_id") % 3 != 0).alias("capture_ok"))
    return serving.health(p).select("event_id", "status", "http_status")


@_query
def due_jobs(spark, d):
    """Jobs of each event type that are due in the middle of the month."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("queue"), F.col("event_id").alias("job_id"), F.when(F.col("event_id") % 4 > 0, F.col("ts")).alias("run_at"))
    return serving.due_jobs(e, F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))).select("queue", "job_id", F.col("position").cast("long"))


@_query
def queue_sizes(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("queue"), F.when(F.col("event_id") % 4 > 0, F.col("ts")).alias("run_at"))
    return serving.queue_sizes(e)


@_query
def rms_dbfs(spark, d):
    out = audio.levels(view(spark, d, "signal_windows"))
    return out.select("recording_id", "n_samples", F.round("rms_dbfs", 6).alias("rms_dbfs"))


@_query
def quiet_chunks(spark, d):
    """Recordings made of 200 repeats of a signal window at 320 samples a second, in rows of 50 repeats, cut at 10 seconds."""
    s = view(spark, d, "signal_windows").select("recording_id", F.transform("samples", lambda x: F.round(x * 1000).cast("int")).alias("samples"))
    parts = s.select("recording_id", F.flatten(F.array_repeat("samples", 50)).alias("samples"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part"))
    return audio.chunks(parts, 320, 10.0)


TURN_RATE = 40


def _provider(wav: bytes):
    """A provider that answers by the length and sum of a clip: outages, refusals, silence, two languages."""
    x = audio.from_wav(wav)[0].astype(int)
    n, total = len(x), int(x.sum())
    if n % 7 == 0:
        return audio.Reply(status=503)
    if n % 7 == 1:
        return audio.Reply(status=422)
    return audio.Reply(text="" if n % 7 == 2 else f"heard {n} {total}", language="de" if n % 3 == 0 else None)


@_query
def transcribe_turns(spark, d):
    """Turns of every meeting and recordings that end a second before them; of seven one is null and one silent."""
    t = written(_turns(spark, d), "turns")
    n = F.greatest(F.lit(1), F.floor((F.col("last") - 1.0) * TURN_RATE)).cast("int")
    value = lambda i: F.when(F.col("meeting_id") % 7 == 1, 0).otherwise((i * 37 + F.col("meeting_id") * 11) % 2001 - 1000).cast("smallint")
    made = t.groupBy("meeting_id").agg(F.max("end").alias("last")).select("meeting_id", F.lit(TURN_RATE).alias("rate"), F.when(F.col("meeting_id") % 7 != 0, F.transform(F.sequence(F.lit(0), n - 1), value)).alias("samples"))
    return audio.transcribe_turns(written(made, "recordings"), t, _provider, at_once=SETTINGS.calls_at_once, wait=lambda s: None)


def _whole_provider(wav: bytes):
    """A provider that answers by the length and loudness of a chunk: outages, refusals, segments, seconds heard or billed."""
    x = audio.from_wav(wav)[0]
    n, v = len(x), abs(int(x[0]))
    if v % 11 == 3:
        return audio.Reply(status=503)
    if v % 11 == 5 or (v % 11 == 7 and n < 722):
        return audio.Reply(status=422)
    spoken = "de" if n % 3 == 0 else None
    if v % 3 == 0:
        return audio.Reply(text="unused", language=spoken, segments=[(0.0, 2.5, f"first {n}"), (2.5, 60.0, f"then {v}"), (3.0, 4.0, " ")])
    return audio.Reply(text=f"heard {n} {v}", language=spoken, duration=5.0 if v % 3 == 1 else None, billed_seconds=7.0)


@_query
def transcribe_whole(spark, d):
    """Recordings of even loudness, 400 samples a row, cut at 20 seconds; of seven one is null and one silent. Odd meetings have no segments."""
    rel = written(_relative(spark, d).select("meeting_id", "pos", "speaker", "start", "end"), "segments")
    n = F.greatest(F.lit(1), F.floor(F.col("last") * TURN_RATE)).cast("int")
    made = rel.groupBy("meeting_id").agg(F.max("end").alias("last")).select("meeting_id", n.alias("n"))
    tasks = audio.tasks_for(spark, made.agg(F.sum("n")).first()[0] or 0, audio.FEW_SAMPLES, audio.MANY_SAMPLES)
    made = made.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 400).cast("int"))).alias("part")).repartition(tasks, "meeting_id", "part")
    loud = F.when(F.col("meeting_id") % 7 == 1, 0).otherwise(F.col("meeting_id") % 500 + 500)
    swing = F.flatten(F.array_repeat(F.array(loud.cast("smallint"), (-loud).cast("smallint")), 200))
    blocks = made.select("meeting_id", "part", F.when(F.col("meeting_id") % 7 != 0, F.slice(swing, 1, F.least(F.lit(400), F.col("n") - F.col("part") * 400))).alias("samples"))
    return audio.whole_transcripts(written(blocks, "blocks"), rel.filter("meeting_id % 2 = 0"), TURN_RATE, _whole_provider, longest_s=20.0, at_once=SETTINGS.calls_at_once, wait=lambda s: None)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from palaver.streaming import queries as streams

    return _ALL | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
