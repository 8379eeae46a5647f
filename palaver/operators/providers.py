"""Transcription outcomes: usable recordings, turn results, and what becomes of a meeting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palaver.functions.lookups import FINALIZE_RETRY_S, MOST_ATTEMPTS, RETRYABLE, failure_code, retryable_fetch
from palaver.functions.text import non_blank

LEAST_BYTES_PER_S = 1000


def silent(size_bytes: Column, seconds: Column) -> Column:
    """A recording far below the rate of speech; unknown lengths are not judged."""
    return F.coalesce((seconds > 5) & (size_bytes / seconds < LEAST_BYTES_PER_S), F.lit(False))


def usable_recordings(recordings: DataFrame) -> DataFrame:
    """The first usable recording of each meeting in the order of its list (pos): audio with an address, not empty, not silent."""
    ok = (F.col("media_type") == "audio") & F.col("raw_url").isNotNull() & (F.col("size_bytes") > 0) & ~silent(F.col("size_bytes"), F.col("meeting_duration_s"))
    first = F.row_number().over(W.partitionBy("meeting_id").orderBy("pos", "recording_id")) == 1
    return recordings.filter(ok).withColumn("_f", first).filter("_f").drop("_f")


def embedded_or_all(meetings: DataFrame, embedded: DataFrame, listed: DataFrame) -> DataFrame:
    """Recordings of each meeting: those in its own payload, or if there are none the listed ones of that meeting."""
    own = embedded.join(meetings, "meeting_id", "left_semi")
    rest = listed.join(meetings, "meeting_id", "left_semi").join(own.select("meeting_id").distinct(), "meeting_id", "left_anti")
    return own.unionByName(rest)


def content_type(c: Column) -> Column:
    return F.when(c.startswith("audio/"), c).otherwise(F.lit("audio/webm"))


def turn_outcomes(results: DataFrame) -> DataFrame:
    """Per meeting: eligible, transcribed, failed, unavailable and outcome of its turns' calls.

    All unavailable: provider_unavailable, to be retried. More than half failed: turns_failed. None: no_turns.
    """
    bad = F.col("outcome") != "ok"
    by = results.groupBy("meeting_id").agg(
        F.count("*").alias("eligible"), F.count_if(~bad).alias("transcribed"), F.count_if(bad).alias("failed"), F.count_if(F.col("outcome") == "unavailable").alias("unavailable")
    )
    return by.withColumn("outcome", turns_verdict(F.col("eligible"), F.col("failed"), F.col("unavailable")))


def turns_verdict(eligible: Column, failed: Column, unavailable: Column) -> Column:
    return F.when(eligible == 0, F.lit("no_turns")).when(unavailable == eligible, F.lit("provider_unavailable")).when(failed * 2 > eligible, F.lit("turns_failed")).otherwise(F.lit("ok"))


def turn_stats(turns: DataFrame, eligible: DataFrame | None, results: DataFrame) -> DataFrame:
    """Per meeting: turns, skipped_short (not eligible), transcribed, failed, and calls with all their attempts.

    Without `eligible` the turns tell themselves which are (segments.clipped), and are derived once."""
    done = results.groupBy("meeting_id").agg(F.count_if(F.col("outcome") == "ok").alias("_ok"), F.count_if(F.col("outcome") != "ok").alias("_bad"), F.sum("attempts").alias("_calls"))
    if eligible is None:
        out = turns.groupBy("meeting_id").agg(F.count("*").alias("turns"), F.count_if("eligible").alias("_e"))
    else:
        out = turns.groupBy("meeting_id").agg(F.count("*").alias("turns")).join(eligible.groupBy("meeting_id").agg(F.count("*").alias("_e")), "meeting_id", "left")
    out = out.join(done, "meeting_id", "left")
    zero = lambda c, name: F.coalesce(c, F.lit(0).cast("long")).alias(name)
    return out.select("meeting_id", "turns", (F.col("turns") - zero("_e", "_")).alias("skipped_short"), zero("_ok", "transcribed"), zero("_bad", "failed"), zero("_calls", "calls"))


def merge_results(eligible: DataFrame, results: DataFrame) -> DataFrame:
    """Eligible turns (meeting_id, turn_no) with the provider's text where it answered, even with nothing, else their own
    words. Results count eligible turns from 1 (turn_idx), so turns that were not asked for don't count and don't stay."""
    said = results.filter(F.col("outcome") == "ok").select("meeting_id", F.col("turn_idx").cast("long"), F.col("result_text"), F.lit(True).alias("_ok"))
    asked = eligible.withColumn("turn_idx", F.row_number().over(W.partitionBy("meeting_id").orderBy("turn_no")).cast("long"))
    out = asked.join(said, ["meeting_id", "turn_idx"], "left")
    return out.withColumn("text", F.when(F.col("_ok"), F.coalesce("result_text", F.lit(""))).otherwise(F.col("text"))).withColumn("from_provider", F.coalesce("_ok", F.lit(False))).drop("_ok", "result_text", "turn_idx")


def decision(attempts: Column, native: str = "native") -> Column:
    """What becomes of a meeting whose capture has ended and whose transcription was tried before `attempts` times:
    struct(action, error_code, fallback_reason, retry_s). See finalize() for the columns that it reads."""
    batch = F.col("provider") != native
    no_words = ~F.col("live_words")
    fetch_error = ~F.col("audio").isin("usable", "none")
    again = attempts + 1 < MOST_ATTEMPTS
    retryable = F.col("result").isin(*RETRYABLE)
    later = retryable_fetch(F.col("audio"), F.regexp_extract("audio", r"^http_(\d{3})$", 1).try_cast("int"))
    reasons = ("undecodable", "silent_recording", "turns_failed", "no_turns")
    can = batch & F.col("live_words")
    delay = (FINALIZE_RETRY_S * (attempts + 1)).cast("int")
    row = lambda action, error=None, why=None, wait=None: F.struct(
        F.lit(action).alias("action"),
        (F.lit(None).cast("string") if error is None else F.lit(error) if isinstance(error, str) else error).alias("error_code"),
        (F.lit(None).cast("string") if why is None else F.lit(why) if isinstance(why, str) else why).alias("fallback_reason"),
        (F.lit(None).cast("int") if wait is None else wait).alias("retry_s"),
    )
    return (
        F.when(no_words & batch & fetch_error & later & again, row("retry", wait=delay))
        .when(no_words & batch & fetch_error, row("fail", "transcription_failed"))
        .when(no_words & (~batch | (F.col("audio") == "none")), row("fail", failure_code(F.col("reason"))))
        .when((F.col("result") == "ok") & non_blank(F.col("result_text")).isNotNull(), row("complete"))
        .when(F.col("result") == "ok", row("fail", "transcription_failed"))
        .when(retryable & again, row("retry", wait=delay))
        .when(can & (F.col("audio") == "none"), row("fall_back", why="no_usable_recording"))
        .when(can & F.col("result").isin(*reasons), row("fall_back", why=F.col("result")))
        .when(can & retryable, row("fall_back", why="provider_unavailable_after_retries"))
        .when(retryable | F.col("result").isin(*reasons), row("fail", "transcription_failed"))
        .otherwise(row("fail", F.col("result")))
    )


def finalize(meetings: DataFrame, native: str = "native") -> DataFrame:
    """What becomes of meetings whose capture has ended: action, error_code, fallback_reason, retry_s.

    Columns: provider, live_words, attempts (so far), reason (why capture ended, or null), audio (usable, none, an error
    code of its fetch, or http_ and the status that the fetch got), result (ok, or the error code or fallback reason of the provider), result_text.
    The first case that applies decides.
    """
    return meetings.withColumn("_d", decision(F.col("attempts"), native)).select(*meetings.columns, "_d.action", "_d.error_code", "_d.fallback_reason", "_d.retry_s")


def finalize_tries(tries: DataFrame, native: str = "native") -> DataFrame:
    """Results of trying to finalize (meeting_id, seq and what finalize() reads, without attempts) as far as they are waited
    for: meeting_id, seq, attempt (from 1), action, error_code, fallback_reason, retry_s. An attempt follows a retry alone,
    so the attempts so far are the row's place among its meeting's tries. The third failure is no retry: it falls back or fails."""
    order = W.partitionBy("meeting_id").orderBy("seq")
    rows = tries.withColumn("attempt", F.row_number().over(order)).filter(F.col("attempt") <= MOST_ATTEMPTS)
    rows = rows.withColumn("_d", decision(F.col("attempt") - 1, native)).select("meeting_id", "seq", "attempt", "_d.*")
    over = F.coalesce(F.max(F.col("action") != "retry").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    return rows.withColumn("_over", over).filter(~F.col("_over")).drop("_over")


def reply_language(hint: Column, *replies: Column) -> Column:
    """Language of a transcript: the request's, else the first reply's; an empty text counts as given."""
    return F.coalesce(hint, *replies)
