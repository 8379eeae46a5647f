"""Normalised transcripts: numbered segments, speakers by first appearance, text and duration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palaver.functions.text import non_blank, non_empty, round3, segment_name, ws_trim

NOBODY = "Unknown"


def normalize(segments: DataFrame) -> DataFrame:
    """Segments with words, in time order: n (from 1), id, speaker_id, speaker_name, start, end, text, language."""
    meeting = W.partitionBy("meeting_id")
    rows = segments.filter(non_blank(F.col("text")).isNotNull())
    rows = rows.withColumn("n", F.row_number().over(meeting.orderBy("start", "end", "pos")).cast("long"))
    rows = rows.withColumn("speaker_name", F.coalesce(non_blank(F.col("speaker")), F.lit(NOBODY)))
    rows = rows.withColumn("_first", F.min("n").over(W.partitionBy("meeting_id", "speaker_name")))
    who = F.dense_rank().over(meeting.orderBy("_first")) - 1
    return rows.select("meeting_id", "n", segment_name(F.col("n")).alias("id"), F.concat(F.lit("speaker_"), who.cast("string")).alias("speaker_id"), "speaker_name", "start", "end", ws_trim(F.col("text")).alias("text"), "language")


def speakers(normalized: DataFrame) -> DataFrame:
    """meeting_id, speaker_id, speaker_name, n_segments."""
    return normalized.groupBy("meeting_id", "speaker_id", "speaker_name").agg(F.count("*").alias("n_segments"))


def transcripts(meetings: DataFrame, normalized: DataFrame, hint: Column | None = None) -> DataFrame:
    """One row for each of `meetings` (meeting_id): language, duration_seconds, n_speakers, n_segments, text.

    The language is the hint, else the first that a segment names, else English. A meeting without words has none.
    """
    lines = F.array_sort(F.collect_list(F.struct("n", F.concat_ws(": ", "speaker_name", "text").alias("line"))))
    told = non_empty(F.col("language"))
    by = normalized.groupBy("meeting_id").agg(
        F.min(F.when(told.isNotNull(), F.struct(F.col("n"), told.alias("language"))))["language"].alias("_told"),
        F.max("end").alias("_end"),
        F.countDistinct("speaker_id").alias("n_speakers"),
        F.count("*").alias("n_segments"),
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"),
    )
    hint = F.lit(None).cast("string") if hint is None else hint
    return meetings.join(by, "meeting_id", "left").select(
        "meeting_id",
        F.coalesce(non_empty(hint), "_told", F.lit("en")).alias("language"),
        round3(F.coalesce("_end", F.lit(0.0))).alias("duration_seconds"),
        F.coalesce("n_speakers", F.lit(0)).cast("long").alias("n_speakers"),
        F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def documents(stored: DataFrame, normalized: DataFrame) -> DataFrame:
    """Transcripts (meeting_id and others) with their speakers and segments as arrays, in order."""
    who = F.array_sort(F.collect_set(F.struct(F.length("speaker_id").alias("l"), F.col("speaker_id").alias("id"), F.col("speaker_name").alias("name"))))
    said = F.array_sort(F.collect_list(F.struct("n", "id", "speaker_id", "speaker_name", "start", "end", "text")))
    by = normalized.groupBy("meeting_id").agg(
        F.transform(who, lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("speakers"),
        F.transform(said, lambda x: F.struct(x["id"].alias("id"), x["speaker_id"].alias("speaker_id"), x["speaker_name"].alias("speaker_name"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))).alias("segments"),
    )
    return stored.join(by, "meeting_id", "left")


def longest(transcript_seconds: Column, recording_seconds: Column) -> Column:
    """Duration of a transcript made from a recording."""
    return F.greatest(transcript_seconds, round3(recording_seconds))
