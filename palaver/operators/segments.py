"""Capture segments: upserts and drafts resolved, times made relative, turns merged, speakers attributed.

Columns: meeting_id, ord (order of arrival, unique in a meeting), speaker, text, language, completed, segment_id,
start, end, start_time (epoch seconds or null). Every window partitions by meeting, so a chain of these operators
needs one exchange: `repartition("meeting_id")` before the first keeps Spark from planning one for each finer key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palaver.functions.text import finite, non_blank, non_empty, round3
from palaver.operators.intervals import overlapping

TURN_ID = r"^turn:(\d+):(p?)(\d+)$"
GAP_S, LEAST_TURN_S, PAD_S = 0.75, 0.4, 0.25


def _by(*keys: str):
    return W.partitionBy("meeting_id", *keys)


def live(c: Column) -> Column:
    """Rows not flagged incomplete; an absent flag counts as complete."""
    return F.coalesce(c, F.lit(True))


def identified(segments: DataFrame) -> DataFrame:
    """Segments that are complete with _id (null if unnamed), _turn (of an id that names one) and _draft."""
    named = non_empty(F.col("segment_id"))
    turn = F.when(named.rlike(TURN_ID), F.regexp_extract(named, TURN_ID, 1))
    draft = turn.isNotNull() & (F.regexp_extract(named, TURN_ID, 2) == "p")
    return segments.filter(live(F.col("completed"))).withColumns({"_id": named, "_turn": turn, "_draft": draft})


def dedupe(segments: DataFrame) -> DataFrame:
    """The rows that stand: the last row of each id, in the place of its first; unnamed rows first; a draft only while
    its turn has no confirmed row. Adds pos, the place in the meeting from 0."""
    rows = identified(segments.repartition("meeting_id"))
    rows = rows.withColumn("_settled", F.max(F.col("_turn").isNotNull() & ~F.col("_draft")).over(_by("_turn")))
    rows = rows.withColumn("_last", F.max("ord").over(_by("_id"))).withColumn("_first", F.when(F.col("_id").isNull(), F.col("ord")).otherwise(F.min("ord").over(_by("_id"))))
    rows = rows.filter((F.col("_id").isNull() | (F.col("ord") == F.col("_last"))) & ~(F.coalesce("_draft", F.lit(False)) & F.col("_settled")))
    order = _by().orderBy(F.col("_id").isNotNull(), "_first")
    return rows.withColumn("pos", F.row_number().over(order) - 1).drop("_id", "_turn", "_draft", "_settled", "_last", "_first")


def rebase(segments: DataFrame) -> DataFrame:
    """Times relative to the meeting: its origin is start_time if that doesn't come after the first segment, else the
    first segment's start."""
    return relative(segments.withColumn("_first_start", F.min("start").over(_by())))


def relative(segments: DataFrame) -> DataFrame:
    """rebase() of segments that hold their meeting's first start, _first_start."""
    origin = F.when(F.col("start_time") <= F.col("_first_start"), F.col("start_time")).otherwise(F.col("_first_start"))
    rel = lambda c: round3(F.greatest(F.lit(0.0), F.col(c) - F.col("_origin")))
    rows = segments.withColumn("_origin", origin)
    return rows.withColumns({"start": rel("start"), "end": rel("end")}).drop("_first_start", "_origin")


def merge_turns(segments: DataFrame, gap: float = GAP_S) -> DataFrame:
    """Neighbouring segments of one speaker, no further apart than `gap`, as one turn.

    meeting_id, turn_no (from 0), speaker (null if blank), start, end, text, language (the first that is not null).
    The distance is to the latest end so far; within a run of one speaker that is the run's running maximum.
    """
    rows = spoken(segments)
    order = _by().orderBy("start", "end", "pos")
    other = F.coalesce(~F.lag("speaker").over(order).eqNullSafe(F.col("speaker")) | (F.row_number().over(order) == 1), F.lit(True))
    rows = rows.withColumn("_run", F.sum(other.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    run = _by("_run").orderBy("start", "end", "pos").rowsBetween(W.unboundedPreceding, -1)
    new = F.coalesce(F.col("start") - F.max("end").over(run) > gap, F.lit(True))
    rows = rows.withColumn("_new", new).withColumn("turn_no", (F.sum(F.col("_new").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("long"))
    return gathered(rows)


def spoken(segments: DataFrame) -> DataFrame:
    """Complete segments with times in order; a blank speaker is none."""
    rows = segments.filter(live(F.col("completed")) & finite(F.col("start")) & finite(F.col("end")) & (F.col("end") >= F.col("start")))
    return rows.withColumn("speaker", non_blank(F.col("speaker")))


def gathered(rows: DataFrame) -> DataFrame:
    """Segments with their turn_no as turns."""
    said = F.filter(F.array_sort(F.collect_list(F.struct("start", "end", "pos", non_blank(F.col("text")).alias("t")))), lambda x: x["t"].isNotNull())
    return rows.groupBy("meeting_id", "turn_no").agg(
        F.max("speaker").alias("speaker"),
        round3(F.min("start")).alias("start"),
        round3(F.max("end")).alias("end"),
        F.array_join(F.transform(said, lambda x: x["t"]), " ").alias("text"),
        F.min(F.when(F.col("language").isNotNull(), F.struct("start", "end", "pos", "language")))["language"].alias("language"),
    )


def clipped(turns: DataFrame, seconds: Column, least: float = LEAST_TURN_S, pad: float = PAD_S) -> DataFrame:
    """All turns with the padded stretch of the recording (clip_from, clip_to), and whether they are long enough to
    transcribe (eligible)."""
    clip = turns.withColumn("clip_from", F.greatest(F.lit(0.0), F.col("start") - pad)).withColumn("clip_to", F.least(seconds, F.col("end") + pad))
    return clip.withColumn("eligible", (F.col("end") - F.col("start") >= least) & (F.col("clip_to") > F.col("clip_from")))


def eligible_turns(turns: DataFrame, seconds: Column, least: float = LEAST_TURN_S, pad: float = PAD_S) -> DataFrame:
    """Turns long enough to transcribe, with the padded stretch of the recording (clip_from, clip_to)."""
    return clipped(turns, seconds, least, pad).filter("eligible").drop("eligible")


def attribute_speakers(spans: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """spans with speaker and overlap: that of the segment in the meeting which overlaps a span most, the first in
    order if several do; null if none overlaps or names a speaker.

    Pairs come from bins of the meeting's time, see intervals.overlapping; the largest is a partial aggregate, so nothing is sorted.
    """
    named = segments.filter(non_empty(F.col("speaker")).isNotNull()).select("meeting_id", "speaker", "start", "end", "pos")
    spans = spans.drop("speaker", "overlap")
    pairs = overlapping(spans.select("meeting_id", key, "start", "end"), named, "meeting_id")
    best = pairs.groupBy("meeting_id", F.col(f"l.{key}").alias(key)).agg(F.max(F.struct("overlap", (-F.col("r.pos")).alias("pos"), F.col("r.speaker").alias("speaker"))).alias("_b"))
    return spans.join(best, ["meeting_id", key], "left").withColumns({"speaker": F.col("_b.speaker"), "overlap": F.col("_b.overlap")}).drop("_b")


def rebase_chunks(replies: DataFrame) -> DataFrame:
    """Provider replies by chunk (meeting_id, chunk_no, chunk_from, chunk_to, duration, billed_seconds, text, segments)
    -> segments on the recording's time. A reply without segments is one as long as it says, or was billed, or the chunk.
    `end` stops at the chunk's; said_until doesn't, and is what speakers are told by. A reply's language stays, if it has one."""
    whole = F.coalesce("duration", "billed_seconds", F.col("chunk_to") - F.col("chunk_from"))
    one = F.array(F.struct(F.lit(0.0).alias("start"), whole.cast("double").alias("end"), F.col("text").alias("text")))
    parts = F.when(F.size(F.coalesce("segments", F.array().cast("array<struct<start:double,end:double,text:string>>"))) > 0, F.col("segments")).otherwise(one)
    spoken = F.col("language") if "language" in replies.columns else F.lit(None).cast("string")
    rows = replies.select("meeting_id", "chunk_no", "chunk_from", "chunk_to", spoken.alias("language"), F.posexplode(parts).alias("pos", "_s"))
    said = F.col("chunk_from") + F.col("_s.end")
    return rows.select("meeting_id", "chunk_no", "pos", (F.col("chunk_from") + F.col("_s.start")).alias("start"), F.least("chunk_to", said).alias("end"), said.alias("said_until"), F.col("_s.text").alias("text"), "language")


def chunk_speakers(replies: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments of rebase_chunks() with the speaker who overlaps each most, told before its end is cut."""
    rows = rebase_chunks(replies).withColumn("span", F.struct("chunk_no", "pos"))
    told = attribute_speakers(rows.select("meeting_id", "span", "start", F.col("said_until").alias("end")), segments, "span")
    return rows.join(told.select("meeting_id", "span", "speaker"), ["meeting_id", "span"]).drop("span", "said_until")
