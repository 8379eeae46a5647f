"""The operators of segments and events for meetings that no task can hold: a meeting spreads over ranges of its order.

They give the rows of `segments.dedupe`, `segments.rebase`, `segments.merge_turns`, `transcripts.normalize` and `lifecycle.replay`. Those take one
exchange and a window over a meeting, which is cheaper while meetings are small; these write the rows in ranges once or twice
and stitch the ranges at their borders, so only one row for each range and meeting goes through a window over a meeting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palaver.functions.lookups import STATUS_RANK, lookup
from palaver.functions.text import non_blank, segment_name, ws_trim
from palaver.operators import lifecycle
from palaver.operators import segments as one_task
from palaver.operators.ranking import dealt, numbered
from palaver.operators.transcripts import NOBODY
from palaver.sources.shared import written


def dedupe(segments: DataFrame) -> DataFrame:
    """segments.dedupe: an id's rows meet in an aggregate, a turn's rows in a window of their own, both a handful; rows
    without an id meet nowhere. Places are counted by ranges."""
    rows, value = one_task.identified(segments), segments.columns
    unnamed = rows.filter("_id is null").select(*value, F.lit(False).alias("_named"), F.col("ord").alias("_place"))
    rest = [c for c in value if c not in ("meeting_id", "ord")]
    last = F.max_by(F.struct(*rest, "_turn", "_draft"), "ord")
    named = rows.filter("_id is not null").groupBy("meeting_id", "_id").agg(F.max("ord").alias("ord"), F.min("ord").alias("_place"), last.alias("_v")).select("meeting_id", "ord", "_place", "_id", "_v.*")
    # Ids that name no turn are drafts of nothing; each is a group of its own.
    turn = W.partitionBy("meeting_id", F.when(F.col("_turn").isNull(), F.col("_id")), "_turn")
    named = named.withColumn("_settled", F.max(F.col("_turn").isNotNull() & ~F.col("_draft")).over(turn)).filter(~(F.col("_draft") & F.col("_settled")))
    kept = unnamed.unionByName(named.select(*value, F.lit(True).alias("_named"), "_place"))
    out = numbered(kept, "meeting_id", [F.col("_named").asc(), F.col("_place").asc()], "pos")
    return out.withColumn("pos", F.col("pos") - 1).drop("_named", "_place")


def rebase(segments: DataFrame) -> DataFrame:
    """segments.rebase: first starts are a partial aggregate that is joined back. Rows without a meeting go with each other."""
    first = segments.groupBy(F.col("meeting_id").alias("_m")).agg(F.min("start").alias("_first_start"))
    return one_task.relative(segments.join(first, F.col("meeting_id").eqNullSafe(F.col("_m"))).drop("_m"))


def merge_turns(segments: DataFrame, gap: float = one_task.GAP_S) -> DataFrame:
    """segments.merge_turns: islands of each range, stitched.

    A range tells of a meeting: who speaks first in it, who last and until when at most in that last run, and whether one run
    fills it. A run that goes on from range to range has the maximum of what these say. With what comes before it, a range
    knows which of its rows begin a turn; how many do so in the ranges before gives the turns' numbers.
    """
    rows = dealt(one_task.spoken(segments), [F.col(c).asc_nulls_first() for c in ("meeting_id", "start", "end", "pos")])
    here = W.partitionBy("_part", "meeting_id").orderBy("_at")
    upto = here.rowsBetween(W.unboundedPreceding, 0)
    changed = (F.row_number().over(here) > 1) & ~F.lag("speaker").over(here).eqNullSafe(F.col("speaker"))
    rows = rows.withColumn("_changed", changed.cast("int")).withColumn("_run", F.sum("_changed").over(upto))
    run = W.partitionBy("_part", "meeting_id", "_run").orderBy("_at")
    rows = rows.withColumn("_before", F.max("end").over(run.rowsBetween(W.unboundedPreceding, -1)))

    ends = rows.groupBy("_part", "meeting_id").agg(
        F.min(F.struct("_at", "speaker"))["speaker"].alias("_head"),
        F.max(F.struct("_at", "speaker", "_run", F.greatest("_before", "end").alias("reach"))).alias("_tail"),
    )
    across = W.partitionBy("meeting_id").orderBy("_part")
    joins = (F.row_number().over(across) > 1) & F.lag("_tail.speaker").over(across).eqNullSafe(F.col("_head"))
    ends = ends.withColumn("_joins", joins)
    ends = ends.withColumn("_chain", F.sum((~(F.col("_joins") & (F.col("_tail._run") == 0))).cast("int")).over(across.rowsBetween(W.unboundedPreceding, 0)))
    ends = ends.withColumn("_reach", F.max("_tail.reach").over(W.partitionBy("meeting_id", "_chain").orderBy("_part").rowsBetween(W.unboundedPreceding, 0)))
    carried = ends.select(F.col("_part").alias("_p"), F.col("meeting_id").alias("_m"), F.when(F.col("_joins"), F.lag("_reach").over(across)).alias("_carried"))

    same = lambda: (F.col("_part") == F.col("_p")) & F.col("meeting_id").eqNullSafe(F.col("_m"))
    reached = F.greatest("_before", F.when(F.col("_run") == 0, F.col("_carried")))
    begins = F.coalesce(F.col("start") - reached > gap, F.lit(True)).cast("long")
    rows = rows.join(carried, same()).withColumn("_begins", begins).drop("_p", "_m", "_changed", "_run", "_before", "_carried")
    rows = written(rows.withColumn("_nth", F.sum("_begins").over(upto)).drop("_begins"), "turn-rows")

    counts = rows.groupBy(F.col("_part").alias("_p"), F.col("meeting_id").alias("_m")).agg(F.max("_nth").alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy("_m").orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("_p", "_m", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    return one_task.gathered(rows.join(counts, same()).withColumn("turn_no", (F.col("_earlier") + F.col("_nth") - 1).cast("long")))


def normalize(segments: DataFrame) -> DataFrame:
    """transcripts.normalize: numbers by ranges; speakers, of whom a meeting has few, are ranked by their first one."""
    rows = segments.filter(non_blank(F.col("text")).isNotNull()).withColumn("speaker_name", F.coalesce(non_blank(F.col("speaker")), F.lit(NOBODY)))
    rows = numbered(rows, "meeting_id", [F.col("start").asc(), F.col("end").asc(), F.col("pos").asc()], "n")
    first = rows.groupBy(F.col("meeting_id").alias("_m"), F.col("speaker_name").alias("_s")).agg(F.min("n").alias("_first"))
    who = first.select("_m", "_s", (F.row_number().over(W.partitionBy("_m").orderBy("_first")) - 1).alias("_who"))
    out = rows.join(who, F.col("meeting_id").eqNullSafe(F.col("_m")) & (F.col("speaker_name") == F.col("_s")))
    return out.select("meeting_id", "n", segment_name(F.col("n")).alias("id"), F.concat(F.lit("speaker_"), F.col("_who").cast("string")).alias("speaker_id"), "speaker_name", "start", "end", ws_trim(F.col("text")).alias("text"), "language")


def _before(moves: np.ndarray, codes: np.ndarray, opens: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Events in order -> the state before each and the one after all, for every state that may come before the first.

    `moves` has the next state by event and state. An event is thus a map of states, and the events up to a place are the
    composition of theirs, which doubles its reach with every step; one that opens a meeting maps all states alike.
    """
    maps = moves[codes]
    maps[opens] = moves[codes[opens], :1]
    reach = 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], 1)
        reach *= 2
    after = maps[:, state]
    before = np.concatenate([state[None], after[:-1]])
    before[opens] = 0
    return before, after[-1]


def _stretches(b: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    """A batch's ranges: number, first row, end."""
    part = b.column(b.schema.get_field_index("_part")).to_numpy()
    cuts = np.flatnonzero(np.diff(part)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
        yield int(part[i]), i, j


def replay(events: DataFrame) -> DataFrame:
    """lifecycle.replay: every range is a map of states, composed of those of its events.

    A meeting has one of a few statuses, so the driver gets a handful of numbers for each range (as many as shuffle
    partitions), from which it knows the status at each range's beginning; with that, each range tells the status before
    each of its events. Which event moves which status where is asked of lifecycle.moved() once.
    """
    spark, states = events.sparkSession, list(STATUS_RANK)  # a meeting begins in the first
    kinds = {k: i for i, k in enumerate([*states, "reopen", "stop"])}
    pairs = spark.createDataFrame([(s, k) for s in states for k in kinds], "s string, k string")
    moves = np.tile(np.arange(len(states)), (len(kinds) + 1, 1))  # whatever else is asked for changes nothing
    for r in pairs.select("s", "k", lifecycle.moved(F.col("s"), F.col("k"))[2].alias("to")).collect():
        moves[kinds[r["k"]], states.index(r["s"])] = states.index(r["to"])

    rows = events.select("meeting_id", "seq", "ts", "target_status")
    rows = dealt(rows, [F.col(c).asc_nulls_first() for c in ("meeting_id", "ts", "seq", "target_status")], "event-rows")
    code = F.coalesce(lookup(kinds, F.col("target_status")).cast("int"), F.lit(len(kinds)))
    opens = ~F.lag("meeting_id").over(here := W.partitionBy("_part").orderBy("_at")).eqNullSafe(F.col("meeting_id"))
    rows = rows.withColumn("_code", code).withColumn("_opens", (F.row_number().over(here) > 1) & opens)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            codes, first = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_code", "_opens"))
            for part, i, j in _stretches(b):
                seen[part] = _before(moves, codes[i:j], first[i:j], seen.get(part, np.arange(len(states))))[1]
        yield pa.RecordBatch.from_pydict({"_part": pa.array(list(seen), pa.int64()), "_map": pa.array([m.tolist() for m in seen.values()], pa.list_(pa.int64()))})

    maps = {r["_part"]: r["_map"] for r in rows.select("_part", "_code", "_opens").mapInArrow(fold, "_part long, _map array<long>").collect()}
    ends = rows.groupBy("_part").agg(F.min_by("meeting_id", "_at").alias("head"), F.max_by("meeting_id", "_at").alias("tail")).orderBy("_part").collect()
    start, state, tail = {}, 0, object()
    for r in ends:
        start[r["_part"]] = state if r["head"] == tail else 0
        state, tail = maps[r["_part"]][start[r["_part"]]], r["tail"]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[int, np.ndarray] = {}
        for b in batches:
            codes, first = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_code", "_opens"))
            was = np.zeros(len(b), np.int64)
            for part, i, j in _stretches(b):
                before, now[part] = _before(moves, codes[i:j], first[i:j], now.get(part, np.array([start[part]])))
                was[i:j] = before[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(was + 1, pa.int32())], names=[*b.schema.names[:4], "_was"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select("meeting_id", "seq", "ts", "target_status").schema)
    told = rows.select("meeting_id", "seq", "ts", "target_status", "_part", "_code", "_opens").mapInArrow(tell, f"{kind}, _was int")
    told = told.withColumn("from_status", F.element_at(F.array(*map(F.lit, states)), F.col("_was")))
    ok, reopens, _ = lifecycle.moved(F.col("from_status"), F.col("target_status"))
    return told.select("meeting_id", "seq", "ts", "from_status", F.col("target_status").alias("to_status"), ok.alias("accepted"), reopens.alias("error_cleared"))
