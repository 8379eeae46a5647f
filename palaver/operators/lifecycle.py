"""Meeting lifecycles: a forward-only state machine over events, as windows, and what follows from its transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palaver.functions.lookups import JOIN_DEADLINE_S, MOST_ATTEMPTS, RETRYABLE, STATUS_RANK, TERMINAL, dispatch_error, lookup, start_delay_ms

_NAME = {str(r): s for s, r in STATUS_RANK.items() if s not in TERMINAL}


def _rank(status: Column) -> Column:
    return lookup(STATUS_RANK, status)


def transitions(events: DataFrame) -> DataFrame:
    """Events (meeting_id, seq, ts, target_status) with from_status and accepted, in the order of ts and seq.

    A meeting starts as queued. Statuses that don't end it must rank above all before. A failure ends any meeting that
    has not ended, a cancellation one that is not in progress yet, a completion one that is being processed. As ranks
    only rise, the state before an event is the highest rank so far, unless a valid ending came first: two windows in
    one partitioning, no fold. For events that reopen meetings see replay().
    """
    before = W.partitionBy("meeting_id").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, -1)
    ends = F.col("target_status").isin(*TERMINAL)
    rows = events.withColumn("_rank", F.coalesce(F.max(F.when(~ends, _rank(F.col("target_status")))).over(before), F.lit(0)))
    rows = rows.withColumn("_ok", _may(F.col("_rank"), F.col("target_status")))
    rows = rows.withColumn("_how", F.min(F.when(ends & F.col("_ok"), F.struct("ts", "seq", "target_status"))).over(before)["target_status"])
    state = F.coalesce("_how", lookup(_NAME, F.col("_rank").cast("string")))
    return rows.select("meeting_id", "seq", "ts", state.alias("from_status"), F.col("target_status").alias("to_status"), (F.col("_how").isNull() & F.col("_ok")).alias("accepted"))


def _may(rank: Column, to: Column) -> Column:
    """Whether a meeting of that rank that has not ended may go to a status."""
    return (
        F.when(to == "failed", F.lit(True))
        .when(to == "cancelled", rank < STATUS_RANK["in_progress"])
        .when(to == "completed", rank == STATUS_RANK["processing"])
        .otherwise(F.coalesce(_rank(to) > rank, F.lit(False)))
    )


def moved(status: Column, target: Column) -> tuple[Column, Column, Column]:
    """Whether an event is accepted, whether it reopens the meeting, and the status after it; `reopen` and `stop` included."""
    ended = status.isin(*TERMINAL)
    reopens = (target == "reopen") & (status == "failed")
    stops = (target == "stop") & ~ended & (status != "processing")
    ok = reopens | stops | (~ended & ~target.isin("reopen", "stop") & _may(_rank(status), target))
    to = F.when(reopens, F.lit("processing")).when(stops, stopped(status)).when(ok, target).otherwise(status)
    return ok, reopens, to


def folded(gathered: str, events: DataFrame) -> Column:
    """The rows of replay(), each with the status after it, from a column of a meeting's events (ts, seq, target_status) in
    order; `events` tells their types."""

    def step(s: Column, e: Column) -> Column:
        ok, reopens, to = moved(s["status"], e["target_status"])
        row = F.struct(e["seq"].alias("seq"), e["ts"].alias("ts"), s["status"].alias("from_status"), e["target_status"].alias("to_status"), ok.alias("accepted"), reopens.alias("error_cleared"), to.alias("status"))
        return F.struct(to.alias("status"), F.concat(s["rows"], F.array(row)).alias("rows"))

    kind = events.select("seq", "ts").schema
    none = F.expr(f"cast(array() as array<struct<seq:{kind['seq'].dataType.simpleString()},ts:{kind['ts'].dataType.simpleString()},from_status:string,to_status:string,accepted:boolean,error_cleared:boolean,status:string>>)")
    return F.aggregate(gathered, F.struct(F.lit("queued").alias("status"), none.alias("rows")), step, lambda s: s["rows"])


def replay(events: DataFrame) -> DataFrame:
    """transitions() for events with `reopen`, which takes a failed meeting back to processing, and `stop`, which takes a
    meeting in progress to processing, cancels one before and is nothing to others. Reopening breaks the rise of ranks,
    so a meeting's events are gathered and folded in order, still by built-in functions. error_cleared tells the events
    that drop a meeting's error and its attempts so far. For meetings with more events than a row can hold see
    ranges.replay()."""
    gathered = events.groupBy("meeting_id").agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "target_status"))).alias("e"))
    return gathered.select("meeting_id", F.inline(folded("e", events))).drop("status")


def final(events: DataFrame) -> DataFrame:
    """meeting_id, status after all events, n_events, n_accepted, created_at (the first event), started_at, ended_at,
    completed_at (first entries) and ending, a struct of seq, ts and status of the event that ended the meeting, or null."""
    t = transitions(events)  # a reopening would keep ended_at, as the first entry counts
    when = lambda *s: F.min(F.when(F.col("accepted") & F.col("to_status").isin(*s), F.col("ts")))
    last = F.max(F.when(F.col("accepted"), F.struct("ts", "seq", "to_status")))["to_status"]
    return t.groupBy("meeting_id").agg(
        F.coalesce(last, F.lit("queued")).alias("status"),
        F.count("*").alias("n_events"),
        F.count_if(F.col("accepted")).alias("n_accepted"),
        F.min("ts").alias("created_at"),
        when("in_progress").alias("started_at"),
        when("processing", *TERMINAL).alias("ended_at"),
        when("completed").alias("completed_at"),
        F.min(F.when(F.col("accepted") & F.col("to_status").isin(*TERMINAL), F.struct("seq", "ts", F.col("to_status").alias("status")))).alias("ending"),
    )


def deadline_error(status: Column) -> Column:
    """The error of a meeting that its join deadline finds in this status, or null."""
    return F.when(status == "joining", F.lit("meeting_join_failed")).when(status == "waiting_for_admission", F.lit("waiting_room_timeout"))


def join_deadlines(events: DataFrame, seconds: int = JOIN_DEADLINE_S) -> DataFrame:
    """What the deadline after the first event finds: meeting_id, deadline, status then, error_code (null: nothing to do)."""
    first = F.min("ts").over(W.partitionBy("meeting_id"))
    rows = transitions(events).withColumn("deadline", first + F.expr(f"interval {seconds} seconds"))
    upto = F.max(F.when(F.col("accepted") & (F.col("ts") <= F.col("deadline")), F.struct("ts", "seq", "to_status")))["to_status"]
    out = rows.groupBy("meeting_id", "deadline").agg(F.coalesce(upto, F.lit("queued")).alias("status"))
    return out.withColumn("error_code", deadline_error(F.col("status")))


def starts(tries: DataFrame) -> DataFrame:
    """Tries to send a bot (meeting_id, seq, error_code, http) as far as they are made, each with attempt (from 1), action
    (sent, retry or fail), the wait_ms before a retry and the failure's error_code.

    An outage (a typed one, a 5xx, no status at all) is tried again, three times in all; other errors and a success end it.
    """
    order = W.partitionBy("meeting_id").orderBy("seq")
    code, http = F.col("error_code"), F.col("http")
    sent = code.isNull() & F.coalesce(http.between(200, 299), F.lit(False))
    outage = F.when(code.isNotNull(), code.isin(*RETRYABLE)).otherwise(http.isNull() | (http >= 500))
    rows = tries.withColumns({"attempt": F.row_number().over(order), "_sent": sent, "_again": ~sent & outage})
    over = F.coalesce(F.max(~F.col("_again")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("_over", over).filter(~F.col("_over") & (F.col("attempt") <= MOST_ATTEMPTS))
    retry = F.col("_again") & (F.col("attempt") < MOST_ATTEMPTS)
    action = F.when(F.col("_sent"), F.lit("sent")).when(retry, F.lit("retry")).otherwise(F.lit("fail"))
    return rows.select("meeting_id", "seq", "attempt", action.alias("action"), F.when(retry, start_delay_ms(F.col("attempt"))).alias("wait_ms"), F.when(action == "fail", dispatch_error(code, http)).alias("error_code"))


def stopped(status: Column) -> Column:
    """The status after a stop request."""
    return F.when(status.isin("processing", *TERMINAL), status).when(status == "in_progress", F.lit("processing")).otherwise(F.lit("cancelled"))


def recovered(status: Column, retained: Column) -> Column:
    """struct(status, error_code) after a recover request; only failed meetings with a retained recording reopen."""
    out = lambda s, e=None: F.struct(s.alias("status"), F.lit(e).cast("string").alias("error_code"))
    return F.when(status.isin("completed", "processing"), out(status)).when((status == "failed") & retained, out(F.lit("processing"))).otherwise(out(status, "invalid_request"))
