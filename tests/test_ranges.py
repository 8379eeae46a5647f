"""Meetings that spread over several ranges against the same operators with a meeting in one task."""

from __future__ import annotations

import random

import numpy as np
import pytest
from palaver.functions.lookups import STATUS_RANK
from palaver.operators import lifecycle, ranges, segments, transcripts
from pyspark.sql import functions as F

COLUMNS = "meeting_id long, ord long, speaker string, text string, language string, completed boolean, segment_id string, start double, end double, start_time double"


def rows(seed: int, n: int, speakers: int):
    """Segments of one large meeting, a small one and one without an id: drafts, repeats, ties, overlaps, pauses, nulls."""
    r, out, at = random.Random(seed), [], 0.0
    for k in range(n):
        at += r.choice([0.0, 0.0, 0.3, 0.7, 0.75, 1.5])
        who = r.choice([None, " ", *[f"s{i}" for i in range(speakers)]]) if r.random() < 0.3 or not out else out[-1][2]
        sid = r.choice([None, "", f"turn:{r.randrange(n // 3)}:{r.choice(['', 'p'])}{r.randrange(2)}", f"other{r.randrange(n)}"])
        end = r.choice([at, at + 0.5, at + 2, at + 9, float("nan"), at - 1, None])
        meeting = r.choice([1, 1, 1, 1, 1, 1, 1, 2, None])
        out.append((meeting, k, who, r.choice([None, " ", f"word{k}"]), r.choice([None, "", "de"]), r.choice([None, True, True, False]), sid, 1000 + at, None if end is None else 1000 + end, r.choice([None, 999.5])))
    return out


@pytest.fixture
def split(spark):
    """A session whose ranges stay apart, so that the meeting lies in several of them."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def plain(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.mark.parametrize(("seed", "n", "speakers"), [(1, 300, 2), (2, 300, 1), (3, 90, 5), (4, 12, 1)])
def test_ranges_give_what_one_task_gives(split, seed, n, speakers):
    raw = split.createDataFrame(rows(seed, n, speakers), COLUMNS).cache()
    whole, parts = segments.dedupe(raw).cache(), ranges.dedupe(raw).cache()
    assert plain(parts.select(whole.columns)) == plain(whole)
    whole, parts = segments.rebase(whole).cache(), ranges.rebase(parts).cache()
    assert plain(parts.select(whole.columns)) == plain(whole)
    assert plain(ranges.merge_turns(parts)) == plain(segments.merge_turns(whole))
    assert plain(ranges.normalize(parts)) == plain(transcripts.normalize(whole))


def test_a_run_over_many_ranges_is_stitched(split):
    """One speaker whose first segment outlasts several ranges, then a pause longer than the gap."""
    said = [(1, 0, "a", "w0", None, True, None, 0.0, 400.0, None)] + [(1, k, "a", f"w{k}", None, True, None, float(k), k + 0.1, None) for k in range(1, 300)] + [(1, 300, "a", "late", None, True, None, 400.8, 401.0, None)]
    t = ranges.merge_turns(split.createDataFrame(said, COLUMNS).withColumn("pos", F.col("ord"))).orderBy("turn_no").collect()
    assert [(r["turn_no"], r["start"], r["end"], len(r["text"].split())) for r in t] == [(0, 0.0, 400.0, 300), (1, 400.8, 401.0, 1)]


def test_a_meeting_lies_in_several_tasks(split):
    raw = split.createDataFrame(rows(5, 400, 2), COLUMNS)
    dealt = ranges.dealt(segments.spoken(raw.withColumn("pos", F.col("ord"))), [F.col("meeting_id").asc_nulls_first(), F.col("start"), F.col("end"), F.col("pos")])
    assert dealt.filter("meeting_id = 1").select("_part").distinct().count() > 3


def test_empty_tables(split):
    none = split.createDataFrame([], COLUMNS)
    d = ranges.rebase(ranges.dedupe(none))
    assert ranges.merge_turns(d).count() == 0 and ranges.normalize(d).count() == 0


EVENTS = "meeting_id long, seq long, ts long, target_status string"


def events(seed: int, n: int) -> list[tuple]:
    """Events of one large meeting, small ones and one without an id: ties, repeats, unknown statuses, nulls in every column."""
    r = random.Random(seed)
    kinds = [*STATUS_RANK, "reopen", "reopen", "stop", "failed", "paused", None]
    out = [(r.choice([5] * 9 + [1, 6, None]), r.choice([k, 3, None]), r.choice([k // 3, None]), r.choice(kinds)) for k in range(n)]
    return out + out[-2:]


@pytest.mark.parametrize(("seed", "n"), [(1, 400), (2, 400), (3, 60), (4, 5)])
def test_lifecycles_over_ranges_are_those_of_a_fold(split, seed, n):
    e = split.createDataFrame(events(seed, n), EVENTS).cache()
    want = plain(lifecycle.replay(e))
    assert len(want) == n + 2 and plain(ranges.replay(e)) == want
    wide = e.withColumns({c: F.lit("x") for c in ("_part", "_at", "_code", "status", "from_status")})
    assert plain(ranges.replay(wide)) == want


def test_a_status_carries_over_ranges_that_change_nothing(split):
    """In progress from the first event on, nothing for hundreds, then stopped; a second meeting begins anew in the last range."""
    e = [(1, 0, 0, "in_progress"), *[(1, k, k, "joining") for k in range(1, 500)], (1, 500, 500, "stop"), (1, 501, 501, "completed"), (2, 0, 0, "stop")]
    got = {(r["meeting_id"], r["seq"]): r for r in ranges.replay(split.createDataFrame(e, EVENTS)).collect()}
    assert len(got) == 503 and not any(got[1, k]["accepted"] for k in range(1, 500))
    assert [(got[k]["from_status"], got[k]["accepted"]) for k in ((1, 500), (1, 501), (2, 0))] == [("in_progress", True), ("processing", True), ("queued", True)]


def test_composition_against_a_loop():
    r = np.random.default_rng(1)
    moves, codes, opens = r.integers(0, 5, (4, 5)), r.integers(0, 4, 999), r.random(999) < 0.01
    before, after = ranges._before(moves, codes, opens, np.arange(5))
    for s in range(5):
        now = s
        for i in range(999):
            now = 0 if opens[i] else now
            assert before[i, s] == now
            now = moves[codes[i], now]
        assert after[s] == now


def test_no_events(split):
    assert ranges.replay(split.createDataFrame([], EVENTS)).count() == 0
