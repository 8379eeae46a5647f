"""Every registered query of the engine against its DuckDB form on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from palaver.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(float(v))
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = table(df.columns, df.collect())
    assert got[1]
    if name in SQL:
        cur = duck.execute(SQL[name])
        assert got == table([c[0] for c in cur.description], cur.fetchall())


def test_turns_need_one_exchange(spark):
    """The windows from deduplication to turns share one exchange by meeting, after that of the derived view."""
    plan = registry.queries()["turns"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(meeting_id") <= 2


@pytest.mark.parametrize("name", ["turns_eligible", "turn_stats", "result_merge"])
def test_turns_are_derived_once(spark, name):
    """Their windows appear once in the plan, and the stored conversations are read once for them."""
    whole = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    turns = registry.queries()["turns"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    windows = lambda plan: sum(line.lstrip(" :+-").startswith("Window ") for line in plan.splitlines())
    assert windows(whole) <= windows(turns) + 2


@pytest.mark.parametrize("name", ["webhook_events", "webhook_outbox", "webhook_signatures", "delivery_secret_join", "meeting_view", "transcript_view", "tenant_lookup", "delete_cascade"])
def test_lifecycles_are_derived_once(spark, name):
    """At most the windows of one derivation are in the plan; where meetings are read more than once they are written before."""
    plan = lambda q: registry.queries()[q](spark, SF)._jdf.queryExecution().executedPlan().toString()
    windows = lambda p: sum(line.lstrip(" :+-").startswith("Window ") for line in p.splitlines())
    assert windows(plan(name)) <= (windows(plan("lifecycle_final")) if name == "webhook_events" else 0)
