"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Alternations needed grow with the logarithm of a component's diameter; this many would serve any real input.
MOST_ROUNDS = 60
#: Up to so many edges a round is one task, which spares it all exchanges; beyond, Spark's usual partitions.
TASK_EDGES = 1 << 18


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v) of any ordered type -> (node, component): every node of an edge, and the smallest node it is joined with.

    Each round hangs a node's larger neighbours on its smallest one (large star), then its smaller neighbours and
    itself (small star), until the edges no longer change. A node's minimum comes from a partial aggregate, and the
    join that brings it back can be split by AQE where a star holds a large share of all edges. Rounds are written to
    the shared folder. Null ends and loops are left out; repeated edges don't matter.
    """
    e = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stash(e, name)
    state = _state(e)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        few = e.coalesce(1) if state[0] <= TASK_EDGES else e
        e = stash(_small_star(_large_star(few)), name)
        was, state = state, _state(e)
        if was == state:
            break
    else:
        raise RuntimeError("components did not settle")
    few = e.coalesce(1) if state[0] <= TASK_EDGES else e
    return few.select(_both(("u", "v"), ("v", "v"), names=("node", "component"))).distinct()


def _state(e: DataFrame) -> tuple:
    """What tells whether a set of edges has changed: its size and an order-free checksum."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _both(*pairs: tuple[str, str], names: tuple[str, str] = ("u", "v")):
    """Two rows of a row; unlike a union it leaves the partitioning as it is."""
    return F.inline(F.array(*[F.struct(F.col(a).alias(names[0]), F.col(b).alias(names[1])) for a, b in pairs]))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(_both(("u", "v"), ("v", "u")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(least, "u").select(_both(("v", "m"), ("u", "m"))).filter("u <> v").distinct()
