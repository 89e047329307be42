"""Connected components of a link table by alternating large and small stars, all in joins and aggregates.

Defined results: an empty table gives no rows; links of an id with itself, repeated ones and their direction count for
nothing; a null end must not occur. The rounds grow with the logarithm of the longest chain; should `most` rounds not
do, the call fails rather than give components that are too small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, reading


def _canonical(edges: DataFrame) -> DataFrame:
    """Distinct links without loops, the greater id first."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Link what each node links to its least neighbour: all greater neighbours (both), or all lesser ones."""
    arcs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    # a minimum by hash aggregate and a join, not a window: adaptive execution splits the join where a hub has many links
    least = arcs.groupBy("a").agg(F.min("b").alias("m"))
    joined = arcs.join(least, "a")
    if both:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id and component (its least id) of every id that has a link; edges: a and b, of like type."""
    state = materialize(_canonical(edges), "links")
    mark = None
    for _ in range(most):
        found = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if found == mark or not found[0]:
            break
        mark, before = found, state
        state = materialize(_canonical(_star(_canonical(_star(state, True)), False)), "links")
        discard(before)
    else:
        raise RuntimeError(f"the components have not settled after {most} rounds")
    own = state.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return reading(own.unionByName(state.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), state)
