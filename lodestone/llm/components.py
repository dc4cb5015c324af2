"""Connected components of an edge table, in the shared folder round by round.

Alternates the large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014).  Minima are taken with partial
aggregation and joined back, so that a node with very many neighbours is an
ordinary skewed join, which adaptive execution splits; no component, link list
or neighbour list is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v).  large: all neighbours of u, keep those above
    u; small: edges hold u > v, the neighbours of u below it and u itself."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = edges.join(low, "u")
    if large:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v")


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads to its component's smallest id: no id has two edges
    down, or one down and one up."""
    down, up = edges.selectExpr("u as id", "1 as down", "0 as up"), edges.selectExpr("v as id", "0 as down", "1 as up")
    ends = down.unionByName(up).groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.filter("down + up > 1 and down > 0").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) of every end of an edge, as a written table; comp is the smallest
    id reachable.  Loops and repeated edges do no harm."""
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        after = materialize(_star(_star(both, True), False).distinct(), "edges")
        discard(now)
        now = after
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    out = materialize(now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots), "components")
    discard(now)
    return out
