"""Connected components of an edge table, by alternating large and small stars.

Every round is a grouped minimum, written as a table of its own, and a join with it on the same key, so
that adaptive execution can split the join of a node with very many edges; rounds grow with the logarithm of the number of nodes.  Each round's edges are
written to the shared folder, and only their count and checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import written

c = F.col


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(c("v").alias("u"), c("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("_kt_m")).select("u", F.least("u", "_kt_m").alias("_kt_m")), "least")
    return both.join(least, "u").filter("v > u").select(c("v").alias("u"), c("_kt_m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = written(edges.groupBy("u").agg(F.min("v").alias("_kt_m")), "least")
    moved = edges.join(least, "u").filter("v <> _kt_m").select(c("v").alias("u"), c("_kt_m").alias("v"))
    kept = least.select("u", c("_kt_m").alias("v"))
    return kept.unionByName(moved.filter("u > v")).unionByName(moved.filter("u < v").select(c("v").alias("u"), c("u").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``u, v`` that has an edge to another; the root is the smallest node."""
    ordered = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(ordered, "edges")
    state = _state(now)
    while state[0]:
        now = written(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(c("v").alias("node"), c("v").alias("root")).distinct()
    return now.select(c("u").alias("node"), c("v").alias("root")).unionByName(roots)
