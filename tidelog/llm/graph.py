"""Connected components by randomised contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a long, b long); two nodes share a root iff linked.

    Each round points every node at the neighbour (or itself) of least random priority and
    contracts; the expected number of nodes falls by a constant factor a round, whatever the
    shape, so the rounds grow with the logarithm of the longest chain. A hub costs one
    partially aggregated minimum, never a collected neighbour list. Loops, repeated edges and
    null ends (ignored) are allowed; an empty table gives an empty table.
    """
    a, b = F.col("a"), F.col("b")
    edges = edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    current = common.materialize(edges, "edges")
    steps: list[DataFrame] = []
    while not current.isEmpty():
        def priority(x, seed=len(steps)):
            return F.struct(F.xxhash64(x, F.lit(seed)).alias("p"), x.alias("id"))

        both = current.union(current.select("b", "a"))
        step = both.groupBy("a").agg(F.min(priority(b)).alias("best")).select(F.col("a").alias("node"), F.least(F.col("best"), priority(a))["id"].alias("to"))
        step = common.materialize(step, "step")
        steps.append(step)
        ends = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = current.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(ends, "b")
        ta, tb = F.col("ta"), F.col("tb")
        current = common.materialize(moved.where(ta != tb).select(F.least(ta, tb).alias("a"), F.greatest(ta, tb).alias("b")).distinct(), "edges")
    if not steps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps.pop()
    while steps:
        later = roots.select(F.col("node").alias("to"), F.col("to").alias("last"))
        roots = steps.pop().join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    return roots.select("node", F.col("to").alias("root"))
