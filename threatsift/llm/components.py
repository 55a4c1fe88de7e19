"""Connected components of an edge table, as joins and aggregations.

Every round sends each node to the neighbour (or itself) that comes first in a
random but fixed order, contracts the edges along these steps and drops loops
and repetitions. A fixed random order contracts paths and stars alike, so the
edges shrink by a constant factor per round and a handful of rounds suffice.
Every round's tables are written to the shared folder, so a lost executor never
repeats earlier rounds. No component is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatsift.llm.common import release, staged


def _order(node: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(11), node).alias("h"), node.alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every node of ``edges`` (columns a, b, long) the
    smallest node reachable from it. Loops, repeated edges and both directions
    are allowed; an empty table gives an empty result."""
    current = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                     "cc-edges")
    steps: list[DataFrame] = []
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = staged(both.groupBy("a").agg(F.min(_order(F.col("b"))).alias("_m"))
                      .select(F.col("a").alias("id"), F.least(F.col("_m"), _order(F.col("a")))["n"].alias("to")), "cc-step")
        steps.append(step)
        moved = (current.join(step.select(F.col("id").alias("a"), F.col("to").alias("a2")), "a")
                 .join(step.select(F.col("id").alias("b"), F.col("to").alias("b2")), "b"))
        before, current = current, staged(moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
                         .distinct(), "cc-edges")
        release(before)
    if not steps:
        return current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    at = steps[-1]
    for earlier in reversed(steps[:-1]):       # follow the steps from the last round back to the first
        nxt = at.select(F.col("id").alias("to"), F.col("to").alias("_end"))
        at = earlier.join(nxt, "to", "left").select("id", F.coalesce("_end", "to").alias("to"))
    at = staged(at, "cc-ends")
    release(current, *steps)
    smallest = at.groupBy("to").agg(F.min("id").alias("component"))
    return at.join(smallest, "to").select("id", "component")
