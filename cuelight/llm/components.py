"""Connected components of a distributed edge table by contraction.

Every vertex is hooked to its smallest neighbour, chains of hooks are shortened, and the edges are rewritten to what the
vertices were hooked to, until no edge is left. A vertex that has a smaller neighbour leaves the edges in its round, and
chains of hooks are shortened, so that long paths take few rounds; a hub with many smaller neighbours takes one hook a
round, but those neighbours then are neighbours of what it was hooked to. All
steps are joins and partial aggregations; vertices with very many edges are split by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.store import Scratch

#: Times that chains of hooks are halved in a round.
JUMPS = 2


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b: long) -> (key, component): the smallest key that can be reached, of all keys with an edge."""
    ordered = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    open_edges = scratch.table(ordered.distinct(), "edges")
    found = None
    while not open_edges.isEmpty():
        hooks = scratch.table(open_edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")), "hooks")
        for _ in range(JUMPS):
            up = hooks.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            hooks = scratch.table(hooks.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")), "hooks")
        of_a, of_b = hooks.select(F.col("v").alias("a"), F.col("p").alias("pa")), hooks.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = open_edges.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
        nxt = scratch.table(moved.filter(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        # Whatever was hooked to a vertex that has now been hooked itself follows it.
        if found is None:
            found = hooks
        else:
            later = hooks.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            moved_on = found.join(later, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
            found = scratch.table(moved_on.unionByName(hooks.join(found.select("v"), "v", "left_anti")), "found")
        open_edges = nxt
    if found is None:
        return open_edges.select(F.col("a").alias("key"), F.col("b").alias("component"))
    roots = found.select(F.col("p").alias("v")).distinct()
    return scratch.table(found.unionByName(roots.select("v", F.col("v").alias("p")).join(found.select("v"), "v", "left_anti")).select(F.col("v").alias("key"), F.col("p").alias("component")), "components")
