"""Connected components as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, settle

#: Each round at least halves what is left of a path, so this is beyond any table's need.
ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that can be reached.

    Alternating large-star and small-star steps, each a grouped minimum and a join, so no component meets in one task. The
    number of rounds grows with the logarithm of the longest path; a round's edges go to the shared folder and the last
    round's are deleted. Edges with a null end and loops are left out; no edges give no rows.
    """
    edges = settle(edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    mark = None
    for _ in range(ROUNDS):
        seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            return edges.selectExpr("a node", "b component").unionByName(edges.selectExpr("b node", "b component").distinct())
        mark = seen
        both = edges.unionByName(edges.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        large = both.where("b > a").join(least, "a").selectExpr("b a", "m b")
        down = large.where("a <> b").distinct()
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").selectExpr("case when b = m then a else b end a", "m b").where("a <> b")
        old, edges = edges, settle(small.distinct(), "edges")
        drop(old)
    raise RuntimeError("components did not settle")
