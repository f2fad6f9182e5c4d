"""Connected components by alternating star contractions; nothing meets at the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shinglery.llm.common import discard, written


def _star(edges: DataFrame, large: bool, made: list[DataFrame]) -> DataFrame:
    """Links the neighbours of each node to the least of them and the node itself.

    large: those above the node; else those below it, and the node. Minima are aggregated and written
    before the join: between two plain exchanges a hub's edges are a skewed join, which adaptive
    execution splits, while an aggregate under the join would bind it to the node's partition.
    """
    seen = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        seen = seen.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = written(seen.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), "minima")
    made.append(least)
    met = seen.join(least, F.col("u") == F.col("n"))
    out = met.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if large else met.select("m", F.explode(F.array("u", "v")).alias("b")).select(F.col("m").alias("a"), "b")
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """`(node, root)` of every node of an edge, root being the component's least; edges: `(a, b)` of one type
    that has an order. Nulls and loops are no edges. The tables of a round go when the next one stands;
    the last one goes with `discard`."""
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        made = [now]
        now = written(_star(_star(now, True, made), False, made), "edges")
        discard(*made)
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if mark == was:
            break
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    out = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    out.shared_path = now.shared_path
    return out
