"""Connected components of an edge table, by large-star and small-star rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, written


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """edges (a, b): one row (node, component) for each node that has an edge; component is its least reachable node.

    Each round hangs every node's larger neighbours, then all of its neighbours, on the least of
    them. No neighbour list is ever gathered: a round is grouped minima (summed before the shuffle)
    and joins; minima are written before they are joined back, so that the joins can split hot keys.
    It ends when a round changes nothing.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = written(now, f"{name}-0")
    mark = _mark(now)
    for i in range(1, rounds + 1):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-{i}m")
        large = both.filter("v > u").join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, f"{name}-{i}a")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{i}n")
        discard(first)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = written(small.filter("u <> v").distinct(), f"{name}-{i}b")
        discard(now, large, least)
        now, new = new, _mark(new)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]
