"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourlens.llm.shared import drop, written


def _pairs(df: DataFrame) -> DataFrame:
    """Distinct edges with the larger node first, without loops."""
    return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b: long): the smallest node that each can reach.

    Large-star ties every larger neighbour of a node to the smallest node
    around it, small-star every smaller one; both keep what is connected, and
    when nothing changes each node is tied to its component's smallest. A
    node's neighbours are never gathered: minima are aggregated and joined to
    the edges, where Spark can split a hot node. Every step is written to the
    shared folder. Null ends and loops are left out; no edges give no rows.
    """
    now = written(_pairs(edges.where("a IS NOT NULL AND b IS NOT NULL")), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("b", "a"))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = written(_pairs(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))),
                        "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        after = written(_pairs(small), "edges")
        new = _mark(after)
        for old in (now, least, large, low):
            drop(old)
        now, same, mark = after, new == mark, new
        if same:
            break
    tied = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tied.union(now.select("b", "b").distinct())
