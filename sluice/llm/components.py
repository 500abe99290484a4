"""Connected components by alternating star contractions, all rounds as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluice.llm.common import hold


def components(links: DataFrame, left: str, right: str, purpose: str = "components") -> DataFrame:
    """``(node, root)`` for every node of the links; the root is the component's smallest node.

    Each round ties every node's larger neighbours to its smallest one, then each node's smaller
    neighbours to the smallest of them. The number of rounds grows with the logarithm of the
    longest chain. A node with a third of all links is pre-aggregated in each task for its minimum
    and joined by a sort-merge join that adaptive execution may split. Rounds are written to the
    shared folder, so no lineage builds up and no executor's disk is needed.
    """
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    edges = hold(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), purpose)
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = hold(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), purpose)
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(lowest, "u").select("v", "m")  # v is the larger end
        large = hold(large.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), purpose)
        lowest = hold(large.groupBy("u").agg(F.min("v").alias("m")), purpose)
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = hold(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), purpose)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number and checksums of the links: equal marks mean that a round changed nothing."""
    one = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(one), F.sum(one.cast("decimal(38,0)"))).first())
