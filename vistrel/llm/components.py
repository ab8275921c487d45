"""Connected components by alternating large-star and small-star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrel.llm.common import drop_tables, materialise


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    across = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges(a, b): component is the smallest node that can be reached.

    Each step is a join and an aggregation with partial sums, so a node with very many edges is no single task's
    work; the table is written to the shared folder after each round, and the loop ends when a round changes nothing.
    """
    table = materialise(_oriented(edges), "edges")
    before = _digest(table)
    while before[0]:
        following = materialise(_small_star(_large_star(table)), "edges")
        drop_tables(table)
        table, after = following, _digest(following)
        if after == before:
            break
        before = after
    return table.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
