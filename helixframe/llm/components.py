"""Connected components by alternating large-star and small-star steps on DataFrames.

Every step sends a node's neighbours to the smallest of them, so the edge count
never grows and long chains shrink fast. A step is an aggregation with map-side
minimum and a join whose other side has one row per node; nodes with very many
neighbours, of which there can only be so many, are broadcast. Each round is
written to the shared folder; nothing is collected but one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shared import drop_staged, split_join, staged


def _met(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``rows`` with their node's ``m``; a node with very many neighbours stays where it is."""
    return split_join(rows, low, ["u"], "n", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _met(both.where("v > u"), low, total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _met(down, low, total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that isn't the smallest of its component; self-links and nulls are ignored.

    Nodes are of any type with an order, structs of ids too.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b))
    now = staged(pairs.distinct(), "edges", edges.count())
    while not _is_forest_of_stars(now):
        then, total = now, now.count()
        middle = staged(_large_star(then, total), "edges", total)
        now = staged(_small_star(middle, total), "edges", total)
        drop_staged(edges.sparkSession, then, middle)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one centre and no centre has another."""
    if not edges.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
