"""Connected components by alternating large-star and small-star rounds.

Each round is a grouped minimum and a join on the node; hubs are pre-aggregated
before the shuffle and the join may split them. Each round's edges are a table
in the shared folder, deleted when the next one's are written; rounds end when
the edges no longer change. No node, link or label meets the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop, table


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """large: neighbours above a node are linked to the least around it; small: those up to it, itself included. The edges' table is deleted."""
    # the minima are written out, so that both sides of the join come straight from a shuffle and a hub's side can be split
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        # edges run from the higher node a to the lower b
        least = table(edges.groupBy("a").agg(F.min("b").alias("m")), "minima")
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = table(moved.where("a > b").distinct(), "edges")
    drop(edges, least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of edges (a, b longs) with the least node it is connected to."""
    now = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    seen = None
    while True:
        now = _round(_round(now, True), False)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    # all edges now lead to the least node of their component
    out = now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    out._textloom_table = now._textloom_table  # for drop()
    return out
