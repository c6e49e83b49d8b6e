"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v) with u > v: neighbours are linked to the smallest one around instead."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = around.join(least, "u")
    if large:
        moved = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links between longs -> (node, root): every linked node with the smallest node it can reach.

    Loops, repeated links and nulls are dropped. A hub's neighbours are never gathered: its minimum is aggregated before the
    shuffle and joined back. Each round is written to the shared folder.
    """
    edges = links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "links")
    mark = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = tuple(state)
        edges = stored(_star(_star(edges, True), False), "links")
