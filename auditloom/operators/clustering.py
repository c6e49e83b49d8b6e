"""Clustering of failed sessions and the report on it."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.embedding import nearest
from auditloom.session import cut_lineage

# Statuses that count as failures, and themes with the words that decide them, in order.
FAILURE_STATUSES = ["correction", "abandoned", "failed"]
THEMES = [
    ("API Rate Limiting & Quota Exceeded", r"\b(rate|429)\b"),
    ("AST Sandbox Gating & Syntax Blocks", r"\b(gating|eval)\b"),
    ("Indirect Prompt Injections & Context Hijacks", r"\b(injection|payload)\b"),
]
OTHER_THEME = "General System Anomaly"

Vectors = list[list[float]]


def failure_filter(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("status").isin(FAILURE_STATUSES))


def initial_centroids(df: DataFrame, vector: str, id_column: str, ids: list) -> Vectors:
    """The vectors of the given rows, in the order of ``ids``; ``len(ids)`` rows reach the driver."""
    rows = df.filter(F.col(id_column).isin(ids)).select(id_column, vector).collect()
    found = {row[0]: [float(x) for x in row[1]] for row in rows}
    return [found[i] for i in ids if i in found]


def nearest_centroid(df: DataFrame, vector: str, centroids: Vectors) -> DataFrame:
    """Add ``cluster`` and ``dist``. Centroids are literals: k times the dimension, whatever the data."""
    return df.withColumn("__near", nearest(vector, centroids)).withColumns(
        # Never NULL, so that no null test is pushed down to compute the distances again.
        {"cluster": F.coalesce("__near.cluster", F.lit(0)), "dist": F.col("__near.dist")}
    ).drop("__near")


def kmeans_update(assigned: DataFrame, vector: str) -> DataFrame:
    """Mean vector per cluster as ``(cluster, centroid, members)``; an empty cluster has no row.

    One vector aggregate, combined before the shuffle: k rows per task cross it, and no row is
    multiplied by the dimension.
    """
    points = assigned.select("cluster", array_to_vector(F.col(vector).cast("array<double>")).alias("__point"))
    return points.groupBy("cluster").agg(
        vector_to_array(Summarizer.mean(F.col("__point"))).alias("centroid"), F.count(F.lit(1)).alias("members")
    )


class KMeansFit(NamedTuple):
    assigned: DataFrame
    centroids: Vectors
    converged: bool
    shift: float


def kmeans_fit(
    df: DataFrame, vector: str, centroids: Vectors, max_iters: int | None = None, tolerance: float = 1e-9
) -> KMeansFit:
    """Lloyd's algorithm from explicit centroids.

    Runs until no centroid moves by more than ``tolerance``; with ``max_iters`` it may stop before, which ``converged`` and
    ``shift`` (the last move) tell. Only the k centroids reach the driver. The default tolerance absorbs the summation order
    of a shuffle; 0 asks for exact equality.
    """
    points = df.select(vector).persist()
    current = [list(c) for c in centroids]
    shift, rounds = math.inf, 0
    while shift > tolerance and (max_iters is None or rounds < max_iters):
        rounds += 1
        assigned = nearest_centroid(points, vector, current)
        means = {r["cluster"]: list(r["centroid"]) for r in kmeans_update(assigned, vector).collect()}
        moved = [means.get(i, old) for i, old in enumerate(current)]
        shift = max((abs(a - b) for new, old in zip(moved, current) for a, b in zip(new, old)), default=0.0)
        if shift > tolerance:
            current = moved
    points.unpersist()
    return KMeansFit(nearest_centroid(df, vector, current), current, shift <= tolerance, shift)


def cluster_theme(assigned: DataFrame, text: str = "text") -> DataFrame:
    """Theme of each cluster. Every pattern is one word, so testing rows equals testing their join."""
    found = [F.bool_or(F.lower(text).rlike(pattern)).alias(f"t{i}") for i, (_, pattern) in enumerate(THEMES)]
    theme = F.lit(OTHER_THEME)
    for i in reversed(range(len(THEMES))):
        theme = F.when(F.col(f"t{i}"), THEMES[i][0]).otherwise(theme)
    return assigned.groupBy("cluster").agg(*found).select("cluster", theme.alias("theme"))


def cluster_members(assigned: DataFrame, k: int, member: str = "session_id") -> DataFrame:
    """Members as rows; a requested cluster without members has one row with a NULL member.

    Rows instead of one list per cluster: a cluster may hold most of the data. The assignment is computed once and
    checkpointed.
    """
    assigned = cut_lineage(assigned.select("cluster", member))
    filled = assigned.select("cluster").distinct()
    wanted = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    empty = wanted.join(filled, "cluster", "left_anti").withColumn(
        member, F.lit(None).cast(assigned.schema[member].dataType)
    )
    return assigned.select("cluster", member).unionByName(empty)


def cluster_report(assigned: DataFrame, k: int, order: str = "session_id") -> DataFrame:
    """Markdown report as ordered lines ``(cluster, block, item, line)``.

    Expects ``session_id, status, text, cluster``. Sorting by the first three gives the document. The assignment is computed
    once and checkpointed; themes, titles and members read it.
    """
    spark = assigned.sparkSession
    assigned = cut_lineage(assigned.select(*dict.fromkeys(["session_id", "status", "text", "cluster", order])))
    themes = cluster_theme(assigned)
    wanted = spark.range(k).select(F.col("id").cast("int").alias("cluster"))
    head = spark.createDataFrame(
        [
            (-1, 0, "1", "# Failure Mode Clustering Report"),
            (-1, 0, "2", ""),
            (-1, 0, "3", "Systematically grouped tracing errors and user corrections."),
            (-1, 0, "4", ""),
        ],
        "cluster INT, block INT, item STRING, line STRING",
    )
    title = F.concat(F.lit("## Cluster "), F.col("cluster").cast("string"))
    filled = F.array(
        title,
        F.concat(F.lit("**Identified Theme**: "), F.col("theme")),
        F.lit(""),
        F.lit("| Session ID | Status | Failure Details |"),
        F.lit("|---|---|---|"),
    )
    nothing = F.array(title, F.lit("No items in this cluster."), F.lit(""))
    sections = (
        wanted.join(themes, "cluster", "left")
        .select("cluster", F.posexplode(F.when(F.col("theme").isNull(), nothing).otherwise(filled)).alias("i", "line"))
        .select("cluster", F.lit(0).alias("block"), F.col("i").cast("string").alias("item"), "line")
    )
    members = assigned.select(
        "cluster",
        F.lit(1).alias("block"),
        F.col(order).cast("string").alias("item"),
        F.format_string("| `%s` | **%s** | %s |", "session_id", F.upper("status"), "text").alias("line"),
    )
    tail = themes.select("cluster", F.lit(2).alias("block"), F.lit("").alias("item"), F.lit("").alias("line"))
    return head.unionByName(sections).unionByName(members).unionByName(tail)
