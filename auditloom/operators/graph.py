"""Import and call edges between repositories, and reach along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.arrays import explode_once
from auditloom.operators.scan import base_name
from auditloom.session import cut_lineage

# How definitions, calls and imports are recognised in Python text; letters of all scripts count.
DEFINITION = r"(?U)\bdef\s+(\w+)\s*\("
CALL = r"(?U)\b(\w+)\s*\("
# The name is read ahead, so that ``from import x`` yields both words.
IMPORT = r"(?U)\b(?:import|from)\s+(?=([\w.\-]+))"


def python_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path").endswith(".py"))


def function_defs(files: DataFrame) -> DataFrame:
    """Every definition occurrence; repeated names stay."""
    found = F.regexp_extract_all("content", F.lit(DEFINITION), 1)
    return explode_once(python_files(files), ["repo", "path"], found, "func")


def call_tokens(files: DataFrame) -> DataFrame:
    """Distinct call-shaped names of each file."""
    tokens = F.array_distinct(F.regexp_extract_all("content", F.lit(CALL), 1))
    return explode_once(python_files(files), ["repo", "path"], tokens, "func")


def imported_names(files: DataFrame) -> DataFrame:
    """Distinct names of each file after ``import`` or ``from``, with every prefix that ends at a word boundary.

    ``import a-b.c`` names ``a``, ``a-b`` and ``a-b.c``.
    """
    def prefixes(written: Column) -> Column:
        pieces = F.regexp_extract_all(written, F.lit(r"(?U)\w+|[^\w]+"), F.lit(0))
        steps = F.sequence(F.lit(1), F.size(pieces))
        return F.filter(
            F.transform(steps, lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "")), lambda p: p.rlike(r"(?U)\w$")
        )

    written = F.array_distinct(F.regexp_extract_all("content", F.lit(IMPORT), 1))
    names = F.array_distinct(F.flatten(F.transform(written, prefixes)))
    return explode_once(python_files(files), ["repo", "path"], names, "name")


def repositories(files: DataFrame) -> DataFrame:
    return files.select("repo").distinct()


def repo_import_edges(files: DataFrame) -> DataFrame:
    """At most one edge per file and imported sibling repository."""
    targets = repositories(files).withColumnRenamed("repo", "target")
    return (
        imported_names(files)
        .join(targets, F.col("name") == F.col("target"))
        .filter(F.col("repo") != F.col("target"))
        .select(
            F.format_string("Repository(%s)", "repo").alias("source_node"),
            F.format_string("Repository(%s)", "target").alias("target_node"),
            F.lit("DEPENDS_ON").alias("edge_type"),
            F.format_string(
                "File '%s' in repository '%s' imports repository '%s'.", base_name(F.col("path")), "repo", "target"
            ).alias("details"),
            F.col("repo").alias("source_repo"),
            F.col("target").alias("target_repo"),
            "path",
        )
    )


def definitions_per_repo(files: DataFrame) -> DataFrame:
    """How often each repository defines each name; counted before the shuffle."""
    return function_defs(files).groupBy("repo", "func").agg(F.count(F.lit(1)).alias("definitions"))


def cross_repo_call_edges(files: DataFrame, repeat: bool = False) -> DataFrame:
    """Call edges from a file to each other repository that defines the name.

    Definitions are counted per (repository, name) before the join, so a name defined a million
    times in one repository is one row of the join with ``definitions = 1000000``. ``repeat=True``
    expands the count into one row per definition occurrence.
    """
    defined = definitions_per_repo(files).select(
        F.col("repo").alias("target"), F.col("func"), "definitions"
    )
    edges = (
        call_tokens(files)
        .join(defined, "func")
        .filter(F.col("repo") != F.col("target"))
        .select(
            F.format_string("Function(%s.%s:%s)", "repo", base_name(F.col("path")), "func").alias("source_node"),
            F.format_string("Function(%s:%s)", "target", "func").alias("target_node"),
            F.lit("CALLS").alias("edge_type"),
            F.format_string(
                "Function call to '%s' maps across repositories from '%s' to '%s'.", "func", "repo", "target"
            ).alias("details"),
            F.col("repo").alias("source_repo"),
            F.col("target").alias("target_repo"),
            "path",
            "definitions",
        )
    )
    if not repeat:
        return edges
    return edges.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("definitions")))).drop(
        "__n", "definitions"
    )


class DepthExceeded(RuntimeError):
    pass


def callgraph_reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes reached from ``seeds`` along ``edges(source, target)``, with their least depth.

    Runs until no new node is found. A ``max_depth`` that stops it earlier raises ``DepthExceeded``.

    Breadth first: each round joins only the new nodes to the edges. The visited set and the
    frontier are checkpointed, so a lost executor does not replay the rounds before.
    """
    steps = cut_lineage(edges.select("source", "target").distinct())
    visited = seeds.select(F.col("node"), F.lit(0).alias("depth")).distinct()
    frontier = visited
    depth = 0
    while True:
        depth += 1
        reached = (
            frontier.select("node")
            .join(steps, F.col("node") == F.col("source"))
            .select(F.col("target").alias("node"))
            .distinct()
        )
        frontier = cut_lineage(
            reached.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth))
        )
        if frontier.isEmpty():
            return visited
        if max_depth is not None and depth > max_depth:
            raise DepthExceeded(f"nodes beyond depth {max_depth}")
        visited = visited.unionByName(frontier)


def _least(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.min("depth").alias("depth"))


def deep_reach(edges: DataFrame, seeds: DataFrame, joins_a_job: int = 8) -> DataFrame:
    """``callgraph_reach`` for graphs with long chains and cycles: the same nodes and least depths, in fewer jobs.

    Where a node has one successor the way on is forced. Tables of jumps over 2, 4, 8, ... forced steps are made by joining
    each with itself, until the longest forced path is spanned; with them a frontier reaches all nodes of its paths in as
    many joins as the path's length has binary digits. A round then crosses one branching. Depths found early over a long
    path are lowered when a shorter one with more branchings turns up, and what hangs on them is walked again.

    Rounds therefore grow with the branchings on a path, joins in a round with the logarithm of the longest chain. The jumps
    take a row a node and power of two below its chain's length. Null nodes have no edges.
    """
    steps = edges.select("source", "target").filter("source IS NOT NULL AND target IS NOT NULL AND source <> target").distinct()
    counted = cut_lineage(steps.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("to")))
    branches = cut_lineage(steps.join(counted.filter("n > 1").select("source"), "source", "left_semi"))
    jump = cut_lineage(counted.filter("n = 1").select(F.col("source").alias("node"), "to"))
    forced, jumps = jump.count(), []
    while forced and not jump.isEmpty():
        jumps.append(jump)
        if 2 ** len(jumps) > forced:  # even a cycle is spanned
            break
        onward = jump.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jump = cut_lineage(jump.join(onward.hint("merge"), "to").select("node", F.col("next").alias("to")))
    visited = cut_lineage(seeds.filter("node IS NOT NULL").select("node", F.lit(0).cast("long").alias("depth")).distinct())
    frontier = visited
    while not frontier.isEmpty():
        spread = frontier
        for k in range(len(jumps) - 1, -1, -1):
            # a plan that grows by one join a step: a union with the joined rows would hold what is before it twice.
            # Never a broadcast of the jumps, which look small as files: the driver would hold a table of all nodes for each.
            ways = spread.join(jumps[k].hint("merge"), "node", "left").select(
                F.explode(F.expr(f"array(struct(node, depth), struct(to AS node, depth + {2**k}L AS depth))")).alias("way")
            )
            spread = _least(ways.select("way.*").filter("node IS NOT NULL"))
            if k % joins_a_job == 0:
                spread = cut_lineage(spread)
        known = visited.withColumnRenamed("depth", "__old")
        better = F.col("__old").isNull() | (F.col("depth") < F.col("__old"))
        # the frontier's own nodes are visited already, at this depth
        gained = cut_lineage(spread.join(known.hint("merge"), "node", "left").filter(better).select("node", "depth"))
        visited = cut_lineage(_least(visited.unionByName(gained)))
        crossed = gained.unionByName(frontier).join(branches.hint("merge"), F.col("node") == F.col("source")).select(F.col("target").alias("node"), (F.col("depth") + 1).alias("depth"))
        known = visited.withColumnRenamed("depth", "__old")
        frontier = cut_lineage(_least(crossed).join(known.hint("merge"), "node", "left").filter(better).select("node", "depth"))
        visited = cut_lineage(_least(visited.unionByName(frontier)))
    return visited.withColumn("depth", F.col("depth").cast("int"))
