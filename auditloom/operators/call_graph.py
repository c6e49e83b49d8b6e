"""Call edges between repositories, factorised over the names that are called.

``graph.cross_repo_call_edges`` writes one row for each file and each other repository that defines a name it calls; a name
such as ``main`` makes all pairs. Here names are nodes of their own: files are linked to names and names to repositories, so
the graph has a row for each call and definition, and counts say how many plain edges each row stands for. What is alike is
one row: the classes are (name, repository), with the number of calling files and of definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.arrays import explode_once
from auditloom.operators.graph import CALL, DEFINITION, call_tokens, python_files
from auditloom.session import cut_lineage


def call_classes(files: DataFrame) -> DataFrame:
    """One row for each name and each repository that defines or calls it; files are read once, counted before the shuffle.

    ``callers`` (files of the repository that call the name), ``definitions`` (occurrences in it); of the other repositories:
    ``targets`` (how many define it), ``target_definitions`` (occurrences in them), ``sources`` (their files that call it).
    ``callers * targets`` are the plain call edges that leave the class, ``sources`` those that reach it if it defines the
    name. Null contents and paths have no names; an empty table gives an empty result.
    """
    def marked(name, definition: int):
        return F.struct(name.alias("func"), F.lit(1 - definition).alias("called"), F.lit(definition).alias("defined"))

    defined = F.transform(F.regexp_extract_all("content", F.lit(DEFINITION), 1), lambda n: marked(n, 1))
    called = F.transform(F.array_distinct(F.regexp_extract_all("content", F.lit(CALL), 1)), lambda n: marked(n, 0))
    rows = explode_once(python_files(files), ["repo"], F.concat(defined, called), "seen")
    classes = rows.groupBy(F.col("seen.func").alias("func"), "repo").agg(
        F.sum("seen.called").alias("callers"), F.sum("seen.defined").alias("definitions")
    )
    totals = classes.groupBy("func").agg(
        F.sum("callers").alias("__callers"),
        F.sum("definitions").alias("__definitions"),
        F.count_if(F.col("definitions") > 0).alias("__targets"),
    )
    return classes.join(totals, "func").select(
        "func",
        "repo",
        "callers",
        "definitions",
        (F.col("__targets") - (F.col("definitions") > 0).cast("long")).alias("targets"),
        (F.col("__definitions") - F.col("definitions")).alias("target_definitions"),
        (F.col("__callers") - F.col("callers")).alias("sources"),
    )


def call_names(files: DataFrame) -> DataFrame:
    """One row a name that is called across repositories: its ends, and the plain edges it stands for.

    ``edges`` counts (file, repository) pairs, ``occurrences`` pairs of a file and a definition.
    """
    return (
        call_classes(files)
        .groupBy("func")
        .agg(
            F.sum("callers").alias("callers"),
            F.count_if(F.col("definitions") > 0).alias("repositories"),
            F.sum("definitions").alias("definitions"),
            F.sum(F.col("callers") * F.col("targets")).alias("edges"),
            F.sum(F.col("callers") * F.col("target_definitions")).alias("occurrences"),
        )
        .filter("edges > 0")
    )


def call_links(files: DataFrame) -> DataFrame:
    """The factorised edges: CALLS from a file to a name, DEFINED_IN from a name to a repository.

    ``links`` is the number of plain edges that pass through the row: for a call the other repositories that define the
    name, for a definition the files elsewhere that call it. Rows that no plain edge passes are left out.
    ``definitions`` counts the definitions at the end of the row. There are at most as many rows as calls and definitions.
    """
    classes = call_classes(files)
    crossing = classes.filter((F.col("callers") > 0) & (F.col("targets") > 0)).select("repo", "func", "targets", "target_definitions")
    calls = (
        call_tokens(files)
        .join(crossing, ["repo", "func"])
        .select(
            F.format_string("File(%s/%s)", "repo", "path").alias("source_node"),
            F.format_string("Name(%s)", "func").alias("target_node"),
            F.lit("CALLS").alias("edge_type"),
            F.col("repo"),
            F.col("path"),
            F.col("func"),
            F.col("targets").alias("links"),
            F.col("target_definitions").alias("definitions"),
        )
    )
    homes = classes.filter((F.col("definitions") > 0) & (F.col("sources") > 0)).select(
        F.format_string("Name(%s)", "func").alias("source_node"),
        F.format_string("Repository(%s)", "repo").alias("target_node"),
        F.lit("DEFINED_IN").alias("edge_type"),
        "repo",
        F.lit(None).cast("string").alias("path"),
        "func",
        F.col("sources").alias("links"),
        "definitions",
    )
    return calls.unionByName(homes)


def call_reach(files: DataFrame, seeds: DataFrame) -> DataFrame:
    """What calls lead to from ``seeds(repo, path)``: (kind, node, depth) of names and repositories, least depth each.

    A seed without a path is a whole repository, at depth 0; with one it is a file, whose own calls lead on. A repository at
    depth d calls names at depth d + 1, which lead to the other repositories that define them, at depth d + 1 too: the same
    repositories and depths as breadth first along the plain edges. Each name is walked through once, however many files
    call it; only a name first called from one repository alone, whose own definition a plain edge leaves out, is walked
    through again for that repository when another one calls it. Runs until nothing new is found, two joins a round.
    """
    classes = cut_lineage(call_classes(files).filter("callers * targets > 0 OR definitions * sources > 0"))
    calls = classes.filter("callers * targets > 0").select("repo", "func")
    homes = classes.filter("definitions * sources > 0").select("func", F.col("repo").alias("home"))
    some = seeds.filter("path IS NOT NULL").select("repo", "path").distinct()
    own = call_tokens(files).join(some, ["repo", "path"], "left_semi").select("repo", "func").join(calls, ["repo", "func"], "left_semi")
    repos = cut_lineage(seeds.filter("path IS NULL").select("repo").distinct().withColumn("depth", F.lit(0)))
    names = cut_lineage(classes.limit(0).select("func", F.lit(0).alias("depth"), F.col("repo").alias("skip")))
    frontier, depth = repos, 0
    while True:
        depth += 1
        called = calls.join(frontier.select("repo"), "repo", "left_semi")
        if depth == 1:
            called = called.unionByName(own)
        found = called.groupBy("func").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"))
        # skip: the only repository that has called the name so far; its own definition is not reached by that
        known = names.groupBy("func").agg(F.max("skip").alias("skip"), F.bool_or(F.col("skip").isNull()).alias("walked"))
        others = ~F.col("walked") & ((F.col("lo") != F.col("skip")) | (F.col("hi") != F.col("skip")))
        alone = F.when(F.col("walked").isNull() & (F.col("lo") == F.col("hi")), F.col("lo"))
        new = found.join(known, "func", "left").filter(F.col("walked").isNull() | others)
        fresh = cut_lineage(new.select("func", F.lit(depth).alias("depth"), alone.alias("skip")))
        led = fresh.join(homes, "func").filter(F.col("skip").isNull() | (F.col("skip") != F.col("home")))
        reached = led.select(F.col("home").alias("repo")).distinct().join(repos, "repo", "left_anti")
        frontier = cut_lineage(reached.withColumn("depth", F.lit(depth)))
        names = names.unionByName(fresh)
        if frontier.isEmpty():
            break
        repos = repos.unionByName(frontier)
    least = names.groupBy("func").agg(F.min("depth").alias("depth"))
    return least.select(F.lit("name").alias("kind"), F.col("func").alias("node"), "depth").unionByName(
        repos.select(F.lit("repository").alias("kind"), F.col("repo").alias("node"), "depth")
    )
