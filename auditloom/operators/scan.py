"""Source files to lines, and lines to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.arrays import explode_once
from auditloom.functions.rules import SAST_RULES, SMELL_RULES, Rule, owasp_class, sql_literal
from auditloom.functions.text import FILE_BREAK, strip

# Folders and extensions that are never scanned.
IGNORED_DIRS = [".git", ".venv", "__pycache__", ".pytest_cache", ".google-agents-cli", "node_modules"]
IGNORED_EXTENSIONS = [".png", ".jpg", ".jpeg", ".webp", ".gif", ".pdf", ".pyc", ".db", ".lock"]

# A query holding one of these asks for the call graph as well.
GRAPH_PHRASES = ["cross-repo", "dependency", "dependencies", "call map"]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; leading dots do not start one. Empty when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def file_filter(files: DataFrame, keep_extensions: list[str] | None = None) -> DataFrame:
    """Drop files with an ignored extension or below an ignored folder."""
    ignored = [e for e in IGNORED_EXTENSIONS if e not in (keep_extensions or [])]
    segments = F.split("path", "/")
    folders = F.slice(segments, F.lit(1), F.size(segments) - 1)
    return files.filter(
        ~extension(F.col("path")).isin(ignored)
        & ~F.exists(folders, lambda folder: folder.isin(IGNORED_DIRS))
    )


def split_lines(files: DataFrame) -> DataFrame:
    """One row per line: 1-based number, ``raw`` with its newline, ``line`` stripped for output."""
    kept = [c for c in files.columns if c != "content"]
    return (
        files.select(*kept, F.split("content", FILE_BREAK, -1).alias("__pieces"))
        .select(*kept, F.size("__pieces").alias("__n"), F.posexplode_outer("__pieces").alias("pos", "piece"))
        .withColumn(
            "raw", F.when(F.col("pos") < F.col("__n") - 1, F.concat("piece", F.lit("\n"))).otherwise(F.col("piece"))
        )
        .filter(F.col("raw") != "")
        .select(
            *kept,
            (F.col("pos") + 1).cast("bigint").alias("line_no"),
            "raw",
            strip(F.col("raw")).alias("line"),
        )
    )


def scan(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per (line, matching rule).

    All rules are literal expressions of one projection: each pattern is compiled once per task,
    nothing is shuffled, and lines without a hit leave in the same stage. The array sits under a
    higher-order function, which Spark evaluates by walking the expressions; as generated code the
    rules would outgrow the size limit of one Java method. ``lines`` needs only ``raw``.
    """
    kept = [c for c in lines.columns if c not in ("raw", "line")]

    def hits_of(guard: str) -> str:
        arms = [
            f"CASE WHEN {rule.condition('raw', '__lowered')} THEN {i} END"
            for i, rule in enumerate(rules, 1)
            if rule.guard == guard
        ]
        none = "CAST(array() AS array<int>)"
        if not arms:
            return none
        found = f"array_compact(array({', '.join(arms)}))"
        return f"CASE WHEN contains(raw, '{guard}') THEN {found} ELSE {none} END" if guard else found

    # Half of the rules match only lines with a parenthesis; one test spares the others all of them.
    hits = F.expr(f"concat({hits_of('')}, {hits_of('(')})")
    labels = F.expr(
        "array("
        + ", ".join(
            f"named_struct('rule', {sql_literal(rule.name)}, 'severity', {sql_literal(rule.severity)})"
            for rule in rules
        )
        + ")"
    )
    return (
        lines.withColumn("__lowered", F.lower("raw"))
        .transform(lambda df: explode_once(df, [*kept, "raw"], hits, "__hit"))
        .withColumn("__label", F.element_at(labels, F.col("__hit")))
        .select(*kept, "__label.rule", strip(F.col("raw")).alias("content"), "__label.severity")
    )


def sast_scan(lines: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    return scan(lines, rules or SAST_RULES)


def smell_scan(lines: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    return scan(lines, rules or SMELL_RULES)


def scan_files(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Match rules on whole files, so that patterns spanning lines can fire. One row per (file, rule)."""
    return scan(files.withColumnRenamed("content", "raw"), rules).drop("content")


def keyword_matches(lines: DataFrame, query: str) -> DataFrame:
    """Every line that holds ``query``, ignoring case."""
    return lines.filter(F.lower("raw").contains(query.lower()))


def keyword_search(lines: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """All matches in path order; with a ``limit`` the first ones, where sorting and limiting are one top-k operator."""
    found = (
        keyword_matches(lines, query)
        .select("path", "line_no", F.col("line").alias("content"))
        .orderBy("path", "line_no")
    )
    return found if limit is None else found.limit(limit)


def matches_found(lines: DataFrame, query: str) -> DataFrame:
    return keyword_matches(lines, query).agg(F.count(F.lit(1)).alias("matches_found"))


def graph_requested(query: Column, graph_query: Column) -> Column:
    """Whether a request asks for the call graph: an explicit graph query, or a phrase in the text."""
    lowered = F.coalesce(F.lower(query), F.lit(""))
    asked = lowered.rlike("|".join(GRAPH_PHRASES))
    return (F.coalesce(graph_query, F.lit("")) != "") | asked


def findings_rollup(findings: DataFrame) -> DataFrame:
    """Findings per repository, OWASP class and severity, with sub-totals (NULL = all)."""
    classed = findings.withColumn("owasp", F.coalesce(owasp_class(F.col("rule")), F.lit("none")))
    return classed.rollup("repo", "owasp", "severity").agg(F.count(F.lit(1)).alias("findings"))
