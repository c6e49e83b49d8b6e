"""Import and call graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions.ordered import with_order_number
from auditloom.operators import call_graph
from auditloom.operators import graph as ops
from auditloom.plans import bridges as b


def _files(spark, sf):
    return b.run_spread(spark, sf, b.REPO_FILES_SQL)


def _edges(spark, sf):
    return ops.repo_import_edges(_files(spark, sf)).select(
        F.col("source_repo").alias("source"), F.col("target_repo").alias("target")
    )


def _reach(spark, sf):
    # Seeds: the repository of the least document.
    seeds = b.table(spark, sf, "documents").agg(F.min_by("source", "doc_id").alias("node"))
    return ops.callgraph_reach(_edges(spark, sf), seeds)


def _call_reach(spark, sf):
    # Seed: the file with the least path that calls anything.
    files = _files(spark, sf)
    least = ops.call_tokens(files).agg(F.min(F.struct("path", "repo")).alias("seed"))
    return call_graph.call_reach(files, least.select("seed.repo", "seed.path"))



# Orders one after the other: by region, customer and date.
_ORDERS_SQL = """
    SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(c_custkey AS BIGINT) AS customer, o_orderdate, CAST(o_orderkey AS BIGINT) AS o_orderkey
    FROM @orders JOIN @customer ON o_custkey = c_custkey JOIN @nation ON c_nationkey = n_nationkey
"""


def _deep_reach(spark, sf):
    """Each order leads to the next, the last one of the first region also back to the first of all: a cycle in a long chain."""
    rows = b.run(spark, sf, _ORDERS_SQL)
    placed = with_order_number(rows, ["region", "customer", "o_orderdate", "o_orderkey"]).select(
        "n", "region", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node")
    )
    ends = placed.filter("region = 0").agg(F.max_by("node", "n").alias("source"), F.min_by("node", "n").alias("target"))
    chain = placed.select(F.col("n") + 1, F.col("node").alias("source")).toDF("n", "source").join(placed.select("n", F.col("node").alias("target")), "n")
    edges = chain.select("source", "target").unionByName(ends.select("source", "target"))
    return ops.deep_reach(edges, placed.filter("n = 0").select("node"))


QUERIES = {
    "function_defs": lambda s, d: ops.function_defs(_files(s, d)),
    "call_tokens": lambda s, d: ops.call_tokens(_files(s, d)),
    "imported_names": lambda s, d: ops.imported_names(_files(s, d)),
    "definitions_per_repo": lambda s, d: ops.definitions_per_repo(_files(s, d)),
    "repo_import_edges": lambda s, d: ops.repo_import_edges(_files(s, d)),
    "cross_repo_call_edges": lambda s, d: ops.cross_repo_call_edges(_files(s, d)),
    "callgraph_reach": _reach,
    "deep_reach": _deep_reach,
    "call_classes": lambda s, d: call_graph.call_classes(_files(s, d)),
    "call_names": lambda s, d: call_graph.call_names(_files(s, d)),
    "call_links": lambda s, d: call_graph.call_links(_files(s, d)),
    "call_reach": _call_reach,
}

_CTE = f"""
    files AS (SELECT * FROM ({b.for_duckdb(b.REPO_FILES_SQL)}) f WHERE path LIKE '%.py'),
    repos AS (SELECT DISTINCT repo FROM ({b.for_duckdb(b.REPO_FILES_SQL)}) f),
    defs AS (SELECT repo, path, unnest(regexp_extract_all(content, '\\bdef\\s+([\\p{{L}}\\p{{M}}\\p{{N}}_]+)\\s*\\(', 1)) AS func FROM files),
    calls AS (SELECT DISTINCT repo, path, func FROM (
        SELECT repo, path, unnest(regexp_extract_all(content, '([\\p{{L}}\\p{{M}}\\p{{N}}_]+)\\s*\\(', 1)) AS func FROM files) c),
    written AS (SELECT DISTINCT repo, path, w FROM (
        SELECT repo, path, unnest(regexp_extract_all(
            regexp_replace(content, '\\b(import|from)(\\s)', '\\1 ; \\1\\2', 'g'), '\\b(?:import|from)\\s+([\\p{{L}}\\p{{M}}\\p{{N}}_.\\-]+)', 1)) AS w FROM files) c),
    names AS (SELECT DISTINCT repo, path, name FROM (
        SELECT repo, path, unnest(list_transform(range(1, length(w) + 1), lambda n: w[1:n])) AS name, w FROM written) p
        WHERE regexp_matches(name, '[\\p{{L}}\\p{{M}}\\p{{N}}_]$') AND (length(name) = length(w) OR NOT regexp_matches(w[length(name) + 1:length(name) + 1], '[\\p{{L}}\\p{{M}}\\p{{N}}_]'))),
    imports AS (
        SELECT 'Repository(' || n.repo || ')' AS source_node, 'Repository(' || r.repo || ')' AS target_node,
               'DEPENDS_ON' AS edge_type,
               'File ''' || string_split(path, '/')[-1] || ''' in repository ''' || n.repo || ''' imports repository ''' || r.repo || '''.' AS details,
               n.repo AS source_repo, r.repo AS target_repo, path
        FROM names n JOIN repos r ON n.name = r.repo AND n.repo <> r.repo),
    per_repo AS (SELECT repo, func, count(*) AS definitions FROM defs GROUP BY ALL),
    calls_to AS (
        SELECT 'Function(' || c.repo || '.' || string_split(path, '/')[-1] || ':' || c.func || ')' AS source_node,
               'Function(' || d.repo || ':' || c.func || ')' AS target_node, 'CALLS' AS edge_type,
               'Function call to ''' || c.func || ''' maps across repositories from ''' || c.repo || ''' to ''' || d.repo || '''.' AS details,
               c.repo AS source_repo, d.repo AS target_repo, path, definitions
        FROM calls c JOIN per_repo d ON c.func = d.func AND c.repo <> d.repo),
    pairs AS (SELECT c.repo, c.path, c.func, d.repo AS home, definitions FROM calls c JOIN per_repo d ON c.func = d.func AND c.repo <> d.repo),
    callers AS (SELECT repo, func, count(*) AS callers FROM calls GROUP BY ALL)
"""


def _sql(body: str) -> str:
    return f"WITH {_CTE} {body}"


ORACLE = {
    "function_defs": _sql("SELECT * FROM defs"),
    "call_tokens": _sql("SELECT * FROM calls"),
    "imported_names": _sql("SELECT * FROM names"),
    "definitions_per_repo": _sql("SELECT * FROM per_repo"),
    "repo_import_edges": _sql("SELECT * FROM imports"),
    "cross_repo_call_edges": _sql("SELECT * FROM calls_to"),
    "deep_reach": b.for_duckdb(f"""
        SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS node, CAST(row_number() OVER (ORDER BY region, customer, o_orderdate, o_orderkey) - 1 AS INT) AS depth
        FROM ({_ORDERS_SQL}) o
    """),
    "call_classes": _sql("""
        SELECT k.func, k.repo, coalesce(c.callers, 0) AS callers, coalesce(d.definitions, 0) AS definitions,
            (SELECT count(*) FROM per_repo o WHERE o.func = k.func AND o.repo <> k.repo) AS targets,
            CAST((SELECT coalesce(sum(o.definitions), 0) FROM per_repo o WHERE o.func = k.func AND o.repo <> k.repo) AS BIGINT) AS target_definitions,
            CAST((SELECT coalesce(sum(o.callers), 0) FROM callers o WHERE o.func = k.func AND o.repo <> k.repo) AS BIGINT) AS sources
        FROM (SELECT func, repo FROM per_repo UNION SELECT func, repo FROM callers) k
        LEFT JOIN callers c ON c.func = k.func AND c.repo = k.repo LEFT JOIN per_repo d ON d.func = k.func AND d.repo = k.repo
    """),
    "call_names": _sql("""
        SELECT e.func, (SELECT count(*) FROM calls c WHERE c.func = e.func) AS callers,
            (SELECT count(*) FROM per_repo d WHERE d.func = e.func) AS repositories,
            CAST((SELECT sum(d.definitions) FROM per_repo d WHERE d.func = e.func) AS BIGINT) AS definitions,
            count(*) AS edges, CAST(sum(e.definitions) AS BIGINT) AS occurrences
        FROM pairs e GROUP BY e.func
    """),
    "call_links": _sql("""
        SELECT 'File(' || repo || '/' || path || ')' AS source_node, 'Name(' || func || ')' AS target_node, 'CALLS' AS edge_type,
            repo, path, func, count(*) AS links, CAST(sum(definitions) AS BIGINT) AS definitions
        FROM pairs GROUP BY repo, path, func
        UNION ALL
        SELECT 'Name(' || func || ')', 'Repository(' || home || ')', 'DEFINED_IN', home, NULL, func, count(*), min(definitions)
        FROM pairs GROUP BY home, func
    """),
    "call_reach": f"""
        WITH RECURSIVE {_CTE},
        start AS (SELECT arg_min(repo, path) AS repo, min(path) AS path FROM calls),
        reach AS (SELECT home AS node, 1 AS depth FROM pairs JOIN start USING (repo, path)
                  UNION
                  SELECT home, depth + 1 FROM reach JOIN (SELECT DISTINCT repo, home FROM pairs) e ON node = repo
                  WHERE depth < (SELECT count(*) FROM repos)),
        near AS (SELECT node, min(depth) AS depth FROM reach GROUP BY node),
        named AS (SELECT func, 1 AS depth FROM pairs JOIN start USING (repo, path)
                  UNION ALL SELECT func, depth + 1 FROM near JOIN pairs ON node = repo)
        SELECT 'repository' AS kind, node, depth FROM near
        UNION ALL SELECT 'name', func, min(depth) FROM named GROUP BY func
    """,
    "callgraph_reach": f"""
        WITH RECURSIVE {_CTE},
        reach AS (SELECT arg_min(source, doc_id) AS node, 0 AS depth FROM documents
                  UNION
                  SELECT target_repo, depth + 1 FROM reach JOIN (SELECT DISTINCT source_repo, target_repo FROM imports) e
                  ON node = source_repo WHERE depth < (SELECT count(*) FROM repos))
        SELECT node, min(depth) AS depth FROM reach GROUP BY node
    """,
}
