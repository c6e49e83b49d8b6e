"""Line splitting, rule scans, keyword search and roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions.rules import SAST_RULES, SMELL_RULES, Rule
from auditloom.operators import code_index, rule_table
from auditloom.operators import scan as ops
from auditloom.plans import bridges as b
from auditloom.session import scratch_path

_KEYWORD = "token"
# Rules of a user's own: one that spans lines, one with a test, one without.
_OWN_RULES = [
    Rule("License then end", r"(?s)License, version \d.*\n", "own", "LOW", ("license",)),
    Rule("Two sentences a line", r"\. [A-Z][a-z]+", "own", "INFO"),
]


def _documents(spark, sf):
    return b.run_spread(spark, sf, b.DOCUMENT_FILES_SQL)


def _document_lines(spark, sf):
    return ops.split_lines(_documents(spark, sf))


def _all_findings(spark, sf):
    return ops.scan(b.code_lines(spark, sf), SAST_RULES + SMELL_RULES)


# Paths with ignored folders and extensions, from the key of each document.
_PATHS_SQL = """
    SELECT 'r' || source || '/' ||
           CASE WHEN doc_id % 11 = 0 THEN 'node_modules/a/' WHEN doc_id % 7 = 0 THEN '.git/' WHEN doc_id % 5 = 0 THEN 'my.git/' ELSE 'src/' END ||
           'f' || CAST(doc_id AS STRING) ||
           CASE WHEN doc_id % 4 = 0 THEN '.py' WHEN doc_id % 9 = 0 THEN '.PNG' WHEN doc_id % 6 = 0 THEN '.tar.lock' ELSE '' END AS path,
           doc_id
    FROM @documents
"""

# Requests, one per conversation turn, some of which ask for the graph.
_REQUESTS_SQL = """
    SELECT conv_id, turn, text || CASE WHEN turn % 4 = 1 THEN ' show the Call Map' WHEN turn % 4 = 2 THEN ' Dependencies?' ELSE '' END AS query,
           CASE WHEN conv_id % 3 = 0 THEN 'MATCH (a) RETURN a' WHEN conv_id % 3 = 1 THEN '' END AS graph_query
    FROM @conversations
"""

# A rule a customer, on the functions of the repository files.
_CUSTOMER_RULES_SQL = r"""
    SELECT 'Call of fn_' || CAST(c_custkey AS STRING) AS rule, CASE WHEN c_custkey % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity,
           'fn_' || CAST(c_custkey AS STRING) AS need
    FROM @customer
"""


def _indexed_search(spark, sf):
    """The first load has other texts for every third document; the second one brings what is searched."""
    folder = scratch_path(spark, "code-index")
    files = _documents(spark, sf)
    older = files.withColumn("content", F.when(F.pmod(F.xxhash64("path"), F.lit(3)) == 0, F.reverse("content")).otherwise(F.col("content")))
    code_index.build_index(older, folder)
    found = code_index.build_index(files, folder, 1).keyword_matches(_KEYWORD)
    return found.select("path", "line_no", F.col("line").alias("content"))


def _indexed_scan(spark, sf):
    return code_index.build_index(_documents(spark, sf), scratch_path(spark, "code-index")).scan(SAST_RULES + SMELL_RULES)


def _rule_table(spark, sf):
    lines = ops.split_lines(b.run_spread(spark, sf, b.REPO_FILES_SQL))
    rules = b.run(spark, sf, _CUSTOMER_RULES_SQL).withColumns(
        {"pattern": F.concat(F.lit(r"\b"), F.col("need"), F.lit(r"\s*\(")), "needs": F.array("need")}
    )
    return rule_table.scan_rule_table(lines, rules)


QUERIES = {
    "file_filter": lambda s, d: ops.file_filter(b.run(s, d, _PATHS_SQL)),
    "split_lines": lambda s, d: _document_lines(s, d).select("repo", "path", "line_no", "line"),
    "sast_scan": lambda s, d: ops.sast_scan(b.code_lines(s, d)),
    "smell_scan": lambda s, d: ops.smell_scan(b.code_lines(s, d)),
    "rule_scan_join": lambda s, d: ops.scan(_document_lines(s, d), SAST_RULES + SMELL_RULES),
    "user_rules": lambda s, d: ops.scan(_document_lines(s, d), SMELL_RULES[:3] + _OWN_RULES),
    "scan_files": lambda s, d: ops.scan_files(_documents(s, d), _OWN_RULES).select("repo", "path", "rule", "severity"),
    "keyword_search": lambda s, d: ops.keyword_search(_document_lines(s, d), _KEYWORD),
    "matches_found": lambda s, d: ops.matches_found(_document_lines(s, d), _KEYWORD),
    "indexed_keyword_search": _indexed_search,
    "indexed_rule_scan": _indexed_scan,
    "rule_table_scan": _rule_table,
    "graph_requested": lambda s, d: b.run(s, d, _REQUESTS_SQL).select(
        "conv_id", "turn", ops.graph_requested(F.col("query"), F.col("graph_query")).alias("wanted")
    ),
    "findings_rollup": lambda s, d: ops.findings_rollup(_all_findings(s, d)),
}

# Two patterns need forms without lookahead or backreference; on one line they are equivalent.
# The third one that does needs text after the newline, so no single line can match it.
_THREAD = r"(?i)threading\.Thread\(.*target\s*=\s*\w+.*\)\s*\n"
_REPEAT = r"""
    len(list_filter(list_zip(string_split(raw, '='), string_split(raw, '=')[2:]),
        lambda x: x[2] IS NOT NULL
             AND regexp_extract(x[1], '\b(\w+)\s*$', 1) <> ''
             AND regexp_extract(x[1], '\b(\w+)\s*$', 1) = regexp_extract(x[2], '^\s*(\w+)', 1))) > 0
"""
_ACROSS_LINES = "Missing Function Access Control"


def _test(rule):
    if rule.name == "Redundant Assignment Duplication":
        return _REPEAT
    pattern = _THREAD if rule.name == "Thread-Safety Violation Hazard" else rule.pattern
    return f"regexp_matches(raw, {b.sql_text(pattern)})"


def scan_sql(lines: str, rules) -> str:
    arms = ", ".join(
        f"CASE WHEN {_test(r)} THEN {{'rule': {b.sql_text(r.name)}, 'severity': '{r.severity}'}} END"
        for r in rules
        if _ACROSS_LINES not in r.name
    )
    return f"""
        SELECT repo, path, line_no, hit.rule AS rule, content, hit.severity AS severity
        FROM (SELECT repo, path, line_no, line AS content, unnest([{arms}]) AS hit FROM ({lines}) l) h
        WHERE hit IS NOT NULL
    """


_LINES_DUCKDB = r"""
    SELECT repo, path, line_no, raw, trim(raw, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)) AS line
    FROM (SELECT repo, path, CAST(pos AS BIGINT) AS line_no,
                 CASE WHEN pos < n THEN piece || chr(10) ELSE piece END AS raw
          FROM (SELECT repo, path, len(pieces) AS n, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos
                FROM (SELECT repo, path, string_split_regex(content, '\r\n|\r|\n') AS pieces FROM (%s) f) s) u) r
    WHERE raw <> ''
"""
DOCUMENT_LINES_DUCKDB = _LINES_DUCKDB % b.for_duckdb(b.DOCUMENT_FILES_SQL)

ORACLE = {
    "file_filter": b.for_duckdb(f"""
        SELECT * FROM ({_PATHS_SQL}) p
        WHERE NOT regexp_matches(path, '/(node_modules|\\.git)/')
          AND NOT regexp_matches(lower(path), '/[^/]+\\.(png|lock)$')
    """),
    "split_lines": f"SELECT repo, path, line_no, line FROM ({DOCUMENT_LINES_DUCKDB}) l",
    "sast_scan": scan_sql(b.CODE_LINES_DUCKDB, SAST_RULES),
    "smell_scan": scan_sql(b.CODE_LINES_DUCKDB, SMELL_RULES),
    "rule_scan_join": scan_sql(DOCUMENT_LINES_DUCKDB, SAST_RULES + SMELL_RULES),
    "user_rules": scan_sql(DOCUMENT_LINES_DUCKDB, SMELL_RULES[:3] + _OWN_RULES),
    "scan_files": b.for_duckdb("SELECT repo, path, hit.rule AS rule, hit.severity AS severity FROM (SELECT repo, path, unnest(["
    + ", ".join(
        f"CASE WHEN regexp_matches(content, {b.sql_text(r.pattern)}) THEN {{'rule': {b.sql_text(r.name)}, 'severity': '{r.severity}'}} END"
        for r in _OWN_RULES
    )
    + f"]) AS hit FROM ({b.DOCUMENT_FILES_SQL}) f) h WHERE hit IS NOT NULL"),
    "keyword_search": f"""
        SELECT path, line_no, line AS content FROM ({DOCUMENT_LINES_DUCKDB}) l
        WHERE contains(lower(raw), '{_KEYWORD}') ORDER BY path, line_no
    """,
    "matches_found": f"""
        SELECT count(*) AS matches_found FROM ({DOCUMENT_LINES_DUCKDB}) l WHERE contains(lower(raw), '{_KEYWORD}')
    """,
    "indexed_keyword_search": f"""
        SELECT path, line_no, line AS content FROM ({DOCUMENT_LINES_DUCKDB}) l WHERE contains(lower(raw), '{_KEYWORD}')
    """,
    "indexed_rule_scan": scan_sql(DOCUMENT_LINES_DUCKDB, SAST_RULES + SMELL_RULES),
    "rule_table_scan": rf"""
        SELECT repo, path, line_no, rule, line AS content, severity
        FROM (SELECT * FROM ({_LINES_DUCKDB % b.for_duckdb(b.REPO_FILES_SQL)}) x WHERE contains(raw, 'fn_')) l JOIN ({b.for_duckdb(_CUSTOMER_RULES_SQL)}) r
            ON contains(raw, need) AND regexp_matches(raw, '\b' || need || '\s*\(')
    """,
    "graph_requested": b.for_duckdb(f"""
        SELECT conv_id, turn,
               coalesce(graph_query, '') <> '' OR contains(lower(query), 'cross-repo') OR contains(lower(query), 'dependency')
               OR contains(lower(query), 'dependencies') OR contains(lower(query), 'call map') AS wanted
        FROM ({_REQUESTS_SQL}) r
    """),
    "findings_rollup": f"""
        SELECT repo, owasp, severity, count(*) AS findings
        FROM (SELECT repo, severity, coalesce(nullif(regexp_extract(rule, '^\\[OWASP (A\\d\\d)', 1), ''), 'none') AS owasp
              FROM ({scan_sql(b.CODE_LINES_DUCKDB, SAST_RULES + SMELL_RULES)}) f) c
        GROUP BY ROLLUP (repo, owasp, severity)
    """,
}
