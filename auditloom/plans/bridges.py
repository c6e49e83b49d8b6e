"""Operator inputs derived from the driver tables.

The driver tables hold no spans, tool calls, manifests or code, so each input is computed from
whole driver tables. A bridge that both engines can express is one SQL text: ``@table`` stands for
a driver table, ``LIST[..]`` for a list, ``EXPLODE[..]`` for one row per element, ``EACH_TO[n]`` for one row per number from 0 to n, and the few function names that
differ are swapped in ``for_duckdb``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.plans.snippets import SNIPPETS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_TABLE = re.compile(r"@(" + "|".join(TABLES) + r")\b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of these tables become programs, manifests or patches: little to read and much to do, so a file of few splits is dealt
# out before the work.
DEALT = {"part"}


def dealt_partitions(spark: SparkSession) -> int:
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).repartition(dealt_partitions(spark))


def for_spark(sql: str, sf_dir: str, partitions: int) -> str:
    sql = re.sub(r"LIST\[([^\]]*)\]", r"array(\1)", sql)
    sql = re.sub(r"EXPLODE\[([^\]]*)\]", r"explode(array(\1))", sql)
    sql = re.sub(r"EACH_TO\[([^\]]*)\]", r"explode(sequence(0L, \1))", sql)

    def source(name: str) -> str:
        file = f"parquet.`{sf_dir}/{name}.parquet`"
        return f"(SELECT /*+ REPARTITION({partitions}) */ * FROM {file})" if name in DEALT else file

    return _TABLE.sub(lambda m: source(m.group(1)), sql)


def for_duckdb(sql: str) -> str:
    sql = re.sub(r"LIST\[([^\]]*)\]", r"[\1]", sql).replace("element_at(", "list_extract(")
    text = re.sub(r"EXPLODE\[([^\]]*)\]", r"unnest([\1])", sql)
    text = re.sub(r"EACH_TO\[([^\]]*)\]", r"unnest(range(0, \1 + 1))", text)
    text = _TABLE.sub(r"\1", text)
    return text.replace("timestamp_micros(", "make_timestamp(").replace("unix_micros(", "epoch_us(")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(for_spark(sql, sf_dir, dealt_partitions(spark)))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to as many partitions as ``spark.auditloom.inputPartitions`` says; unset (the default), do nothing.

    A table that is one small file with one row group is one split, however many cores there are; the bench sets it.
    """
    wanted = df.sparkSession.conf.get("spark.auditloom.inputPartitions", None)
    return df.repartition(int(wanted)) if wanted else df


def run_spread(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spread(run(spark, sf_dir, sql))


# Calls: every turn of a conversation that the assistant wrote. One call in seven is logged twice.
CALLS_SQL = """
    SELECT conv_id, turn, copy_no,
           'ins-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) || '-' || CAST(copy_no AS STRING) AS insert_id,
           timestamp_micros(1704067200000000 + (conv_id * 3600 + turn * 60 + copy_no * 7) * 1000000) AS ts,
           'tr-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS trace,
           'sp-' || CAST(turn AS STRING) AS span_id,
           CASE WHEN conv_id % 29 = 0 THEN NULL ELSE 'conv-' || CAST(conv_id AS STRING) END AS conversation_id,
           'store://msgs/call' || CAST(conv_id AS STRING) || 't' || CAST(turn AS STRING) || '_in.jsonl' AS input_ref,
           CASE WHEN (conv_id + turn) % 17 = 0 THEN NULL
                ELSE 'store://msgs/call' || CAST(conv_id AS STRING) || 't' || CAST(turn AS STRING) || '_out.jsonl' END AS output_ref,
           CAST(length(text) AS STRING) AS usage_input_tokens,
           CAST(turn * 10 AS STRING) AS usage_output_tokens,
           'agent_' || CAST(conv_id % 5 AS STRING) AS agent_name,
           'stop' AS finish_reasons,
           'user-' || CAST(conv_id % 11 AS STRING) AS user_id
    FROM (SELECT conv_id, turn, text, EXPLODE[0, 1] AS copy_no FROM @conversations WHERE role = 'assistant') c
    WHERE copy_no = 0 OR (conv_id * 31 + turn) % 7 = 0
"""

# Messages: a turn is stored in the output file of its own call and in the input files of all later
# turns of its conversation. Files without a call are never referenced.
MESSAGES_SQL = """
    SELECT 'store://msgs/call' || CAST(conv_id AS STRING) || 't' || CAST(turn + ahead AS STRING)
               || CASE WHEN ahead = 0 THEN '_out.jsonl' ELSE '_in.jsonl' END AS file_path,
           role,
           CAST(CASE WHEN ahead = 0 THEN 0 ELSE turn END AS BIGINT) AS message_idx,
           conv_id, turn, text
    FROM (SELECT c.conv_id, turn, role, text, EACH_TO[last_turn - turn] AS ahead
          FROM @conversations c JOIN (SELECT conv_id, max(turn) AS last_turn FROM @conversations GROUP BY conv_id) l
          ON c.conv_id = l.conv_id) m
"""


def inference_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(
        spark,
        sf_dir,
        f"""
        SELECT 'inference' AS logName, insert_id AS insertId, ts AS timestamp, trace, span_id AS spanId,
               named_struct(
                   'gen_ai_conversation_id', conversation_id, 'gen_ai_agent_name', agent_name,
                   'gen_ai_input_messages_ref', input_ref, 'gen_ai_output_messages_ref', output_ref,
                   'gen_ai_usage_input_tokens', usage_input_tokens,
                   'gen_ai_usage_output_tokens', usage_output_tokens,
                   'gen_ai_response_finish_reasons', finish_reasons, 'user_id', user_id) AS labels
        FROM ({CALLS_SQL})
        """,
    )


def completion_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(
        spark,
        sf_dir,
        f"""
        SELECT file_path, role, message_idx AS index,
               CASE WHEN (conv_id + turn) % 13 = 0 THEN NULL
                    WHEN turn % 3 = 0 THEN array({_TEXT_PART}, {_CALL_PART})
                    ELSE array({_TEXT_PART}) END AS parts
        FROM ({MESSAGES_SQL})
        """,
    )


_PART = (
    "named_struct('type', {type}, 'content', {content}, 'mime_type', {mime}, 'uri', CAST(NULL AS STRING), "
    "'data', {data}, 'id', {id}, 'name', {name}, 'arguments', {args}, 'response', CAST(NULL AS STRING))"
)
_TEXT_PART = _PART.format(
    type="'text'", content="text", mime="'text/plain'", data="CAST(text AS BINARY)",
    id="CAST(NULL AS STRING)", name="CAST(NULL AS STRING)", args="CAST(NULL AS STRING)",
)
_CALL_PART = _PART.format(
    type="'function_call'", content="CAST(NULL AS STRING)", mime="CAST(NULL AS STRING)",
    data="CAST(NULL AS BINARY)", id="'t' || CAST(turn AS STRING)", name="'lookup'",
    args="'{\"turn\":' || CAST(turn AS STRING) || '}'",
)

# The same parts as rows, for SQL engines without Spark's struct syntax.
PART_ROWS_SQL = f"""
    SELECT file_path, role, message_idx, CAST(part_idx AS BIGINT) AS part_idx,
           CASE WHEN part_idx = 0 THEN 'text' ELSE 'function_call' END AS part_type,
           CASE WHEN part_idx = 0 THEN text END AS content,
           CASE WHEN part_idx = 0 THEN 'text/plain' END AS mime_type,
           CASE WHEN part_idx = 0 THEN md5(text) END AS data_md5_hex,
           CASE WHEN part_idx = 1 THEN 't' || CAST(turn AS STRING) END AS tool_id,
           CASE WHEN part_idx = 1 THEN 'lookup' END AS tool_name,
           CASE WHEN part_idx = 1 THEN '{{"turn":' || CAST(turn AS STRING) || '}}' END AS tool_args
    FROM (SELECT *, EXPLODE[0, 1] AS part_idx FROM ({MESSAGES_SQL}) m) p
    WHERE (conv_id + turn) % 13 <> 0 AND (part_idx = 0 OR turn % 3 = 0)
"""


def sql_text(value: str) -> str:
    """A SQL string literal for engines that do not read backslashes."""
    return "'" + value.replace("'", "''") + "'"


# Code lines: an order is a file, its lines are numbered snippets chosen by the row keys.
def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_suppkey")) % len(SNIPPETS)
    line = F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]), (pick + 1).cast("int"))
    keys = spread(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    )
    return keys.select(
        F.concat(F.lit("repo"), (F.col("l_partkey") % 20).cast("string")).alias("repo"),
        F.concat(F.lit("src/file_"), F.col("l_orderkey").cast("string"), F.lit(".py")).alias("path"),
        F.col("l_linenumber").cast("bigint").alias("line_no"),
        F.concat(line, F.lit("\n")).alias("raw"),
        F.btrim(line).alias("line"),
    )


CODE_LINES_DUCKDB = f"""
    SELECT 'repo' || CAST(l_partkey % 20 AS VARCHAR) AS repo,
           'src/file_' || CAST(l_orderkey AS VARCHAR) || '.py' AS path,
           CAST(l_linenumber AS BIGINT) AS line_no,
           snippet || chr(10) AS raw, trim(snippet) AS line
    FROM (SELECT *, list_extract([{', '.join(sql_text(s) for s in SNIPPETS)}],
                 CAST((l_orderkey * 7 + l_linenumber * 13 + l_suppkey) % {len(SNIPPETS)} + 1 AS INT)) AS snippet
          FROM lineitem) picked
"""


# Text files: a document is a file of the repository named by its source.
DOCUMENT_FILES_SQL = """
    SELECT source AS repo, 'docs/' || source || '/note_' || CAST(doc_id AS STRING) || '.py' AS path, text AS content
    FROM @documents
"""

# Manifests: a part is a manifest; names, pins, licences and look-alikes follow from the key.
MANIFESTS_SQL = """
    SELECT 'repo' || CAST(p_partkey % 20 AS STRING) || '/m' || CAST(p_partkey AS STRING) || '/' ||
           CASE WHEN p_partkey % 19 = 0 THEN 'go.mod' WHEN p_partkey % 23 = 0 THEN 'poetry.lock'
                WHEN p_partkey % 31 = 0 THEN 'README.md' WHEN p_partkey % 37 = 0 THEN '.git/setup.py'
                WHEN eco = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'requirements.txt' ELSE 'requirements-dev.txt' END
                WHEN eco = 1 THEN CASE WHEN p_size % 2 = 0 THEN 'pom.xml' ELSE 'build.gradle' END
                ELSE 'package.json' END AS path,
           '// ' || p_name || ' ' || p_brand || NL ||
           CASE WHEN p_partkey % 10 = 0 THEN '"license": "GPL-3.0",' WHEN p_partkey % 10 = 1 THEN '<license>GNU LGPL</license>'
                WHEN p_partkey % 10 = 2 THEN 'license = ''MPL-2.0''' ELSE '"license": "MIT",' END || NL ||
           CASE WHEN p_partkey % 41 = 0 THEN 'reqeusts' WHEN p_partkey % 43 = 0 THEN 'Lodas exprees' ELSE 'ok' END || NL ||
           CASE WHEN eco = 0 THEN lib_py || '==' || version || NL || 'my-' || lib_py2 || '==' || version2
                WHEN eco = 1 AND p_size % 2 = 0 THEN '<artifactId>' || lib_jvm || '</artifactId>' || NL || '  <version>' || version || '</version>'
                WHEN eco = 1 THEN 'implementation "g:' || lib_jvm || ':' || version || '"'
                ELSE '{ "' || lib_js || '": "' || mark || version || '", "' || lib_js2 || '" : "' || version2 || '" }' END
           AS content
    FROM (SELECT p_partkey, p_name, p_brand, p_size, p_partkey % 3 AS eco, chr(10) AS NL,
                 element_at(LIST['pyjwt', 'Requests', 'django', 'flask', 'cryptography', 'urllib3', 'jinja2'], CAST(p_partkey % 7 + 1 AS INT)) AS lib_py,
                 element_at(LIST['requests', 'Jinja2', 'pyjwt'], CAST(p_partkey % 5 % 3 + 1 AS INT)) AS lib_py2,
                 element_at(LIST['log4j-core', 'spring-beans', 'spring-core', 'jackson-databind', 'commons-text'], CAST(p_partkey % 5 + 1 AS INT)) AS lib_jvm,
                 element_at(LIST['lodash', 'express', 'axios', 'jsonwebtoken', 'mongoose', 'semver'], CAST(p_partkey % 11 % 6 + 1 AS INT)) AS lib_js,
                 element_at(LIST['semver', 'axios', 'lodash'], CAST(p_size % 3 + 1 AS INT)) AS lib_js2,
                 element_at(LIST['', '^', '~'], CAST(p_size % 3 + 1 AS INT)) AS mark,
                 CAST(p_size % 8 AS STRING) || '.' || CAST(p_partkey % 40 AS STRING) ||
                   CASE WHEN p_size % 5 = 0 THEN '' ELSE '.' || CAST(p_partkey % 23 AS STRING) END AS version,
                 CAST(p_partkey % 4 AS STRING) || '.' || CAST(p_size AS STRING) || '.1' AS version2
          FROM @part) keys
"""

# Repositories of code: a document is a module that defines, calls and imports by its keys, followed
# by its whole text.
# Advisory ranges: an order is a range of versions of one known library; some are open at either side.
ADVISORY_RANGES_SQL = """
    SELECT element_at(LIST['python', 'python', 'jvm', 'jvm', 'node', 'node'], CAST(o_orderkey % 6 + 1 AS INT)) AS ecosystem,
           element_at(LIST['requests', 'pyjwt', 'log4j-core', 'commons-text', 'lodash', 'semver'], CAST(o_orderkey % 6 + 1 AS INT)) AS library,
           CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_custkey % 4 AS STRING) || '.' || CAST(o_orderkey % 53 AS STRING) END AS introduced,
           CASE WHEN o_orderkey % 997 = 0 THEN NULL
                ELSE CAST(o_custkey % 4 AS STRING) || '.' || CAST(o_orderkey % 53 + o_custkey % 3 AS STRING) || '.' || CAST(o_custkey % 5 AS STRING) END AS fixed,
           'ADV-' || CAST(o_orderkey AS STRING) AS advisory,
           element_at(LIST['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'UNKNOWN'], CAST(o_custkey % 5 + 1 AS INT)) AS severity
    FROM @orders
"""

REPO_FILES_SQL = """
    SELECT source AS repo, 'lib/mod_' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 13 = 0 THEN '.md' ELSE '.py' END AS path,
           'import src' || CAST((doc_id * 3 + 1) % 20 AS STRING) || NL ||
           'from src' || CAST((doc_id * 7 + 2) % 20 AS STRING) || '-extra import helper' || NL ||
           'def ' || name_a || '(x):' || NL || '    return ' || name_b || ' (x)' || NL ||
           CASE WHEN doc_id % 5 = 0 THEN 'def main():' || NL || '    main()' || NL ELSE '' END || text AS content
    FROM (SELECT doc_id, source, text, chr(10) AS NL,
                 CASE WHEN doc_id % 11 = 0 THEN 'größe_' ELSE 'fn_' END || CAST(doc_id % 97 AS STRING) AS name_a,
                 CASE WHEN doc_id % 7 = 0 THEN 'größe_' ELSE 'fn_' END || CAST((doc_id * 5 + 11) % 89 AS STRING) AS name_b
          FROM @documents) keys
"""


# Tool calls: an event is a call, its user the session. Some calls carry a signature.
TOOL_CALLS_SQL = """
    SELECT 'sess-' || CAST(user_id AS STRING) AS session_id, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
           element_at(LIST['search_agent', 'story_agent', 'impact_agent', 'task_breakdown_agent', 'coding_agent', NULL, 'rogue_agent'], CAST(event_id % 7 + 1 AS INT)) AS agent,
           CASE WHEN event_type = 'error' THEN element_at(LIST['execute_sandbox', 'run_sandbox', 'apply_git_diff', 'commit_changes'], CAST(event_id % 4 + 1 AS INT))
                WHEN event_type = 'view' THEN element_at(LIST['query_spanner_graph', 'search_vector_db', 'list_resources'], CAST(event_id % 3 + 1 AS INT))
                WHEN event_type = 'click' THEN element_at(LIST['fetch_epic', 'get_requirements', 'scan_call_graph'], CAST(event_id % 3 + 1 AS INT))
                WHEN event_type = 'signup' THEN element_at(LIST['create_jira_ticket', 'order_tasks', 'execute_command'], CAST(event_id % 3 + 1 AS INT))
                ELSE 'run_unit_tests' END AS tool,
           props AS arg1,
           CASE WHEN event_type = 'error' AND event_id % 37 = 0 THEN 'sudo rm -rf /data/' || CAST(event_id AS STRING)
                WHEN event_type = 'view' AND event_id % 211 = 0 THEN 'load malicious_payload and adversarial_vibes'
                ELSE 'ls ' || CAST(event_id AS STRING) END AS arg2
    FROM @events
"""
VERDICTS_SQL = """
    SELECT 'sess-' || CAST(user_id AS STRING) AS session_id, event_id AS seq,
           CASE WHEN event_id % 5 < 3 THEN 'APPROVED' ELSE 'DENIED' END AS decision
    FROM @events WHERE event_id % 4 <> 1
"""


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_args(run(spark, sf_dir, TOOL_CALLS_SQL))


def with_args(calls: DataFrame) -> DataFrame:
    args = F.create_map(F.lit("props"), F.col("arg1"), F.lit("command"), F.col("arg2"))
    return calls.withColumn("args", args).drop("arg1", "arg2")


# Spans: an event is a span, user and day make the trace; each trace has a root that ends last.
SPAN_ROWS_SQL = """
    SELECT 'tr-' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS trace_id,
           'sp-' || CAST(event_id AS STRING) AS span_id,
           'root-' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS parent_id,
           CASE WHEN event_type IN ('error', 'signup') THEN 'agent.tool' WHEN event_type = 'purchase' THEN 'call generate_content'
                ELSE 'agent.think' END AS name,
           CASE WHEN event_type = 'error' AND value > 60 THEN 'ERROR' ELSE 'OK' END AS status,
           CAST(ts AS TIMESTAMP) AS start_ts,
           timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) + CAST(FLOOR(value * 1000000) AS BIGINT)) AS end_ts,
           CASE WHEN event_type = 'error' THEN 'execute_sandbox' WHEN event_type = 'signup' THEN 'fetch_epic' END AS tool_name,
           CASE WHEN event_id % 97 = 0 THEN 'true' WHEN event_id % 13 = 0 THEN 'False' END AS policy_violation,
           CASE WHEN event_id % 101 = 0 THEN 'QUARANTINED' WHEN event_id % 3 = 0 THEN 'OK' END AS agent_status,
           CASE WHEN event_type = 'error' AND event_id % 58 = 0 THEN 'app.SecurityAnomalyException'
                WHEN event_type = 'error' AND event_id % 29 = 0 THEN 'ValueError' END AS exception_type
    FROM @events
"""
ROOT_ROWS_SQL = f"""
    SELECT trace_id, min(parent_id) AS span_id, CAST(NULL AS STRING) AS parent_id, 'agent.session' AS name, 'OK' AS status,
           min(start_ts) AS start_ts,
           timestamp_micros(max(unix_micros(end_ts)) + 1000000) AS end_ts,
           CAST(NULL AS STRING) AS tool_name, CAST(NULL AS STRING) AS policy_violation,
           CAST(NULL AS STRING) AS agent_status, CAST(NULL AS STRING) AS exception_type
    FROM ({SPAN_ROWS_SQL}) s GROUP BY trace_id
"""
SPANS_SQL = f"{SPAN_ROWS_SQL} UNION ALL {ROOT_ROWS_SQL}"


def as_spans(rows: DataFrame) -> DataFrame:
    named = [("tool.name", "tool_name"), ("policy_violation", "policy_violation"), ("agent_status", "agent_status")]
    pairs = F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in named]),
        lambda p: p["v"].isNotNull(),
    )
    exception = F.struct(
        F.lit("exception").alias("name"),
        F.create_map(F.lit("exception.type"), F.col("exception_type")).alias("attributes"),
    )
    events = F.when(F.col("exception_type").isNotNull(), F.array(exception)).otherwise(
        F.array().cast("array<struct<name:string,attributes:map<string,string>>>")
    )
    return rows.select(
        "trace_id", "span_id", "parent_id", "name", "status", "start_ts", "end_ts",
        F.map_from_entries(pairs).alias("attributes"), events.alias("events"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_spans(run(spark, sf_dir, SPANS_SQL))


# Failed sessions: a document is a session log; its labels and key give the status.
FAILURES_SQL = """
    SELECT 's-' || CAST(d.doc_id AS STRING) AS session_id, d.doc_id AS doc_id,
           CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 0 THEN 'abandoned' WHEN l.quality = 1 THEN 'ok'
                WHEN d.doc_id % 3 = 0 THEN 'correction' WHEN d.doc_id % 3 = 1 THEN 'failed' ELSE 'running' END AS status,
           d.text || CASE WHEN d.doc_id % 7 = 0 THEN ' hit the Rate limit' WHEN d.doc_id % 7 = 1 THEN ' gating says eval'
                          WHEN d.doc_id % 7 = 2 THEN ' injection payload' ELSE '' END AS text
    FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id
"""

# Patch cases and candidates: a part is a case.
PATCH_CASES_SQL = """
    SELECT 'case-' || CAST(p_partkey AS STRING) AS case_id, p_partkey,
           'import os' || NL || 'def run_' || CAST(p_partkey AS STRING) || '(x):' || NL || '    # ' || p_name || NL ||
           CASE WHEN p_partkey % 4 = 0 THEN '    eval(x)' WHEN p_partkey % 4 = 1 THEN '    os.system(x); Exec(x)'
                WHEN p_partkey % 4 = 2 THEN '    subprocess.run(x)' ELSE '    y = x' END || NL ||
           '    return ' || CAST(p_size AS STRING) || CASE WHEN p_partkey % 5 = 0 THEN NL ELSE '' END AS original_code,
           element_at(LIST['AST Gating Violation: Use of prohibited function eval is blocked.', 'Untrusted input flows: taint reaches subprocess sink',
                           'Egress Governance Violation: unapproved host', 'naming convention broken', 'nothing known at all', ''],
                      CAST(p_partkey % 6 + 1 AS INT)) AS error_trace,
           CASE WHEN p_partkey % 8 = 0 THEN '' ELSE 'f' || CAST(p_partkey AS STRING) || '.py' END AS context
    FROM (SELECT p_partkey, p_name, p_size, chr(10) AS NL FROM @part) keys
"""
PATCH_CANDIDATES_SQL = f"""
    SELECT case_id, candidate_no, 'model-' || CAST(candidate_no AS STRING) AS model_label, original_code, error_trace,
           CASE WHEN candidate_no = 1 THEN replace(replace(original_code, 'eval(', 'parse('), 'os.system(', 'call(')
                WHEN candidate_no = 2 THEN original_code ELSE '# gone' || chr(10) || 'pass' END AS patched_code,
           CASE WHEN candidate_no = 1 THEN 'Removed the prohibited function eval and the tainted input that flows to the subprocess sink; the violation is blocked.'
                WHEN candidate_no = 2 THEN 'No explanation provided.' ELSE 'Short naming fix ' || case_id END AS explanation,
           element_at(LIST['CRITICAL', 'high', 'MEDIUM', 'LOW', 'severe', ''], CAST((p_partkey + candidate_no) % 6 + 1 AS INT)) AS severity
    FROM (SELECT *, EXPLODE[1, 2, 3] AS candidate_no FROM ({PATCH_CASES_SQL}) cases) c
    WHERE candidate_no < 3 OR p_partkey % 2 = 0
"""

# Agent events: a conversation is a run, its turns the events; some turns carry a finding line.
AGENT_EVENTS_SQL = """
    SELECT conv_id AS report_id, turn AS event_no, role,
           CASE WHEN (conv_id + turn) % 9 = 0 THEN NULL
                ELSE text || NL || element_at(LIST[
                    'AST Gating Violation: Use of prohibited function ''eval'' is blocked.',
                    'Security Policy Violation: structural policy denied', 'Dynamic Taint Gating Violation: x flows to dangerous sink',
                    'Possible SQL Injection in src/db/query.py line 4', 'Weak hashing found at lib/a-b.js', 'Command injection: passed, safe',
                    'SCA Vulnerable Dependency: requests (CVE-2023-32681)', 'CVE-2024-1: none', 'Code smell: TODO left in file x.go',
                    'Hardcoded credentials in config', 'insecure cryptography and JWT token use', 'user enumeration via XSS at web/app.cpp',
                    'All clean.', '  Outdated dependency   '], CAST((conv_id * 5 + turn) % 14 + 1 AS INT)) || NL END AS text_a,
           CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN 'Todo: repeat' || NL END AS text_b
    FROM (SELECT conv_id, turn, role, text, chr(10) AS NL FROM @conversations) c
"""


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(F.struct(F.col("text_a").alias("text")), F.struct(F.col("text_b").alias("text")))
    return run(spark, sf_dir, AGENT_EVENTS_SQL).select("report_id", "event_no", "role", parts.alias("parts"))


# Evaluation cases: a turn of a conversation is a recorded run of three events.
EVAL_ROWS_SQL = """
    SELECT conv_id, turn, element_at(LIST['clean_search_flow', 'rbac_gating_violation', 'adversarial_sandbox_injection', 'context_hygiene_pii_masking', 'free_form'],
                      CAST((conv_id + turn * 3) % 5 + 1 AS INT)) AS eval_case_id,
           text || CASE WHEN (conv_id + turn) % 4 = 0 THEN ' agent_status=QUARANTINED' WHEN (conv_id + turn) % 4 = 1 THEN ' blocked_by_rbac=True'
                        WHEN (conv_id + turn) % 4 = 2 THEN ' [[EMAIL_1]]' ELSE ' mail ops@example.com' END AS text_a,
           CASE WHEN conv_id % 3 = 0 THEN 'get_search_tool' ELSE 'other_tool' END AS tool,
           CASE WHEN conv_id % 7 < 2 THEN 'Security Anomaly: stopped' WHEN conv_id % 7 < 4 THEN 'RBAC Policy Violation: no'
                WHEN conv_id % 7 = 4 THEN 'Quarantined' ELSE 'done' END AS answer,
           CASE WHEN turn % 2 = 0 THEN 'remediation_triggered=True' ELSE '' END AS text_b
    FROM @conversations
"""


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, EVAL_ROWS_SQL)
    call = "struct<name:string,args:map<string,string>>"
    answer = "struct<name:string,response:map<string,string>>"

    def part(text=None, called=None, answered=None):
        return F.struct(
            (text if text is not None else F.lit(None).cast("string")).alias("text"),
            (called if called is not None else F.lit(None).cast(call)).alias("function_call"),
            (answered if answered is not None else F.lit(None).cast(answer)).alias("function_response"),
        )

    def event(author, *parts):
        content = F.struct(F.lit("model").alias("role"), F.array(*parts).alias("parts"))
        return F.struct(F.lit(author).alias("author"), content.alias("content"))

    called = F.struct(F.col("tool").alias("name"), F.create_map(F.lit("q"), F.lit("x")).alias("args"))
    answered = F.struct(F.col("tool").alias("name"), F.create_map(F.lit("error"), F.col("answer")).alias("response"))
    turn = F.struct(
        F.lit(0).cast("bigint").alias("turn_index"),
        F.array(
            event("user", part(text=F.col("text_a"))),
            event("agent", part(called=called.cast(call)), part(answered=answered.cast(answer))),
            event("agent", part(text=F.col("text_b"))),
        ).alias("events"),
    )
    return rows.select(
        "conv_id", "turn", "eval_case_id", F.struct(F.array(turn).alias("turns")).alias("agent_data")
    )


# User feedback and webhook payloads: an event is one of each.
FEEDBACK_SQL = """
    SELECT event_id,
           CASE WHEN event_id % 10 = 0 THEN 'great' WHEN event_id % 10 = 1 THEN NULL WHEN event_id % 10 = 2 THEN CAST(event_id % 5 AS STRING)
                ELSE CAST(value AS STRING) END AS score,
           CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS text,
           CASE WHEN event_id % 23 = 0 THEN 'other' WHEN event_id % 3 = 0 THEN 'feedback' END AS log_type,
           CASE WHEN event_id % 29 = 0 THEN 'billing' WHEN event_id % 5 = 0 THEN 'audit-service' END AS service_name,
           'u' || CAST(user_id AS STRING) AS user_id, 's' || CAST(event_id AS STRING) AS session_id
    FROM @events
"""
WEBHOOK_SQL = """
    SELECT event_id,
           CASE WHEN event_id % 6 = 0 THEN '{}'
                WHEN event_id % 6 = 1 THEN '{"number": ' || CAST(event_id AS STRING) || '}'
                WHEN event_id % 6 = 2 THEN '{"repository": {"clone_url": ""}, "pull_request": {}}'
                ELSE '{"number": ' || CAST(event_id AS STRING) || ', "pull_request": {"title": "' || event_type || ' fix"}, "repository": {"clone_url": "https://host.example/org/repo'
                     || CAST(user_id AS STRING) || CASE WHEN event_id % 2 = 0 THEN '.git' ELSE '' END || '"}, "extra": 1}' END AS payload
    FROM @events
"""

# Review outcomes: a patch candidate is an outcome.
OUTCOMES_SQL = f"""
    SELECT case_id, candidate_no, timestamp_micros(1717200000000000 + candidate_no * 1000000) AS timestamp,
           original_code AS insecure_code, error_trace, patched_code AS proposed_patch,
           explanation || CASE WHEN candidate_no = 1 THEN ' é "quoted" ' ELSE '' END AS explanation, severity,
           candidate_no = 1 AS accepted,
           CASE WHEN candidate_no = 2 THEN 'looks fine' END AS developer_comment,
           CASE WHEN candidate_no = 1 THEN '' WHEN candidate_no = 2 THEN model_label END AS model_used
    FROM ({PATCH_CANDIDATES_SQL}) p
"""

# Programs: a part is a program of six statements, whose kinds, names and hosts follow from its keys; one in thirteen does
# not parse. Kinds: 0 read input, 1 copy, 2 sanitise, 3 read an argument, 4 run, 5 evaluate, 6 and 7 request, 8 swallow, 9 other.
GATE_STATEMENTS = range(1, 7)
_BROKEN = "p_partkey % 13 = 0"


def _gate_parts(i: int) -> dict[str, str]:
    return {
        "kind": f"(p_partkey * {7 * i + 3} + p_size * {i} + {i * i}) % 10",
        "a": f"'v' || CAST((p_partkey + p_size * {i}) % 3 AS STRING)",
        "b": f"'v' || CAST((p_partkey + {i}) % 3 AS STRING)",
        "host": f"CASE WHEN (p_partkey + {i}) % 3 = 0 THEN 'api.github.com' ELSE 'h' || CAST(p_partkey % 7 AS STRING) || '.example' END",
    }


_STATEMENT_SQL = """
    CASE kind WHEN 0 THEN a || ' = input()' WHEN 1 THEN a || ' = ' || b WHEN 2 THEN a || ' = int(' || b || ')' WHEN 3 THEN a || ' = sys.argv[1]'
        WHEN 4 THEN 'os.system(' || a || ')' WHEN 5 THEN 'eval(' || a || ')' WHEN 6 THEN 'requests.get("https://' || host || '/x")'
        WHEN 7 THEN 'requests.post(' || a || ')' WHEN 8 THEN 'try:' || chr(10) || '    f()' || chr(10) || 'except:' || chr(10) || '    pass'
        ELSE 'x = 1' END || chr(10)
"""


def gate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = dealt(spark, sf_dir, "part")
    text = F.lit("import os, sys, requests\n")
    for i in GATE_STATEMENTS:
        statement = _STATEMENT_SQL
        for name, value in _gate_parts(i).items():
            statement = re.sub(rf"\b{name}\b", f"({value})", statement)
        text = F.concat(text, F.expr(statement))
    return parts.select(
        F.concat(F.lit("gate/part_"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"),
        F.when(F.expr(_BROKEN), F.lit("def broken(:\n    pass\n")).otherwise(text).alias("content"),
    )


def _fact(kind: str, line: str = "line", **fields: str) -> str:
    empty = {
        "target": "NULL::VARCHAR", "value_kind": "NULL::VARCHAR", "value_name": "NULL::VARCHAR", "func": "NULL::VARCHAR",
        "names": "NULL::VARCHAR[]", "first_kind": "NULL::VARCHAR", "first_value": "NULL::VARCHAR",
    }
    return f"{{'kind': '{kind}', 'lineno': CAST({line} AS INT), " + ", ".join(f"'{k}': {fields.get(k, v)}" for k, v in empty.items()) + "}"


def _assigned(value_kind: str, value_name: str = "NULL::VARCHAR", target: str = "a") -> str:
    return _fact("assign", target=target, value_kind=f"'{value_kind}'", value_name=value_name)


def _called(func: str, names: str = "[]::VARCHAR[]", first: str = "NULL::VARCHAR", value: str = "NULL::VARCHAR", line: str = "line") -> str:
    return _fact("call", line, func=f"'{func}'", names=names, first_kind=first, first_value=value)


# What each kind of statement is made of, in visiting order.
_FACTS_OF = [
    [_assigned("call", "'input'"), _called("input")],
    [_assigned("name", "b")],
    [_assigned("call", "'int'"), _called("int", "[b]", "'other'")],
    [_assigned("argv")],
    [_called("os.system", "[a]", "'other'")],
    [_called("eval", "[a]", "'other'")],
    [_called("requests.get", first="'text'", value="'https://' || host || '/x'")],
    [_called("requests.post", "[a]", "'other'")],
    [_called("f", line="line + 1"), _fact("except", "line + 2")],
    [_assigned("other", target="'x'")],
]
_GATE_CTE = f"""
    picked AS ({' UNION ALL '.join(f"SELECT p_partkey, {i} AS i, " + ', '.join(f'{v} AS {k}' for k, v in _gate_parts(i).items()) + f' FROM part WHERE NOT {_BROKEN}' for i in GATE_STATEMENTS)}),
    placed AS (SELECT *, 2 + coalesce(sum(CASE WHEN kind = 8 THEN 4 ELSE 1 END) OVER (PARTITION BY p_partkey ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM picked)
"""
GATE_FACTS_DUCKDB = f"""
    WITH {_GATE_CTE}
    SELECT 'gate/part_' || CAST(p_partkey AS VARCHAR) || '.py' AS path, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i, j) - 1 AS INT) AS seq,
        f.kind, f.lineno, f.target, f.value_kind, f.value_name, f.func, array_to_string(f.names, ',') AS names, f.first_kind, f.first_value, CAST(NULL AS VARCHAR) AS message
    FROM (SELECT p_partkey, i, unnest(facts) AS f, generate_subscripts(facts, 1) AS j
          FROM (SELECT *, CASE kind {' '.join(f"WHEN {k} THEN [{', '.join(facts)}]" for k, facts in enumerate(_FACTS_OF))} END AS facts FROM placed) p) u
    UNION ALL
    SELECT 'gate/part_' || CAST(p_partkey AS VARCHAR) || '.py', 0, 'syntax_error', 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'invalid syntax' FROM part WHERE {_BROKEN}
"""


def _tainted(func: str) -> str:
    message = f"'Dynamic Taint Gating Violation: Untrusted input variable ''' || a || ''' flows to dangerous sink ''{func}'' without sanitization.'"
    return f"CASE WHEN list_contains(tainted, a) AND NOT list_contains(clean, a) THEN [{message}] ELSE [] END"


# The errors follow from the statements: taint step by step, the rest by kind.
GATE_ERRORS_DUCKDB = f"""
    WITH RECURSIVE {_GATE_CTE},
    flow AS (
        SELECT p_partkey, 0 AS i, []::VARCHAR[] AS tainted, []::VARCHAR[] AS clean, []::VARCHAR[] AS errors FROM part WHERE NOT {_BROKEN}
        UNION ALL
        SELECT p.p_partkey, p.i,
            CASE WHEN kind IN (0, 3) OR (kind = 1 AND list_contains(tainted, b)) THEN list_append(tainted, a)
                 WHEN kind IN (1, 2) THEN list_filter(tainted, lambda t: t <> a) ELSE tainted END,
            CASE WHEN kind = 2 THEN list_append(clean, a) ELSE clean END,
            list_concat(errors, CASE kind WHEN 4 THEN {_tainted('os.system')}
                WHEN 5 THEN list_concat(['AST Gating Violation: Use of prohibited function ''eval'' is blocked.'], {_tainted('eval')}) ELSE [] END)
        FROM flow f JOIN placed p ON p.p_partkey = f.p_partkey AND p.i = f.i + 1
    ),
    found AS (
        SELECT p_partkey, 0 AS part, i AS place, 'Lint Warning: Empty exception catch block at line ' || CAST(line + 2 AS INT) || ' is discouraged.' AS error FROM placed WHERE kind = 8
        UNION ALL SELECT p_partkey, 1, generate_subscripts(errors, 1), unnest(errors) FROM flow WHERE i = 6
        UNION ALL SELECT p_partkey, 2, i, 'Egress Governance Violation: Outbound request to unapproved host ''' || host || ''' is blocked to prevent indirect prompt injection.'
            FROM placed WHERE kind = 6 AND host <> 'api.github.com'
        UNION ALL SELECT p_partkey, 2, i, 'Egress Governance Violation: Dynamic/variable network destination in ''requests.post'' cannot be verified and is blocked.' FROM placed WHERE kind = 7
        UNION ALL SELECT p_partkey, 0, 0, 'Lint/Syntax Error in gate/part_' || CAST(p_partkey AS VARCHAR) || '.py:1: invalid syntax' FROM part WHERE {_BROKEN}
    )
    SELECT 'gate/part_' || CAST(p_partkey AS VARCHAR) || '.py' AS path, row_number() OVER (PARTITION BY p_partkey ORDER BY part, place) AS error_no, error FROM found
"""

# Commands: an order is a command that names a script by its customer key, or holds inline code.
COMMANDS_SQL = """
    SELECT o_orderkey AS command_id,
           CASE WHEN o_orderkey % 4 = 0 THEN 'ls -l /data'
                WHEN o_orderkey % 4 = 1 THEN 'python3 -c "eval(1)" && echo ok'
                WHEN o_orderkey % 4 = 2 THEN 'python gate/part_' || CAST(o_custkey AS STRING) || '.py --fast'
                ELSE 'cat a.txt; python gate/part_' || CAST(o_custkey AS STRING) || '.py gate/missing.py' END AS command
    FROM @orders
"""

# Agent steps for the transition report: events in session order.
AGENT_STEPS_SQL = """
    SELECT 'sess-' || CAST(user_id AS STRING) AS session_id, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
           element_at(LIST['search_agent', 'story_agent', 'impact_agent', 'task_breakdown_agent', 'coding_agent', NULL],
                      CAST((event_id + length(event_type)) % 6 + 1 AS INT)) AS agent
    FROM @events
"""
