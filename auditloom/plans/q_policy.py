"""Tool-call policy and trace retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import policy as ops
from auditloom.operators import traces
from auditloom.plans import bridges as b
from auditloom.session import scratch_path


def _decisions(spark, sf):
    return ops.tool_call_decisions(
        b.tool_calls(spark, sf), ops.policy_table(spark), b.run(spark, sf, b.VERDICTS_SQL)
    )


def _merged_latency(spark, sf):
    """Sketches written by day, read back and merged; the estimate is held against the true ranks."""
    path = scratch_path(spark, "latency")
    spans = b.spans(spark, sf)
    traces.latency_sketches(spans).write.partitionBy("day").parquet(path)
    merged = traces.merged_latency(spark.read.parquet(path), {"p95_ms": 0.95})
    timed = spans.select("name", F.col("attributes")["tool.name"].alias("tool"), F.round((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1000, 3).alias("ms"))
    ranks = timed.alias("t").join(merged.alias("m"), F.col("t.name").eqNullSafe(F.col("m.name")) & F.col("t.tool").eqNullSafe(F.col("m.tool")))
    near = ranks.groupBy("m.name", "m.tool", "spans", "avg_ms", "max_ms").agg(
        ((F.avg((F.col("ms") < F.col("p95_ms")).cast("double")) <= 0.97) & (F.avg((F.col("ms") <= F.col("p95_ms")).cast("double")) >= 0.93)).alias("p95_near")
    )
    return near


_CALL = ["session_id", "seq", "ts", "agent", "tool"]

QUERIES = {
    "rbac_violations": lambda s, d: ops.rbac_violations(b.tool_calls(s, d), ops.policy_table(s)).select(*_CALL),
    "rbac_allowed": lambda s, d: ops.rbac_allowed(b.tool_calls(s, d), ops.policy_table(s)).select(*_CALL),
    "adversarial_signature": lambda s, d: ops.adversarial_signature(b.tool_calls(s, d)).drop("args"),
    "quarantine_status": lambda s, d: ops.quarantine_status(b.tool_calls(s, d)).select(*_CALL, "quarantined"),
    "needs_semantic_review": lambda s, d: ops.needs_semantic_review(
        b.tool_calls(s, d), b.run(s, d, b.VERDICTS_SQL)
    ).drop("args"),
    "tool_call_decisions": _decisions,
    "session_policy_flags": lambda s, d: ops.session_policy_flags(_decisions(s, d)),
    "trace_retention": lambda s, d: traces.trace_retention(b.spans(s, d)),
    "retained_spans": lambda s, d: traces.retained_spans(b.spans(s, d)).select(
        "trace_id", "span_id", "name", "status", "start_ts", "end_ts"
    ),
    "span_latency": lambda s, d: traces.span_latency(b.spans(s, d)),
    "merged_latency": _merged_latency,
}

_POLICY = ", ".join(f"('{a}', '{t}')" for a, tools in ops.DEFAULT_POLICY.items() for t in tools)


def _hit(column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{s}')" for s in ops.SIGNATURES) + ")"


_REVIEWED = ", ".join(f"'{t}'" for t in ops.REVIEWED_TOOLS)
_CTE = f"""
    grants(agent, tool) AS (VALUES {_POLICY}),
    verdicts AS ({b.VERDICTS_SQL}),
    calls AS (SELECT *, CASE WHEN {_hit('arg1')} THEN arg1 WHEN {_hit('arg2')} THEN arg2 END AS bad FROM ({b.TOOL_CALLS_SQL}) c),
    state AS (SELECT *, coalesce(bool_or(bad IS NOT NULL) OVER (
                  PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS quarantined
              FROM calls),
    decided AS (
        SELECT s.session_id, s.seq, s.ts, s.agent, s.tool, s.arg1, s.arg2,
               CASE WHEN quarantined THEN 'QUARANTINED' WHEN bad IS NOT NULL THEN 'ANOMALY'
                    WHEN s.agent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM grants g WHERE g.agent = s.agent AND g.tool = s.tool) THEN 'RBAC_BLOCK'
                    WHEN s.agent IS NOT NULL AND s.tool IN ({_REVIEWED}) AND coalesce(v.decision, 'DENIED') <> 'APPROVED' THEN 'SEMANTIC_BLOCK'
                    ELSE 'ALLOW' END AS decision, bad
        FROM state s LEFT JOIN verdicts v ON v.session_id = s.session_id AND v.seq = s.seq),
    spans AS ({b.SPANS_SQL}),
    kept AS (
        SELECT trace_id, reason IN ('error', 'policy', 'self_repair') AS retained, reason, sandbox_calls, model_calls, spans
        FROM (SELECT trace_id, sandbox_calls, model_calls, spans,
                     CASE WHEN NOT rooted THEN 'no_root' WHEN err THEN 'error' WHEN pol THEN 'policy'
                          WHEN sandbox_calls >= 3 OR model_calls >= 3 THEN 'self_repair' ELSE 'routine' END AS reason
              FROM (SELECT trace_id, bool_or(parent_id IS NULL) AS rooted,
                           bool_or(status = 'ERROR' OR exception_type IS NOT NULL) AS err,
                           bool_or(coalesce(policy_violation = 'true', false) OR coalesce(agent_status = 'QUARANTINED', false)) AS pol,
                           count(*) FILTER (WHERE name = 'agent.tool' AND tool_name = 'execute_sandbox') AS sandbox_calls,
                           count(*) FILTER (WHERE contains(name, 'generate_content')) AS model_calls,
                           count(*) AS spans
                    FROM spans GROUP BY trace_id) f) r),
    timed AS (SELECT name, tool_name AS tool, epoch_us(end_ts) - epoch_us(start_ts) AS us FROM spans)
"""


def _sql(body: str) -> str:
    return b.for_duckdb(f"WITH {_CTE} {body}")


_C = ", ".join(_CALL)
_ANOMALY = """
    CASE WHEN decision = 'ANOMALY' THEN bad END AS offending_value, CASE WHEN decision = 'ANOMALY' THEN tool END AS offending_tool,
    CASE WHEN decision = 'ANOMALY' THEN CAST(json_object('props', arg1, 'command', arg2) AS VARCHAR) END AS offending_args,
    CASE WHEN decision = 'ANOMALY' THEN concat('Blue Team detected adversarial payload in tool ''', tool, ''': ''', bad, '''') END AS error_trace
"""
ORACLE = {
    "rbac_violations": _sql(
        f"SELECT {_C} FROM calls c WHERE agent IS NOT NULL AND NOT EXISTS "
        "(SELECT 1 FROM grants g WHERE g.agent = c.agent AND g.tool = c.tool)"
    ),
    "rbac_allowed": _sql(
        f"SELECT {_C} FROM calls c WHERE agent IS NULL OR EXISTS (SELECT 1 FROM grants g WHERE g.agent = c.agent AND g.tool = c.tool)"
    ),
    "adversarial_signature": _sql(
        f"SELECT {_C}, bad AS offending_value, CASE "
        + " ".join(f"WHEN contains(bad, '{s}') THEN '{s}'" for s in ops.SIGNATURES)
        + " END AS signature FROM calls WHERE bad IS NOT NULL"
    ),
    "quarantine_status": _sql(f"SELECT {_C}, quarantined FROM state"),
    "needs_semantic_review": _sql(
        f"SELECT c.session_id, c.seq, c.ts, c.agent, c.tool, v.decision, coalesce(v.decision = 'APPROVED', false) AS approved "
        f"FROM calls c LEFT JOIN verdicts v ON v.session_id = c.session_id AND v.seq = c.seq WHERE tool IN ({_REVIEWED})"
    ),
    "tool_call_decisions": _sql(
        f"SELECT {_C}, decision, {_ANOMALY} FROM decided"
    ),
    "session_policy_flags": _sql(
        "SELECT session_id, bool_or(decision = 'ANOMALY') AS quarantined, bool_or(decision = 'ANOMALY') AS remediation_triggered, "
        "bool_or(decision = 'RBAC_BLOCK') AS blocked_by_rbac, bool_or(decision IN ('ANOMALY', 'RBAC_BLOCK')) AS policy_violation "
        "FROM decided GROUP BY session_id"
    ),
    "trace_retention": _sql("SELECT * FROM kept"),
    "retained_spans": _sql(
        "SELECT trace_id, span_id, name, status, start_ts, end_ts FROM spans "
        "WHERE trace_id IN (SELECT trace_id FROM kept WHERE retained)"
    ),
    "merged_latency": _sql(
        "SELECT name, tool, count(*) AS spans, round(sum(us) / count(*) / 1000, 3) AS avg_ms, round(max(us) / 1000, 3) AS max_ms, true AS p95_near "
        "FROM timed GROUP BY name, tool"
    ),
    "span_latency": _sql(
        "SELECT name, tool, count(*) AS spans, round(sum(us) / count(*) / 1000, 3) AS avg_ms, round(max(us) / 1000, 3) AS max_ms, "
        "round(quantile_disc(us, 0.95) / 1000, 3) AS p95_ms FROM timed GROUP BY name, tool"
    ),
}
