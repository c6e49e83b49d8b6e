import datetime as dt

from auditloom.operators import policy, traces
from auditloom.schemas import SPAN_SCHEMA, TOOL_CALL_SCHEMA
from auditloom.session import scratch_path
from auditloom.streaming import quarantine, run, tail_sampling

T0 = dt.datetime(2024, 1, 1)


def _calls(spark):
    def call(session, seq, agent, tool, arg):
        return (session, seq, T0 + dt.timedelta(seconds=seq), agent, tool, {"x": arg})

    return spark.createDataFrame(
        [
            call("a", 1, "coding_agent", "execute_sandbox", "ls"),
            call("a", 2, "coding_agent", "execute_sandbox", "rm -rf /"),
            call("a", 3, "coding_agent", "execute_sandbox", "ls"),
            call("b", 1, "search_agent", "query_spanner_graph", "q"),
            call("b", 2, "search_agent", "execute_sandbox", "q"),
            call("b", 3, None, "execute_sandbox", "q"),
            call("b", 4, "nobody", "order_tasks", "q"),
            call("c", 1, "search_agent", "execute_sandbox", "run adversarial_vibes"),
        ],
        TOOL_CALL_SCHEMA,
    )


WANT = {
    ("a", 1): "ALLOW", ("a", 2): "ANOMALY", ("a", 3): "QUARANTINED", ("b", 1): "ALLOW", ("b", 2): "RBAC_BLOCK",
    ("b", 3): "ALLOW", ("b", 4): "RBAC_BLOCK", ("c", 1): "ANOMALY",
}


def test_decisions(spark):
    decided = policy.tool_call_decisions(_calls(spark), policy.policy_table(spark))
    assert {(r["session_id"], r["seq"]): r["decision"] for r in decided.collect()} == WANT
    flags = {r["session_id"]: r for r in policy.session_policy_flags(decided).collect()}
    assert flags["a"]["quarantined"] and not flags["a"]["blocked_by_rbac"]
    assert flags["b"]["policy_violation"] and not flags["b"]["quarantined"]


def test_missing_verdict_denies(spark):
    calls = _calls(spark).withColumn("tool", __import__("pyspark").sql.functions.lit("execute_command"))
    verdicts = spark.createDataFrame([("a", 1, "APPROVED")], "session_id STRING, seq BIGINT, decision STRING")
    rows = {(r["session_id"], r["seq"]): r["approved"] for r in policy.needs_semantic_review(calls, verdicts).collect()}
    assert rows[("a", 1)] and not rows[("b", 1)]


def test_stream_quarantine_over_several_triggers(spark):
    path = scratch_path(spark, "calls")
    for seq in (1, 2, 3, 4):
        _calls(spark).filter(f"seq = {seq}").coalesce(1).write.mode("append").parquet(path)
    stream = run.read_stream(spark, path, TOOL_CALL_SCHEMA, files_per_trigger=1)
    out = run.run_available(quarantine.stream_quarantine(stream, policy.policy_table(spark)))
    assert {(r["session_id"], r["seq"]): r["decision"] for r in out.collect()} == WANT


def _span(trace, span, parent, name="agent.think", status="OK", attributes=None, events=()):
    at = T0 + dt.timedelta(seconds=ord(span[0]))
    return (trace, span, parent, name, status, at, at + dt.timedelta(seconds=1, microseconds=7), attributes or {}, list(events))


def _spans(spark):
    tool = {"tool.name": "execute_sandbox"}
    rows = [
        _span("ok", "a", "z"), _span("ok", "z", None, attributes={"policy_violation": "False"}),
        _span("error", "a", "z", status="ERROR"), _span("error", "z", None),
        _span("policy", "a", "z"), _span("policy", "z", None, attributes={"blocked_by_rbac": "True"}),
        _span("exception", "a", "z", events=[("exception", {"exception.type": "X"})]), _span("exception", "z", None),
        *[_span("tools", c, "z", "agent.tool", attributes=tool) for c in "abc"], _span("tools", "z", None),
        *[_span("models", c, "z", "call generate_content") for c in "abc"], _span("models", "z", None),
        *[_span("two", c, "z", "agent.tool", attributes=tool) for c in "ab"], _span("two", "z", None),
        _span("rootless", "a", "z", status="ERROR"),
    ]
    return spark.createDataFrame(rows, SPAN_SCHEMA)


KEPT = {"error": "error", "policy": "policy", "exception": "error", "tools": "self_repair", "models": "self_repair"}


def test_trace_retention(spark):
    rows = {r["trace_id"]: r for r in traces.trace_retention(_spans(spark)).collect()}
    assert {t: r["reason"] for t, r in rows.items() if r["retained"]} == KEPT
    assert rows["ok"]["reason"] == rows["two"]["reason"] == "routine" and rows["rootless"]["reason"] == "no_root"


def test_stream_tail_sampling_equals_batch(spark):
    spans = _spans(spark)
    path = scratch_path(spark, "spans")
    spans.filter("parent_id IS NOT NULL").coalesce(1).write.mode("append").parquet(path)
    spans.filter("parent_id IS NULL").coalesce(1).write.mode("append").parquet(path)
    stream = run.read_stream(spark, path, SPAN_SCHEMA, files_per_trigger=1)
    out = run.run_available(tail_sampling.stream_tail_sampling(stream))
    columns = ["trace_id", "span_id", "name", "status", "start_ts", "end_ts"]
    got = sorted(map(tuple, out.select(*columns).collect()))
    assert got == sorted(map(tuple, traces.retained_spans(spans).select(*columns).collect()))


def test_sessions_share_a_call_of_the_stream_processor(spark):
    path, buckets = scratch_path(spark, "calls"), 1
    for seq in (1, 2, 3, 4):
        _calls(spark).filter(f"seq = {seq}").replace("c", None, "session_id").coalesce(1).write.mode("append").parquet(path)
    stream = run.read_stream(spark, path, TOOL_CALL_SCHEMA, files_per_trigger=2)
    out = run.run_available(quarantine.stream_quarantine(stream, policy.policy_table(spark), buckets=buckets))
    want = {(s if s != "c" else None, n): d for (s, n), d in WANT.items()}
    rows = out.collect()
    assert {(r["session_id"], r["seq"]): r["decision"] for r in rows} == want and len(rows) == len(want)
    assert {r["offending_args"] for r in rows if r["decision"] == "ANOMALY"} == {'{"x":"rm -rf /"}', '{"x":"run adversarial_vibes"}'}
