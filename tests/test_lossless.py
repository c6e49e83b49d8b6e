"""Nothing is cut short: reach, reads, lookups, and streams with late or rootless rows."""

import time

import pytest

from auditloom.operators import evals, graph, policy, traces
from auditloom.schemas import SPAN_SCHEMA
from auditloom.session import scratch_path
from auditloom.sources import readers
from auditloom.streaming import run, tail_sampling
from test_policy_traces import _calls, _span


def test_reach_follows_a_long_chain_and_raises_at_a_limit(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(25)] + [("n3", "n0")], "source STRING, target STRING")
    seeds = spark.createDataFrame([("n0",)], "node STRING")
    assert {r["node"]: r["depth"] for r in graph.callgraph_reach(edges, seeds).collect()} == {f"n{i}": i for i in range(26)}
    with pytest.raises(graph.DepthExceeded):
        graph.callgraph_reach(edges, seeds, max_depth=3)


def test_names_of_all_scripts(spark):
    files = spark.createDataFrame(
        [("größe", "größe/a.py", "def café(x): pass\nдоля (1)\n"), ("b", "b/b.py", "import größe.sub\ncafé(2)\ndef доля(y): pass")],
        "repo STRING, path STRING, content STRING",
    )
    assert {r["func"] for r in graph.function_defs(files).collect()} == {"café", "доля"}
    assert {r["func"] for r in graph.call_tokens(files).collect()} == {"café", "доля"}
    assert {(r["source_repo"], r["target_repo"]) for r in graph.repo_import_edges(files).collect()} == {("b", "größe")}
    assert graph.cross_repo_call_edges(files).count() == 2


def test_source_tree_with_odd_names(spark, tmp_path):
    root = tmp_path / "node_modules" / "a b%41+ü"
    for name, data in {
        "r one/a b.py": b"x\n", "r one/pct%41.py": b"y\n", "r one/ü+z.py": "ü�".encode() + b"\xff", "r one/.git/no.py": b"n", "r2/p.png": b"n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    want = [("r one", "r one/a b.py", "x\n"), ("r one", "r one/pct%41.py", "y\n"), ("r one", "r one/ü+z.py", "ü�")]
    assert sorted(map(tuple, readers.read_source_tree(spark, str(root)).collect())) == want


def test_rejected_lines_are_returned(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"role": "user", "index": 0, "parts": []}\n' + '{"role"\n' * 1200)
    assert readers.read_completions(spark, str(tmp_path)).count() == 1
    assert readers.rejected_completions(spark, str(tmp_path)).count() == 1200


def test_lookups_do_not_shuffle_the_calls(spark):
    grants = policy.policy_table(spark)
    calls = _calls(spark)
    frames = [policy.rbac_violations(calls, grants), policy.rbac_allowed(calls, grants)]
    for frame in frames:
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(agent" not in plan.split("BroadcastExchange")[0]
    assert sum(f.count() for f in frames) == calls.count()
    steps = spark.createDataFrame([("s", "a", "b")], "session_id STRING, from_agent STRING, to_agent STRING")
    assert "hashpartitioning(from_agent" not in evals.transition_conformance(steps)._jdf.queryExecution().executedPlan().toString()


def _files(spark, *groups):
    path = scratch_path(spark, "spans")
    for rows in groups:
        spark.createDataFrame(rows, SPAN_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return run.read_stream(spark, path, SPAN_SCHEMA, files_per_trigger=1)


def test_late_spans_follow_the_verdict_of_their_trace(spark):
    first = [_span("bad", "a", "z", status="ERROR"), _span("ok", "a", "z"), _span("late", "a", "z", status="ERROR")]
    roots = [_span("bad", "z", None), _span("ok", "z", None)]
    after = [_span("bad", "b", "z"), _span("ok", "b", "z", status="ERROR"), _span("late", "z", None)]
    out = run.run_available(tail_sampling.stream_tail_outcomes(_files(spark, first, roots, after)))
    got = {(r["trace_id"], r["span_id"]): r["outcome"] for r in out.collect()}
    assert got == {
        **{("bad", s): "kept" for s in "abz"}, **{("ok", s): "dropped" for s in "abz"}, **{("late", s): "kept" for s in "az"},
    }
    assert traces.retained_spans(spark.createDataFrame(first + roots + after[:1] + after[2:], SPAN_SCHEMA)).count() == 5


def test_spans_without_a_root_leave_after_the_patience(spark):
    stream = tail_sampling.stream_tail_outcomes(_files(spark, [_span("lost", "a", "z"), _span("lost", "b", "z")]), patience_ms=1)
    query = stream.writeStream.format("memory").queryName("tail_patience").outputMode("append").trigger(processingTime="100 milliseconds").option(
        "checkpointLocation", scratch_path(spark, "checkpoint")
    ).start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("tail_patience").count() < 2:
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted((r["trace_id"], r["span_id"], r["outcome"]) for r in spark.table("tail_patience").collect()) == [("lost", "a", "no_root"), ("lost", "b", "no_root")]


def test_a_call_of_the_sampler_handles_many_traces(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    plain = tail_sampling.BucketSampler.handleInputRows

    class Counted(tail_sampling.BucketSampler):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            yield from plain(self, key, rows, timerValues)

    monkeypatch.setattr(tail_sampling, "BucketSampler", Counted)
    spans = [_span(f"t{i}", "a", "r", status="ERROR" if i % 2 else "OK") for i in range(60)]
    roots = [_span(f"t{i}", "r", None) for i in range(50)]
    stream = tail_sampling.stream_tail_outcomes(_files(spark, spans, roots, spans[:5]), buckets=4)
    left = [(r["trace_id"], r["outcome"]) for r in run.run_available(stream).collect()]
    assert sorted(left) == sorted([(f"t{i}", "kept" if i % 2 else "dropped") for i in [*range(50), *range(50), *range(5)]])
    assert calls.value <= 12
