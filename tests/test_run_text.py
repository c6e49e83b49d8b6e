"""Lines and segments of runs against the gathered text; merged latency sketches against all spans."""

import datetime as dt
import random

from pyspark.sql import functions as F

from auditloom.operators import findings, run_text, traces
from auditloom.schemas import SPAN_SCHEMA
from test_policy_traces import T0

EVENTS = "report_id LONG, event_no LONG, role STRING, parts ARRAY<STRUCT<text: STRING>>"


def _events(spark, seed):
    rng = random.Random(seed)
    pieces = ["one", "\r", "\n", "\n\n", " two \r", "\nthree", "", None, "Possible SQL Injection in a/b.py", "\x85x", "日本 語", "\r\n"]
    rows = []
    for report in range(12):
        for event in range(rng.randrange(9)):
            rows.append((report, event * rng.choice([1, 5000]) + event, "model", [(rng.choice(pieces),) for _ in range(rng.randrange(4))]))
    return spark.createDataFrame(rows + [(99, 0, "model", None), (98, 0, "model", [(None,), ("",)])], EVENTS).selectExpr("*", "1 AS span", "'x' AS text")


def test_lines_equal_those_of_the_gathered_text(spark):
    for seed in (1, 2):
        events = _events(spark, seed)
        want = findings.report_lines(findings.accumulate_text(events)).filter("line_no IS NOT NULL").collect()
        got = run_text.run_lines(events, events_per_bucket=3).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
    assert run_text.run_lines(events.limit(0)).count() == 0


def test_segments_in_order_are_the_text(spark):
    events = _events(spark, 3)
    texts = {r["report_id"]: r["text"] for r in findings.accumulate_text(events).collect()}
    for size in (1, 4, 1000):
        found = {}
        for r in run_text.text_segments(events, size, events_per_bucket=2).orderBy("report_id", "segment_no").collect():
            assert 0 < len(r["text"]) <= size
            found.setdefault(r["report_id"], []).append(r["text"])
        assert {k: "".join(v) for k, v in found.items()} == texts
        assert all(len(s) == size for v in found.values() for s in v[:-1])


def test_merged_sketches_are_near_the_whole(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        start = T0 + dt.timedelta(hours=i % 100)
        rows.append((f"t{i}", f"s{i}", None, rng.choice(["a", "b"]), "OK", start, start + dt.timedelta(microseconds=int(rng.paretovariate(1.2) * 1000)), {}, []))
    spans = spark.createDataFrame(rows + [("t", "s", None, "a", "OK", None, T0, {}, [])], SPAN_SCHEMA)
    sketches = traces.latency_sketches(spans)
    assert sketches.select("day").distinct().count() == 5
    got = {r["name"]: r for r in traces.merged_latency(sketches).collect()}
    for name in "ab":
        values = sorted((r[6] - r[5]) / dt.timedelta(milliseconds=1) for r in rows if r[3] == name)
        r = got[name]
        assert r["spans"] == len(values) and r["max_ms"] == round(values[-1], 3) and abs(r["avg_ms"] - sum(values) / len(values)) < 0.01
        for column, q in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)):
            rank = sum(v <= r[column] + 1e-9 for v in values) / len(values)
            assert abs(rank - q) < 0.01
    assert traces.merged_latency(sketches.filter(F.lit(False))).count() == 0
