"""Streams over many triggers, rows in any order: latest versions win, state stays flat, nothing is lost."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from auditloom.operators import completions, traces
from auditloom.schemas import SPAN_SCHEMA
from auditloom.session import scratch_path
from auditloom.streaming import bounded_sampling, latest, run, tail_sampling
from test_policy_traces import T0, _span

PART = (
    "insert_id STRING, timestamp TIMESTAMP, trace STRING, span_id STRING, conversation_id STRING, usage_input_tokens STRING, "
    "usage_output_tokens STRING, agent_name STRING, finish_reasons STRING, user_id STRING, messages_ref_uri STRING, message_type STRING, "
    "api_call_id STRING, role STRING, message_idx BIGINT, part_idx BIGINT, part_type STRING, content STRING, uri STRING, mime_type STRING, "
    "data_md5_hex STRING, tool_id STRING, tool_name STRING, tool_args STRING, tool_response STRING"
)


def _versions(rng, n):
    """Parts of a few messages, each many times over, with equal and missing times."""
    rows = []
    for i in range(n):
        kind = rng.choice(["input", "input", "output"])
        at = rng.choice([None, T0 + dt.timedelta(seconds=rng.randrange(6))])
        row = {c.split()[0]: None for c in PART.split(", ")}
        row |= {
            "insert_id": f"i{rng.randrange(30)}", "timestamp": at, "trace": rng.choice(["t1", "t2", None]), "span_id": rng.choice(["s1", "s2"]),
            "conversation_id": rng.choice(["c1", None]), "messages_ref_uri": f"m{i}", "message_type": kind, "role": rng.choice(["user", "assistant", None]),
            "message_idx": rng.randrange(2), "part_idx": rng.randrange(2), "content": f"text {i}",
        }
        rows.append(tuple(row.values()))
    return rows


def test_latest_versions_win_over_many_triggers_in_any_order(spark):
    rng = random.Random(5)
    rows = _versions(rng, 240)
    path, out, checkpoint = (scratch_path(spark, n) for n in ("versions", "corrections", "checkpoint"))
    whole = spark.createDataFrame(rows, PART)
    columns = completions.VIEW_COLUMNS

    def view(parts):
        stages = completions.dedup_across_traces(completions.dedup_within_trace(completions.drop_echoed_assistant(parts)))
        return sorted(map(str, stages.select(*columns).collect()))

    taken = 0
    for many in (2, 1):  # a second run goes on where the first one stopped
        for _ in range(many):
            part = rows[taken : taken + 80]
            taken += 80
            spark.createDataFrame(part + part[:3], PART).coalesce(1).write.mode("append").parquet(path)
        stream = run.read_stream(spark, path, whole.schema, files_per_trigger=1)
        latest.run_latest(stream, out, checkpoint)
        seen = spark.createDataFrame(rows[:taken], PART)
        assert sorted(map(str, latest.current_view(spark, out, whole.schema).select(*columns).collect())) == view(seen)
    kept = latest.latest_parts(spark, out, whole.schema)
    assert kept.count() == completions.dedup_within_trace(whole).count() and taken == 240
    latest.corrections_sink(out)(kept, 1)  # a trigger that is replayed with other rows of the same keys changes nothing
    assert sorted(map(str, latest.current_view(spark, out, whole.schema).select(*columns).collect())) == view(whole)


def _timed(trace, span, parent, minute, **more):
    row = list(_span(trace, "a", parent, **more))
    row[1] = span
    row[5] = T0 + dt.timedelta(minutes=minute)
    row[6] = row[5] + dt.timedelta(seconds=30)
    return tuple(row)


def test_pending_stays_flat_and_no_span_is_lost(spark):
    path, out, checkpoint = (scratch_path(spark, n) for n in ("spans", "sampled", "checkpoint"))
    tool = {"tool.name": "execute_sandbox"}
    triggers = []
    for t in range(7):
        now = 100 * t
        rows = [_timed(f"early{t}", "x", "r", now), _timed(f"early{t}", "r", None, now + 1)]
        rows += [_timed(f"split{t}", "x", "r", now, status="ERROR"), _timed(f"orphan{t}", "x", "r", now)]
        if t:
            rows += [_timed(f"split{t - 1}", "r", None, now), _timed(f"early{t - 1}", "late", "r", now - 100, status="ERROR")]
        triggers.append(rows)
    # three sandbox calls, two of them gone as no_root long before the root comes; an error that left before its root
    triggers[0] += [_timed("long", "a", "r", 1, name="agent.tool", attributes=tool), _timed("long", "b", "r", 2, name="agent.tool", attributes=tool)]
    triggers[0] += [_timed("wrong", "a", "r", 1, status="ERROR")]
    triggers[5] += [_timed("long", "c", "r", 501, name="agent.tool", attributes=tool), _timed("long", "r", None, 502), _timed("wrong", "r", None, 502)]
    for rows in triggers:
        spark.createDataFrame(rows, SPAN_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = run.read_stream(spark, path, spark.createDataFrame([], SPAN_SCHEMA).schema, files_per_trigger=1)
    bounded_sampling.run_bounded_sampling(stream, out, dt.timedelta(minutes=150), checkpoint=checkpoint)
    waiting = [bounded_sampling.waiting_spans(spark, out, t).count() for t in range(7)]
    assert max(waiting[2:]) <= 4 and waiting[-1] <= waiting[3]
    got = {(r["trace_id"], r["span_id"]): (r["left_as"], r["outcome"]) for r in bounded_sampling.sampled_outcomes(spark, out).collect()}
    spans = Counter((r[0], r[1]) for rows in triggers for r in rows)
    last = {(r["trace_id"], r["span_id"]) for r in bounded_sampling.waiting_spans(spark, out, 6).collect()}
    assert set(got) | last == set(spans) and not set(got) & last and max(spans.values()) == 1
    assert got["early0", "x"] == got["early0", "late"] == ("dropped", "dropped") and got["split0", "x"] == ("kept", "kept")
    assert got["orphan0", "x"] == ("no_root", "no_root") and got["long", "a"] == ("no_root", "kept") == got["wrong", "a"] and got["long", "r"] == ("kept", "kept")
    # a replayed trigger writes the same again
    before = sorted(map(str, bounded_sampling.sampled_outcomes(spark, out).collect()))
    bounded_sampling.BoundedSampler(out, dt.timedelta(minutes=150))(spark.createDataFrame(triggers[6], SPAN_SCHEMA), 6)
    assert sorted(map(str, bounded_sampling.sampled_outcomes(spark, out).collect())) == before


def test_with_patience_to_spare_the_outcomes_are_those_of_the_batch(spark):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        names = [f"s{k}" for k in range(rng.randrange(1, 5))]
        rows += [_timed(f"t{i}", n, "root", rng.randrange(50), status=rng.choice(["OK", "OK", "ERROR"])) for n in names]
        rows.append(_timed(f"t{i}", "root", None, 60))
    rng.shuffle(rows)
    rows = [r for r in rows if r[2]] + [r for r in rows if not r[2]]
    path, out = scratch_path(spark, "spans"), scratch_path(spark, "sampled")
    for at in (0, len(rows) // 2):
        spark.createDataFrame(rows[at : at + len(rows) // 2 + at], SPAN_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    whole = spark.createDataFrame(rows, SPAN_SCHEMA)
    bounded_sampling.run_bounded_sampling(run.read_stream(spark, path, whole.schema, files_per_trigger=1), out, dt.timedelta(days=1))
    got = bounded_sampling.sampled_outcomes(spark, out)
    kept = sorted((r["trace_id"], r["span_id"]) for r in got.filter("outcome = 'kept'").collect())
    assert kept == sorted((r["trace_id"], r["span_id"]) for r in traces.retained_spans(whole).collect()) and got.count() == len(rows)


def test_flags_of_spans_that_left_without_their_root_stay_in_state():
    """The stateful sampler decides on what has left as well."""
    import pandas as pd

    class Value:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    sampler = tail_sampling.TailSampler(3, 1000)
    sampler.evicted = Value()
    frame = lambda *rows: pd.DataFrame(rows, columns=["is_root", "is_error", "is_policy", "is_sandbox", "is_model"])
    sampler.evicted.update(sampler._flags(frame((False, False, False, True, False), (False, True, False, True, False))))
    assert sampler._flags(frame((True, False, False, True, False))) == (True, False, 3, 0)
