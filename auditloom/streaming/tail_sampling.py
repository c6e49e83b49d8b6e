"""Keep or drop whole traces once their root span has ended.

Spans are reduced to a few flags and their JSON in the JVM; the state of a trace is the list of those rows. A trace is
decided when its root arrives; the verdict stays in state, and spans that come later follow it. No row is dropped: there is
no watermark. With a ``patience``, spans of a trace whose root has not come by then leave as ``no_root``; their flags stay and
count when it comes. ``bounded_sampling`` does the same with verdicts in files instead of state.

Without a patience no trace has a timer of its own, and many traces share a state: a call of the Python processor handles a
bucket of them at once, where a call a trace would spend nearly all its time on the way there and back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditloom.operators.traces import fact_columns
from auditloom.schemas import SPAN_SCHEMA
from auditloom.streaming.run import use_rocksdb

_STATE = "is_root boolean, is_error boolean, is_policy boolean, is_sandbox boolean, is_model boolean, span string"
_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_FLAGS = ["is_root", "is_error", "is_policy", "is_sandbox", "is_model"]


class TailSampler(StatefulProcessor):
    def __init__(self, threshold: int, patience_ms: int | None):
        self.threshold = threshold
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("spans", _STATE)
        self.verdict = handle.getValueState("verdict", "outcome string")
        self.evicted = handle.getValueState("evicted", "is_error boolean, is_policy boolean, sandbox bigint, model bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows), ignore_index=True)
        if self.verdict.exists():
            yield self._out(key, self.verdict.get()[0], arrived["span"])
            return
        columns = [*_FLAGS, "span"]
        if not arrived["is_root"].any():
            self.buffer.appendList([tuple(r) for r in arrived[columns].itertuples(index=False, name=None)])
            if self.patience_ms is not None:
                self._forget_timers()
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
            return
        earlier = pd.DataFrame([tuple(r) for r in self.buffer.get()], columns=columns)
        self.buffer.clear()
        self._forget_timers()
        trace = pd.concat([earlier, arrived[columns]], ignore_index=True) if len(earlier) else arrived[columns]
        error, policy, sandbox, model = self._flags(trace)
        self.evicted.clear()
        keep = error or policy or sandbox >= self.threshold or model >= self.threshold
        outcome = "kept" if keep else "dropped"
        self.verdict.update((outcome,))
        yield self._out(key, outcome, trace["span"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The root has not come: the spans leave, and one that comes after all decides on what follows."""
        waiting = pd.DataFrame([tuple(r) for r in self.buffer.get()], columns=[*_FLAGS, "span"])
        self.buffer.clear()
        if len(waiting):
            self.evicted.update(self._flags(waiting))
            yield self._out(key, "no_root", waiting["span"])

    def _flags(self, trace: pd.DataFrame) -> tuple[bool, bool, int, int]:
        """Flags of the spans, and of those that left before."""
        error, policy, sandbox, model = self.evicted.get() if self.evicted.exists() else (False, False, 0, 0)
        return (
            bool(error or trace["is_error"].any()),
            bool(policy or trace["is_policy"].any()),
            int(sandbox + trace["is_sandbox"].sum()),
            int(model + trace["is_model"].sum()),
        )

    def _forget_timers(self) -> None:
        if self.patience_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    @staticmethod
    def _out(key, outcome: str, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"trace_id": key[0], "outcome": outcome, "span": spans})

    def close(self) -> None:
        pass


class BucketSampler(StatefulProcessor):
    """``TailSampler`` for a bucket of traces, without timers."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", f"trace_id string, {_STATE}")
        self.verdicts = handle.getListState("verdicts", "trace_id string, outcome string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["trace_id", *_FLAGS, "span"]
        arrived = pd.concat(list(rows), ignore_index=True)[columns]
        known = dict(tuple(r) for r in self.verdicts.get())
        outcome = pd.Series([known.get(t) for t in arrived["trace_id"]], index=arrived.index, dtype=object)
        late = outcome.notna()
        if late.any():
            yield arrived.loc[late, ["trace_id", "span"]].assign(outcome=outcome[late])[["trace_id", "outcome", "span"]]
        arrived = arrived[~late]
        rooted = set(arrived.loc[arrived["is_root"], "trace_id"])
        if not rooted:
            self._wait(arrived, self.waiting.appendList)
            return
        earlier = pd.DataFrame([tuple(r) for r in self.waiting.get()], columns=columns)
        spans = pd.concat([earlier, arrived], ignore_index=True) if len(earlier) else arrived
        decided = pd.Series([t in rooted for t in spans["trace_id"]], index=spans.index)
        left = spans[decided]
        flags = left[_FLAGS].astype(int).groupby(left["trace_id"], dropna=False).sum()
        kept = (flags["is_error"] > 0) | (flags["is_policy"] > 0) | (flags["is_sandbox"] >= self.threshold) | (flags["is_model"] >= self.threshold)
        fresh = {None if pd.isna(t) else t: "kept" if k else "dropped" for t, k in kept.items()}
        self.verdicts.appendList(list(fresh.items()))
        self.waiting.clear()
        self._wait(spans[~decided], self.waiting.put)
        yield pd.DataFrame({"trace_id": left["trace_id"], "outcome": [fresh[t] for t in left["trace_id"]], "span": left["span"]})

    @staticmethod
    def _wait(spans: pd.DataFrame, store) -> None:
        if len(spans):
            store(list(spans.itertuples(index=False, name=None)))

    def close(self) -> None:
        pass


def stream_tail_outcomes(spans: DataFrame, threshold: int = 3, patience_ms: int | None = None, buckets: int = 1024) -> DataFrame:
    """Every span of a stream once its trace is decided: ``outcome`` (kept, dropped, no_root) and the columns of spans.

    ``patience_ms`` is how long, in processing time, a trace waits for its root after its last span; None (the default) waits
    for ever, with traces in ``buckets``, a number that a stream keeps for life. With timers a query goes on running batches, so it needs a trigger that is not ``availableNow``.
    """
    use_rocksdb(spans.sparkSession)
    facts = spans.select(*fact_columns(), F.to_json(F.struct(*spans.columns), _TIME).alias("span"))
    output = "trace_id string, outcome string, span string"
    if patience_ms is None:
        bucketed = facts.withColumn("bucket", F.pmod(F.xxhash64("trace_id"), F.lit(buckets))).groupBy("bucket")
        decided = bucketed.transformWithStateInPandas(BucketSampler(threshold), output, "append", "none")
    else:
        decided = facts.groupBy("trace_id").transformWithStateInPandas(TailSampler(threshold, patience_ms), output, "append", "processingTime")
    return decided.select("outcome", F.from_json("span", SPAN_SCHEMA, _TIME).alias("s")).select("outcome", "s.*")


def stream_tail_sampling(spans: DataFrame, threshold: int = 3, patience_ms: int | None = None) -> DataFrame:
    """Spans of the traces to keep, out of a stream of spans."""
    return stream_tail_outcomes(spans, threshold, patience_ms).filter("outcome = 'kept'").drop("outcome")
