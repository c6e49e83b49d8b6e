"""Tool-call decisions on a stream, with one sticky flag of state per session.

Signatures and grants are worked out before the stateful step, so the Python worker only orders the
calls of a session inside a trigger and applies the flag. A call of the worker handles a bucket of
sessions at once, where a call a session would spend nearly all its time on the way there and back;
its state is the list of the quarantined ones. The rows it holds for one bucket are
bounded by the trigger (``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditloom.operators.policy import REVIEWED_TOOLS, anomaly_columns, offending_value
from auditloom.streaming.run import use_rocksdb

_KEPT = ["seq", "agent", "tool", "args", "offending_value"]
_OUTPUT = "session_id string, seq bigint, agent string, tool string, args string, offending_value string, decision string"


class BucketQuarantine(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.quarantined = handle.getListState("quarantined", "session_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], ignore_index=True)
        known = {r[0] for r in self.quarantined.get()}
        sessions = pd.Series([None if pd.isna(s) else s for s in calls["session_id"]], index=calls.index, dtype=object)
        marked = calls["marked"].astype(bool)
        so_far = marked.astype(int).groupby(sessions, dropna=False).cumsum()
        quarantined = (so_far > marked) | pd.Series([s in known for s in sessions], index=calls.index, dtype=bool)
        fresh = set(sessions[marked]) - known
        if fresh:
            self.quarantined.appendList([(s,) for s in fresh])
        decision = pd.Series("ALLOW", index=calls.index)
        decision[calls["unapproved"]] = "SEMANTIC_BLOCK"
        decision[calls["denied"]] = "RBAC_BLOCK"
        decision[marked] = "ANOMALY"
        decision[quarantined] = "QUARANTINED"
        yield calls[_KEPT].assign(session_id=sessions, decision=decision)[["session_id", *_KEPT, "decision"]]

    def close(self) -> None:
        pass


def stream_quarantine(calls: DataFrame, policy: DataFrame, verdicts: DataFrame | None = None, buckets: int = 1024) -> DataFrame:
    """One decision per call of a stream, with the columns of ``tool_call_decisions`` but ``ts``.

    ``policy`` and ``verdicts`` (``session_id, seq, decision``) are static tables; without ``verdicts`` the second opinion is
    off, with them a reviewed tool without an approval is blocked. Sessions share ``buckets``, a number that a stream keeps for life.
    """
    use_rocksdb(calls.sparkSession)
    opinion = F.lit(None).cast("string")
    if verdicts is not None:
        calls = calls.join(verdicts.select("session_id", "seq", F.col("decision").alias("opinion")), ["session_id", "seq"], "left")
        opinion = F.col("opinion")
    unapproved = F.lit(verdicts is not None) & F.col("agent").isNotNull() & F.col("tool").isin(REVIEWED_TOOLS)
    grants = policy.select("agent", "tool").distinct().withColumn("granted", F.lit(True))
    staged = calls.join(grants, ["agent", "tool"], "left").select(
        "session_id", "seq", "ts", "agent", "tool",
        # only anomalies show their arguments
        F.when(offending_value(F.col("args")).isNotNull(), F.to_json("args")).alias("args"),
        offending_value(F.col("args")).alias("offending_value"),
        offending_value(F.col("args")).isNotNull().alias("marked"),
        (unapproved & (F.coalesce(opinion, F.lit("DENIED")) != "APPROVED")).alias("unapproved"),
        (F.col("agent").isNotNull() & F.col("granted").isNull()).alias("denied"),
    )
    bucketed = staged.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets))).groupBy("bucket")
    decided = bucketed.transformWithStateInPandas(BucketQuarantine(), _OUTPUT, "append", "none")
    return decided.select("session_id", "seq", "agent", "tool", "decision", *anomaly_columns())
