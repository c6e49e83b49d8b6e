"""Tail sampling whose working state stays bounded: no span is lost and every flag counts, however late.

Each trigger is a batch job over the new spans and a few tables, a folder a trigger:

* ``pending``   spans of traces that wait for their root, as they were left by the trigger before (replaced each time)
* ``verdicts``  one row a decided trace; late spans are joined with it and leave at once
* ``evicted``   the flags of spans that left as ``no_root``; they count when the root does come
* ``outcomes``  every span once, as it left: kept, dropped or no_root
* ``clock``     the latest end of a span so far

A trace waits until the clock is ``patience`` beyond the end of its last span, so ``pending`` holds the traces of that time
and no more. What is kept for ever are the small rows of ``verdicts`` and ``evicted``, in files, not in state. A trigger
reads what earlier triggers wrote and writes only its own folders, so a replayed trigger does the same again, and nothing
depends on when it runs. All of it is JVM work.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.traces import fact_columns
from auditloom.schemas import SPAN_SCHEMA
from auditloom.session import cut_lineage, scratch_path

_FLAGS = "trace_id string, has_error boolean, has_policy boolean, sandbox_calls bigint, model_calls bigint"
_VERDICT = "trace_id string, outcome string"


class BoundedSampler:
    """A ``foreachBatch`` function over spans."""

    def __init__(self, path: str, patience: timedelta, threshold: int = 3):
        self.path = path
        self.patience = int(patience.total_seconds() * 1_000_000)
        self.threshold = threshold

    def _before(self, spark: SparkSession, name: str, schema, batch_id: int, last: bool = False) -> DataFrame:
        """Rows of the triggers before, or only of the last of them."""
        if batch_id == 0:
            return spark.createDataFrame([], schema)
        if last:
            return spark.read.schema(schema).parquet(f"{self.path}/{name}/batch={batch_id - 1}")
        return spark.read.schema(schema).parquet(f"{self.path}/{name}").filter(F.col("batch") < batch_id).drop("batch")

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = batch.columns
        spans = batch.unionByName(self._before(spark, "pending", SPAN_SCHEMA, batch_id, last=True))
        verdicts = self._before(spark, "verdicts", _VERDICT, batch_id)
        # one row a trace
        marked = cut_lineage(spans.join(verdicts, "trace_id", "left").select(*columns, "outcome"))
        open_ = marked.filter("outcome IS NULL").drop("outcome")
        facts = open_.select(*fact_columns(), "end_ts").groupBy("trace_id").agg(
            F.bool_or("is_root").alias("rooted"),
            F.bool_or("is_error").alias("has_error"),
            F.bool_or("is_policy").alias("has_policy"),
            F.count_if("is_sandbox").alias("sandbox_calls"),
            F.count_if("is_model").alias("model_calls"),
            F.max(F.unix_micros("end_ts")).alias("last"),
        )
        earlier = self._before(spark, "evicted", _FLAGS, batch_id).groupBy("trace_id").agg(
            F.bool_or("has_error").alias("old_error"),
            F.bool_or("has_policy").alias("old_policy"),
            F.sum("sandbox_calls").alias("old_sandbox"),
            F.sum("model_calls").alias("old_model"),
        )
        clock = self._before(spark, "clock", "now bigint", batch_id, last=True).unionByName(marked.select(F.unix_micros("end_ts").alias("now")))
        now = clock.agg(F.max("now")).first()[0]
        none, zero = F.lit(False), F.lit(0)
        keep = (
            F.col("has_error") | F.coalesce("old_error", none) | F.col("has_policy") | F.coalesce("old_policy", none)
            | (F.col("sandbox_calls") + F.coalesce("old_sandbox", zero) >= self.threshold)
            | (F.col("model_calls") + F.coalesce("old_model", zero) >= self.threshold)
        )
        overdue = F.col("last") < F.lit(now).cast("long") - self.patience
        outcome = F.when(F.col("rooted"), F.when(keep, "kept").otherwise("dropped")).when(overdue, "no_root")
        traces = cut_lineage(facts.join(earlier, "trace_id", "left").withColumn("outcome", outcome))
        left = open_.join(traces.select("trace_id", "outcome"), "trace_id").select(*columns, "outcome")
        self._write(marked.filter("outcome IS NOT NULL").unionByName(left.filter("outcome IS NOT NULL")), "outcomes", batch_id)
        self._write(left.filter("outcome IS NULL").select(*columns), "pending", batch_id)
        self._write(traces.filter("rooted").select("trace_id", "outcome"), "verdicts", batch_id)
        self._write(traces.filter("outcome = 'no_root'").select("trace_id", "has_error", "has_policy", "sandbox_calls", "model_calls"), "evicted", batch_id)
        self._write(spark.range(1).select(F.lit(now).cast("bigint").alias("now")), "clock", batch_id)


def run_bounded_sampling(spans: DataFrame, path: str, patience: timedelta, threshold: int = 3, checkpoint: str | None = None) -> None:
    """Take in the spans that are there and stop; called again with the same folders, goes on.

    Spans without an end neither move the clock nor make their trace wait longer; a trace of only such spans waits for its
    root for ever.
    """
    (
        spans.writeStream.foreachBatch(BoundedSampler(path, patience, threshold))
        .option("checkpointLocation", checkpoint or scratch_path(spans.sparkSession, "checkpoint"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def sampled_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Every span that has left, with its outcome as of now: a span that left as no_root takes its trace's later verdict."""
    left = spark.read.schema(f"{SPAN_SCHEMA}, outcome STRING").parquet(f"{path}/outcomes")
    verdicts = spark.read.schema(_VERDICT).parquet(f"{path}/verdicts").select("trace_id", F.col("outcome").alias("verdict"))
    return left.drop("batch").withColumnRenamed("outcome", "left_as").join(verdicts, "trace_id", "left").withColumn(
        "outcome", F.coalesce("verdict", "left_as")
    ).drop("verdict")


def waiting_spans(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Spans that wait for their root after a trigger."""
    return spark.read.schema(SPAN_SCHEMA).parquet(f"{path}/pending/batch={batch_id}")
