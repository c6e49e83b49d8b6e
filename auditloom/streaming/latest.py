"""The completions view kept up to date by a stream: the latest version of each message part wins, however late it comes.

One row of state for each message part of a span holds its latest version (a streaming aggregation: the JVM, RocksDB). A trigger
emits the keys that it touched with what is their latest version now, and these corrections are appended, a folder for each
trigger, so a replayed trigger writes the same folder again. Whoever reads takes the latest correction of each key; the order
of versions is total, so corrections may be read in any order and read twice.

The choice across traces (the earliest copy of an input part) is made when reading: it depends on which versions are the latest,
and would have to be taken back when one of them moves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.completions import VIEW_COLUMNS, dedup_across_traces, dedup_within_trace, drop_echoed_assistant
from auditloom.session import scratch_path
from auditloom.streaming.run import use_rocksdb

PART_KEY = ["conversation_id", "trace", "span_id", "message_type", "role", "message_idx", "part_idx"]


def version_order() -> Column:
    """Sorts versions of one part as the within-trace stage does: the latest first, then insert id and file."""
    return F.struct(
        F.col("timestamp").isNull().alias("undated"), (-F.unix_micros("timestamp")).alias("age"), F.col("insert_id"), F.col("messages_ref_uri")
    )


def stream_latest(parts: DataFrame) -> DataFrame:
    """Latest version of every part of a stream, for output mode ``update``; columns as in ``parts``.

    Null key columns are one value each. Rows are never dropped; state grows with the number of different parts.
    """
    use_rocksdb(parts.sparkSession)
    rest = [c for c in parts.columns if c not in PART_KEY]
    kept = parts.groupBy(*PART_KEY).agg(F.min_by(F.struct(*rest), version_order()).alias("__row"))
    return kept.select(*PART_KEY, "__row.*")


def corrections_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each trigger's corrections to a folder of its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_latest(parts: DataFrame, path: str, checkpoint: str | None = None) -> None:
    """Take in what is there, write the corrections under ``path`` and stop; called again with the same folders, goes on."""
    (
        stream_latest(parts)
        .writeStream.outputMode("update")
        .foreachBatch(corrections_sink(path))
        .option("checkpointLocation", checkpoint or scratch_path(parts.sparkSession, "checkpoint"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def latest_parts(spark: SparkSession, path: str, schema) -> DataFrame:
    """One row a message part of a span: its latest correction."""
    return dedup_within_trace(spark.read.schema(schema).parquet(f"{path}/batch=*"))


def current_view(spark: SparkSession, path: str, schema) -> DataFrame:
    """``completions_view`` (without its order) of everything that has come so far."""
    return latest_parts(spark, path, schema).transform(drop_echoed_assistant).transform(dedup_across_traces).select(*VIEW_COLUMNS)
