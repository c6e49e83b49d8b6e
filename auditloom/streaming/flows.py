"""Streams without custom state: log routing, feedback intake, and deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators.feedback import LOG_TYPE, SERVICE_NAME, split_feedback
from auditloom.streaming.run import use_rocksdb


def inference_route(log_name: str, input_pattern: str, output_pattern: str) -> Column:
    """Calls of one log whose input or output reference matches."""
    labels = F.col("labels")
    return (F.col("logName") == log_name) & (
        labels["gen_ai_input_messages_ref"].rlike(input_pattern)
        | labels["gen_ai_output_messages_ref"].rlike(output_pattern)
    )


def feedback_route(service_name: str = SERVICE_NAME) -> Column:
    return (F.col("log_type") == LOG_TYPE) & (F.col("service_name") == service_name)


def route_logs(logs: DataFrame, route: Column) -> DataFrame:
    """Rows of one route with their day ``dt``; works on batches and streams."""
    return logs.filter(route).withColumn("dt", F.to_date("timestamp"))


def feedback_sink(
    valid_path: str, rejected_path: str, service_name: str = SERVICE_NAME
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that splits each micro-batch into two JSON folders.

    Each batch overwrites its own sub-folder, so a replayed batch does not write twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        valid, rejected = split_feedback(batch, service_name)
        valid.write.mode("overwrite").json(f"{valid_path}/batch={batch_id}")
        rejected.write.mode("overwrite").json(f"{rejected_path}/batch={batch_id}")

    return write


def stream_feedback_ingest(
    rows: DataFrame, valid_path: str, rejected_path: str, checkpoint: str, service_name: str = SERVICE_NAME
):
    """Start the intake; returns the running query."""
    return (
        rows.writeStream.foreachBatch(feedback_sink(valid_path, rejected_path, service_name))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_completions_dedup(parts: DataFrame, watermark: str | None = None) -> DataFrame:
    """First arrival of each input part of a conversation; every output part of a span.

    All keys stay in state (RocksDB), so no row is lost however late it comes. A ``watermark`` bounds the state; Spark then
    drops rows that come later than that. Within a trigger Spark keeps any one of equal keys; across triggers the earlier
    arrival wins.
    """
    use_rocksdb(parts.sparkSession)
    is_output = F.col("message_type") != "input"
    keyed = parts.withColumns(
        {"__trace": F.when(is_output, F.col("trace")), "__span": F.when(is_output, F.col("span_id"))}
    )
    keys = ["conversation_id", "message_type", "role", "message_idx", "part_idx", "__trace", "__span"]
    if watermark is None:
        kept = keyed.dropDuplicates(keys)
    else:
        kept = keyed.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(keys)
    return kept.drop("__trace", "__span")
