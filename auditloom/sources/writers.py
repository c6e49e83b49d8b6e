"""Writers. Reports are written as ordered lines by many tasks; file names keep the order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.completions import completions_view


def write_inference_logs(logs: DataFrame, path: str) -> None:
    """Day-partitioned log table; rows are dealt out by day first, large days to several files."""
    logs.withColumn("dt", F.to_date("timestamp")).hint("rebalance", "dt").write.mode("append").partitionBy("dt").parquet(path)


def write_cluster_report(report: DataFrame, path: str) -> None:
    """Markdown lines of ``cluster_report`` in order."""
    report.orderBy("cluster", "block", "item").select("line").write.mode("overwrite").text(path)


def write_audit_report(reports: DataFrame, path: str) -> None:
    """One Markdown report per row, in report order."""
    reports.orderBy("report_id").select("report").write.mode("overwrite").text(path)


def register_completions_view(logs: DataFrame, messages: DataFrame, name: str = "completions_view") -> None:
    """The completions view under a name that SQL can use."""
    completions_view(logs, messages, ordered=False).createOrReplaceTempView(name)
