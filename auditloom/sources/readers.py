"""Readers with fixed schemas."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.policy import policy_table
from auditloom.operators.scan import IGNORED_DIRS, IGNORED_EXTENSIONS
from auditloom.schemas import (
    COMPLETION_SCHEMA,
    EVAL_FILE_SCHEMA,
    INFERENCE_LOG_SCHEMA,
    SESSION_LOG_SCHEMA,
)


def read_inference_logs(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """The call log, partitioned by day ``dt``; ``start`` and ``end`` (inclusive) prune days."""
    logs = spark.read.schema(f"{INFERENCE_LOG_SCHEMA}, dt DATE").format(fmt).load(path)
    if start:
        logs = logs.filter(F.col("dt") >= F.lit(start).cast("date"))
    if end:
        logs = logs.filter(F.col("dt") <= F.lit(end).cast("date"))
    return logs


class TooManyBadRecords(ValueError):
    pass


def _parsed_completions(spark: SparkSession, path: str) -> DataFrame:
    # Lines are parsed by from_json with the whole schema: which lines count as malformed must not
    # depend on the columns that the caller selects.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(
        F.from_json("value", f"{COMPLETION_SCHEMA}, _corrupt STRING", options).alias("m"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("value").alias("line"),
    )
    return parsed.withColumn("malformed", F.col("m").isNull() | F.col("m._corrupt").isNotNull())


def read_completions(spark: SparkSession, path: str, max_bad: int | None = None) -> DataFrame:
    """Stored messages (one JSON object per line) with the name of their file.

    Unknown fields are dropped. Lines that do not parse are left out; ``rejected_completions`` returns them. With
    ``max_bad``, more than that many of them are an error, found by a count that stops early.
    """
    parsed = _parsed_completions(spark, path)
    if max_bad is not None and len(parsed.filter("malformed").select("file_path").take(max_bad + 1)) > max_bad:
        raise TooManyBadRecords(f"more than {max_bad} malformed lines under {path}")
    return parsed.filter("NOT malformed").select("m.parts", "m.role", "m.index", "file_path")


def rejected_completions(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, line)`` of the lines that ``read_completions`` leaves out."""
    return _parsed_completions(spark, path).filter("malformed").select("file_path", "line")


def read_source_tree(spark: SparkSession, root: str) -> DataFrame:
    """Text files below ``root`` as ``(repo, path, content)``.

    Folder and extension rules are tests on the file path that Spark applies while listing, so
    ignored files are not opened. Undecodable bytes are left out, vanished files skipped. ``repo`` is
    the first folder below ``root``.
    """
    extensions = "|".join(e[1:] for e in IGNORED_EXTENSIONS)
    folders = "|".join(d.replace(".", r"\.") for d in IGNORED_DIRS)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .load(root)
    )
    # The listing gives locations percent-encoded; a plus stands for itself there.
    location = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    relative = F.regexp_replace(location, F.lit(rf"^.*?{_literal(root)}/+"), F.lit(""))
    kept = files.filter(~F.lower(location).rlike(rf"/[^/]+\.({extensions})$")).filter(
        ~F.concat(F.lit("/"), relative).rlike(rf"/({folders})/")
    )
    text = F.col("content").cast("string")
    # Bytes that are no text become U+FFFD and go; a U+FFFD of the file's own is set aside meanwhile.
    own, aside = F.lit("�"), F.lit("\ufffe\uffff")
    mended = F.replace(F.make_valid_utf8(F.replace(text, own, aside)), own, F.lit(""))
    decoded = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(mended, aside, own))
    return kept.select(relative.alias("path"), decoded.alias("content")).select(
        F.element_at(F.split("path", "/"), 1).alias("repo"), "path", "content"
    )


def _literal(root: str) -> str:
    plain = root.split(":", 1)[-1] if "://" not in root else root.split("://", 1)[-1]
    return "\\Q" + plain.rstrip("/") + "\\E"


def read_session_logs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of session logs per file."""
    return spark.read.schema(SESSION_LOG_SCHEMA).option("multiLine", "true").json(path)


def read_eval_traces(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, one row each, of files with an ``eval_cases`` array."""
    files = spark.read.schema(EVAL_FILE_SCHEMA).option("multiLine", "true").json(path)
    return files.select(F.explode_outer("eval_cases").alias("c")).filter(F.col("c").isNotNull()).select("c.*")


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Grants of a small policy file (YAML or JSON); a missing file denies everything."""
    try:
        rows = spark.read.option("wholetext", "true").text(path).collect()
    except AnalysisException:
        return policy_table(spark, {})
    text = "\n".join(row[0] for row in rows)
    try:
        import yaml

        parsed = yaml.safe_load(text)
    except ImportError:
        parsed = json.loads(text)
    roles = ((parsed or {}).get("roles") or {}).items()
    return policy_table(spark, {agent: (entry or {}).get("allowed_tools") or [] for agent, entry in roles})
