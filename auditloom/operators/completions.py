"""Model-call logs joined with their stored messages, flattened and deduplicated.

The payload travels through one join and two deduplications. Both deduplications are written as
``row_number() = 1`` filters so that Spark limits each group inside every map task before the
shuffle: a conversation or message with a third of all copies sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REF_FIELDS = [
    "insert_id", "timestamp", "trace", "span_id", "conversation_id", "usage_input_tokens",
    "usage_output_tokens", "agent_name", "finish_reasons", "user_id",
]

VIEW_COLUMNS = [
    "timestamp", "insert_id", "trace", "span_id", "conversation_id", "api_call_id",
    "message_type", "role", "message_idx", "part_idx", "content", "part_type", "tool_name",
    "tool_args", "tool_response", "usage_input_tokens", "usage_output_tokens", "agent_name",
    "finish_reasons", "user_id", "uri", "mime_type", "data_md5_hex", "messages_ref_uri",
]


def log_refs(logs: DataFrame) -> DataFrame:
    """Flatten the label struct; keep calls that reference at least one message file."""
    labels = F.col("labels")
    return logs.select(
        F.col("insertId").alias("insert_id"),
        "timestamp",
        "trace",
        F.col("spanId").alias("span_id"),
        labels["gen_ai_conversation_id"].alias("conversation_id"),
        labels["gen_ai_input_messages_ref"].alias("input_ref"),
        labels["gen_ai_output_messages_ref"].alias("output_ref"),
        labels["gen_ai_usage_input_tokens"].alias("usage_input_tokens"),
        labels["gen_ai_usage_output_tokens"].alias("usage_output_tokens"),
        labels["gen_ai_agent_name"].alias("agent_name"),
        labels["gen_ai_response_finish_reasons"].alias("finish_reasons"),
        labels["user_id"].alias("user_id"),
    ).filter(F.col("input_ref").isNotNull() | F.col("output_ref").isNotNull())


def unpivot_refs(refs: DataFrame) -> DataFrame:
    """One row per message reference, read in a single pass over the log."""
    sides = F.array(
        F.struct(F.col("input_ref").alias("uri"), F.lit("input").alias("side")),
        F.struct(F.col("output_ref").alias("uri"), F.lit("output").alias("side")),
    )
    return (
        refs.select(*REF_FIELDS, F.explode(sides).alias("ref"))
        .select(
            *REF_FIELDS,
            F.col("ref.uri").alias("messages_ref_uri"),
            F.col("ref.side").alias("message_type"),
        )
        .filter(F.col("messages_ref_uri").isNotNull())
    )


def api_call_id(uri: Column) -> Column:
    """Leading ``_``-free piece of the ``*.jsonl`` file name; NULL when the name differs."""
    stem = F.nullif(F.regexp_extract(uri, r"/([^/]+)\.jsonl", 1), F.lit(""))
    return F.split(stem, "_")[0]


def refs_join_messages(refs: DataFrame, messages: DataFrame) -> DataFrame:
    """Attach every message to each reference of its file."""
    stored = messages.select(
        F.col("file_path").alias("messages_ref_uri"), "role", "parts", F.col("index").alias("message_idx")
    )
    return refs.join(stored, "messages_ref_uri", "inner").withColumn(
        "api_call_id", api_call_id(F.col("messages_ref_uri"))
    )


def unnest_parts(joined: DataFrame) -> DataFrame:
    """One row per message part with its 0-based offset; messages without parts drop out."""
    kept = [c for c in joined.columns if c != "parts"]
    return joined.select(*kept, F.posexplode("parts").alias("part_idx", "part")).select(
        *kept,
        F.col("part_idx").cast("bigint").alias("part_idx"),
        F.col("part.type").alias("part_type"),
        F.col("part.content").alias("content"),
        F.col("part.uri").alias("uri"),
        F.col("part.mime_type").alias("mime_type"),
        F.md5(F.col("part.data")).alias("data_md5_hex"),
        F.col("part.id").alias("tool_id"),
        F.col("part.name").alias("tool_name"),
        F.col("part.arguments").alias("tool_args"),
        F.col("part.response").alias("tool_response"),
    )


def dedup_within_trace(parts: DataFrame) -> DataFrame:
    """Latest copy of each message part inside a span."""
    window = Window.partitionBy(
        "conversation_id", "trace", "span_id", "message_type", "role", "message_idx", "part_idx"
    ).orderBy(F.col("timestamp").desc(), F.col("insert_id"), F.col("messages_ref_uri"))
    return parts.withColumn("__rn", F.row_number().over(window)).filter("__rn = 1").drop("__rn")


def dedup_across_traces(parts: DataFrame) -> DataFrame:
    """Earliest copy of each input part in a conversation; every output part.

    Outputs carry their trace and span in the key. After the first stage that key is unique for
    them, so the filter keeps them all, and it stays a plain ``row_number() = 1``.
    """
    is_output = F.col("message_type") != "input"
    window = Window.partitionBy(
        "conversation_id", "message_type", "role", "message_idx", "part_idx",
        F.when(is_output, F.col("trace")), F.when(is_output, F.col("span_id")),
    ).orderBy(F.col("timestamp"), F.col("insert_id"), F.col("messages_ref_uri"))
    return parts.withColumn("__rn", F.row_number().over(window)).filter("__rn = 1").drop("__rn")


def drop_echoed_assistant(parts: DataFrame) -> DataFrame:
    """Remove model turns repeated as input (an input with NULL role goes too, as in SQL)."""
    return parts.filter(~((F.col("message_type") == "input") & (F.col("role") == "assistant")))


def order_completions(parts: DataFrame) -> DataFrame:
    return parts.orderBy(
        *[
            F.col(c).asc_nulls_first()
            for c in ("conversation_id", "timestamp", "message_type", "message_idx", "part_idx")
        ]
    )


def completions_view(logs: DataFrame, messages: DataFrame, ordered: bool = True) -> DataFrame:
    """The whole chain.

    Echoed model turns are dropped before the parts are unnested: role and type are keys of both
    deduplications, so the result is the same and the payload is never shuffled for them.
    """
    flat = (
        refs_join_messages(unpivot_refs(log_refs(logs)), messages)
        .transform(drop_echoed_assistant)
        .transform(unnest_parts)
        .transform(dedup_within_trace)
        .transform(dedup_across_traces)
        .select(*VIEW_COLUMNS)
    )
    return order_completions(flat) if ordered else flat
