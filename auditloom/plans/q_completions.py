"""Completions view and each of its steps."""

from __future__ import annotations

from auditloom.operators import completions as ops
from auditloom.plans import bridges as b


def _joined(spark, sf):
    refs = ops.unpivot_refs(ops.log_refs(b.inference_logs(spark, sf)))
    return ops.refs_join_messages(refs, b.completion_messages(spark, sf))


def _flat(spark, sf):
    return ops.unnest_parts(_joined(spark, sf))


_KEYS = [
    "insert_id", "trace", "span_id", "conversation_id", "message_type", "role", "message_idx",
    "part_idx", "messages_ref_uri",
]


def _view(ordered):
    return lambda spark, sf: ops.completions_view(
        b.inference_logs(spark, sf), b.completion_messages(spark, sf), ordered
    )


QUERIES = {
    "log_refs": lambda s, d: ops.log_refs(b.inference_logs(s, d)),
    "unpivot_refs": lambda s, d: ops.unpivot_refs(ops.log_refs(b.inference_logs(s, d))),
    "refs_join_messages": lambda s, d: _joined(s, d).drop("parts"),
    "unnest_parts": lambda s, d: _flat(s, d),
    "dedup_within_trace": lambda s, d: ops.dedup_within_trace(_flat(s, d)).select(*_KEYS),
    "dedup_across_traces": lambda s, d: ops.dedup_across_traces(
        ops.dedup_within_trace(_flat(s, d))
    ).select(*_KEYS),
    "drop_echoed_assistant": lambda s, d: ops.drop_echoed_assistant(_flat(s, d)).select(*_KEYS),
    "order_completions": lambda s, d: ops.order_completions(_flat(s, d)).select(*_KEYS),
    "completions_view": _view(True),
}

_LOG = f"""
    SELECT insert_id, ts AS timestamp, trace, span_id, conversation_id, input_ref, output_ref,
           usage_input_tokens, usage_output_tokens, agent_name, finish_reasons, user_id
    FROM ({b.CALLS_SQL}) calls
    WHERE input_ref IS NOT NULL OR output_ref IS NOT NULL
"""
_COMMON = (
    "insert_id, timestamp, trace, span_id, conversation_id, usage_input_tokens, usage_output_tokens, "
    "agent_name, finish_reasons, user_id"
)
_UNPIVOT = f"""
    SELECT {_COMMON}, input_ref AS messages_ref_uri, 'input' AS message_type FROM log WHERE input_ref IS NOT NULL
    UNION ALL
    SELECT {_COMMON}, output_ref AS messages_ref_uri, 'output' AS message_type FROM log WHERE output_ref IS NOT NULL
"""
_CALL_ID = r"string_split(nullif(regexp_extract(messages_ref_uri, '/([^/]+)\.jsonl', 1), ''), '_')[1]"
_JOIN = f"""
    SELECT r.*, {_CALL_ID} AS api_call_id, m.role, m.message_idx
    FROM refs r JOIN ({b.MESSAGES_SQL}) m ON r.messages_ref_uri = m.file_path
"""
_FLAT = f"""
    SELECT r.*, {_CALL_ID} AS api_call_id, m.role, m.message_idx, m.part_idx, m.part_type, m.content,
           CAST(NULL AS STRING) AS uri, m.mime_type, m.data_md5_hex, m.tool_id, m.tool_name, m.tool_args,
           CAST(NULL AS STRING) AS tool_response
    FROM refs r JOIN ({b.PART_ROWS_SQL}) m ON r.messages_ref_uri = m.file_path
"""
_STAGE1 = """
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (
            PARTITION BY conversation_id, trace, span_id, message_type, role, message_idx, part_idx
            ORDER BY timestamp DESC, insert_id, messages_ref_uri) AS rn
        FROM flat) WHERE rn = 1
"""
_STAGE2 = """
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, CASE WHEN message_type = 'input' THEN row_number() OVER (
            PARTITION BY conversation_id, message_type, role, message_idx, part_idx
            ORDER BY timestamp, insert_id, messages_ref_uri) ELSE 1 END AS rn
        FROM stage1) WHERE rn = 1
"""
_NO_ECHO = "NOT (message_type = 'input' AND role = 'assistant')"


def _sql(body: str) -> str:
    return b.for_duckdb(
        f"WITH log AS ({_LOG}), refs AS ({_UNPIVOT}), flat AS ({_FLAT}), "
        f"stage1 AS ({_STAGE1}), stage2 AS ({_STAGE2}) {body}"
    )


_K = ", ".join(_KEYS)
ORACLE = {
    "log_refs": _sql("SELECT * FROM log"),
    "unpivot_refs": _sql("SELECT * FROM refs"),
    "refs_join_messages": _sql(_JOIN),
    "unnest_parts": _sql("SELECT * FROM flat"),
    "dedup_within_trace": _sql(f"SELECT {_K} FROM stage1"),
    "dedup_across_traces": _sql(f"SELECT {_K} FROM stage2"),
    "drop_echoed_assistant": _sql(f"SELECT {_K} FROM flat WHERE {_NO_ECHO}"),
    "order_completions": _sql(
        f"SELECT {_K} FROM flat ORDER BY conversation_id NULLS FIRST, timestamp, message_type, message_idx, part_idx"
    ),
    "completions_view": _sql(
        f"SELECT {', '.join(ops.VIEW_COLUMNS)} FROM stage2 WHERE {_NO_ECHO} "
        "ORDER BY conversation_id NULLS FIRST, timestamp, message_type, message_idx, part_idx"
    ),
}
