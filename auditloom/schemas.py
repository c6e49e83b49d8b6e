"""Explicit schemas of the external inputs (no inference on read)."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the external log and message formats.
INFERENCE_LOG_SCHEMA = """
    logName STRING, textPayload STRING, timestamp TIMESTAMP, receiveTimestamp TIMESTAMP,
    severity STRING, insertId STRING, trace STRING, spanId STRING, traceSampled BOOLEAN,
    resource STRUCT<type: STRING, labels: STRUCT<project_id: STRING, location: STRING>>,
    labels STRUCT<
        gen_ai_conversation_id: STRING, gen_ai_agent_name: STRING,
        gen_ai_input_messages_ref: STRING, gen_ai_output_messages_ref: STRING,
        gen_ai_system_instructions_ref: STRING, gen_ai_usage_input_tokens: STRING,
        gen_ai_usage_output_tokens: STRING, gen_ai_response_finish_reasons: STRING,
        gen_ai_tool_definitions: STRING, gen_ai_tool_definitions_ref: STRING,
        gcp_vertex_agent_invocation_id: STRING, gcp_vertex_agent_event_id: STRING,
        event_name: STRING, user_id: STRING>
"""

PART_TYPE = (
    "STRUCT<type: STRING, content: STRING, mime_type: STRING, uri: STRING, data: BINARY, "
    "id: STRING, name: STRING, arguments: STRING, response: STRING>"
)
COMPLETION_SCHEMA = f"parts ARRAY<{PART_TYPE}>, role STRING, index BIGINT"

SESSION_LOG_SCHEMA = "session_id STRING, status STRING, text STRING"

TEXT_CONTENT = "STRUCT<role: STRING, parts: ARRAY<STRUCT<text: STRING>>>"
EVAL_CONTENT = (
    "STRUCT<role: STRING, parts: ARRAY<STRUCT<text: STRING, "
    "function_call: STRUCT<name: STRING, args: MAP<STRING, STRING>>, "
    "function_response: STRUCT<name: STRING, response: MAP<STRING, STRING>>>>>"
)
EVAL_CASE_TYPE = (
    f"STRUCT<eval_case_id: STRING, prompt: {TEXT_CONTENT}, "
    "agent_data: STRUCT<agents: MAP<STRING, STRUCT<agent_id: STRING, instruction: STRING>>, "
    f"turns: ARRAY<STRUCT<turn_index: BIGINT, events: ARRAY<STRUCT<author: STRING, content: {EVAL_CONTENT}>>>>>, "
    f"responses: ARRAY<STRUCT<response: {TEXT_CONTENT}>>>"
)
EVAL_FILE_SCHEMA = f"eval_cases ARRAY<{EVAL_CASE_TYPE}>"

WEBHOOK_SCHEMA = (
    "number BIGINT, pull_request STRUCT<title: STRING>, repository STRUCT<clone_url: STRING>"
)

FEEDBACK_SCHEMA = (
    "score STRING, text STRING, log_type STRING, service_name STRING, user_id STRING, session_id STRING"
)

SPAN_SCHEMA = (
    "trace_id STRING, span_id STRING, parent_id STRING, name STRING, status STRING, "
    "start_ts TIMESTAMP, end_ts TIMESTAMP, attributes MAP<STRING, STRING>, "
    "events ARRAY<STRUCT<name: STRING, attributes: MAP<STRING, STRING>>>"
)

TOOL_CALL_SCHEMA = (
    "session_id STRING, seq BIGINT, ts TIMESTAMP, agent STRING, tool STRING, args MAP<STRING, STRING>"
)


def struct_type(ddl: str) -> T.StructType:
    """Parse one of the DDL strings above."""
    return T.StructType.fromDDL(ddl)
