"""User feedback, review outcomes and webhook requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import json_quote

# The literals a feedback row must carry, and default texts.
LOG_TYPE = "feedback"
SERVICE_NAME = "audit-service"
DEFAULT_PROMPT = (
    "Fix the security violations in this code.\n\nCode:\n{insecure_code}\n\nViolations:\n{error_trace}\n"
)


def validate_feedback(rows: DataFrame, service_name: str = SERVICE_NAME) -> DataFrame:
    """Typed rows with defaults and a flag ``valid``.

    The score must be a number and the two literals must match when given; a missing text is empty
    and missing ids get a fresh one.
    """
    col = F.col
    score = col("score").try_cast("double")
    log_type = F.coalesce("log_type", F.lit(LOG_TYPE))
    service = F.coalesce("service_name", F.lit(service_name))
    return rows.select(
        *[c for c in rows.columns if c not in ("score", "text", "log_type", "service_name", "user_id", "session_id")],
        score.alias("score"),
        F.coalesce("text", F.lit("")).alias("text"),
        log_type.alias("log_type"),
        service.alias("service_name"),
        F.coalesce("user_id", F.uuid()).alias("user_id"),
        F.coalesce("session_id", F.uuid()).alias("session_id"),
        (score.isNotNull() & (log_type == LOG_TYPE) & (service == service_name)).alias("valid"),
    )


def split_feedback(rows: DataFrame, service_name: str = SERVICE_NAME) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected)"""
    checked = validate_feedback(rows, service_name)
    return checked.filter("valid").drop("valid"), checked.filter("NOT valid").drop("valid")


def session_key(clone_url: Column, prefix: str = "repo-session-") -> Column:
    """Session of a repository: last path segment without ``.git``; a default when there is no URL."""
    name = F.replace(F.element_at(F.split(clone_url, "/"), -1), F.lit(".git"), F.lit(""))
    given = F.coalesce(clone_url, F.lit("")) != ""
    return F.concat(F.lit(prefix), F.when(given, name).otherwise(F.lit("default-repo")))


def webhook_events(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Pull-request events out of JSON text; missing keys take their defaults."""
    from auditloom.schemas import WEBHOOK_SCHEMA

    kept = [c for c in payloads.columns if c != payload]
    parsed = payloads.select(*kept, F.from_json(payload, WEBHOOK_SCHEMA).alias("p"))
    flat = parsed.select(
        *kept,
        F.coalesce("p.repository.clone_url", F.lit("")).alias("clone_url"),
        F.coalesce("p.pull_request.title", F.lit("")).alias("title"),
        F.coalesce("p.number", F.lit(0).cast("bigint")).alias("number"),
    )
    return flat.withColumn("session_id", session_key(F.col("clone_url")))


def _filled(template: str, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` slots; texts between slots are literals, values are never scanned again."""
    pieces: list[Column] = []
    rest = template
    while rest:
        places = [(rest.index("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not places:
            pieces.append(F.lit(rest))
            break
        at, name = min(places)
        pieces += [F.lit(rest[:at]), F.coalesce(values[name], F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


def to_training_example(outcomes: DataFrame, prompt: str = DEFAULT_PROMPT) -> DataFrame:
    """Review outcomes as feedback rows; accepted ones carry a user and a model turn.

    ``outcomes`` has ``timestamp`` (when it was logged) next to the outcome fields.
    """
    answer = F.concat(
        F.lit('{\n  "patched_code": '), json_quote(F.col("proposed_patch")),
        F.lit(',\n  "explanation": '), json_quote(F.col("explanation")),
        F.lit(',\n  "severity": '), json_quote(F.col("severity")), F.lit("\n}"),
    )
    question = _filled(prompt, {"insecure_code": F.col("insecure_code"), "error_trace": F.col("error_trace")})

    def turn(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.array(F.struct(text.alias("text"))).alias("parts"))

    example = F.when(
        F.col("accepted"), F.struct(F.array(turn("user", question), turn("model", answer)).alias("contents"))
    )
    kept = [
        c for c in outcomes.columns
        if c not in ("timestamp", "developer_comment", "model_used")
    ]
    return outcomes.select(
        F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp"),
        *kept,
        F.coalesce("developer_comment", F.lit("")).alias("developer_comment"),
        F.when(F.coalesce("model_used", F.lit("")) == "", "unknown").otherwise(F.col("model_used")).alias("model_used"),
        example.alias("training_example"),
    )


def append_feedback_jsonl(rows: DataFrame, path: str) -> None:
    """Append one JSON object per row; a missing training example is written as null."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)
