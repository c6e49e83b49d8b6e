"""Which traces to keep, their spans, and span latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Span names, and attribute keys that decide retention.
TOOL_SPAN = "agent.tool"
SANDBOX_TOOL = "execute_sandbox"
MODEL_SPAN = "generate_content"
POLICY_ATTRIBUTES = ["policy_violation", "blocked_by_rbac"]
FALSE_TEXTS = ["", "false", "0", "none"]


def is_set(value: Column) -> Column:
    """Truth of a typed attribute that was stored as text."""
    return F.coalesce(~F.lower(value).isin(FALSE_TEXTS), F.lit(False))


def fact_columns() -> list[Column]:
    """Trace and flags of a span, as expressions."""
    attribute = F.col("attributes")
    exceptions = F.filter("events", lambda e: e["name"] == "exception")
    policy = (
        is_set(attribute[POLICY_ATTRIBUTES[0]])
        | is_set(attribute[POLICY_ATTRIBUTES[1]])
        | F.coalesce(attribute["agent_status"] == "QUARANTINED", F.lit(False))
    )
    return [
        F.col("trace_id"),
        F.col("parent_id").isNull().alias("is_root"),
        F.coalesce((F.col("status") == "ERROR") | (F.size(exceptions) > 0), F.lit(False)).alias("is_error"),
        policy.alias("is_policy"),
        F.coalesce(
            (F.col("name") == TOOL_SPAN) & (attribute["tool.name"] == SANDBOX_TOOL), F.lit(False)
        ).alias("is_sandbox"),
        F.coalesce(F.col("name").contains(MODEL_SPAN), F.lit(False)).alias("is_model"),
    ]


def span_facts(spans: DataFrame) -> DataFrame:
    """Per span, the facts that the retention of its trace depends on."""
    return spans.select(*fact_columns())


def trace_retention(spans: DataFrame, threshold: int = 3) -> DataFrame:
    """One row per trace: keep it or not, and why. Traces without a root are not kept.

    An exception of any type already counts as an error, so the types that also signal a policy
    breach never change the outcome.
    """
    facts = span_facts(spans).groupBy("trace_id").agg(
        F.bool_or("is_root").alias("rooted"),
        F.bool_or("is_error").alias("has_error"),
        F.bool_or("is_policy").alias("has_policy"),
        F.count_if("is_sandbox").alias("sandbox_calls"),
        F.count_if("is_model").alias("model_calls"),
        F.count(F.lit(1)).alias("spans"),
    )
    loops = (F.col("sandbox_calls") >= threshold) | (F.col("model_calls") >= threshold)
    reason = (
        F.when(~F.col("rooted"), "no_root")
        .when(F.col("has_error"), "error")
        .when(F.col("has_policy"), "policy")
        .when(loops, "self_repair")
        .otherwise("routine")
    )
    return facts.withColumn("reason", reason).select(
        "trace_id",
        F.col("reason").isin("error", "policy", "self_repair").alias("retained"),
        "reason", "sandbox_calls", "model_calls", "spans",
    )


def retained_spans(spans: DataFrame, threshold: int = 3) -> DataFrame:
    """All spans of the traces to keep."""
    kept = trace_retention(spans, threshold).filter("retained").select("trace_id")
    return spans.join(kept, "trace_id", "left_semi")


def span_latency(spans: DataFrame) -> DataFrame:
    """Latency by span name and tool, in milliseconds."""
    micros = F.unix_micros("end_ts") - F.unix_micros("start_ts")
    timed = spans.select(
        "name", F.col("attributes")["tool.name"].alias("tool"), micros.alias("us")
    )
    return timed.groupBy("name", "tool").agg(
        F.count(F.lit(1)).alias("spans"),
        F.round(F.sum("us") / F.count(F.lit(1)) / 1000, 3).alias("avg_ms"),
        F.round(F.max("us") / 1000, 3).alias("max_ms"),
        F.round(F.percentile_approx("us", 0.95, 10000) / 1000, 3).alias("p95_ms"),
    )


def latency_sketches(spans: DataFrame, k: int = 800) -> DataFrame:
    """One row a (day, name, tool): counts, sum, maximum and a quantile sketch of the latency in microseconds.

    Rows of any days can be merged later (``merged_latency``) without the spans. With ``k`` of 800 a quantile's rank is off
    by less than one in a hundred. Spans without a start or an end have no latency and no row.
    """
    micros = F.unix_micros("end_ts") - F.unix_micros("start_ts")
    timed = spans.select(F.to_date("start_ts").alias("day"), "name", F.col("attributes")["tool.name"].alias("tool"), micros.alias("us"))
    return timed.filter("us IS NOT NULL").groupBy("day", "name", "tool").agg(
        F.count(F.lit(1)).alias("spans"),
        F.sum("us").alias("sum_us"),
        F.max("us").alias("max_us"),
        F.kll_sketch_agg_bigint("us", k).alias("sketch"),
    )


def merged_latency(sketches: DataFrame, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Latency by name and tool, in milliseconds, from rows of ``latency_sketches``: exact mean and maximum, estimated quantiles."""
    wanted = quantiles or {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    merged = sketches.groupBy("name", "tool").agg(
        F.sum("spans").alias("spans"),
        F.sum("sum_us").alias("sum_us"),
        F.max("max_us").alias("max_us"),
        F.kll_merge_agg_bigint("sketch").alias("sketch"),
    )
    return merged.select(
        "name", "tool", "spans",
        F.round(F.col("sum_us") / F.col("spans") / 1000, 3).alias("avg_ms"),
        F.round(F.col("max_us") / 1000, 3).alias("max_ms"),
        *[F.round(F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)) / 1000, 3).alias(name) for name, q in wanted.items()],
    )
