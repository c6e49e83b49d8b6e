"""Tool-call policy: allowed tools, attack signatures, session quarantine.

The quarantine of a session starts at its first signature. That moment is a map-side combined
minimum per session, joined back to the calls; a session with a third of all calls is split by the
skew handling of the join instead of being sorted in one window task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.lookup import inline_table
from auditloom.functions.text import contains_any, first_contained

# Signatures, tools that need a second opinion, and the default grants.
SIGNATURES = ["rm -rf", "adversarial_vibes", "malicious_payload"]
REVIEWED_TOOLS = ["run_sandbox", "execute_command", "commit_changes"]
DEFAULT_POLICY = {
    "search_agent": ["query_spanner_graph", "search_vector_db", "list_resources", "clone_github_repo"],
    "story_agent": ["fetch_epic", "get_requirements"],
    "impact_agent": ["scan_call_graph", "track_dependencies"],
    "task_breakdown_agent": ["create_jira_ticket", "order_tasks"],
    "coding_agent": ["execute_sandbox", "apply_git_diff", "run_unit_tests", "request_input"],
}


def policy_table(spark: SparkSession, policy: dict[str, list[str]] | None = None) -> DataFrame:
    """Grants as rows ``(agent, tool)``."""
    roles = DEFAULT_POLICY if policy is None else policy
    rows = [(agent, tool) for agent, tools in roles.items() for tool in tools]
    return inline_table(spark, rows, "agent STRING, tool STRING")


def rbac_violations(calls: DataFrame, policy: DataFrame) -> DataFrame:
    """Calls whose agent may not use the tool. Unknown agents may use none; a NULL agent is not checked."""
    return calls.filter(F.col("agent").isNotNull()).join(policy, ["agent", "tool"], "left_anti")


def rbac_allowed(calls: DataFrame, policy: DataFrame) -> DataFrame:
    """The other calls: those whose agent may use the tool, and those of a NULL agent."""
    grants = policy.select(F.col("agent").alias("_agent"), F.col("tool").alias("_tool"), F.lit(True).alias("_granted")).distinct()
    marked = calls.join(grants, (F.col("agent") == F.col("_agent")) & (F.col("tool") == F.col("_tool")), "left")
    return marked.filter(F.col("agent").isNull() | F.col("_granted")).select(*calls.columns)


def offending_value(args: Column, signatures: list[str] | None = None) -> Column:
    """First argument value that carries a signature; NULL when none does."""
    marks = signatures or SIGNATURES
    return F.try_element_at(F.filter(F.map_values(args), lambda v: contains_any(v, marks)), F.lit(1))


def adversarial_signature(calls: DataFrame, signatures: list[str] | None = None) -> DataFrame:
    """Calls that carry a signature, with the value and the signature found in it."""
    marks = signatures or SIGNATURES
    return (
        calls.withColumn("offending_value", offending_value(F.col("args"), marks))
        .filter(F.col("offending_value").isNotNull())
        .withColumn("signature", first_contained(F.col("offending_value"), marks))
    )


def first_signatures(calls: DataFrame) -> DataFrame:
    """Per session, when its first signature arrived."""
    return (
        calls.filter(offending_value(F.col("args")).isNotNull())
        .groupBy("session_id")
        .agg(F.min(F.struct("ts", "seq")).alias("first_signature"))
    )


def quarantine_status(calls: DataFrame) -> DataFrame:
    """Add ``quarantined``: an earlier call of the session carried a signature."""
    joined = calls.join(first_signatures(calls), "session_id", "left")
    later = F.struct("ts", "seq") > F.col("first_signature")
    return joined.withColumn("quarantined", F.coalesce(later, F.lit(False))).drop("first_signature")


def needs_semantic_review(calls: DataFrame, verdicts: DataFrame, tools: list[str] | None = None) -> DataFrame:
    """Calls to reviewed tools with the outside verdict; a missing verdict denies the call.

    ``verdicts`` has ``session_id, seq, decision``.
    """
    return (
        calls.filter(F.col("tool").isin(tools or REVIEWED_TOOLS))
        .join(verdicts, ["session_id", "seq"], "left")
        .withColumn("approved", F.coalesce(F.col("decision") == "APPROVED", F.lit(False)))
    )


def tool_call_decisions(
    calls: DataFrame, policy: DataFrame, verdicts: DataFrame | None = None
) -> DataFrame:
    """One decision per call. Quarantine beats a signature, a signature beats the policy.

    Without ``verdicts`` the second opinion is off, as when no reviewer is reachable by design.
    """
    grants = policy.select("agent", "tool").distinct().withColumn("granted", F.lit(True))
    staged = quarantine_status(calls).withColumn("offending_value", offending_value(F.col("args")))
    staged = staged.join(grants, ["agent", "tool"], "left")
    review = F.lit(False)
    if verdicts is not None:
        opinions = verdicts.select("session_id", "seq", F.col("decision").alias("opinion"))
        staged = staged.join(opinions, ["session_id", "seq"], "left")
        review = (
            F.col("agent").isNotNull()
            & F.col("tool").isin(REVIEWED_TOOLS)
            & (F.coalesce(F.col("opinion"), F.lit("DENIED")) != "APPROVED")
        )
    decision = (
        F.when(F.col("quarantined"), "QUARANTINED")
        .when(F.col("offending_value").isNotNull(), "ANOMALY")
        .when(F.col("agent").isNotNull() & F.col("granted").isNull(), "RBAC_BLOCK")
        .when(review, "SEMANTIC_BLOCK")
        .otherwise("ALLOW")
    )
    staged = staged.withColumn("decision", decision).withColumn("args", F.to_json("args"))
    return staged.select("session_id", "seq", "ts", "agent", "tool", "decision", *anomaly_columns())


def anomaly_columns() -> list[Column]:
    """What is kept of an anomaly: value, tool and arguments (JSON) of the call, and the trace that starts a remediation.

    NULL for other decisions. Expects ``decision, offending_value, tool`` and ``args`` as JSON.
    """
    here = F.col("decision") == "ANOMALY"
    trace = F.concat(
        F.lit("Blue Team detected adversarial payload in tool '"), F.col("tool"), F.lit("': '"), F.col("offending_value"), F.lit("'")
    )
    return [
        F.when(here, F.col("offending_value")).alias("offending_value"),
        F.when(here, F.col("tool")).alias("offending_tool"),
        F.when(here, F.col("args")).alias("offending_args"),
        F.when(here, trace).alias("error_trace"),
    ]


def session_policy_flags(decisions: DataFrame) -> DataFrame:
    """Per session: quarantined, remediation started, blocked by policy, and whether any holds."""
    def any_call(name: str) -> Column:
        return F.bool_or(F.col("decision") == name)

    return decisions.groupBy("session_id").agg(
        any_call("ANOMALY").alias("quarantined"),
        any_call("ANOMALY").alias("remediation_triggered"),
        any_call("RBAC_BLOCK").alias("blocked_by_rbac"),
        (any_call("ANOMALY") | any_call("RBAC_BLOCK")).alias("policy_violation"),
    )
