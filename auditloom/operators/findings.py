"""Report text to structured findings, metrics and the response envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import contains_any, null_if_empty, strip, text_lines

# Words that open each branch of the line parser, and words that negate it.
GATE_WORDS = ["gating violation", "policy violation"]
SAST_WORDS = [
    "sql injection", "command injection", "path traversal", "insecure cryptography", "weak hashing", "xss", "ssrf",
]
SCA_WORDS = ["vulnerable dependency", "outdated dependency", "cve-"]
SMELL_WORDS = ["code smell", "empty except", "broad exception", "todo", "hardcoded credentials"]
SAST_NEGATIONS = [
    "none", "no violations", "no flaws", "0 violations", "zero violations", "passed", "safe", "clean", "no security",
]
OTHER_NEGATIONS = ["none", "no violations", "passed", "safe", "clean"]
FILE_MENTION = r"(?:in|at|file)\s+([a-zA-Z0-9_\-\./]+\.(?:py|js|go|java|rb|cpp|h))"
NO_FINDINGS = "Low risk: No immediate vulnerabilities identified."
METRICS = [
    "user_enumeration", "weak_hashing", "insecure_jwt", "sast_vulnerabilities", "sca_vulnerabilities", "code_smells",
]
ENVELOPE_VERSION = "v0.9"


def _record(kind: Column | str, severity: Column | str, file: Column | str) -> Column:
    def column(value: Column | str) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    return F.struct(
        column(kind).alias("type"), column(severity).alias("severity"), column(file).alias("file"),
        F.lit("N/A").alias("line"), F.col("code"),
    )


def _classify() -> Column:
    """Finding of the trimmed line ``code`` (lower-cased: ``low``); NULL when there is none.

    The first branch whose words occur decides, even when a negation then drops the line.
    """
    low = F.col("low")
    file = F.coalesce(null_if_empty(F.regexp_extract("code", FILE_MENTION, 1)), F.lit("Unknown"))
    gate_type = (
        F.when(contains_any(low, ["eval", "exec"]), "Prohibited Builtin (eval/exec)")
        .when(contains_any(low, ["taint", "flows to dangerous sink"]), "Dynamic Command Injection")
        .when(low.contains("structural policy"), "RBAC Authorization Failure")
        .otherwise("Sandbox Gating Violation")
    )
    critical = contains_any(low, ["eval", "exec", "taint", "flows to dangerous sink"])

    def unless(negations: list[str], record: Column) -> Column:
        return F.when(~contains_any(low, negations), record)

    return (
        F.when(
            contains_any(low, GATE_WORDS),
            _record(gate_type, F.when(critical, "CRITICAL").otherwise("HIGH"), "sandbox_gating.py"),
        )
        .when(
            contains_any(low, SAST_WORDS),
            unless(
                SAST_NEGATIONS,
                _record(
                    "SAST: Vulnerability Detected",
                    F.when(contains_any(low, ["sql", "command"]), "CRITICAL").otherwise("HIGH"),
                    file,
                ),
            ),
        )
        .when(
            contains_any(low, SCA_WORDS),
            unless(OTHER_NEGATIONS, _record("SCA: Package Vulnerability", "MEDIUM", "requirements.txt")),
        )
        .when(
            contains_any(low, SMELL_WORDS),
            unless(
                OTHER_NEGATIONS,
                _record(
                    "SonarQube: Code Smell / Quality",
                    F.when(contains_any(low, ["hardcoded", "credential"]), "HIGH").otherwise("LOW"),
                    "Unknown",
                ),
            ),
        )
    )


def report_lines(reports: DataFrame, text: str = "text") -> DataFrame:
    """Trimmed lines ``(report_id, line_no, code)``; an empty report has one row of NULLs."""
    return reports.withColumn("__lines", text_lines(F.col(text))).select(
        "report_id", F.posexplode_outer("__lines").alias("line_no", "raw")
    ).select("report_id", F.col("line_no").cast("bigint").alias("line_no"), strip(F.col("raw")).alias("code"))


def _classified(lines: DataFrame) -> DataFrame:
    return lines.withColumn("low", F.lower("code")).withColumn("finding", _classify())


def parse_findings(lines: DataFrame) -> DataFrame:
    """Findings of report lines, with repeats."""
    return _classified(lines).filter(F.col("finding").isNotNull()).select("report_id", "line_no", "finding.*")


def first_finding_per_key(findings: DataFrame) -> DataFrame:
    """First finding of each (type, code) in a report.

    Severity and file follow from the code, so this is a grouping with a minimum, combined before
    the shuffle.
    """
    return findings.groupBy("report_id", "type", "severity", "file", "line", "code").agg(
        F.min("line_no").alias("line_no")
    )


def _metric_aggregates() -> list[Column]:
    code, kind = F.lower("finding.code"), F.col("finding.type")
    kind_low = F.lower(kind)
    sast = kind_low.contains("sast") | kind.isin("Dynamic Command Injection", "Prohibited Builtin (eval/exec)")
    flags = [
        code.contains("user enumeration"),
        contains_any(code, ["weak hash", "cryptography"]),
        contains_any(code, ["jwt", "token"]),
        sast,
        kind_low.contains("sca"),
        kind_low.contains("sonarqube"),
    ]
    return [
        F.bool_or(F.col("finding").isNotNull()).alias("vulnerabilities_found"),
        *[F.bool_or(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in zip(METRICS, flags)],
    ]


def audit_metrics(lines: DataFrame) -> DataFrame:
    """Six flags per report and whether anything was found; repeats do not change a flag.

    Every line takes part, so reports without findings keep their row without a join.
    """
    return _classified(lines).groupBy("report_id").agg(*_metric_aggregates())


def accumulate_text(events: DataFrame) -> DataFrame:
    """Text of one run: its non-empty text parts in arrival order, joined without separator.

    The run's text is one value by definition (the response of one invocation), so its parts are
    gathered in one row. ``events`` has ``report_id, event_no, parts array<struct<text>>``.
    """
    parts = events.select("report_id", "event_no", F.posexplode("parts").alias("part_no", "part")).filter(
        F.coalesce(F.col("part.text"), F.lit("")) != ""
    )
    gathered = F.array_sort(F.collect_list(F.struct("event_no", "part_no", F.col("part.text").alias("text"))))
    return parts.groupBy("report_id").agg(
        F.array_join(F.transform(gathered, lambda p: p["text"]), "").alias("text")
    )


def last_text_event(events: DataFrame, payloads: DataFrame) -> DataFrame:
    """Write each run's payload over its last text part.

    In the last event that has a part with text (empty counts) the first such part is replaced; if
    no event has one, the content of the last event becomes the payload. Runs without a payload
    stay as they are. ``payloads`` has ``report_id, payload``; ``events`` also ``role``.
    """
    has_text = F.exists("parts", lambda p: p["text"].isNotNull())
    last = events.groupBy("report_id").agg(
        F.max(F.when(has_text, F.col("event_no"))).alias("__text_event"), F.max("event_no").alias("__last_event")
    )
    targets = last.join(payloads, "report_id").select(
        "report_id", F.coalesce("__text_event", "__last_event").alias("event_no"),
        F.col("__text_event").isNull().alias("__whole"), "payload",
    )
    joined = events.join(targets, ["report_id", "event_no"], "left")
    place = F.array_position(F.transform("parts", lambda p: p["text"].isNotNull()), F.lit(True))
    replaced = F.transform(
        "parts",
        lambda p, i: F.when(i + 1 == place, p.withField("text", F.col("payload"))).otherwise(p),
    )
    part_type = events.schema["parts"].dataType.elementType
    fresh = F.array(
        F.struct(
            *[
                (F.col("payload") if f.name == "text" else F.lit(None).cast(f.dataType)).alias(f.name)
                for f in part_type.fields
            ]
        )
    )
    return joined.withColumns(
        {
            "parts": F.when(F.col("payload").isNull(), F.col("parts")).when(F.col("__whole"), fresh).otherwise(replaced),
            "role": F.when(F.col("__whole"), "model").otherwise(F.col("role")),
        }
    ).select(*events.columns)


def audit_envelope(
    reports: DataFrame, title: str = "Security Audit Report", surface: str = "audit-surface"
) -> DataFrame:
    """Response envelope of each report as JSON.

    ``reports`` has ``report_id, text``. One grouping yields the flags and the findings of a report;
    the findings of one text are gathered in its row, repeats dropped (equal type and code have
    equal severity and file).
    """
    numbered = F.when(F.col("finding").isNotNull(), F.struct("line_no", "finding"))
    gathered = F.array_sort(F.collect_list(numbered))
    per_report = _classified(report_lines(reports)).groupBy("report_id").agg(
        *_metric_aggregates(),
        F.array_distinct(F.transform(gathered, lambda g: g["finding"])).alias("parsed"),
    )
    staged = reports.join(per_report, "report_id")
    parsed = F.col("parsed")
    codes = F.transform(parsed, lambda f: f["code"])
    items = F.when(F.size(parsed) == 0, F.array(F.lit(NO_FINDINGS))).otherwise(codes)
    data = F.struct(
        "vulnerabilities_found",
        F.col("text").alias("raw_output"),
        parsed.alias("parsed_vulnerabilities"),
        F.struct(*METRICS).alias("metrics"),
    )

    def component(name: str, kind: str, *more: Column) -> Column:
        return F.to_json(F.struct(F.lit(name).alias("id"), F.lit(kind).alias("type"), *more))

    components = F.concat(
        F.lit("["),
        component("root", "Container", F.array(F.lit("title"), F.lit("vulnerabilities_list")).alias("children")),
        F.lit(","),
        component("title", "Header", F.struct(F.lit(title).alias("text")).alias("properties")),
        F.lit(","),
        component("vulnerabilities_list", "List", F.struct(items.alias("items")).alias("properties")),
        F.lit("]"),
    )
    envelope = F.concat(
        F.lit('{"data":'), F.to_json(data),
        F.lit(f',"ui":{{"version":"{ENVELOPE_VERSION}","updateComponents":{{"surfaceId":"{surface}","components":'),
        components, F.lit('}},"ui_available":true}'),
    )
    return staged.select("report_id", envelope.alias("envelope"))


def audit_report(reports: DataFrame, metrics: DataFrame, title: str = "Automated Security Audit Report") -> DataFrame:
    """Markdown report per audit: status line, metric table, raw text."""
    def row(name: str) -> Column:
        state = F.when(F.col(name), "⚠️  Vulnerability Flagged").otherwise("✅ Safe")
        return F.concat(F.lit("| "), F.initcap(F.replace(F.lit(name), F.lit("_"), F.lit(" "))), F.lit(" | "), state, F.lit(" |"))

    status = F.when(F.col("vulnerabilities_found"), "❌ **Vulnerabilities Identified**").otherwise(
        "✅ **No Critical Vulnerabilities Found**"
    )
    body = F.array(
        F.lit(f"## 🔍 {title}"), F.lit(""), F.concat(F.lit("### Status: "), status), F.lit(""),
        F.lit("### Code Quality & Security Metrics"), F.lit("| Metric | Status |"), F.lit("| :--- | :--- |"),
        *[row(name) for name in METRICS],
        F.lit(""), F.lit("### Summary of Findings"), F.lit("```markdown"), F.col("text"), F.lit("```"), F.lit(""),
        F.lit("> _Report generated automatically._"),
    )
    return reports.join(metrics, "report_id").select("report_id", F.array_join(body, "\n").alias("report"))
