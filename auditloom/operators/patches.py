"""Scoring of candidate patches, choice of the best, listing of the change, and the fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import contains_any, literal_array, strip, text_lines

# Weights, dangerous calls, severity keywords in order, and grade limits.
WEIGHTS = {
    "violation_removal": 0.40,
    "code_preservation": 0.25,
    "explanation_quality": 0.20,
    "severity_accuracy": 0.15,
}
DANGEROUS_PATTERNS = [
    "eval(", "exec(", "os.system(", "os.popen(", "subprocess.call(", "subprocess.run(", "subprocess.Popen(",
]
SEVERITY_KEYWORDS = {
    "CRITICAL": ["eval", "exec", "rm -rf", "command injection", "sql injection"],
    "HIGH": ["taint", "subprocess", "os.system", "deserialization", "xxe"],
    "MEDIUM": ["egress", "network", "unapproved host", "lint"],
    "LOW": ["style", "naming", "convention", "todo"],
}
GRADES = [("A", 0.85), ("B", 0.70), ("C", 0.55), ("D", 0.40)]
NO_EXPLANATION = "No explanation provided."
LINE_WITH_END = r"[^\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]*(?:\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029])|[^\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]+"
FALLBACK_HEAD = (
    "# Automatic remediation (offline fallback)\n"
    "# Original code was quarantined due to the following violations:\n"
)
FALLBACK_TAIL = "pass  # Execution blocked pending human review\n"

_LOWERED = [p.lower() for p in DANGEROUS_PATTERNS]


def grade_bucket(score: Column) -> Column:
    grade = F.lit("F")
    for letter, least in reversed(GRADES):
        grade = F.when(score >= F.lit(least), letter).otherwise(grade)
    return grade


def _ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole.cast("double")


def violation_removal(original: Column, patched: Column) -> Column:
    """Share of the dangerous calls of the original that the patch no longer has."""
    present = F.filter(literal_array(_LOWERED), lambda p: F.lower(original).contains(p))
    removed = F.filter(present, lambda p: ~F.lower(patched).contains(p))
    unchanged = F.when(patched != original, F.lit(1.0)).otherwise(F.lit(0.5))
    return F.when(F.size(present) == 0, unchanged).otherwise(_ratio(F.size(removed), F.size(present)))


def code_lines(code: Column) -> Column:
    """Distinct trimmed lines that are neither empty nor comments."""
    trimmed = F.transform(text_lines(code), strip)
    return F.array_distinct(F.filter(trimmed, lambda line: (line != "") & ~line.startswith("#")))


def code_preservation(original: Column, patched: Column) -> Column:
    """Share of the harmless original lines that are still there."""
    safe = F.filter(code_lines(original), lambda line: ~contains_any(F.lower(line), _LOWERED))
    kept = F.array_intersect(safe, code_lines(patched))
    return F.when(F.size(safe) == 0, F.lit(1.0)).otherwise(_ratio(F.size(kept), F.size(safe)))


def explanation_quality(explanation: Column, error_trace: Column) -> Column:
    """Length and mention of the words of the error trace (repeated words count again)."""
    words = F.regexp_extract_all(F.lower(error_trace), F.lit(r"\b\w{4,}\b"), 0)
    named = F.filter(words, lambda word: F.lower(explanation).contains(word))
    length = F.length(explanation)
    by_length = F.when(length > 80, F.lit(0.3) + F.lit(0.2)).when(length > 20, F.lit(0.3)).otherwise(F.lit(0.0))
    by_words = F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.lit(0.5) * _ratio(F.size(named), F.size(words)))
    given = F.coalesce(explanation, F.lit(""))
    return F.when((given == "") | (given == NO_EXPLANATION), F.lit(0.0)).otherwise(
        F.least(by_length + by_words, F.lit(1.0))
    )


def severity_accuracy(severity: Column, error_trace: Column) -> Column:
    """1 when the declared severity fits the trace; less the further the first fitting one is."""
    trace = F.lower(error_trace)
    declared = F.upper(severity)
    names = list(SEVERITY_KEYWORDS)
    fits = {name: contains_any(trace, words) for name, words in SEVERITY_KEYWORDS.items()}
    declared_fits = F.lit(False)
    for name in names:
        declared_fits = declared_fits | ((declared == name) & fits[name])
    rank = F.array_position(literal_array(names), declared).cast("int")
    first = F.coalesce(*[F.when(fits[name], F.lit(i + 1)) for i, name in enumerate(names)])
    apart = F.greatest(F.lit(1.0) - F.abs(first - rank).cast("double") * F.lit(0.3), F.lit(0.0))
    return (
        F.when(F.coalesce(severity, F.lit("")) == "", F.lit(0.0))
        .when(declared_fits, F.lit(1.0))
        .when(first.isNotNull() & (rank > 0), apart)
        .otherwise(F.lit(0.5))
    )


def score_patch(candidates: DataFrame) -> DataFrame:
    """Add the four dimensions, ``total_score`` (4 places) and ``grade`` (of the unrounded total)."""
    col = F.col
    scored = candidates.withColumns(
        {
            "violation_removal": violation_removal(col("original_code"), col("patched_code")),
            "code_preservation": code_preservation(col("original_code"), col("patched_code")),
            "explanation_quality": explanation_quality(col("explanation"), col("error_trace")),
            "severity_accuracy": severity_accuracy(col("severity"), col("error_trace")),
        }
    )
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + col(name) * F.lit(weight)
    return (
        scored.withColumn("__total", total)
        .withColumns({"total_score": F.round("__total", 4), "grade": grade_bucket(col("__total"))})
        .drop("__total")
    )


def best_patch(scored: DataFrame) -> DataFrame:
    """Per case the candidate with the highest rounded total; the first one wins a tie.

    A maximum for each column, combined before the shuffle; all have one order, so they are of one row. Columns that the caller
    does not use, such as the texts, are neither sorted nor shuffled: as parts of a struct they would be.
    """
    payload = [c for c in scored.columns if c != "case_id"]
    order = F.struct("total_score", -F.col("candidate_no"))
    best = [F.max_by(c, order).alias(c) for c in payload]
    return scored.groupBy("case_id").agg(*best, F.count(F.lit(1)).alias("candidates_count"))


def build_diff(original: Column, patched: Column, context: Column) -> Column:
    """All original lines marked ``-``, an empty line, all patched lines marked ``+``."""
    name = F.when(F.coalesce(context, F.lit("")) == "", "sandbox_code.py").otherwise(context)

    def marked(code: Column, mark: str) -> Column:
        lines = F.regexp_extract_all(code, F.lit(LINE_WITH_END), 0)
        return F.array_join(F.transform(lines, lambda line: F.concat(F.lit(mark), line)), "")

    return F.concat(
        F.lit("--- original  ("), name, F.lit(")\n+++ patched   ("), name, F.lit(")\n"),
        marked(original, "- "), F.lit("\n"), marked(patched, "+ "),
    )


def fallback_patch(error_trace: Column) -> Column:
    """A no-op stub that lists the violations as comments."""
    notes = F.transform(text_lines(error_trace), lambda line: F.concat(F.lit("# "), line, F.lit("\n")))
    body = F.when(error_trace == "", F.lit("")).otherwise(F.array_join(notes, ""))
    return F.concat(F.lit(FALLBACK_HEAD), body, F.lit(FALLBACK_TAIL))


def remediate(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """One outcome per case: the best candidate, or the fallback when there is none.

    ``cases`` has ``case_id, original_code, error_trace, context``; ``candidates`` has
    ``case_id, candidate_no, model_label, patched_code, explanation, severity``.
    """
    joined = cases.select("case_id", "original_code", "error_trace").join(candidates, "case_id")
    winners = best_patch(score_patch(joined)).select(
        "case_id", "patched_code", "explanation", "severity", "model_label", "total_score", "grade", "candidates_count"
    )
    staged = cases.join(winners, "case_id", "left")
    none = F.col("candidates_count").isNull()

    def or_else(name: str, value: Column) -> Column:
        return F.when(none, value).otherwise(F.col(name)).alias(name)

    patched = F.when(none, fallback_patch(F.col("error_trace"))).otherwise(F.col("patched_code"))
    return staged.withColumn("patched_code", patched).select(
        "case_id",
        F.when(none, "offline_fallback").otherwise("patched").alias("status"),
        "patched_code",
        or_else(
            "explanation",
            F.lit("Offline fallback: no candidate available. Code replaced with a safe no-op stub."),
        ),
        or_else("severity", F.lit("HIGH")),
        build_diff(F.col("original_code"), F.col("patched_code"), F.col("context")).alias("diff"),
        or_else("total_score", F.lit(0.0)),
        or_else("grade", F.lit("F")),
        F.coalesce("candidates_count", F.lit(0).cast("bigint")).alias("candidates_count"),
        or_else("model_label", F.lit("offline_fallback")).alias("winning_model"),
    )
