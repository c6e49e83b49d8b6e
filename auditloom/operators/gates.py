"""Static gates for Python code: lint, prohibited calls, taint, outbound requests.

Parsing needs Python's own grammar, so one ``mapInPandas`` step turns each file into an array of
facts in visiting order. All rules are column expressions on that array: the file stays one row,
nothing is shuffled, and the taint rule folds over the facts in the JVM.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.arrays import explode_once
from auditloom.operators.patches import build_diff, fallback_patch

# Calls and hosts the rules know.
TAINT_SOURCES = ["input", "raw_input", "open"]
SANITIZERS = ["int", "float", "escape", "sanitize", "mask_pii"]
PROHIBITED = ["eval", "exec"]
EXECUTION_SINKS = [
    "subprocess.run", "subprocess.Popen", "subprocess.call", "os.system", "os.popen", "exec", "eval",
]
NETWORK_SINKS = [
    "requests.get", "requests.post", "urllib.request.urlopen", "http.client.HTTPConnection",
    "http.client.HTTPSConnection", "httpx.get", "httpx.post", "socket.connect",
]
APPROVED_HOSTS = ["github.com", "nvd.nist.gov", "api.github.com", "127.0.0.1", "localhost"]
URL_HOST = r"https?://([^:/\s]+)"
SCRIPT_MENTION = r"\b([\w\-./]+\.py)\b"
INLINE_CODE = r"""python3?\s+-c\s+["'](.*?)["']"""

FACT_TYPE = (
    "STRUCT<seq: INT, kind: STRING, lineno: INT, target: STRING, value_kind: STRING, value_name: STRING, "
    "func: STRING, names: ARRAY<STRING>, first_kind: STRING, first_value: STRING, message: STRING>"
)
FACTS = f"ARRAY<{FACT_TYPE}>"


def dotted(node: ast.expr) -> str:
    """``a.b.c`` for names and attributes; what cannot be named is left out."""
    attributes: list[str] = []
    while isinstance(node, ast.Attribute):
        attributes.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        attributes.append(node.id)
    return ".".join(reversed(attributes))


class _Facts(ast.NodeVisitor):
    """Collects one dict per assignment target, call and bare handler, parents first."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def _add(self, node: ast.AST, kind: str, **fields) -> None:
        self.rows.append({"seq": len(self.rows), "kind": kind, "lineno": getattr(node, "lineno", 0), **fields})

    def visit_Assign(self, node: ast.Assign) -> None:
        value = node.value
        if isinstance(value, ast.Call):
            origin = {"value_kind": "call", "value_name": dotted(value.func)}
        elif isinstance(value, ast.Name):
            origin = {"value_kind": "name", "value_name": value.id}
        elif isinstance(value, ast.Subscript) and dotted(value.value) == "sys.argv":
            origin = {"value_kind": "argv", "value_name": None}
        else:
            origin = {"value_kind": "other", "value_name": None}
        for target in node.targets:
            if isinstance(target, ast.Name):
                self._add(node, "assign", target=target.id, **origin)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        first = node.args[0] if node.args else None
        literal = isinstance(first, ast.Constant) and isinstance(first.value, str)
        self._add(
            node,
            "call",
            func=dotted(node.func),
            names=[a.id for a in node.args if isinstance(a, ast.Name)],
            first_kind=None if first is None else ("text" if literal else "other"),
            first_value=first.value if literal else None,
        )
        self.generic_visit(node)

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        if len(node.body) == 1 and isinstance(node.body[0], ast.Pass):
            self._add(node, "except")
        self.generic_visit(node)


_FIELDS = [
    "seq", "kind", "lineno", "target", "value_kind", "value_name", "func", "names", "first_kind", "first_value",
    "message",
]


def code_facts(code: str | None, name: str) -> list[dict]:
    """Facts of one file; a file that does not parse has a single ``syntax_error`` fact."""
    try:
        tree = ast.parse(code or "", filename=name)
        visitor = _Facts()
        visitor.visit(tree)
        rows = visitor.rows
    except SyntaxError as error:
        rows = [{"seq": 0, "kind": "syntax_error", "lineno": error.lineno, "message": error.msg}]
    except (RecursionError, MemoryError) as error:
        # Code nested too deeply to analyse must not pass, and must not fail the job.
        rows = [{"seq": 0, "kind": "syntax_error", "lineno": 0, "message": type(error).__name__}]
    return [{field: row.get(field) for field in _FIELDS} for row in rows]


def extract_code_facts(files: DataFrame) -> DataFrame:
    """``(path, content, facts)``: one row per file, parsed in Arrow batches, no shuffle."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["facts"] = [code_facts(c, p) for p, c in zip(batch["path"], batch["content"])]
            yield batch[["path", "content", "facts"]]

    return files.select("path", "content").mapInPandas(parse, f"path STRING, content STRING, facts {FACTS}")


def code_fact_rows(facts: DataFrame) -> DataFrame:
    """The facts as a table."""
    return facts.select("path", F.explode("facts").alias("f")).select("path", "f.*")


def _of_kind(kind: str) -> Column:
    return F.filter("facts", lambda f: f["kind"] == kind)


def syntax_errors() -> Column:
    return F.transform(
        _of_kind("syntax_error"),
        lambda f: F.format_string("Lint/Syntax Error in %s:%s: %s", "path", f["lineno"].cast("string"), f["message"]),
    )


def lint_empty_except() -> Column:
    return F.transform(
        _of_kind("except"),
        lambda f: F.concat(
            F.lit("Lint Warning: Empty exception catch block at line "), f["lineno"].cast("string"),
            F.lit(" is discouraged."),
        ),
    )


def _prohibited_message(func: Column) -> Column:
    return F.concat(F.lit("AST Gating Violation: Use of prohibited function '"), func, F.lit("' is blocked."))


def _taint_message(name: Column, func: Column) -> Column:
    return F.concat(
        F.lit("Dynamic Taint Gating Violation: Untrusted input variable '"), name,
        F.lit("' flows to dangerous sink '"), func, F.lit("' without sanitization."),
    )


def prohibited_calls() -> Column:
    calls = F.filter(_of_kind("call"), lambda f: f["func"].isin(PROHIBITED))
    return F.transform(calls, lambda f: _prohibited_message(f["func"]))


def gating_errors() -> Column:
    """Prohibited calls and tainted arguments, in visiting order.

    The fold carries the tainted and the sanitized names. A source taints its target; a sanitizer
    clears it for good; a plain copy of a tainted name taints; anything else clears.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("tainted"), none.alias("clean"), none.alias("errors"))

    def step(acc: Column, fact: Column) -> Column:
        tainted, clean, errors = acc["tainted"], acc["clean"], acc["errors"]
        target = F.array(fact["target"])
        is_call = fact["value_kind"] == "call"
        source = (is_call & fact["value_name"].isin(TAINT_SOURCES)) | (fact["value_kind"] == "argv")
        sanitizer = is_call & fact["value_name"].isin(SANITIZERS)
        copied = (fact["value_kind"] == "name") & F.array_contains(tainted, fact["value_name"])
        assign = fact["kind"] == "assign"
        is_call_fact = fact["kind"] == "call"
        banned = F.when(
            fact["func"].isin(PROHIBITED), F.array(_prohibited_message(fact["func"]))
        ).otherwise(none)
        flowing = F.filter(
            fact["names"], lambda n: F.array_contains(tainted, n) & ~F.array_contains(clean, n)
        )
        flows = F.when(
            fact["func"].isin(EXECUTION_SINKS), F.transform(flowing, lambda n: _taint_message(n, fact["func"]))
        ).otherwise(none)
        return F.struct(
            F.when(~assign, tainted)
            .when(F.coalesce(source | (~sanitizer & copied), F.lit(False)), F.array_union(tainted, target))
            .otherwise(F.array_except(tainted, target))
            .alias("tainted"),
            F.when(assign & F.coalesce(~source & sanitizer, F.lit(False)), F.array_union(clean, target))
            .otherwise(clean)
            .alias("clean"),
            F.when(is_call_fact, F.concat(errors, banned, flows)).otherwise(errors).alias("errors"),
        )

    return F.aggregate("facts", start, step, lambda acc: acc["errors"])


def taint_violations() -> Column:
    return F.filter(gating_errors(), lambda e: e.startswith("Dynamic Taint"))


def url_host(url: Column) -> Column:
    """Host of an http(s) URL; the whole text when there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(url, URL_HOST, 1), F.lit("")), url)


def egress_violations(hosts: list[str] | None = None) -> Column:
    """Requests to hosts outside the list, or to destinations that are not literal texts."""
    approved = hosts or APPROVED_HOSTS
    sinks = F.filter(
        _of_kind("call"),
        lambda f: f["func"].isin(NETWORK_SINKS)
        & ((f["first_kind"] == "other") | ((f["first_kind"] == "text") & ~url_host(f["first_value"]).isin(approved))),
    )
    return F.transform(
        sinks,
        lambda f: F.when(
            f["first_kind"] == "text",
            F.concat(
                F.lit("Egress Governance Violation: Outbound request to unapproved host '"), url_host(f["first_value"]),
                F.lit("' is blocked to prevent indirect prompt injection."),
            ),
        ).otherwise(
            F.concat(
                F.lit("Egress Governance Violation: Dynamic/variable network destination in '"), f["func"],
                F.lit("' cannot be verified and is blocked."),
            )
        ),
    )


def numbered_error_trace(errors: Column) -> Column:
    return F.array_join(
        F.transform(
            errors, lambda e, i: F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit("] "), e)
        ),
        "\n",
    )


def gate_report(files: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """Per file: ordered errors, whether it passed, the numbered trace, and a fallback patch.

    A file that does not parse reports only that.
    """
    rules = F.concat(lint_empty_except(), gating_errors(), egress_violations(hosts))
    return (
        extract_code_facts(files)
        .withColumn("errors", F.when(F.size(syntax_errors()) > 0, syntax_errors()).otherwise(rules))
        .withColumn("passed", F.size("errors") == 0)
        .withColumn("error_trace", numbered_error_trace(F.col("errors")))
        .withColumn("patched_code", F.when(~F.col("passed"), fallback_patch(F.col("error_trace"))))
        .withColumn("diff", F.when(~F.col("passed"), build_diff(F.col("content"), F.col("patched_code"), F.col("path"))))
        .select("path", "passed", "errors", "error_trace", "patched_code", "diff")
    )


def error_rows(report: DataFrame) -> DataFrame:
    """Errors as rows ``(path, error_no, error)``."""
    return explode_once(report, ["path"], F.col("errors"), "error", "pos").select(
        "path", (F.col("pos") + 1).cast("bigint").alias("error_no"), "error"
    )


def command_targets(commands: DataFrame) -> DataFrame:
    """Code a command would run: script names, and inline code as a row of its own.

    ``commands`` has ``command_id, command``; the result ``(command_id, path, content)`` has NULL
    content for scripts, which are looked up by path.
    """
    scripts = F.transform(
        F.regexp_extract_all("command", F.lit(SCRIPT_MENTION), 1),
        lambda p: F.struct(p.alias("path"), F.lit(None).cast("string").alias("content")),
    )
    inline = F.when(
        F.col("command").rlike(INLINE_CODE),
        F.array(F.struct(F.lit("<inline>").alias("path"), F.regexp_extract("command", INLINE_CODE, 1).alias("content"))),
    ).otherwise(F.array().cast("array<struct<path:string,content:string>>"))
    return explode_once(commands, ["command_id"], F.concat(scripts, inline), "t").select("command_id", "t.*")


def blocked_commands(commands: DataFrame, files: DataFrame) -> DataFrame:
    """Commands whose scripts or inline code fail the gates, with the errors.

    Each distinct script is gated once, whatever number of commands names it.
    """
    targets = command_targets(commands)
    named = targets.filter(F.col("content").isNull()).select("command_id", "path")
    used = files.join(named.select("path").distinct(), "path", "left_semi")
    script_errors = named.join(error_rows(gate_report(used)), "path")
    inline = targets.filter(F.col("content").isNotNull())
    codes = inline.select("content").distinct().select(F.lit("<inline>").alias("path"), "content")
    gated = extract_code_facts(codes)
    rules = F.concat(lint_empty_except(), gating_errors(), egress_violations())
    errors = F.when(F.size(syntax_errors()) > 0, syntax_errors()).otherwise(rules)
    inline_errors = inline.join(explode_once(gated, ["content"], errors, "error", "pos"), "content").select("command_id", "path", (F.col("pos") + 1).cast("bigint").alias("error_no"), "error")
    return script_errors.select("command_id", "path", "error_no", "error").unionByName(inline_errors)


def page_egress(pages: DataFrame, hosts: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose host is not in the allow list ``hosts(host)``; exact match, no sub-domains."""
    return pages.withColumn("host", url_host(F.col(url))).join(hosts, "host", "left_anti")
