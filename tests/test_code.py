import json

import pytest
from pyspark.sql import functions as F

from auditloom.operators import dependencies as deps
from auditloom.operators import feedback, findings, gates, graph, patches
from auditloom.sources import readers


@pytest.mark.parametrize(
    "code, expected",
    [
        ("def f(:\n", ["Lint/Syntax Error"]),
        ("try:\n    f()\nexcept:\n    pass\n", ["Lint Warning: Empty exception catch block at line 3"]),
        ("eval('1')\nexec('2')\n", ["AST Gating Violation", "AST Gating Violation"]),
        ("import subprocess\ncmd = input()\nsubprocess.run(cmd)\n", ["Dynamic Taint Gating Violation: Untrusted input variable 'cmd'"]),
        ("import os, sys\na = sys.argv[1]\nb = a\nos.system(b)\n", ["Dynamic Taint Gating Violation: Untrusted input variable 'b'"]),
        ("import subprocess\nn = int(input())\nsubprocess.run(['ls', n])\n", []),
        ("x = open('f')\nx = 3\nexec(x)\n", ["AST Gating Violation"]),
        ("a = b = input()\neval(b)\n", ["AST Gating", "Dynamic Taint Gating Violation: Untrusted input variable 'b'"]),
        ("x = input()\nx: str = 'a'\nx += 'b'\nos.popen(x)\n", ["Dynamic Taint"]),
        ("x = input()\nx = sanitize(x)\nx = input()\nos.popen(x)\n", []),
        ("requests.get('https://github.com/a')\n", []),
        ("requests.get('http://github.com.evil.io/a')\n", ["Egress Governance Violation: Outbound request to unapproved host 'github.com.evil.io'"]),
        ("requests.get(url)\nhttpx.post()\n", ["Egress Governance Violation: Dynamic/variable network destination in 'requests.get'"]),
    ],
)
def test_gates(spark, code, expected):
    files = spark.createDataFrame([("t.py", code)], "path STRING, content STRING")
    row = gates.gate_report(files).first()
    assert len(row["errors"]) == len(expected)
    assert all(e.startswith(w) for e, w in zip(row["errors"], expected))
    assert row["passed"] == (not expected)
    if expected:
        assert row["error_trace"].startswith("  [1] ") and "eval(" not in row["patched_code"]


def test_deep_code_does_not_pass(spark):
    files = spark.createDataFrame([("t.py", "x = " + "-" * 100_000 + "1\n")], "path STRING, content STRING")
    assert not gates.gate_report(files).first()["passed"]


def test_commands(spark):
    commands = spark.createDataFrame(
        [(1, "python bad.py"), (2, "ls"), (3, "python3 -c 'exec(1)'"), (4, "python good.py")], "command_id INT, command STRING"
    )
    files = spark.createDataFrame([("bad.py", "eval(x)"), ("good.py", "x = 1")], "path STRING, content STRING")
    blocked = {r["command_id"] for r in gates.blocked_commands(commands, files).collect()}
    assert blocked == {1, 3}


@pytest.mark.parametrize(
    "version, fixed, below",
    [("2.3.9", "2.4.0", True), ("2.4.0", "2.4.0", False), ("2.4", "2.4.0", False), ("2.4.0.1", "2.4.0", False),
     ("2", "2.4.0", True), ("10.0", "9.0.0", False), ("2..3", "2.4.0", True), (".", "1.0.0", True)],
)
def test_version_lt(spark, version, fixed, below):
    row = spark.range(1).select(deps.version_lt(F.lit(version), F.lit(fixed))).first()
    assert row[0] is below


def test_manifest_checks(spark):
    files = spark.createDataFrame(
        [
            ("r/requirements.txt", "PyJWT==2.3.0\nreqeusts\nfoo==0.1.2\nlicense = 'LGPL-3'"),
            ("r/pom.xml", "<artifactId>log4j-core</artifactId>\n <version>2.16.1</version><license>GPL</license>"),
            ("r/package.json", '{"lodash": "^4.17.21", "axios": "1.5.9", "license": "MIT"}'),
            ("r/notes.txt", "pyjwt==1.0"),
        ],
        "path STRING, content STRING",
    )
    advisories = spark.createDataFrame([("pyjwt", "ADV-1", "Extra", "CRITICAL")], "library STRING, cve STRING, name STRING, severity STRING")
    found = deps.all_findings(deps.manifests(files), advisories).collect()
    got = {(r["path"][2:], r["dependency"], r["version"], r["check_order"]) for r in found}
    # A look-alike counts anywhere in the text, so "lodas" is also found inside "lodash".
    assert got == {
        ("package.json", "lodas", "N/A", 2),
        ("requirements.txt", "multiple", "N/A", 1), ("pom.xml", "multiple", "N/A", 1),
        ("requirements.txt", "reqeusts", "N/A", 2), ("requirements.txt", "multiple", "==0.1.2", 3),
        ("requirements.txt", "pyjwt", "2.3.0", 4), ("pom.xml", "log4j-core", "2.16.1", 4),
        ("package.json", "axios", "1.5.9", 4), ("requirements.txt", "pyjwt", "2.3.0", 5),
    }
    assert any("'LGPL-3'" in r["rule"] for r in found)


def test_graph(spark):
    files = spark.createDataFrame(
        [
            ("lib", "lib/a.py", "def helper(x):\n    pass\ndef helper(y):\n    pass\n"),
            ("app", "app/b.py", "import lib-extra\nfrom lib import helper\nhelper (1); helper(2)\n"),
            ("app", "app/c.md", "import lib\nhelper(1)"),
        ],
        "repo STRING, path STRING, content STRING",
    )
    assert graph.repo_import_edges(files).count() == 1
    edges = graph.cross_repo_call_edges(files).collect()
    assert [(e["path"], e["target_repo"], e["definitions"]) for e in edges] == [("app/b.py", "lib", 2)]
    assert graph.cross_repo_call_edges(files, repeat=True).count() == 2
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "source STRING, target STRING")
    seeds = spark.createDataFrame([("a",)], "node STRING")
    assert dict(graph.callgraph_reach(chain, seeds).collect()) == {"a": 0, "b": 1, "c": 1}


def _case(**more):
    base = dict(case_id="c", candidate_no=1, original_code="import os\nos.system(x)\ntotal = 1\n", patched_code="import os\ntotal = 1\n",
                explanation="", severity="HIGH", error_trace="taint flows to os.system")
    return {**base, **more}


def test_patch_scores(spark):
    rows = [
        _case(explanation="short"),
        _case(candidate_no=2, patched_code="pass", explanation="No explanation provided."),
        _case(candidate_no=3, explanation="The taint no longer flows; os.system was removed and the remaining lines are kept as they were before.", severity="LOW"),
        _case(candidate_no=4, patched_code="os.system(x)"),
    ]
    got = {r["candidate_no"]: r for r in patches.score_patch(spark.createDataFrame(rows)).collect()}
    assert got[1]["violation_removal"] == 1.0 and got[4]["violation_removal"] == 0.0
    assert got[1]["code_preservation"] == 1.0 and got[2]["code_preservation"] == 0.0
    assert got[2]["explanation_quality"] == 0.0 < got[3]["explanation_quality"] <= 1.0
    assert got[1]["severity_accuracy"] == 1.0 and got[3]["severity_accuracy"] == pytest.approx(0.4)
    best = patches.best_patch(patches.score_patch(spark.createDataFrame(rows))).first()
    assert best["candidate_no"] == max(got.values(), key=lambda r: (r["total_score"], -r["candidate_no"]))["candidate_no"]
    assert best["candidates_count"] == 4


def test_diff_and_fallback(spark):
    cases = spark.createDataFrame([("c", "a\nb", "bad\nworse", "")], "case_id STRING, original_code STRING, error_trace STRING, context STRING")
    none = spark.createDataFrame([], "case_id STRING, candidate_no INT, model_label STRING, patched_code STRING, explanation STRING, severity STRING")
    row = patches.remediate(cases, none).first()
    assert row["status"] == "offline_fallback" and row["grade"] == "F" and "# bad\n# worse\n" in row["patched_code"]
    assert "- a\n- b\n+ # Automatic" in row["diff"]


def test_findings_and_envelope(spark):
    text = "Gating Violation: eval used\nSQL injection in src/a.py\nSQL injection: none\nTODO later\nTODO later\n  cve-1 in lib  "
    reports = spark.createDataFrame([(1, text), (2, "fine"), (3, "")], "report_id INT, text STRING")
    lines = findings.report_lines(reports)
    parsed = findings.parse_findings(lines)
    assert [(r["line_no"], r["severity"], r["file"]) for r in parsed.orderBy("line_no").collect()] == [
        (0, "CRITICAL", "sandbox_gating.py"), (1, "CRITICAL", "src/a.py"), (3, "LOW", "Unknown"), (4, "LOW", "Unknown"),
        (5, "MEDIUM", "requirements.txt"),
    ]
    assert findings.first_finding_per_key(parsed).count() == 4
    metrics = {r["report_id"]: r for r in findings.audit_metrics(lines).collect()}
    assert metrics[1]["sast_vulnerabilities"] and not metrics[2]["vulnerabilities_found"] and not metrics[3]["code_smells"]
    envelopes = {r[0]: json.loads(r[1]) for r in findings.audit_envelope(reports).collect()}
    assert len(envelopes[1]["data"]["parsed_vulnerabilities"]) == 4 and envelopes[1]["ui"]["version"] == "v0.9"
    assert envelopes[2]["ui"]["updateComponents"]["components"][2]["properties"]["items"] == [findings.NO_FINDINGS]
    assert envelopes[3]["data"]["raw_output"] == "" and envelopes[3]["ui_available"] is True


def test_training_example_is_plain_json(spark):
    patch = 'a = "é\\n"\t\U0001f600 \x01\n'
    rows = spark.createDataFrame(
        [("code", "trace {insecure_code}", patch, "why", "HIGH", True, None, ""), ("code", "t", patch, "why", "LOW", False, "no", "m")],
        "insecure_code STRING, error_trace STRING, proposed_patch STRING, explanation STRING, severity STRING, accepted BOOLEAN, developer_comment STRING, model_used STRING",
    ).withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = feedback.to_training_example(rows).collect()
    model = got[0]["training_example"]["contents"][1]["parts"][0]["text"]
    assert model == json.dumps({"patched_code": patch, "explanation": "why", "severity": "HIGH"}, indent=2)
    assert "trace {insecure_code}" in got[0]["training_example"]["contents"][0]["parts"][0]["text"]
    assert got[1]["training_example"] is None and got[0]["model_used"] == "unknown"


def test_feedback_and_sessions(spark):
    rows = spark.createDataFrame([("4.5",), ("great",), (None,)], "score STRING")
    full = rows.selectExpr("score", *[f"CAST(NULL AS STRING) AS {c}" for c in ("text", "log_type", "service_name", "user_id", "session_id")])
    checked = [(r["valid"], r["text"], len(r["user_id"])) for r in feedback.validate_feedback(full).collect()]
    assert checked == [(True, "", 36), (False, "", 36), (False, "", 36)]
    urls = spark.createDataFrame([("https://h/o/r.git",), ("",), (None,)], "u STRING")
    assert [r[0] for r in urls.select(feedback.session_key(F.col("u"))).collect()] == [
        "repo-session-r", "repo-session-default-repo", "repo-session-default-repo"
    ]


def test_readers(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("roles:\n  a:\n    allowed_tools: [x, y]\n")
    assert readers.read_policies(spark, str(tmp_path / "p.yaml")).count() == 2
    assert readers.read_policies(spark, str(tmp_path / "missing.yaml")).count() == 0
    tree = tmp_path / "tree" / "repo1" / "src"
    tree.mkdir(parents=True)
    (tree / "a.py").write_bytes(b"ok\xff\n")
    (tree / "b.PNG").write_bytes(b"x")
    (tree.parent / ".git").mkdir()
    (tree.parent / ".git" / "c.py").write_text("no")
    rows = [tuple(r) for r in readers.read_source_tree(spark, str(tmp_path / "tree")).collect()]
    assert rows == [("repo1", "repo1/src/a.py", "ok\n")]
    (tmp_path / "m.jsonl").write_text('{"role": "user", "index": 0, "parts": [{"content": "hi"}], "other": 1}\n{"role"\n')
    assert readers.read_completions(spark, str(tmp_path / "m.jsonl")).count() == 1
    with pytest.raises(readers.TooManyBadRecords):
        readers.read_completions(spark, str(tmp_path / "m.jsonl"), max_bad=0)
    (tmp_path / "s.json").write_text('[{"session_id": "a", "status": "failed", "text": "t"}]')
    assert readers.read_session_logs(spark, str(tmp_path / "s.json")).count() == 1
    (tmp_path / "t.json").write_text('{"eval_cases": [{"eval_case_id": "free"}, {"eval_case_id": "x", "agent_data": {"turns": []}}]}')
    assert readers.read_eval_traces(spark, str(tmp_path / "t.json")).count() == 2


def test_texts_that_nobody_asks_for_are_not_carried_to_the_best_patch(spark):
    from pyspark.sql import functions as F

    rows = spark.range(60).select(
        F.format_string("c%d", F.col("id") % 7).alias("case_id"), "id", (F.col("id") % 3).cast("double").alias("total_score"),
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("candidate_no"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("text "), "id")).alias("patched_code"),
    )
    best = patches.best_patch(rows)
    plan = best.select("case_id", "candidate_no", "candidates_count")._jdf.queryExecution().optimizedPlan().toString()
    assert "patched_code" not in plan
    for row in best.collect():  # all columns are of one row, nulls among them
        assert row["patched_code"] == (f"text {row['id']}" if row["id"] % 4 else None)
        assert row["candidate_no"] == (row["id"] if row["id"] % 2 == 0 else None)
        assert row["total_score"] == 2.0
