import re

from pyspark.sql import functions as F

from auditloom.functions.rules import SAST_RULES, SMELL_RULES
from auditloom.operators import scan
from auditloom.plans.snippets import SNIPPETS

RULES = SAST_RULES + SMELL_RULES

# Text that only matches across lines, by rule name.
ACROSS_LINES = {
    "[OWASP A01:2021-Broken Access Control] Insecure Direct Object References (IDOR)": "def show(user_id):\n    return db.find(user_id)\n",
    "[OWASP A01:2021-Broken Access Control] Missing Function Access Control": "@app.route('/x', methods=['post'])\ndef save():\n    pass\n",
    "Cognitive/Cyclomatic Complexity Smell": "if a:\n    if b:\n        if c:\n            x()\n",
    "Empty Class or Method": "class Store:\n    pass\n",
    "Cyclic Imports / Architectural Violation": "import a;\nimport b;\nimport c;\n",
    "Null Pointer Dereference Hazard": "row = None\nrow.name\n",
    "God Class / Large Structural Smells": "class A(B):\n" + "    def f(self):\n" * 10,
}


def _lines(spark, texts):
    rows = [("r", "a.py", i, t + "\n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "repo STRING, path STRING, line_no BIGINT, raw STRING")


def test_registry_size():
    assert (len(SAST_RULES), len(SMELL_RULES)) == (60, 25)
    assert len({r.name for r in RULES}) == 85


def test_scan_equals_direct_regex(spark):
    texts = SNIPPETS + [s.upper() for s in SNIPPETS]
    got = {(r["line_no"], r["rule"]) for r in scan.scan(_lines(spark, texts), RULES).collect()}
    want = {
        (i, rule.name) for i, text in enumerate(texts) for rule in RULES if re.search(rule.pattern, text + "\n")
    }
    assert got == want
    fired = {name for _, name in want}
    assert fired == {r.name for r in RULES} - set(ACROSS_LINES)


def test_whole_file_scope_fires_line_spanning_rules(spark):
    rows = [("r", f"{i}.py", text) for i, text in enumerate(ACROSS_LINES.values())]
    files = spark.createDataFrame(rows, "repo STRING, path STRING, content STRING")
    got = {(r["path"], r["rule"]) for r in scan.scan_files(files, RULES).collect()}
    for i, name in enumerate(ACROSS_LINES):
        assert (f"{i}.py", name) in got
    by_line = {r["rule"] for r in scan.scan(scan.split_lines(files), RULES).collect()}
    assert not by_line & set(ACROSS_LINES)


def test_very_long_lines(spark):
    filler = "x " * 25_000
    texts = [f"free(a) {filler} free(b)z", f"os.path.exists(p) {filler} open(p)"]
    rules = {r["rule"][23:] for r in scan.scan(_lines(spark, texts), RULES).collect()}
    assert any("Use-After-Free" in r for r in rules) and any("TOCTOU" in r for r in rules)


def test_split_lines_and_keyword(spark):
    files = spark.createDataFrame(
        [("r", "a.py", "one\r\n two\rTHREE token"), ("r", "b.py", ""), ("r", "c.py", "x\n\n")],
        "repo STRING, path STRING, content STRING",
    )
    rows = [(r["path"], r["line_no"], r["raw"], r["line"]) for r in scan.split_lines(files).orderBy("path", "line_no").collect()]
    assert rows == [
        ("a.py", 1, "one\n", "one"), ("a.py", 2, " two\n", "two"), ("a.py", 3, "THREE token", "THREE token"),
        ("c.py", 1, "x\n", "x"), ("c.py", 2, "\n", ""),
    ]
    lines = scan.split_lines(files)
    assert scan.keyword_search(lines, "three TOKEN").count() == 1
    assert scan.matches_found(lines, "t").first()[0] == 2


def test_file_filter(spark):
    paths = ["a/b.py", "a/.git/b.py", "a/x.PNG", "a/.bashrc", "a/uv.lock", "node_modules/m.js", "a/my.git/b.py"]
    files = spark.createDataFrame([(p,) for p in paths], "path STRING")
    kept = {r[0] for r in scan.file_filter(files).collect()}
    assert kept == {"a/b.py", "a/.bashrc", "a/my.git/b.py"}
    assert "a/uv.lock" in {r[0] for r in scan.file_filter(files, [".lock"]).collect()}


def test_graph_requested(spark):
    df = spark.createDataFrame([("a Call Map", None), ("plain", ""), (None, "MATCH")], "q STRING, g STRING")
    assert [r[0] for r in df.select(scan.graph_requested(F.col("q"), F.col("g"))).collect()] == [True, False, True]
