"""The trigram index and the rule table against plain scans."""

import random

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from auditloom.functions.rules import SAST_RULES, SMELL_RULES, Rule
from auditloom.operators import code_index, rule_table, scan
from auditloom.plans.snippets import SNIPPETS
from auditloom.session import scratch_path
from auditloom.streaming import run

RULES = SAST_RULES + SMELL_RULES
FILE = "repo STRING, path STRING, content STRING"


def _files(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "tokenize", "TOKEN", "größe", "x = 1", "if a:", "κόσμος", "日本語です", "𝒳𝒴𝒵"]
    rows = []
    for i in range(n):
        lines = [rng.choice(SNIPPETS) if rng.random() < 0.2 else " ".join(rng.choice(words) for _ in range(4)) for _ in range(6)]
        rows.append((f"r{i % 3}", f"f{i}.py", rng.choice(["\n", "\r\n", "\r"]).join(lines)))
    return rows + [("r0", "copy.py", rows[0][2]), ("r1", "empty.py", ""), ("r1", "null.py", None), ("r2", "ab.py", "ab\nto\rken")]


def _sorted(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=str)


def _compare(spark, index, rows, queries=("TokenIze", "ab", "κόσμος", "𝒳𝒴𝒵", "a:\n", "")):
    lines = scan.split_lines(spark.createDataFrame(rows, FILE))
    for query in queries:
        got = _sorted(index.keyword_matches(query), "repo", "path", "line_no", "raw", "line")
        assert got == _sorted(scan.keyword_matches(lines, query), "repo", "path", "line_no", "raw", "line"), query
    columns = ["repo", "path", "line_no", "rule", "content", "severity"]
    for rules in ([RULES[1], Rule("short", "x =", "own", "LOW", ("x",)), Rule("none", "b.ta", "own", "LOW")], RULES)[: max(1, len(queries) // 3)]:
        assert _sorted(index.scan(rules), *columns) == _sorted(scan.scan(lines, rules), *columns)


def test_searches_equal_full_scans_over_two_loads(spark):
    folder, rows = scratch_path(spark, "index"), _files(1)
    index = code_index.build_index(spark.createDataFrame(rows, FILE).selectExpr("*", "1 AS digest"), folder)
    _compare(spark, index, rows)
    changed = [(r, p, "new tokens here\nalpha" if p in ("f1.py", "f2.py") else c) for r, p, c in rows if p != "f3.py"] + [("r9", "new.py", "quite other text")]
    index = code_index.build_index(spark.createDataFrame(changed, FILE), folder, 1)
    _compare(spark, index, changed, ("token", "größe", "日本語で"))
    written = spark.read.parquet(f"{folder}/contents/load=1")
    assert {r["content"] for r in written.collect()} == {"new tokens here\nalpha", "quite other text"}
    code_index.build_index(spark.createDataFrame(changed, FILE), folder, 1)  # the same load again
    _compare(spark, index, changed, ("token",))
    index = code_index.build_index(spark.createDataFrame([], FILE), folder, 2)
    assert index.keyword_matches("token").count() == 0 and index.scan(RULES).count() == 0


def test_the_index_leaves_out_what_cannot_match(spark):
    rows = [("r", f"f{i}.py", f"text number {i} " * 50) for i in range(200)] + [("r", "hit.py", "os.system(x)")]
    index = code_index.build_index(spark.createDataFrame(rows, FILE), scratch_path(spark, "index"))
    assert index.contents_with(["os.system("]).count() == 1 and index.contents_with(["number 77 "]).count() == 1
    assert index.contents_with(["os"]).count() == index.contents_with(["text", "x"]).count() == 201
    frame = index.contents_with(["os.system("])
    frame.collect()
    filters = frame._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1:]
    assert any(part.split("]")[0].count("bucket") for part in filters)


def _own_rules(n):
    return [Rule(f"own {i}", rf"\bword{i}\b\s*=", "own", "LOW", (f"word{i}",)) for i in range(n)] + [
        Rule("always", r"\d{5}", "own", "HIGH"), Rule("twice", "alpha|beta", "own", "LOW", ("alpha", "beta")), Rule("twice", "alpha", "own", "LOW", ("alpha",)),
    ]


def test_a_rule_table_finds_what_the_plan_of_rules_finds(spark):
    rows = _files(2) + [("r", "own.py", "Word3 = 1\nword7=2 word3=5\nword11 12345\n")]
    lines = scan.split_lines(spark.createDataFrame(rows, FILE)).withColumn("rule_no", F.lit(1))
    columns = ["repo", "path", "line_no", "rule", "content", "severity"]
    for rules in (RULES + _own_rules(20), _own_rules(1)[1:2]):
        got = rule_table.scan_rule_table(lines, rule_table.rule_rows(spark, rules))
        assert _sorted(got, *columns) == _sorted(scan.scan(lines, rules), *columns) and got.columns == ["repo", "path", "line_no", "rule_no", "rule", "content", "severity"]
    many = rule_table.rule_rows(spark, RULES + _own_rules(5000))
    assert _sorted(rule_table.scan_rule_table(lines, many).filter("rule LIKE 'own%'"), "path", "rule") == [("own.py", "own 3"), ("own.py", "own 7")]
    assert rule_table.scan_rule_table(lines, many.limit(0)).count() == 0 and rule_table.scan_rule_table(lines.limit(0), many).count() == 0
    try:
        rule_table.scan_rule_table(lines, many, most_rules=100)
        raise AssertionError("no limit")
    except rule_table.TooManyRules:
        pass


def test_rules_of_a_stream_may_change_between_triggers(spark):
    path, table, out = (scratch_path(spark, n) for n in ("lines", "rules", "findings"))
    versions = [_own_rules(3)[:1], _own_rules(3)[1:2], []]
    lines = scan.split_lines(spark.createDataFrame([("r", "a.py", "word0 = 1 word1 = 2")], FILE)).select("repo", "path", "line_no", "raw")
    checkpoint, seen = scratch_path(spark, "checkpoint"), []
    for i, rules in enumerate(versions):
        rule_table.rule_rows(spark, rules).write.parquet(f"{table}/version={i}")
        lines.withColumn("line_no", F.lit(i).cast("bigint")).coalesce(1).write.mode("append").parquet(path)
        stream = run.read_stream(spark, path, lines.schema)
        rule_table.run_rule_scan(stream, lambda i=i: spark.read.schema(rule_table.RULE_SCHEMA).parquet(f"{table}/version={i}"), out, checkpoint)
        seen = _sorted(spark.read.parquet(f"{out}/batch=*"), "line_no", "rule")
    assert seen == [(0, "own 0"), (1, "own 1")]


def test_postings_are_lists_and_contents_stay_where_they_are(spark):
    rows = [("r", f"f{i}.py", f"text number {i % 7} says αβγ\n{i}") for i in range(300)]
    index = code_index.build_index(spark.createDataFrame(rows, FILE), scratch_path(spark, "index"))
    listed = index.postings.select("trigram", F.explode("places").alias("place"))
    different = listed.select("trigram").distinct().count()
    assert listed.count() == listed.distinct().count() > 300 * 20 and index.postings.count() <= 4 * different  # a row a trigram and task, not a content
    found = index.contents_with(["number 3 "])
    assert found.count() == len([i for i in range(300) if i % 7 == 3])
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_rules_that_stay_a_table_find_the_same(spark):
    rows = _files(3) + [("r", "own.py", "Word3 = 1\nword7=2 word3=5\nword11 12345\nalphabeta 𝒳𝒴𝒵w"), ("r", "long.py", "x " * 40 + "end")]
    lines = scan.split_lines(spark.createDataFrame(rows, FILE)).withColumn("rule_no", F.lit(1))
    own = _own_rules(30) + [Rule("long", r"x{1} end", "own", "LOW", ("x " * 30 + "end", "x " * 35 + "end")), Rule("wide", "𝒴", "own", "LOW", ("𝒳𝒴𝒵w", "none"))]
    for chosen in (RULES + own, own[:5]):
        table = rule_table.rule_rows(spark, chosen)
        columns = ["repo", "path", "line_no", "rule_no", "rule", "content", "severity"]
        got = rule_table.scan_rule_table(lines, table, held_rules=2)
        assert got.columns == columns and _sorted(got, *columns) == _sorted(rule_table.scan_rule_table(lines, table), *columns)
    many = spark.range(250_000).selectExpr("concat('r', id) AS rule", "concat('word', id, '\\\\s*=') AS pattern", "'LOW' AS severity", "array(concat('word', id)) AS needs")
    found = rule_table.scan_rule_table(lines.filter("path = 'own.py'"), many)  # once over the limit of all rules
    assert _sorted(found, "line_no", "rule") == [(2, "r3"), (2, "r7")]


def test_only_contents_with_copies_are_shuffled(spark, monkeypatch):
    plans, save = {}, DataFrameWriter.parquet

    def parquet(self, path, *args, **more):
        plans[path.split("/")[-2]] = self._df._jdf.queryExecution().optimizedPlan().toString()
        return save(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    rows = [("r", f"f{i}.py", f"text number {i}" if i % 10 else "a copy") for i in range(400)] + _files(5)
    index = code_index.build_index(spark.createDataFrame(rows, FILE), scratch_path(spark, "index"))
    lines = plans["contents"].split("\n")
    grouped = [i for i, line in enumerate(lines) if "Aggregate [digest" in line and "content" in line]
    union = next(i for i, line in enumerate(lines) if "Union" in line)
    assert len(grouped) == 1 and any("getbit" in line for line in lines[union : grouped[0]])  # a branch that groups nothing comes first
    contents = [r["content"] for r in index.contents.collect()]
    assert len(contents) == len(set(contents)) and set(contents) == {c or "" for _, _, c in rows}
    # no content is grouped with another by its number
    found = index.contents_with(["number 7", "text"])
    keys = [line.split("], [")[0] for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in line]
    assert keys and not any("place#" in key for key in keys)


def test_hashes_that_clash_lose_and_double_nothing_over_loads(spark, monkeypatch):
    rows = [("r", f"f{i}.py", f"text number {i}" if i % 10 else "a copy") for i in range(200)] + _files(5)
    monkeypatch.setattr(code_index, "_hashed", lambda digest: [F.lit(0).cast("bigint").alias("mark"), F.pmod(F.hash(digest), F.lit(100)).alias("at")])
    folder = scratch_path(spark, "index")
    for load, some in enumerate((rows[:100], rows[:150] + [("r", "f1.py", "text number 1 again")], rows[50:])):
        index = code_index.build_index(spark.createDataFrame(some, FILE), folder, load)
        contents = [r["content"] for r in index.contents.collect()]
        assert len(contents) == len(set(contents)) and set(contents) == {c or "" for _, _, c in some}
    assert index.keyword_matches("number 1").count() == sum("number 1" in (c or "") for _, _, c in some)
    every = [r["content"] for r in spark.read.parquet(f"{folder}/contents").collect()]
    assert len(every) == len(set(every)) and set(every) == {c or "" for _, _, c in rows} | {"text number 1 again"}
