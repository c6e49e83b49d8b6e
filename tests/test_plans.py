import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from auditloom.functions.embedding import text_char_embedding
from auditloom.functions.ordered import bucketed_lag, bucketed_row_number
from auditloom.operators import clustering
from auditloom.plans.bridges import TABLES

SF = "/root/testdata/sf0.001"


def test_ordered_helpers_equal_windows_on_a_skewed_group(spark):
    df = spark.range(500).select(
        F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 5 == 0, F.lit(None)).otherwise("cold").alias("k"),
        (F.col("id") * 7 % 500).alias("ts"), F.col("id").cast("string").alias("v"),
    )
    window = Window.partitionBy("k").orderBy("ts")
    want = df.select("k", "ts", F.row_number().over(window).cast("bigint").alias("n"), F.lag("v").over(window).alias("p"))
    bucket = F.floor(F.col("ts") / 30)
    numbered = bucketed_row_number(df, ["k"], ["ts"], bucket).select("k", "ts", "n")
    lagged = bucketed_lag(df, ["k"], ["ts"], "v", bucket, "p").select("k", "ts", "p")
    assert sorted(map(str, numbered.collect())) == sorted(map(str, want.select("k", "ts", "n").collect()))
    assert sorted(map(str, lagged.collect())) == sorted(map(str, want.select("k", "ts", "p").collect()))


def test_embedding(spark):
    texts = ["", "Abc", "é" * 40 + "xyz"]
    rows = text_char_embedding(spark.createDataFrame([(t,) for t in texts], "text STRING")).collect()
    for text, row in zip(texts, rows):
        want = np.zeros(16)
        for i, c in enumerate(text.lower()):
            want[i % 16] += ord(c)
        norm = np.linalg.norm(want)
        assert np.allclose(row["embedding"], want / norm if norm else want)


def test_kmeans_equals_plain_lloyd(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(m, 0.4, (20, 3)) for m in (0, 2, 4)])
    seeds = [points[0], points[25], points[50], np.full(3, 99.0)]
    centers = np.array(seeds)
    for _ in range(50):
        labels = ((points[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        centers = np.array([points[labels == i].mean(0) if (labels == i).any() else centers[i] for i in range(4)])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id INT, v ARRAY<DOUBLE>")
    fitted, final, converged, _ = clustering.kmeans_fit(df, "v", [s.tolist() for s in seeds])
    assert converged and not clustering.kmeans_fit(df, "v", [s.tolist() for s in seeds], max_iters=1).converged
    assert [r["cluster"] for r in fitted.orderBy("id").collect()] == labels.tolist()
    assert np.allclose(final, centers)
    members = clustering.cluster_members(fitted.withColumn("session_id", F.col("id").cast("string")), 4)
    assert members.filter("cluster = 3 AND session_id IS NULL").count() == 1


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(5).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_windows_are_limited_before_the_shuffle(spark):
    plan = entry.queries()["completions_view"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4


@pytest.mark.parametrize(
    "name",
    ["completions_view", "sast_scan", "smell_scan", "all_findings", "cross_repo_call_edges", "mask_pii", "tool_call_decisions",
     "retained_spans", "cluster_theme", "best_patch", "audit_metrics", "eval_case_scores", "transition_conformance", "gate_report"],
)
def test_matches_sql_twin(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(repr(r) for r in cursor.fetchall())
    got = sorted(repr(tuple(r)) for r in entry.queries()[name](spark, SF).select(*columns).collect())
    assert got == want


def test_all_findings_read_the_manifests_once_and_equal_the_single_checks(spark, tmp_path):
    from auditloom.operators import dependencies as deps

    rows = [
        ("a/requirements.txt", 'requests==0.0.1\nreqeusts\njinja2==3.0\n"license": "GPL-3.0"'), ("b/package.json", '{"lodash": "^1.2.3", "x": "0.1.2"}'),
        ("c/pom.xml", "<artifactId>log4j-core</artifactId><version>2.14.0</version>"), ("d/go.mod", "lodash 0.9.9"), ("e/setup.py", ""), ("f/setup.py", None),
    ]
    spark.createDataFrame(rows, "path STRING, content STRING").write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    advisories = spark.createDataFrame([("log4j-core", "C-1", "one", "HIGH"), ("log4j-core", None, None, None), ("requests", "C-2", "two", "LOW")], "library STRING, cve STRING, name STRING, severity STRING")
    got = deps.all_findings(files, advisories)
    parts = [deps.license_risk(files), deps.typosquat_hits(files), deps.unstable_pin(files), deps.cve_range_join(files), deps.advisory_enrichment(files, advisories)]
    want = sorted((tuple(r) for part in parts for r in part.collect()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want and {r[-1] for r in want} == {1, 2, 3, 4, 5}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1


def test_rows_that_become_programs_manifests_or_patches_are_dealt_out(spark):
    from auditloom.plans import registry

    for name in ("lint_empty_except", "score_patch", "dependency_versions", "numbered_error_trace"):
        frame = registry.all_queries()[name](spark, "/root/testdata/sf0.001")
        sizes = [r["count"] for r in frame.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
        assert len(sizes) >= 8 and max(sizes) < sum(sizes) / 3, name  # a single file, a single row group


def test_parts_of_a_stream_are_written_by_all_tasks_in_their_order(spark):
    from auditloom.plans import q_flows
    from auditloom.session import scratch_path
    from auditloom.streaming import run

    rows, out, checkpoint = spark.range(0, 4000, 1, 4), scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    for i, stream in enumerate(q_flows._in_parts(rows, "parts", F.col("id") % 3, 3)):
        run.run_to_files(stream.withColumn("file", F.col("_metadata.file_name")), out, checkpoint)
        got = spark.read.parquet(out)
        assert {r[0] for r in got.select(F.col("id") % 3).distinct().collect()} == set(range(i + 1))
        assert got.filter(F.col("id") % 3 == i).select("file").distinct().count() > 1
    assert got.count() == got.select("id").distinct().count() == 4000


def test_documents_are_as_many_files_as_their_rows_need(spark, monkeypatch):
    from auditloom.plans import q_flows
    from auditloom.session import scratch_path
    from auditloom.sources import readers

    monkeypatch.setattr(q_flows, "_FILE_BYTES", 10_000)
    for n, least in ((2000, 10), (0, 1)):
        path = scratch_path(spark, "sessions")
        logs = spark.range(n).selectExpr("concat('s', id) AS session_id", "'ok' AS status", "repeat('t', 60) AS text")
        q_flows._write_documents(logs.select(F.to_json(F.struct("session_id", "status", "text"))), path, "[", "]")
        back = readers.read_session_logs(spark, path)
        files = [r[0] for r in spark.read.text(path).select(F.octet_length("value").alias("b"), F.col("_metadata.file_name").alias("f")).groupBy("f").agg(F.sum("b")).select("sum(b)").collect()]
        assert back.select("session_id").distinct().count() == back.count() == n and len(files) >= least and max(files) < 15_000


def test_streams_of_parts_have_as_many_tasks_as_their_messages_need(spark, monkeypatch):
    from auditloom import session
    from auditloom.plans import q_flows

    monkeypatch.setattr(session, "TASK_BYTES", 20_000)
    held, seen, run_to_files = spark.conf.get("spark.sql.shuffle.partitions"), [], q_flows.run.run_to_files
    monkeypatch.setattr(q_flows.run, "run_to_files", lambda *a: (run_to_files(*a), seen.append(a[2])))
    kept = q_flows.QUERIES["stream_completions_dedup"](spark, "/root/testdata/sf0.001")
    size = q_flows._message_bytes(q_flows.b.completion_messages(spark, "/root/testdata/sf0.001"))
    written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{seen[0]}/state/0").select("path")
    states = {p.split("/state/0/")[1].split("/")[0] for (p,) in written.collect()} - {"_metadata"}
    assert len(states) == -(-size // 20_000) > int(held)
    assert kept.count() > 0 and spark.conf.get("spark.sql.shuffle.partitions") == held
