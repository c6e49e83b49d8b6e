"""Range joins against comparing every pin with every range."""

import random
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.operators import dependencies as deps
from auditloom.operators import version_ranges as vr

PARTS = st.lists(st.one_of(st.integers(0, 12).map(str), st.integers(0, 2**62).map(str), st.sampled_from(["00", "007", "x", ""])), max_size=5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(PARTS, PARTS), min_size=1, max_size=60))
def test_keys_sort_as_versions_compare(spark, pairs):
    rows = [(".".join(a), ".".join(b)) for a, b in pairs]
    frame = spark.createDataFrame(rows, "a STRING, b STRING")
    key = vr.version_key
    wrong = frame.filter((key(F.col("a")) < key(F.col("b"))) != deps.version_lt(F.col("a"), F.col("b")))
    assert wrong.collect() == []


def _version(rng):
    return ".".join(str(rng.choice([0, 0, 1, 2, 3, 10, 11])) for _ in range(rng.randrange(1, 4)))


def _tables(spark, seed, pins=120, ranges=150):
    rng = random.Random(seed)
    library = lambda: rng.choice([("python", "hot"), ("python", "hot"), ("jvm", "hot"), ("node", "b")])
    p = [(f"f{i}", *library(), _version(rng)) for i in range(pins)] + [("n", "python", "hot", None), ("u", "python", "unknown", "1.0"), ("w", "jvm", "hot", "abc")]
    r = [(*library(), rng.choice([None, _version(rng)]), rng.choice([None, _version(rng), _version(rng)]), f"A{i}", rng.choice([*vr.SEVERITIES, "odd", None])) for i in range(ranges)]
    r += r[:5] + [("jvm", "nobody", "1", "2", "A-x", "LOW")]
    return (
        spark.createDataFrame(p, "path STRING, ecosystem STRING, library STRING, version STRING"),
        spark.createDataFrame(r, "ecosystem STRING, library STRING, introduced STRING, fixed STRING, advisory STRING, severity STRING"),
    )


def _plain(pins, ranges):
    below = lambda a, b: deps.version_lt(F.col(a), F.col(b))
    pairs = pins.filter("version IS NOT NULL").join(ranges, ["ecosystem", "library"])
    return pairs.filter((F.col("introduced").isNull() | ~below("version", "introduced")) & (F.col("fixed").isNull() | below("version", "fixed")))


def test_hits_equal_comparing_all_pairs(spark):
    for seed in (1, 2):
        pins, ranges = _tables(spark, seed)
        columns = ["path", "ecosystem", "library", "version", "introduced", "fixed", "advisory", "severity"]
        got = vr.range_hits(pins, ranges).select(*columns).collect()
        want = _plain(pins, ranges).select(*columns).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and got
    assert vr.range_hits(pins.limit(0), ranges).count() == 0 and vr.range_hits(pins, ranges.limit(0)).count() == 0


def test_fixed_only_ranges_equal_cve_hits(spark):
    pins, ranges = _tables(spark, 5)
    only = ranges.filter("fixed IS NOT NULL").withColumn("introduced", F.lit(None).cast("string"))
    columns = ["path", "library", "version", "advisory"]
    assert sorted(map(tuple, vr.range_hits(pins, only).select(*columns).collect())) == sorted(map(tuple, deps.cve_hits(pins, only).select(*columns).collect()))


def test_exposure_equals_sweeping_by_hand(spark):
    for seed in (3,):
        pins, ranges = _tables(spark, seed, ranges=24)
        exposed = vr.exposure(pins, ranges).collect()
        got = {(r["ecosystem"], r["library"], r["version"]): (r["advisories"], r["severity"]) for r in exposed}
        rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in vr.SEVERITIES]), F.col("severity")), F.lit(0))
        held = _plain(pins.drop("path").distinct(), ranges).withColumn("rank", F.when(rank == 0, 99).otherwise(rank))
        want = {
            (r["ecosystem"], r["library"], r["version"]): (r["n"], ([*vr.SEVERITIES] + [None] * 95)[r["worst"] - 1])
            for r in held.groupBy("ecosystem", "library", "version").agg(F.count("*").alias("n"), F.min("rank").alias("worst")).collect()
        }
        assert got == want and got
        safe = {(r["ecosystem"], r["library"], r["version"]): r["safe_version"] for r in exposed}
        ends = ranges.select("ecosystem", "library", F.col("fixed").alias("version")).filter("fixed IS NOT NULL").distinct()
        free = {}
        bad = {(r["ecosystem"], r["library"], r["version"]) for r in _plain(ends, ranges).collect()}
        for e, lib, v in {tuple(r) for r in ends.collect()} - bad:
            free.setdefault((e, lib), []).append(v)
        number = lambda v: [int(x) for x in v.split(".") if x.isdigit()]

        def padded(v):
            parts = number(v)
            while parts and parts[-1] == 0:
                parts.pop()
            return parts

        for (e, lib, v), end in safe.items():
            above = [padded(x) for x in free.get((e, lib), []) if padded(x) > padded(v)]
            assert (padded(end) if end else None) == (min(above) if above else None), (e, lib, v, end)


def test_a_hundred_thousand_ranges_of_one_library(spark):
    ranges = spark.range(100_000).selectExpr(
        "'python' AS ecosystem", "'hot' AS library", "concat('1.', id) AS introduced", "concat('1.', id + 1) AS fixed", "concat('A', id) AS advisory", "'HIGH' AS severity"
    )
    pins = spark.range(4000).selectExpr("concat('f', id) AS path", "'python' AS ecosystem", "'hot' AS library", "concat('1.', id * 29) AS version")
    start = time.time()
    got = {r["path"]: r["advisory"] for r in vr.range_hits(pins, ranges).collect()}
    assert got == {f"f{i}": f"A{i * 29}" for i in range(4000) if i * 29 < 100_000} and time.time() - start < 120
    exposed = vr.exposure(pins, ranges).agg(F.count("*"), F.max("advisories"), F.min("safe_version"), F.max("safe_version")).first()
    assert tuple(exposed) == (len(got), 1, "1.100000", "1.100000")


def test_keys_are_worked_out_for_different_ranges_only(spark):
    pins, ranges = _tables(spark, 6)
    many = ranges.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40))))
    pinned = vr._pinned(pins)
    different = vr._different(many, pinned, "severity")
    held = ranges.filter("library <> 'nobody'").select("ecosystem", "library", "introduced", "fixed", "severity").distinct()
    assert different.agg(F.sum("rows")).first()[0] % 40 == 0 and different.count() <= held.count()
    for found in (vr.range_hits(pins, many), vr.exposure(pins, many)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" not in plan and "lpad" not in plan  # no key of a row of either table is left to do
    got, once = vr.range_hits(pins, many), vr.range_hits(pins, ranges)
    assert got.count() == 40 * once.count() > 0
