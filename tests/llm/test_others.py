import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import compression_quality as cq
from auditloom.llm import source_mixing as sm
from auditloom.llm import topk_search as tk
from auditloom.llm.queries import op6_compression_quality


# Mixing


def filled(sizes, weights, most):
    """Targets by resharing the excess until no target is above its cap."""
    total, targets, capped = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        share = sum(w for i, w in enumerate(weights) if i not in capped)
        targets = [most * s if i in capped else weights[i] * left / share for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in capped and targets[i] > most * s}
        if not over:
            return targets
        capped |= over


@pytest.mark.parametrize("sizes", [[10, 20, 30], [0, 1000, 5, 5], [1, 1, 1, 1, 900, 3, 3], [7], [0, 0]])
def test_targets_match_repeated_resharing(spark, sizes):
    frame = spark.createDataFrame([(f"s{i}" if i else None, n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in sm.source_targets(frame).collect()}
    order = [*range(1, len(sizes)), 0]  # null last
    want = filled([sizes[i] for i in order], [j % 3 + 1 for j in range(len(sizes))], 3)
    assert all(math.isclose(got[f"s{i}" if i else None], w, abs_tol=1e-9) for i, w in zip(order, want))


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(800)]
    rows += [(1, None, "d"), (1, "", "d"), (None, "x y", "e"), (2, rows[2][1], rows[2][2]), (900, "long " * 20000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as key", "3 as bucket", "4 as rest")
    few, many = (sorted(map(tuple, sm.mix_sources(docs, buckets=n).collect()), key=str) for n in (1, 64))
    assert few == many == sorted(map(tuple, sm.mix_sources(docs, buckets=64).collect()), key=str) and len(few) == len(rows)
    by = {}
    for _, source, size, source_size, target, epochs, taken in few:
        assert taken <= 3 * size and taken >= epochs * size
        by.setdefault(source, [0, target, 0])
        by[source][0] += taken
        by[source][2] = max(by[source][2], size)
    assert all(abs(taken - target) <= largest / 2 + 1 for taken, target, largest in by.values())
    assert sm.mix_sources(docs.limit(0)).count() == 0


def test_heavier_documents_come_first(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'w w' as text", "if(id < 3000, 'a', 'b') as source", "if(id % 2 = 0, 1.0D, 0.1D) as q")
    taken = sm.mix_sources(docs, weights=(1, 3), quality=F.col("q")).filter("source = 'a'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n"))
    n = {r["odd"]: r["n"] for r in taken.collect()}
    assert n[0] > 2 * n[1]


def test_ranges_of_keys_spread_rows_of_any_weight(spark):
    for weight in (4.0, 1.0, 0.3, 0.05, 0.002):
        keys = spark.range(20_000).select((-F.log((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))) / weight).alias("key"))
        rows = keys.withColumn("bucket", sm.key_bucket(F.col("key"), 4096))
        assert rows.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 20_000 / 150
        order = [r["bucket"] for r in rows.orderBy("key").collect()]
        assert order == sorted(order) and order[-1] < 4096


# Search


def test_topk_matches_a_full_sort(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) if x else 0.0 for x in np.round(rng.normal(size=rng.integers(0, 7)), 1)]) for i in range(150)]
    rows += [(151, None), (152, [None, 1.0]), (153, [float("nan")]), (154, [float("inf")]), (None, [1.0]), (20, [0.5] * 4), (20, [0.5] * 4), (33, [8.0, 9.0]), (33, [9.0, 8.0]), (33, [9.0, 8.0]), (40, [9.0, 9.0, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as n", "3 as slot")
    kept = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    want = []
    for q in {i for i, _ in kept}:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for i, v in kept if i == q for c, w in kept if c != q)[:5]
            want += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    for options in ({"block_rows": 16, "query_rows": 3}, {}):
        got = tk.topk_search(frame, F.col("vec_id") % 20 == 0, k=5, **options)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert tk.topk_search(frame.limit(0), F.lit(True)).count() == 0 and tk.topk_search(frame, F.lit(False)).count() == 0


def test_scatter_equals_the_product():
    rng = np.random.default_rng(5)
    matrix = rng.integers(-9, 9, size=(40, 6)) * (rng.random((40, 6)) < 0.4)
    query = rng.integers(-9, 9, size=8)
    assert (tk.accumulate(query, tk.postings(matrix), 40) == matrix @ query[:6]).all()


# Quality


def test_isotonic_fit_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(6)
    x = rng.random(500)
    y = (rng.random(500) < x).astype(float)
    knots, values = cq.isotonic(x, y, np.ones(500))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all() and abs(np.interp(x, knots, values).mean() - y.mean()) < 0.05


def test_held_out_quality(spark):
    rows = {r["doc_id"]: r for r in op6_compression_quality(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(r["quality"], rows[r["doc_id"]]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(rows) == 10_000 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert np.mean([q == r["predicted"] for q, r in held]) > 0.95
    good, bad = ([r["score"] for q, r in held if q == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert abs(np.mean([r["score"] for _, r in held]) - np.mean([q for q, _ in held])) < 0.05


def test_quality_edges(spark):
    rng = random.Random(7)
    text = lambda q: " ".join(rng.choice("ab cd ef gh" if q else "@@ !! ## $$").strip() or "x" for _ in range(400))
    rows = [(i, text(i % 2)) for i in range(60)] + [(100, None), (101, ""), (None, "a b"), (1, text(1)), (102, "ab " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as quality", "1 as score", "2 as y", "3 as rank")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None), (2, 7), (None, 1), (100, 0), (999, 1)], "doc_id long, quality int")
    for learn in (F.lit(True), F.lit(False), F.col("quality") == 1):
        out = cq.score(docs, cq.fit(docs, labels, learn, dict_rows=10)).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
        assert sum(r["difference"] is None for r in out) == 2
    assert cq.score(docs.limit(0), cq.fit(docs.limit(0), labels, F.lit(True))).count() == 0
