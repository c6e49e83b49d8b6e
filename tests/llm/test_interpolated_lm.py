import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from auditloom.llm import interpolated_lm as lm
from auditloom.llm.common import fold
from auditloom.llm.queries import op2_interpolated_lm

DATA = "/root/testdata/sf0.001"


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def model(rows, weights):
    """Plain-Python counts and scores."""
    uni, pair = Counter(), Counter()
    for _, part, text in rows:
        if part != lm.UNSEEN:
            tokens = [None, *words(text), None]
            uni.update(tokens[1:])
            pair.update(zip(tokens, tokens[1:]))
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, part, text in rows:
        tokens = [None, *words(text), None]
        base = sum(math.log10((uni[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens[1:])
        score = 0.0
        for a, t in zip(tokens, tokens[1:]):
            mix = weights[0 if not uni[a] else int(math.log2(uni[a])) + 1]
            score += math.log10(mix[0] * pair[a, t] / max(uni[a], 1) + mix[1] * uni[t] / max(n, 1) + mix[2] / (v + 1))
        out.append((i, len(tokens) - 1, sum(uni[t] > 0 for t in tokens[1:]), n, base, score))
    return out


def test_scores_match_plain_counts(spark, monkeypatch):
    kept = []
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a, **k: kept.append(learn(*a, **k)) or kept[-1])
    got = {r["doc_id"]: r for r in op2_interpolated_lm(spark, DATA).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    part = lambda i: {0: lm.UNSEEN, 1: lm.DELETED}.get(zlib.crc32(str(i).encode()) % 10, lm.MAIN)
    want = model([(i, part(i), t) for i, t in docs], kept[0])
    assert len(got) == len(want)
    for i, tokens, known, n, base, score in want:
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
        assert r["held_out"] == (part(i) == lm.UNSEEN)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_weights_are_those_of_plain_em():
    rng = np.random.default_rng(1)
    p2, p1, n = rng.random(50) * (rng.random(50) < 0.6), rng.random(50) / 10, rng.integers(1, 9, 50).astype(float)
    code = (3 * 2048 + np.arange(50)) * 2048
    got = lm.learn_weights(code, n, p2 * n, p1 * n, 99)[3]
    mix = [0.4, 0.4, 0.2]
    for _ in range(200):
        sums = [0.0] * 3
        for a, b, w in zip(p2, p1, n):
            parts = [mix[0] * a, mix[1] * b, mix[2] / 100]
            for k in range(3):
                sums[k] += w * parts[k] / sum(parts)
        mix = [s / sum(n) for s in sums]
    assert np.allclose(got, mix, atol=1e-5) and math.isclose(got.sum(), 1)


def test_edges(spark):
    rows = [(1, "A b  c", "x"), (1, "A b  c", "x"), (None, None, "y"), (4, "", None), (5, "never seen " * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").withColumn("block", F.lit(1))
    out = lm.interpolated_scores(docs, F.when(F.col("doc_id") == 1, 0).when(F.col("doc_id") == 4, 1), block_bytes=50)
    got = {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in out.collect()}
    assert out.count() == 5 and got == {(1, 4, 4, 9), (None, 1, 1, 9), (4, 1, 1, 9), (5, 6001, 1, 9)}
    assert lm.interpolated_scores(docs.limit(0), F.lit(0)).count() == 0
    nothing = lm.interpolated_scores(docs, F.lit(None)).collect()
    assert len(nothing) == 5 and all(math.isfinite(r["score"]) and r["train_tokens"] == 0 for r in nothing)


def test_counts_over_32_bits_survive():
    for values in ([], [0, 5], [3, 2**32 - 1], [1, 2**32, 2**45]):
        assert lm.unzip_counts(lm.zip_counts(np.array(values, dtype=np.int64))).tolist() == values
