import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import crf_language as crf
from auditloom.llm.queries import op1_crf_language

SYLLABLES = {"xx": "ka ro mi tu sen", "yy": "blå grø tjø vik sund", "zz": "ção nho lha que rua"}


def sentence(lang, rng, n=12):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(n))


def brute(scores, change, first):
    """Label probabilities and expected changes by summing over all label sequences."""
    n, k = scores.shape
    total, marginal, pairs = 0.0, np.zeros((n, k)), np.zeros((k, k))
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(first[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:])))
        total += w
        for i, y in enumerate(path):
            marginal[i, y] += w
        for a, b in zip(path, path[1:]):
            pairs[a, b] += w
    return marginal / total, pairs / total


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 4, 5, 2])
    starts = np.cumsum(lengths) - lengths
    scores, change, first = rng.normal(size=(12, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got, expected = crf.posteriors(scores, starts, lengths, change, first, pairs=True)
    want = [brute(scores[s : s + n], change, first) for s, n in zip(starts, lengths)]
    assert np.allclose(got, np.concatenate([w[0] for w in want])) and np.allclose(expected, sum(w[1] for w in want))


def test_words_of_switched_text_are_labelled():
    rng = random.Random(1)
    model = crf.train([(lang, sentence(lang, rng)) for _ in range(150) for lang in SYLLABLES], rounds=4)
    text = " ".join([sentence("xx", rng), sentence("yy", rng), sentence("zz", rng)])
    found, p = crf.label_words([text], model)
    want = np.repeat([0, 1, 2], 12)
    assert (p.argmax(axis=1) == want).mean() > 0.9 and np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_held_out_accuracy(spark):
    rows = op1_crf_language(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = rows.filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got[0] > 0.98 and got[1] > 100
    assert rows.count() == 1000 and rows.filter("score < 0 or score > 1 or lang_pred is null").count() == 0


@pytest.mark.parametrize("labelled", [True, False])
def test_edges(spark, labelled):
    rng = random.Random(2)
    rows = [(i, sentence(lang, rng), lang) for i, lang in enumerate(list(SYLLABLES) * 30)]
    odd = [(900, None, "xx"), (901, "", "xx"), (902, "123 !!! ---", "yy"), (None, sentence("yy", rng), None), (5, sentence("xx", rng, 4000), None), (5, "ka", "zz")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'q' as id", "lang as label")
    model = crf.fit(docs, F.lit(labelled))
    out = {(r["doc_id"], r["n_words"]): r for r in crf.identify(docs, model, block_bytes=500).collect()}
    for i in (900, 901, 902):
        assert (out[i, 0]["lang_pred"], out[i, 0]["score"], out[i, 0]["shares"]) == ("und", 0.0, {})
    if labelled:
        assert out[None, 12]["lang_pred"] == "yy" and out[5, 4000]["lang_pred"] == "xx"
    else:
        assert {r["lang_pred"] for r in out.values()} == {"und"}
    assert crf.identify(docs.limit(0), model).count() == 0


def test_words_that_hold_the_end_marks(spark):
    rng = random.Random(6)
    model = crf.train([(lang, sentence(lang, rng)) for _ in range(60) for lang in SYLLABLES], rounds=3)
    text = f"{sentence('xx', rng)} ka\x02ka \x01ka\x02 \x02a\x02\x02"
    docs = spark.createDataFrame([(1, text), (2, sentence("yy", rng))], "doc_id long, text string")
    out = {r["doc_id"]: r for r in crf.identify(docs, model).collect()}
    assert out[1]["n_words"] == 15 and out[1]["lang_pred"] == "xx" and out[2]["lang_pred"] == "yy"
