import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import toxicity_gru as tg


def loss(net, rows, grams, begin, index, size, target):
    _, forward, backward = tg.projections(net, rows, grams, begin)
    states = np.concatenate([tg.recur(net, "f", forward, index, size), tg.recur(net, "b", backward, index, size)], axis=2)
    p = 1 / (1 + np.exp(-tg.pool(net, states, size)[0]))
    return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = tg.Network({b"aa": 1, b"bb": 2, b"cc": 3}, word_size=3, char_size=2, hidden=3, window=5)
    net.start(1)
    for name in net.p:
        net.p[name] = net.p[name] * 3  # differences of float32 need some slope
    rows, grams, begin = tg.inputs(net, [b"aa", b"bb.", b"cc", b"dd"])
    index, size = rng.integers(0, 4, (6, 5)), np.array([5, 5, 3, 1, 5, 4])
    target = np.array([1, 0, 1, 0, 0.3, 1])
    found, where, _ = tg.loss_gradients(net, rows, grams, begin, index, size, target, np.ones(6))
    for name, g in found.items():
        full = np.zeros_like(net.p[name])
        full[where.get(name, slice(None))] = g
        flat, slope = net.p[name].reshape(-1), full.reshape(-1)
        for i in np.argsort(-np.abs(slope))[:4]:
            old, step = flat[i], np.float32(0.02)
            flat[i] = old + step
            up = loss(net, rows, grams, begin, index, size, target)
            flat[i] = old - step
            down = loss(net, rows, grams, begin, index, size, target)
            flat[i] = old
            assert abs((up - down) / 0.04 - slope[i]) < 2e-3 + 0.03 * abs(slope[i]), name


def slow_logit(net, window):
    """One window, one word at a time, with plain loops."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    h = net.hidden
    vectors = []
    for word in window:
        bare = word.strip(tg.EDGES) or word
        marked = b"\x02" + bare + b"\x03"
        grams = [int(tg.trigrams([bare])[0][k]) for k in range(len(marked) - 2)]
        vectors.append(np.concatenate([net.p["words"][net.vocabulary.get(bare, 0)], np.mean([net.p["chars"][g] for g in grams], axis=0)]))
    ways = []
    for way, order in (("f", vectors), ("b", vectors[::-1])):
        state, states = np.zeros(h), []
        for x in order:
            a = x @ net.p[f"in_{way}"] + net.p[f"in_b_{way}"]
            s = state @ net.p[f"turn_{way}"]
            z, r = sig(a[:h] + s[:h]), sig(a[h : 2 * h] + s[h : 2 * h])
            new = np.tanh(a[2 * h :] + r * s[2 * h :])
            state = (1 - z) * new + z * state
            states.append(state)
        ways.append(states if way == "f" else states[::-1])
    both = [np.concatenate(x) for x in zip(*ways)]
    score = np.array([np.tanh(x @ net.p["attend"] + net.p["attend_b"]) @ net.p["pick"] for x in both])
    weight = np.exp(score - score.max())
    pooled = sum(w * x for w, x in zip(weight / weight.sum(), both))
    return float(pooled @ net.p["out"] + net.p["out_b"][0])


def test_every_window_is_scored_and_the_worst_counts():
    rng = random.Random(3)
    net = tg.Network({b"bad": 1, b"w1": 2, b"w2": 3}, window=8, stride=6)
    net.start(5)
    texts = [" ".join(rng.choice(["bad", "w1.", "w2", "Other", "long" * 9]) for _ in range(n)) for n in (1, 3, 7, 8, 9, 15, 40, 101)]
    found = tg.worst_logits(net, [t.encode() for t in texts] + [None, b"", b" \n"])
    assert np.isnan(found[-3:]).all()
    for text, got in zip(texts, found):
        words = tg.tokens(text.encode())
        starts = tg.windows_of(len(words), 8, 6).tolist()
        assert set(range(len(words))) == {i for s in starts for i in range(s, min(s + 8, len(words)))}
        assert got == pytest.approx(max(slow_logit(net, words[s : s + 8]) for s in starts), abs=1e-4)


def corpus(spark, rng, n, insults):
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([20, 60, 200]))]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            text[rng.randrange(len(text))] = rng.choice(insults)
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_new_spellings(spark):
    rng = random.Random(1)
    rows, labels = corpus(spark, rng, 400, ["idiotic", "Moron!", "scumbag"])
    clean = " ".join(f"w{i}" for i in range(30))
    rows += [(1000, f"{clean} idiotics {clean}"), (1001, clean), (1002, None), (1003, ""), (None, "scumbag"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").selectExpr("*", "1 AS y", "2 AS rank", "'z' AS id", "3 AS doc")
    labels += [(7, None), (8, 5), (None, 1)]
    known = spark.createDataFrame(labels, "doc_id LONG, toxic INT")
    net = tg.fit(docs, known, F.col("doc_id") % 5 != 0, steps=150)
    got = {r["doc_id"]: r["score"] for r in tg.score(docs, net).collect()}
    held = [(got[i], t) for i, t in labels[:400] if i % 5 == 0]
    assert sum((s >= 0.3) == bool(t) for s, t in held) >= 0.95 * len(held)
    assert got[1000] > got[1001] and got[1001] < 0.3 and got[1002] == got[1003] == pytest.approx(0.25, abs=0.02)
    assert tg.score(docs, net).count() == len(rows) and all(0 <= s <= 1 for s in got.values()) and tg.score(docs.limit(0), net).count() == 0


def test_nothing_to_learn_from_and_repeated_ids_stay_bounded(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id LONG, text STRING")
    none = spark.createDataFrame([], "doc_id LONG, toxic INT")
    assert {r["score"] for r in tg.score(docs, tg.fit(docs, none, F.lit(True))).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id LONG, toxic INT")
    assert {r["score"] for r in tg.score(docs, tg.fit(docs, one, F.lit(True))).collect()} == {1.0}
    many = spark.range(3000).selectExpr("7L AS doc_id", "concat('text ', id) AS text").unionByName(docs)
    labels = spark.createDataFrame([(7, 1), (1, 0), (2, 0)], "doc_id LONG, toxic INT")
    net = tg.fit(many, labels, F.lit(True), sample_rows=20, steps=3)
    assert net.constant is None and len(net.vocabulary) <= 50
