import random
import zlib

import pytest
from pyspark.sql import functions as F

from auditloom.llm import spelling_permuterm as sp


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def slow(counts, factor=10):
    form, n_near = {}, {}
    for w, n in counts.items():
        others = [o for o in counts if o != w and near(w, o)]
        n_near[w] = len(others)
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_comparing_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = set()
    for _ in range(40):
        word = "".join(rng.choice("aabéÀz") for _ in range(rng.randrange(1, 9)))
        for _ in range(rng.randrange(8)):
            words.add(word)
            at = rng.randrange(len(word) + 1)
            word = rng.choice([word[:at] + rng.choice("aabé") + word[at:], word[:at] + word[at + 1 :], word[:at] + "b" + word[at + 1 :]]) or "a"
    words |= {"aaaa", "aaaaa", "aaaaaa", "aabb", "abab", "x" * 90, "x" * 91, "x" * 40 + "y" + "x" * 49}
    counts = {w: rng.choice([1, 2, 3, 10, 30, 100, 1000, 20000]) for w in words}
    frame = spark.createDataFrame(sorted(counts.items()), "word STRING, n LONG").selectExpr("*", "1 AS id", "'k' AS key")
    got = [tuple(r[c] for c in COLUMNS) for r in sp.spelling_variants(frame).collect()]
    assert sorted(got, key=str) == slow(counts)


def test_forms_are_followed_to_the_last(spark):
    chain = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 10_000, "aabbbbb": 100_000, "lonelyone": 5}
    got = {r["word"]: r["root"] for r in sp.spelling_variants(spark.createDataFrame(list(chain.items()), "word STRING, n LONG")).collect()}
    assert got == {w: "aabbbbb" if w != "lonelyone" else w for w in chain}
    assert sp.spelling_variants(spark.createDataFrame([], "word STRING, n LONG")).count() == 0
    with pytest.raises(ValueError):
        sp.spelling_variants(spark.createDataFrame([], "word STRING, n LONG"), factor=1)


def test_words_of_texts(spark):
    rows = [(1, "Straßenn straßenn ABCDEFGH-abcdefgh ÀÉÎÕÜßÿ abcdef"), (2, None), (2, ""), (None, "xylophon'xylophon 7letters"), (1, "gööödmorning " * 31), (3, "w" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").selectExpr("*", "'r' AS run", "7 AS id")
    runs = sp.letter_runs(docs)
    want = []
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if len(run) >= 7:
                h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
                want.append(run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run)
            run = ""
    got = [r["word"] for r in runs.select(sp.lose_letters(runs, 3).alias("word")).collect()]
    assert sorted(got) == sorted(want) and set(want) != {r["run"] for r in runs.collect()}
    counted = {r["word"]: r["n"] for r in sp.word_counts(runs.select(F.col("run").alias("word"))).collect()}
    assert counted["gööödmorning"] == 31 and "straßenn" in counted and "w" * 5000 not in counted and sp.letter_runs(docs.limit(0)).count() == 0
