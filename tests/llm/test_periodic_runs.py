import hashlib
import random
import zlib

import pytest

from auditloom.llm import periodic_runs as pr
from auditloom.llm.queries import op13_periodic_runs


def slow(words, least=24, times=3):
    """Every stretch that no neighbour extends, for every period; of equal stretches the least period."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, times * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def text(rng):
    words = [rng.choice("abcdefghij"[: rng.choice([1, 2, 10])]) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(4)):
        unit = [rng.choice("abcdef") for _ in range(rng.randrange(1, 30))]
        if rng.random() < 0.4:
            unit = unit[:2] * rng.randrange(5, 13) + unit
        words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 200)]
        if rng.random() < 0.3:
            words = words * 2
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_trying_all_periods(seed):
    rng = random.Random(seed)
    texts = [text(rng) for _ in range(60)]
    for words, (n, runs, rest) in zip(texts, pr.runs_of_texts([" ".join(w).encode() for w in texts])):
        assert (n, runs, rest.decode()) == (len(words), slow(words), kept(words, slow(words)))


def test_words_of_a_fibonacci_text_and_of_one_word():
    a, b = ["a"], ["a", "b"]
    while len(b) < 2000:
        a, b = b, b + a
    long = ["w"] * 30_000
    (n, runs, _), (m, single, rest) = pr.runs_of_texts([" ".join(b).encode(), " ".join(long).encode()])
    assert runs == slow(b) and runs and (m, single, rest) == (30_000, [(0, 30_000, 1)], b"w")
    assert pr.runs_of_texts([]) == [] and pr.runs_of_texts([None, b" \n"]) == [(0, [], b""), (0, [], b"")]


def test_documents_with_nulls_repeats_odd_bytes_and_clashing_columns(spark):
    unit = "x Y zé "
    rows = [(1, unit * 9), (1, unit * 9), (2, None), (3, ""), (None, "q " * 40 + "end"), (4, "a\x0bb\x1cc\td " * 12)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").selectExpr("*", "1 AS id", "2 AS runs", "'k' AS kept")
    odd = docs.unionByName(spark.sql("SELECT 9L AS doc_id, CAST(repeat(concat(unhex('FF20C3'), ' '), 30) AS STRING) AS text, 1 AS id, 2 AS runs, 'k' AS kept"))
    got = {(r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), bytes(r["kept"])) for r in pr.periodic_runs(odd).collect()}
    assert got == {
        (1, 27, ((0, 27, 3),), "x Y zé".encode()), (2, 0, (), b""), (3, 0, (), b""), (None, 41, ((0, 40, 1),), b"q end"),
        (4, 36, ((0, 36, 3),), b"a b\x1cc d"), (9, 60, ((0, 60, 2),), b"\xff \xc3"),
    }
    assert pr.periodic_runs(odd).count() == 7 and pr.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.periodic_runs(docs, least=10)


def test_query_equals_brute_force_on_a_small_table(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(text(rng) + [f"u{rng.randrange(9)}" for _ in range(rng.randrange(40))])) for i in range(120)] + [(500, None), (501, " "), (None, "a " * 50)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for i, t in rows:
        words = (t or "").split(" ") if t and t.strip() else []
        words = [w for w in words if w]
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        runs = slow(words)
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (
            (len(runs), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None)
        )
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept(words, runs).encode()).hexdigest()
    assert planted > 5
