import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from auditloom.llm import components, simhash_trie
from auditloom.llm.simhash_trie import fingerprint, walk


def slow_fingerprint(text, size=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32})
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, budget=3):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= budget:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(values))]


def groups(labels):
    found = {}
    for i, label in enumerate(labels):
        found.setdefault(label, set()).add(i)
    return sorted(map(sorted, found.values()))


@pytest.mark.parametrize("text", ["", None, "A b", "a b c d", "Ä b c\x1fd e F", "x\t\ny\x0bz  w " * 50])
def test_fingerprint_matches_the_definition(text):
    assert fingerprint(text) == slow_fingerprint(text)


def clustered(rng, n):
    base = rng.integers(0, 2**64, size=max(1, n // 8), dtype=np.uint64)
    picked = base[rng.integers(0, len(base), size=n)]
    for _ in range(4):
        flip = np.uint64(1) << rng.integers(0, 64, size=n, dtype=np.uint64)
        picked = np.where(rng.random(n) < 0.5, picked ^ flip, picked)
    return np.unique(picked)


@pytest.mark.parametrize("small", [1, 4, 64])
def test_walk_within_one_run_matches_brute_force(small):
    values = clustered(np.random.default_rng(small), 400)
    assert groups(walk(values, values, 3, small=small).parent) == groups(slow_components([int(v) for v in values]))


def test_walk_between_runs_finds_every_link():
    values = clustered(np.random.default_rng(3), 500)
    a, b = values[values < 2**63], values[values >= 2**63]
    parent = walk(a, b, 3, depth=1, small=4, width=16).parent
    for i in range(len(a)):
        for j in range(len(b)):
            if bin(int(a[i]) ^ int(b[j])).count("1") <= 3:
                assert parent[i] == parent[len(a) + j]


def test_links_over_cut_tries_match_brute_force(spark):
    values = clustered(np.random.default_rng(5), 1500)
    signed = [int(v) for v in values.view(np.int64)]
    frame = spark.createDataFrame([Row(fp=v) for v in signed])
    for subtree, limit in ((1 << 20, 1 << 20), (32, 16)):
        links = simhash_trie.trie_links(frame, subtree=subtree, limit=limit)
        found = {r["node"]: r["root"] for r in components.components(links).collect()}
        labels = [found.get(v, v) for v in signed]
        assert groups(labels) == groups(slow_components([int(v) for v in values]))


def test_near_duplicates_handle_copies_nulls_and_clashing_columns(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, text, 1), (3, text, 2), (3, text, 2), (9, None, 3), (8, "", 4), (None, "solo text of its own here", 5), (7, "other words entirely", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long").selectExpr("*", "fp as component_id", "1 as id", "2 as root")
    out = simhash_trie.near_duplicates(docs)
    got = sorted(((r["doc_id"], r["component_id"]) for r in out.collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (None, None), (7, 7)], key=str)
    assert simhash_trie.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    rows = [(i, i + 1) for i in range(100, 160)] + [(1000 + i, 1000) for i in range(50)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert {found[i] for i in range(100, 161)} == {100} and {found[1000 + i] for i in range(50)} == {1000} and 7 not in found
