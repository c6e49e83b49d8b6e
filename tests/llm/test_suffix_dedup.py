import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import suffix_dedup as sd
from auditloom.llm.queries import op7_suffix_dedup


def slow(rows, width=50):
    """{row number: removed mask} by definition; a null id is larger than all others."""
    texts = [(sd.NO_ID if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in texts:
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            least[w] = min(d, least.get(w, d))
    out = []
    for d, b in texts:
        mask = [False] * len(b)
        for i in range(len(b) - width + 1):
            if least[b[i : i + width]] < d:
                mask[i : i + width] = [True] * width
        out.append((b, mask))
    return out


def digest(b, mask):
    kept = bytes(c for c, m in zip(b, mask) if not m)
    spans = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
    return len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("letters,depth", [(1, 5), (2, 50), (2, 7), (4, 20), (90, 50)])
def test_suffix_ranks_order_by_the_first_symbols(letters, depth):
    rng = np.random.default_rng(letters)
    part = rng.integers(1, letters + 1, size=300)
    text = np.concatenate([part, part[40:200], part[:90], rng.integers(1, letters + 1, size=100), np.zeros(2 * depth, dtype=np.int64)])
    ranks = sd.suffix_ranks(text, letters + 1, depth)
    order = np.argsort(ranks, kind="stable")
    heads = [tuple(text[i : i + depth]) for i in order if i + depth <= len(text) - depth]
    assert heads == sorted(heads)


def test_least_owner_matches_brute_force():
    rng = random.Random(2)
    runs = ["".join(rng.choice("ab") for _ in range(rng.randint(6, 40))).encode() for _ in range(60)]
    owners = np.array([rng.randrange(30) for _ in runs])
    least, begins = sd.least_owner(runs, owners, 6)
    want = {}
    for r, o in zip(runs, owners):
        for i in range(len(r) - 5):
            want[r[i : i + 6]] = min(o, want.get(r[i : i + 6], o))
    for k, r in enumerate(runs):
        assert least[begins[k] : begins[k + 1]].tolist() == [want[r[i : i + 6]] for i in range(len(r) - 5)]


def corpus(rng, n):
    word = lambda: "".join(rng.choice("aeioué bcd") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(6, 40))) for _ in range(8)]
    rows = []
    for i in range(n):
        kind = rng.random()
        text = " ".join(rng.choice(passages) if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 60)))
        if kind < 0.1 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.3 and rows:
            text = (rng.choice(rows)[1] or "")[rng.randint(0, 90) :] + word()
        rows.append((rng.choice([i, i, i, 3, None]) if kind > 0.9 else i, text))
    return [*rows, (10_000, None), (10_001, ""), (10_002, "x" * 3000), (10_003, "x" * 70), (-4, "x" * 49), (-5, "y" * 50), (7777, "yy" * 30)]


def test_removal_matches_the_definition(spark):
    rows = corpus(random.Random(5), 150)
    frame = spark.createDataFrame([(d, t, 0, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, block int, row int")
    for options in ({"block_bytes": 2000, "range_bytes": 2000}, {}):
        out = sd.remove_repeats(frame.repartition(3), carry=F.struct("row", "block"), **options)
        got = {r["carried"]["row"]: r for r in out.collect()}
        assert len(got) == len(rows)
        for i, (b, mask) in enumerate(slow(rows)):
            r = got[i]
            assert (r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) == digest(b, mask)
    assert sd.remove_repeats(frame.limit(0)).count() == 0


def test_query_matches_brute_force_on_a_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {d: digest(b, m) for (d, _), (b, m) in zip(rows, slow(rows))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op7_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and any(w[1] for w in want.values())


def test_runs_of_a_hot_minimizer_are_spread_over_the_ranges(spark):
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = word(90)
    texts = [word(60) + passage + word(60) for _ in range(300)]
    data = [t.encode() for t in texts]
    block = sd.Block(b"".join(data), np.array([len(b) for b in data]), np.arange(300), 50, 20)
    keys, many, runs = block.minimizers()
    assert runs[many].max() > 200
    dealt = block.dealt(many, many & (runs > 20), 64)
    strings = np.bincount(dealt.ranges, weights=dealt.strings, minlength=64)
    assert strings.max() < 3 * strings.mean()
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: m for (d, _), (_, m) in zip(rows, slow(rows))}
    for most_runs in (20, 20_000):
        for r in sd.remove_repeats(frame.repartition(3), most_runs=most_runs, block_bytes=4000).collect():
            mask = [False] * r["n_bytes"]
            for span in r["removed"]:
                mask[span["start"] : span["end"]] = [True] * (span["end"] - span["start"])
            assert mask == want[r["carried"]]


def test_a_block_sends_a_row_to_a_range_however_many_parts_it_has(spark, monkeypatch):
    rows = corpus(random.Random(6), 200)
    frame = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    written, kept = {}, sd.stored

    def stored(df, name):
        written[name] = kept(df, name)
        return written[name]

    monkeypatch.setattr(sd, "stored", stored)
    got = {r["carried"]: r for r in sd.remove_repeats(frame, carry=F.col("row"), block_bytes=3000, range_bytes=20).collect()}
    blocks = written["repeat-blocks"].count()
    size = written["repeat-blocks"].agg(F.sum(F.octet_length("text"))).first()[0]
    sent = written["repeat-judged"]
    assert size // 20 > 64 and blocks > 1 and sent.count() == sent.select("block", "range").distinct().count() <= 8 * blocks
    for i, (b, mask) in enumerate(slow(rows)):
        r = got[i]
        assert (r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) == digest(b, mask)


def test_strings_that_occur_once_are_not_sorted(monkeypatch):
    rng = random.Random(3)
    word = lambda n: bytes(rng.choice(b"abcdefghij") for _ in range(n))
    passage = word(70)
    runs = [word(90) for _ in range(200)] + [word(40) + passage + word(30) for _ in range(5)] + [passage[10:], b"x" * 80]
    owners = np.array([rng.randrange(1000) for _ in runs])
    want = {}
    for r, o in zip(runs, owners):
        for i in range(len(r) - 49):
            want[r[i : i + 50]] = min(o, want.get(r[i : i + 50], o))
    sorted_bytes, kept = [], sd.suffix_ranks

    def ranks(text, size, depth):
        sorted_bytes.append(len(text) if depth == 50 else 0)
        return kept(text, size, depth)

    monkeypatch.setattr(sd, "suffix_ranks", ranks)
    least, begins = sd.least_owner(runs, owners, 50)
    assert 0 < sum(sorted_bytes) < 1000 < sum(map(len, runs))
    for k, r in enumerate(runs):
        assert least[begins[k] : begins[k + 1]].tolist() == [want[r[i : i + 50]] for i in range(len(r) - 49)]
    least, begins = sd.least_owner(runs[:1], owners[:1], 50)
    assert set(least.tolist()) == {owners[0]} and begins.tolist() == [0, 41]
    assert [x.tolist() for x in sd.least_owner([], owners[:0], 50)] == [[], [0]]
