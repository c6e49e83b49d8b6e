import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import decontamination as dc


def slow_best(pattern, window):
    """Least edit distance of the pattern to any substring, by the full table."""
    row = [0] * (len(window) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(window, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        new = [i]
        for j, c in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != c)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=20), st.text("abc ", max_size=40), st.integers(0, 8))
def test_bit_parallel_search_matches_the_table(pattern, window, budget):
    got = dc.Pattern(pattern, budget).best(window)
    want = slow_best(pattern, window)
    assert (got is None) == (want > budget)
    if got:
        assert got[0] == want and edits(pattern, window[got[1] : got[2]]) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcd ", min_size=4, max_size=14), min_size=1, max_size=4), st.text("abcd .\n", max_size=60), st.sampled_from([0.0, 0.15, 0.3]))
def test_matcher_finds_what_brute_force_finds(items, text, rate):
    clean = [(i, dc.normalize(t)) for i, t in enumerate(items)]
    clean = [(i, t) for i, t in clean if t]
    got = {x[0]: x[1] for x in dc.Matcher(clean, rate).leaks(text)} if clean else {}
    window = dc.normalize(text)
    want = {i: d for i, t in clean if (d := slow_best(t, window)) <= int(rate * len(t))}
    assert got == want


def changed(text, n, rng):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[i : i + (kind > 0)] = rng.choice("xyz") if kind < 2 else ""
    return "".join(out)


@pytest.mark.parametrize("chunk_chars", [60, 1_000_000])
def test_planted_items_are_found_and_clean_documents_kept(spark, chunk_chars):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(4)] + [(9, None), (10, "Too short?"), (2, None), (11, "..."), (12, "12 + 7"), (13, "\u4f60\u597d\u5417")]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [
        (1, f"{filler(30)} {items[0][1].upper().replace(' ', ',  ')} {filler(30)}", "kept"),
        (2, f"{filler(30)} {changed(items[1][1], 4, rng)} {filler(3000)} {items[2][1]}", "kept"),
        (3, filler(200), "kept"),
        (4, None, None),
        (5, "", ""),
        (3, filler(200), "kept"),
        (None, items[3][1], "x"),
        (6, f"{filler(5)} too  SHORT, {filler(5)}", "x"),
        (7, f"toos hort, too shorts, 312 7, too shor {filler(5)}", "kept"),
        (8, "what is 12+7", "x"),
        (9, "\u6211\u8bf4\u4f60\u597d\u5417\u4eca\u5929", "x"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string, leaks string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(frame, bench, chunk_chars=chunk_chars).collect()}
    assert got == {(1, 0), (2, 1), (2, 2), (None, 3), (6, 10), (8, 12), (9, 13)}
    clean = dc.decontaminate(frame, bench, chunk_chars=chunk_chars)
    assert clean.columns == frame.columns and sorted(r["doc_id"] for r in clean.collect()) == [3, 3, 4, 5, 7]
    assert dc.contaminated(frame, bench.limit(0)).count() == 0 and dc.contaminated(frame.limit(0), bench).count() == 0
    assert dc.decontaminate(frame, bench.limit(0)).count() == len(docs)
