import random
from collections import Counter

import corpus_pipeline as cp
from test_crf_language import SYLLABLES, sentence
from test_simhash_trie import slow_components, slow_fingerprint


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def corpus():
    rng = random.Random(8)
    line = lambda lang, n=60: sentence(lang, rng, n)
    docs = {i: (f"{line(lang)}\n{line(lang)}", lang) for i, lang in enumerate(list(SYLLABLES) * 12)}
    item, passage = line("yy", 25), line("xx", 20)
    bits = lambda t: bin(slow_fingerprint(t) ^ slow_fingerprint(docs[0][0])).count("1")
    near = next(t for t in (f"{docs[0][0]} {line('xx', 1)}" for _ in range(1000)) if bits(t) <= 3)
    extra = {
        100: (docs[4][0], "yy"),  # a copy
        101: (near, "xx"),  # a near copy
        102: (f"{line('yy')} {item} {line('yy')}", "yy"),  # a test item
        103: (f"{line('xx')} {passage} {line('xx')}", "xx"),
        104: (f"{line('xx')} {passage} {line('xx')}", "xx"),  # a passage that stands in 103
        105: (None, "xx"), 106: ("", "yy"), 107: ("12 34 !!", "zz"), 108: (line("zz", 300), None), 109: (f"{line('xx', 40)} {line('yy', 40)}", "xx"),
    }
    rows = [(i, t, lang, rng.choice(["a", "b", None]), len(t or "")) for i, (t, lang) in (docs | extra).items()]
    return rows + [rows[3]], [(1, item), (2, None)], passage


def test_each_stage_does_its_work_and_keeps_clean_documents(spark, tmp_path):
    rows, items, passage = corpus()
    write(spark, tmp_path, rows, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        seen[name + " n"] = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    gone = [set(texts)]
    for name, _ in cp.STAGES[:-1]:
        gone.append(set(seen[name]))
    assert gone[0] - gone[1] == {105, 106, 107}
    assert gone[1] - gone[2] == {100, 101} and max(seen["simhash_near_dedup n"].values()) == 1
    assert gone[2] - gone[3] == set() and gone[3] - gone[4] == {102}
    assert seen["language_id"][108]["lang"] == "zz"
    cut = seen["suffix_array_dedup"]
    assert passage in cut[103]["text"] and passage[10:-10] not in cut[104]["text"] and cut[104]["n_chars"] == len(cut[104]["text"])
    same = [i for i in cut if i not in (104,) and cut[i]["text"] == texts[i]]
    assert len(same) == len(cut) - 1
    mixed = {r["doc_id"]: r for r in cp.mix(spark, docs, str(tmp_path)).collect()}
    assert set(mixed) == gone[4] and all(r["size"] == len(seen["benchmark_decontamination"][i]["text"].split()) for i, r in mixed.items())
    again = {r["doc_id"]: r["taken"] for r in cp.run(spark, str(tmp_path)).collect()}
    assert again == {i: r["taken"] for i, r in mixed.items()}


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_keeps_the_first_row_of_each_group_as_brute_force_does(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    one, two, three, clean, late = (text(200) for _ in range(5))
    rows = [(None, one), (None, two), (None, one), (3, three), (7, f"{three} more"), (7, clean), (7, clean), (None, f"{clean} more"), (9, late), (9, None), (10, "")]
    for i in range(20, 40):
        base = text(rng.choice([3, 60, 400])).split(" ")
        rows.append((i, " ".join(base)))
        base[rng.randrange(len(base))] = "other"
        rows.append((i + 100, " ".join(base)))
    frame = spark.createDataFrame([(i, t, "xx", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = frame.selectExpr("*", "1 as n", "2 as head", "'x' as `a.b`", "3 as key", "4 as digest")
    kept = cp.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    groups = slow_components([slow_fingerprint(t) for _, t in rows])
    heads = {}
    for (i, t), group in zip(rows, groups):
        heads.setdefault(group, []).append((i, t))
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(heads)
    for members in heads.values():
        mine = [x for x in got if x in members]
        least = min((i for i, _ in members if i is not None), default=None)
        assert len(mine) == 1 and mine[0][0] == least
    assert (None, one) in got and (None, two) in got and (7, clean) in got and (9, late) in got
