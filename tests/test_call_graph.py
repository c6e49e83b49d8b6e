"""Factorised call graph against the plain edges."""

import random
from collections import Counter

from auditloom.operators import call_graph as cg
from auditloom.operators import graph


def _files(spark, seed=1, repos=6, files=40):
    rng = random.Random(seed)
    rows = []
    for i in range(files):
        names = [f"f{rng.randrange(12)}" for _ in range(rng.randrange(4))]
        calls = [f"f{rng.randrange(15)}" for _ in range(rng.randrange(4))]
        body = "".join(f"def {n}(x): pass\n" for n in names) + "".join(f"y = {n}(1)\n" for n in calls)
        rows.append((f"r{rng.randrange(repos)}", f"p{i}.{'py' if i % 9 else 'txt'}", body))
    rows += [("r0", "empty.py", ""), ("r1", "null.py", None), ("r0", "twice.py", "def f1(): pass\ndef f1(): pass\n"), ("far", "x.py", "def alone(): pass\nlone()")]
    return spark.createDataFrame(rows, "repo STRING, path STRING, content STRING").selectExpr("*", "1 AS func", "2 AS callers")


def _plain(files):
    return [r.asDict() for r in graph.cross_repo_call_edges(files).collect()]


def test_counts_stand_for_the_plain_edges(spark):
    files = _files(spark)
    plain = _plain(files)
    called = [(r["source_repo"], r["path"], r["details"].split("'")[1], r["target_repo"], r["definitions"]) for r in plain]
    links = [r.asDict() for r in cg.call_links(files).collect()]
    calls = {(r["repo"], r["path"], r["func"]): (r["links"], r["definitions"]) for r in links if r["edge_type"] == "CALLS"}
    homes = {(r["func"], r["repo"]): r["links"] for r in links if r["edge_type"] == "DEFINED_IN"}
    assert calls == {
        k: (n, sum(d for a, b, f, _, d in called if (a, b, f) == k)) for k, n in Counter((a, b, f) for a, b, f, _, _ in called).items()
    }
    assert homes == Counter((f, t) for _, _, f, t, _ in called) and len(links) == len(calls) + len(homes)
    names = {r["func"]: (r["edges"], r["occurrences"]) for r in cg.call_names(files).collect()}
    assert names == {f: (sum(x[2] == f for x in called), sum(x[4] for x in called if x[2] == f)) for f in {x[2] for x in called}}
    classes = cg.call_classes(files).collect()
    assert sum(r["callers"] * r["targets"] for r in classes) == len(plain) == sum(r["sources"] for r in classes if r["definitions"])
    assert cg.call_links(files.limit(0)).count() == 0 and cg.call_names(files.limit(0)).count() == 0


def _slow_reach(plain, seeds):
    """Breadth first along the plain edges: depth of each repository."""
    steps = {(r["source_repo"], r["target_repo"]) for r in plain}
    depth = {r: 0 for r, p in seeds if p is None}
    level = {t for s, t in steps if s in depth} | {r["target_repo"] for r in plain if (r["source_repo"], r["path"]) in set(seeds)}
    d = 0
    while level - set(depth):
        d += 1
        new = level - set(depth)
        depth |= {r: d for r in new}
        level = {t for s, t in steps if s in new}
    return depth


def test_reach_through_names_equals_reach_along_plain_edges(spark):
    for seed, wanted in ((3, [("r1", "p3.py"), ("r2", "p5.py"), ("none", "p"), ("far", "x.py")]), (4, [("r3", None), ("r1", "p1.py")])):
        files = _files(spark, seed, repos=12, files=16)
        if seed == 3:
            rows = files.select("repo", "path").collect()
            wanted = [(r["repo"], r["path"]) for r in rows[:4]] + wanted
        got = cg.call_reach(files, spark.createDataFrame(wanted, "repo STRING, path STRING")).collect()
        assert {r["node"]: r["depth"] for r in got if r["kind"] == "repository"} == _slow_reach(_plain(files), wanted)
        assert len({(r["kind"], r["node"]) for r in got}) == len(got)


def test_a_name_is_walked_again_for_its_first_caller(spark):
    files = spark.createDataFrame(
        [("r", "a.py", "f(1)\ndef f(x): pass"), ("s", "b.py", "def f(x): pass\nf(2)"), ("t", "c.py", "g(1)")], "repo STRING, path STRING, content STRING"
    )
    got = cg.call_reach(files, spark.createDataFrame([("r", "a.py")], "repo STRING, path STRING")).collect()
    assert {(r["kind"], r["node"], r["depth"]) for r in got} == {("name", "f", 1), ("repository", "s", 1), ("repository", "r", 2)}


def test_a_name_in_every_repository_makes_no_pairs(spark):
    repos = 400
    files = spark.range(repos).selectExpr("concat('r', id) AS repo", "'m.py' AS path", "'def main(): pass\nmain()' AS content")
    assert cg.call_links(files).count() == 2 * repos
    name = cg.call_names(files).collect()
    assert [(r["func"], r["edges"]) for r in name] == [("main", repos * (repos - 1))]
    frame = cg.call_links(files)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = cg.call_reach(files, spark.createDataFrame([("r0", None)], "repo STRING, path STRING")).collect()
    assert {(r["kind"], r["depth"]) for r in got} == {("name", 1), ("repository", 0), ("repository", 1)} and len(got) == repos + 1


def _breadth_first(edges, seeds):
    after = {}
    for s, t in edges:
        after.setdefault(s, set()).add(t)
    depth, level, d = {s: 0 for s in seeds}, set(seeds), 0
    while level:
        d += 1
        level = {t for s in level for t in after.get(s, ())} - set(depth)
        depth |= {t: d for t in level}
    return depth


def _deep(spark, edges, seeds):
    frame = spark.createDataFrame(edges, "source STRING, target STRING")
    got = graph.deep_reach(frame, spark.createDataFrame([(s,) for s in seeds], "node STRING")).collect()
    assert len({r["node"] for r in got}) == len(got)
    return {r["node"]: r["depth"] for r in got}


def test_deep_reach_on_a_chain_and_a_cycle_of_ten_thousand(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(10_000)]
    cycle = [(f"k{i}", f"k{(i + 1) % 10_000}") for i in range(10_000)]
    edges = chain + cycle + [("c9999", "k500"), ("k500", "c3"), ("alone", "alone")]
    got = _deep(spark, edges, ["c0"])
    assert got == _breadth_first(edges, ["c0"]) and len(got) == 20_001 and max(got.values()) == 19_999


def test_deep_reach_equals_breadth_first_on_mixed_graphs(spark):
    for seed in (2,):
        rng = random.Random(seed)
        edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(50)]
        edges += [(f"n{i}", f"p{i}-0") for i in (3, 7)] + [(f"p{i}-{j}", f"p{i}-{j + 1}") for i in (3, 7) for j in range(30)] + [("p3-30", "n5"), ("p7-12", "n9")]
        edges += [("n1", None), (None, "n2"), ("n4", "n4"), ("n3", "p3-20")]
        seeds = ["n3", "n7", "absent"]
        assert _deep(spark, edges, seeds) == _breadth_first([e for e in edges if None not in e], seeds)
    assert _deep(spark, [], ["a"]) == {"a": 0}


def test_plans_of_deep_reach_stay_small(spark, monkeypatch):
    plans, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = [(f"c{i}", f"c{i + 1}") for i in range(600)] + [("c300", "d0"), ("d0", "c1")]
    assert _deep(spark, edges, ["c0"]) == _breadth_first(edges, ["c0"])
    assert max(p.count("Scan parquet") for p in plans) <= 10 and not any("BroadcastHashJoin" in p for p in plans[4:])
