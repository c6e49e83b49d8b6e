"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints of 64 bits are sorted; a sorted run is a binary trie whose nodes are index ranges. The join walks pairs of
nodes downwards together, adds up the bits in which their paths differ and drops a pair as soon as that exceeds the budget.

The trie's top is cut at a prefix length that follows the number of distinct fingerprints: the node pairs above the cut are
the prefixes that differ in at most ``budget`` bits (an equi-join), and each pair of subtrees, in runs of bounded size, is
walked in one task. A walk returns a forest of links, never all pairs of a group.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import readable, slices, stored
from auditloom.llm.components import components

SEED = 42


def shingles(text: str | None, size: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The text's words joined by single blanks, and start and end of each shingle in it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only the six blanks split
    if not words:
        return b"", []
    line = b" ".join(words)
    ends = [*np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist(), len(line)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    return line, [(0, len(line))] if len(words) <= size else list(zip(starts, ends[size - 1 :]))


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash of word shingles, as an unsigned number; 0 if there is no word."""
    line, spans = shingles(text, size)
    if not spans:
        return 0
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(spans), 1 << 15):
        hashes = b"".join([digest(line[a:b], SEED) for a, b in spans[at : at + (1 << 15)]])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(spans)).tobytes(), "big")


def simhash(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp) of every row: the fingerprint of the whole text as a signed long. Null and empty texts give 0."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, 4 << 20):
                found = np.array([fingerprint(t, size) for t in part.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), readable(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


class Forest:
    """Smallest-index components over numpy edge arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []  # links that joined two components

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.parent[i], self.parent[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((low, high))
            once = order[np.concatenate(([True], np.diff(high[order]) > 0))]
            self.edges.append((i[once], j[once]))
            self.parent[high[once]] = low[once]
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo, lo + 1, ... of each range, one after the other."""
    total = int(n.sum())
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)


def walk(a: np.ndarray, b: np.ndarray, budget: int, depth: int = 0, small: int = 64, width: int = 1 << 17) -> Forest:
    """Links between two sorted runs of distinct unsigned fingerprints (``b is a``: within one).

    Node pairs are ranges (a_lo, a_hi, b_lo, b_hi) with the bits that differ so far. Pairs of at most ``small``
    combinations are compared directly. The frontier is walked depth first in pieces of ``width`` pairs. Budgets are tried
    from 1 up, and pairs whose members are all linked already are dropped. Members of ``b`` follow those of ``a`` in the forest.
    """
    same = a is b
    base = 0 if same else len(a)
    forest = Forest(base + len(b))
    if not len(a) or not len(b):
        return forest
    for allowed in range(1, budget + 1) if same else (budget,):
        top = np.uint64(64 - depth)
        used = int(np.bitwise_count((a[0] >> top) ^ (b[0] >> top))) if depth else 0
        if used > allowed:
            continue
        start = (np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]), np.array([used]))
        stack = [(depth, start)]
        runs = None
        if same:
            change = np.flatnonzero(np.diff(forest.parent)) + 1
            runs = np.append(change, len(a))
        while stack:
            d, pairs = stack.pop()
            if len(pairs[0]) > width:
                stack += [(d, tuple(x[at : at + width] for x in pairs)) for at in range(0, len(pairs[0]), width)]
                continue
            alo, ahi, blo, bhi, used = pairs
            if same:
                # a range whose members share a component ends before the next change of component
                end = runs[np.searchsorted(runs, alo, side="right")]
                end_b = runs[np.searchsorted(runs, blo, side="right")]
                done = (end >= ahi) & (end_b >= bhi) & (forest.parent[alo] == forest.parent[blo]) & (ahi - alo + bhi - blo > 2)
                if done.any():
                    alo, ahi, blo, bhi, used = (x[~done] for x in (alo, ahi, blo, bhi, used))
            counts = (ahi - alo) * (bhi - blo)
            direct = counts <= small if d < 64 else np.ones(len(alo), dtype=bool)
            if direct.any():
                n, m, c = (ahi - alo)[direct], (bhi - blo)[direct], counts[direct]
                for at in range(0, len(c), max(1, (1 << 20) // small)):
                    cut = slice(at, at + max(1, (1 << 20) // small))
                    inner = _ranges(np.zeros(len(c[cut]), dtype=np.int64), c[cut])
                    width_b = np.repeat(m[cut], c[cut])
                    i = np.repeat(alo[direct][cut], c[cut]) + inner // width_b
                    j = np.repeat(blo[direct][cut], c[cut]) + inner % width_b
                    near = np.bitwise_count(a[i] ^ b[j]) <= allowed
                    if same:
                        near &= i < j
                    if near.any():
                        forest.link(i[near], base + j[near])
            alo, ahi, blo, bhi, used = (x[~direct] for x in (alo, ahi, blo, bhi, used))
            if not len(alo):
                continue
            s = np.uint64(63 - d)
            one = np.uint64(1) << s

            def split(run, lo, hi):
                return np.clip(np.searchsorted(run, ((run[lo] >> s) | np.uint64(1)) << s), lo, hi)

            am, bm = split(a, alo, ahi), split(b, blo, bhi)
            # the searched value keeps the bits above; where the bit is already set in the first member, all have it
            am = np.where(a[alo] & one, alo, am)
            bm = np.where(b[blo] & one, blo, bm)
            own = (alo == blo) & (ahi == bhi) if same else np.zeros(len(alo), dtype=bool)
            kids = [
                (alo, am, blo, bm, used, np.ones(len(alo), dtype=bool)),
                (am, ahi, bm, bhi, used, np.ones(len(alo), dtype=bool)),
                (alo, am, bm, bhi, used + 1, used < allowed),
                (am, ahi, blo, bm, used + 1, (used < allowed) & ~own),
            ]
            found = [[x[(k[1] > k[0]) & (k[3] > k[2]) & k[5]] for x in k[:5]] for k in kids]
            stack.append((d + 1, tuple(np.concatenate(x) for x in zip(*found))))
    return forest


def _runs(depth: int, limit: int):
    """Fingerprints sorted by round -> runs of one subtree, at most ``limit`` long: (node, first, fps)."""

    def run(batches):
        rest = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)]

        def cut(rounds, values, last):
            prefix = (values.view(np.uint64) >> np.uint64(64 - depth)).view(np.int64) if depth else np.zeros(len(values), dtype=np.int64)
            nodes = rounds << depth | prefix
            edges = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(values)]
            rows, kept = [], [rounds[:0], values[:0]]
            for lo, hi in zip(edges, edges[1:]):
                while hi - lo > limit:
                    rows.append((nodes[lo], values[lo : lo + limit]))
                    lo += limit
                if hi == len(values) and not last:
                    kept = [rounds[lo:hi], values[lo:hi]]
                elif hi > lo:
                    rows.append((nodes[lo], values[lo:hi]))
            return rows, kept

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            rows, rest = cut(*(np.concatenate(x) for x in zip(rest, new)), False)
            if rows:
                yield _run_batch(rows)
        rows, _ = cut(*rest, True)
        if rows:
            yield _run_batch(rows)

    return run


def _run_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(n) for n, _ in rows], pa.int64()),
            pa.array([int(v[0]) for _, v in rows], pa.int64()),
            pa.array([v.tobytes() for _, v in rows], pa.binary()),
        ],
        names=["node", "first", "fps"],
    )


def trie_links(fps: DataFrame, budget: int = 3, subtree: int = 2048, limit: int = 4096) -> DataFrame:
    """(fp) of distinct longs -> (u, v): pairs at ``budget`` or fewer differing bits that connect all such fingerprints.

    With a column ``round`` only fingerprints of one round are compared, and the result has it too. Every two linked
    fingerprints are connected by the result; a walked pair of subtrees gives at most one link a member.
    """
    rounds = "round" in fps.columns
    fps = fps.select(F.col("round").cast("long") if rounds else F.lit(0).cast("long").alias("round"), "fp")
    sizes = fps.groupBy("round").count().agg(F.max("count"), F.sum("count")).first()
    largest, count = (int(x or 0) for x in sizes)
    depth = min(20, max(0, ceil(log2(max(largest, 1) / subtree))))
    tasks = max(1, min(2000, ceil(count / 20_000)))
    ordered = fps.repartitionByRange(tasks, "round", "fp").sortWithinPartitions("round", "fp")
    runs = stored(ordered.mapInArrow(_runs(depth, limit), "node long, first long, fps binary"), "trie-runs")
    masks = [sum(1 << bit for bit in bits) for k in range(min(budget, depth) + 1) for bits in combinations(range(depth), k)]
    sought = (
        runs.select(F.col("first").alias("b_first"), F.col("fps").alias("b_fps"), F.col("node").alias("b_node"))
        .withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks]) if len(masks) < 2000 else F.array([F.lit(m) for m in masks])))
        .withColumn("node", F.col("b_node").bitwiseXOR(F.col("mask")))
        .filter(F.col("node") <= F.col("b_node"))
    )
    pairs = runs.join(sought, "node").filter((F.col("node") < F.col("b_node")) | (F.col("first") <= F.col("b_first")))

    def run(batches):
        for batch in batches:
            for node, fps_a, fps_b, same in zip(*(batch.column(c).to_pylist() for c in ("node", "fps", "b_fps", "same"))):
                # one run may hold both signs only if the trie is not cut; unsigned order is what the walk needs
                a = np.sort(np.frombuffer(fps_a, dtype=np.int64).view(np.uint64))
                b = a if same else np.sort(np.frombuffer(fps_b, dtype=np.int64).view(np.uint64))
                edges = walk(a, b, budget, depth).edges
                if edges:
                    both = (a if same else np.concatenate([a, b])).view(np.int64)
                    u, v = (both[np.concatenate(x)] for x in zip(*edges))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), node >> depth)), pa.array(u), pa.array(v)], names=["round", "u", "v"])

    narrow = pairs.select("node", "fps", F.when(F.col("first") != F.col("b_first"), F.col("b_fps")).alias("b_fps"), (F.col("first") == F.col("b_first")).alias("same"))
    links = narrow.mapInArrow(run, "round long, u long, v long")
    return links if rounds else links.drop("round")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = 3
) -> DataFrame:
    """One row per input row: id, fp (signed long), component_id, the smallest id reachable over links, its own included.

    Documents with equal fingerprints are linked, null and empty texts among them (fingerprint 0). Null ids are never a
    component_id unless a component has no other. Repeated rows are kept. Other columns are ignored. An empty table gives
    an empty result.
    """
    marked = stored(simhash(docs, id_col=id_col, text_col=text_col, size=size), "fingerprints")
    # one row a fingerprint: the smallest id before the shuffle, so a large group of copies costs one row a task
    distinct = stored(marked.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct-fingerprints")
    roots = stored(components(trie_links(distinct.select("fp"), budget)), "fingerprint-roots")
    linked = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = linked.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
