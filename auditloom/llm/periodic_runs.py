"""Runs of repeated words, found on a grammar of each text.

Re-Pair turns the word ids of a text into a grammar: again and again the most frequent pairs of neighbouring symbols become
new nonterminals. What is left at the end is paired up to a balanced tree. Every run lies in some node of the derivation and
crosses the boundary of its two halves, so the runs across that boundary are computed once for each nonterminal, however
often it occurs, translated to all its places, and intervals of equal period that overlap are merged to maximal ones.

A batch of texts goes through all this at once in numpy; symbols of different texts are different, so each text has its own
grammar. Nothing is shuffled. A text is never cut, so a task holds one text and its symbols at least (some hundred bytes a
word).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.arrays import let
from auditloom.llm.common import WORD, slices

GRAM = 4  # a run longer than max(24, 3 periods) repeats this many words next to any boundary that it crosses
PRIME = (1 << 31) - 1


class Nodes:
    """Boundaries of the derivation: one row (lo, mid, hi) a nonterminal, at its first place, and all places of each."""

    def __init__(self, least: int):
        self.least = least
        self.count = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.places: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, name: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> None:
        """Places of nonterminals, named by any numbers; those of fewer than ``least`` words hold no run and are left out."""
        long = hi - lo >= self.least
        if not long.any():
            return
        _, first, inverse = np.unique(name[long], return_index=True, return_inverse=True)
        self.parts.append((lo[long][first], mid[long][first], hi[long][first]))
        self.places.append((inverse + self.count, lo[long]))
        self.count += len(first)

    def arrays(self):
        lo, mid, hi = (np.concatenate(x) for x in zip(*self.parts))
        node, start = (np.concatenate(x) for x in zip(*self.places))
        order = np.argsort(node, kind="stable")
        return lo, mid, hi, node[order], start[order]


def pair_up(symbols: np.ndarray, text: np.ndarray, nodes: Nodes) -> None:
    """Re-Pair of all texts at once; ``symbols`` of different ``text`` numbers (ascending) differ.

    In each round a pair that occurs twice or more, without overlap, is replaced wherever no neighbouring pair is more
    frequent (ties: the smaller code): the most frequent pair of every text is replaced everywhere. A text without repeated
    pairs leaves the rounds, and its symbols are paired up to a balanced tree.
    """
    n = len(symbols)
    sym, doc = symbols.astype(np.int64), text
    lo, hi = np.arange(n), np.arange(1, n + 1)
    fresh = int(sym.max()) + 1 if n else 0
    done: list[tuple[np.ndarray, ...]] = []
    while len(sym):
        code = sym[:-1] << 32 | sym[1:]
        at = np.flatnonzero(doc[1:] == doc[:-1])
        if len(at):
            # of a, a, a, a the pairs at every other place are occurrences
            goes_on = np.concatenate(([False], (np.diff(at) == 1) & (code[at[1:]] == code[at[:-1]])))
            step = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(goes_on, 0, step))
            at = at[(step - begin) % 2 == 0]
        values, inverse, counts = np.unique(code[at], return_inverse=True, return_counts=True)
        often = counts[inverse] > 1
        at, inverse = at[often], inverse[often]
        rank = np.empty(len(values), dtype=np.int64)
        rank[np.lexsort((values, -counts))] = np.arange(len(values))
        level = rank[inverse]
        beside = np.diff(at) == 1
        loses = np.zeros(len(at), dtype=bool)
        loses[1:] |= beside & (level[1:] > level[:-1])
        loses[:-1] |= beside & (level[:-1] > level[1:])
        at, inverse = at[~loses], inverse[~loses]
        often = np.bincount(inverse, minlength=len(values))[inverse] > 1
        at, inverse = at[often], inverse[often]
        _, name = np.unique(inverse, return_inverse=True)
        nodes.add(name, lo[at], hi[at], hi[at + 1])
        sym[at] = fresh + name
        fresh += int(name.max()) + 1 if len(at) else 0
        hi[at] = hi[at + 1]
        kept = np.ones(len(sym), dtype=bool)
        kept[at + 1] = False
        active = np.zeros(int(doc[-1]) + 1, dtype=bool)
        active[doc[at]] = True
        finished = kept & ~active[doc]
        if finished.any():
            done.append((doc[finished], lo[finished], hi[finished]))
        kept &= active[doc]
        sym, doc, lo, hi = sym[kept], doc[kept], lo[kept], hi[kept]
    for doc, lo, hi in done:
        while True:
            first = np.concatenate(([True], doc[1:] != doc[:-1]))
            place = np.arange(len(doc)) - np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
            left = np.flatnonzero((place[:-1] % 2 == 0) & (doc[1:] == doc[:-1]))
            if not len(left):
                break
            nodes.add(left, lo[left], hi[left], hi[left + 1])
            hi = hi.copy()
            hi[left] = hi[left + 1]
            kept = np.ones(len(doc), dtype=bool)
            kept[left + 1] = False
            doc, lo, hi = doc[kept], lo[kept], hi[kept]


class Extensions:
    """How far two places of the ids agree, by two prefix sums modulo a prime and halving."""

    def __init__(self, ids: np.ndarray, seed: int):
        self.sums, self.powers = [], []
        for base in np.random.default_rng(seed).integers(1 << 20, PRIME - 1, size=2):
            power = np.ones(len(ids) + 1, dtype=np.int64)
            have, step = 1, int(base)
            while have < len(power):
                new = min(have, len(power) - have)
                power[have : have + new] = power[:new] * step % PRIME
                have, step = 2 * have, step * step % PRIME
            terms = (ids + 1) % PRIME * power[:-1] % PRIME
            # sums of a million terms below 2^31 stay below 2^51
            total = np.zeros(len(ids) + 1, dtype=np.int64)
            for start in range(0, len(ids), 1 << 20):
                part = terms[start : start + (1 << 20)]
                total[start + 1 : start + 1 + len(part)] = (total[start] + np.cumsum(part)) % PRIME
            self.sums.append(total)
            self.powers.append(power)

    def equal(self, i: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        same = np.ones(len(i), dtype=bool)
        for total, power in zip(self.sums, self.powers):
            here = (total[i + size] - total[i]) % PRIME
            there = (total[i + q + size] - total[i + q]) % PRIME
            same &= here * power[q] % PRIME == there
        return same

    def reach(self, i: np.ndarray, q: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """The number of words, up to ``limit``, from ``i`` on (``back``: before ``i``) that equal those ``q`` further."""
        size = np.zeros(len(i), dtype=np.int64)
        for k in range(int(limit.max()).bit_length() - 1 if len(i) else -1, -1, -1):
            longer = size + (1 << k)
            fits = np.flatnonzero(longer <= limit)
            start = i[fits] - longer[fits] if back else i[fits]
            good = fits[self.equal(start, q[fits], longer[fits])]
            size[good] = longer[good]
        return size


def _expand(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range of ``count`` numbers from ``start`` on: the range's own index, and the numbers."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def crossing_runs(ids: np.ndarray, lo, mid, hi, least: int, times: int, seed: int, width: int = 1 << 20):
    """(node, start, end, period) of the runs that cross ``mid`` within [lo, hi), as far as they go in it."""
    n = len(ids)
    grams = np.zeros(max(0, n - GRAM + 1), dtype=np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + len(grams)].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(grams, kind="stable")
    group = np.concatenate(([0], np.cumsum(np.diff(grams[order]) != 0))) if len(order) else order
    keys = group * n + order
    rank, named = np.empty_like(order), np.empty_like(order)
    rank[order], named[order] = np.arange(len(order)), group
    extensions = Extensions(ids, seed)
    found = []
    longest = (hi - lo) // times
    for right in (True, False):
        # the words after (before) the boundary come again one period further on (back)
        anchor = mid if right else mid - GRAM
        usable = np.flatnonzero((anchor + GRAM <= hi) & (anchor >= lo) & (anchor + GRAM <= n))
        a = anchor[usable]
        if right:
            begin = rank[a] + 1
            end = np.searchsorted(keys, named[a] * n + np.minimum(hi[usable] - GRAM, a + longest[usable]), side="right")
        else:
            begin = np.searchsorted(keys, named[a] * n + np.maximum(lo[usable], a - longest[usable]), side="left")
            end = rank[a]
        count = np.maximum(end - begin, 0)
        piece = np.cumsum(count) // width
        for p in np.unique(piece[count > 0]):
            some = np.flatnonzero((piece == p) & (count > 0))
            owner, places = _expand(begin[some], count[some])
            owner = some[owner]
            node, q = usable[owner], np.abs(order[places] - a[owner])
            i = mid[node] if right else mid[node] - q
            after = extensions.reach(i, q, hi[node] - q - i, False)
            before = extensions.reach(i, q, i - lo[node], True)
            good = after + before + q >= np.maximum(least, times * q)
            found.append((node[good], (i - before)[good], (i + after + q)[good], q[good]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 4


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray):
    """Intervals of one period that share a period of words or more become one; of equal intervals the least period stays."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    shift = int(end.max()) + 1
    reach = np.maximum.accumulate(end + period * shift) - period * shift  # a later period starts beyond all earlier ends
    new = np.concatenate(([True], (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[1:])))
    first = np.flatnonzero(new)
    start, end, period = start[first], np.maximum.reduceat(end, first), period[first]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    once = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))
    start, end, period = start[once], end[once], period[once]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find_runs(ids: np.ndarray, text: np.ndarray, least: int = 24, times: int = 3):
    """(start, end, period) of all maximal runs in texts laid end to end, by start, then period.

    ``ids`` of different ``text`` numbers differ. Agreement is found by hashes; every run is then compared word by word, and
    if one fails, all are sought again with other hashes.
    """
    nodes = Nodes(least)
    pair_up(ids, text, nodes)
    none = np.empty(0, dtype=np.int64)
    if not nodes.count:
        return none, none, none
    lo, mid, hi, node, place = nodes.arrays()
    first, many = np.searchsorted(node, np.arange(nodes.count)), np.bincount(node, minlength=nodes.count)
    for seed in range(100):
        own, start, end, period = crossing_runs(ids, lo, mid, hi, least, times, seed)
        if not len(own):
            return none, none, none
        run, at = _expand(first[own], many[own])
        moved = place[at] - lo[own[run]]
        start, end, period = merged(start[run] + moved, end[run] + moved, period[run])
        if all(np.array_equal(ids[s : e - q], ids[s + q : e]) for s, e, q in zip(start.tolist(), end.tolist(), period.tolist())):
            return start, end, period
    raise RuntimeError("no hashes agree with the words")


def runs_of_texts(texts: list[bytes | None], least: int = 24, times: int = 3):
    """For each text: its number of words, its runs [(start, length, period)], its kept words joined by single blanks."""
    words = [(t or b"").split() for t in texts]  # the six blanks of bytes.split are those between words
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ids, base = [], 0
    for w in words:
        names: dict[bytes, int] = {}
        ids.append(np.fromiter((names.setdefault(x, len(names)) for x in w), np.int64, len(w)) + base)
        base += len(names)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    whole = np.concatenate(ids) if ids else np.empty(0, dtype=np.int64)
    start, end, period = find_runs(whole, np.repeat(np.arange(len(words)), sizes), least, times)
    change = np.zeros(len(whole) + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    gone = np.cumsum(change[:-1]) > 0
    owner = np.searchsorted(edges, start, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(words) + 1))
    out = []
    for d, w in enumerate(words):
        a, b = bounds[d], bounds[d + 1]
        runs = list(zip((start[a:b] - edges[d]).tolist(), (end[a:b] - start[a:b]).tolist(), period[a:b].tolist()))
        if runs:
            w = [x for x, out_ in zip(w, gone[edges[d] : edges[d + 1]].tolist()) if not out_]
        out.append((len(words[d]), runs, b" ".join(w)))
    return out


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """One row per input row: id, n_words, runs, kept.

    A run is a stretch of words with smallest period q (words q apart are identical) and at least max(``least``, ``times`` * q)
    words that no neighbouring word extends; ``least`` is 24 or more, ``times`` 3 or more. ``runs`` holds (start, length,
    period) in words from 0, by start, then period. ``kept`` are the bytes of the words that no run holds after its first
    period, joined by single blanks. Null and empty texts have no words and an empty ``kept``. Bytes that are no UTF-8 are
    taken as they are. Repeated rows, null ids and other columns play no part.
    """
    if least < 24 or times < 3:
        raise ValueError("least must be 24 or more, times 3 or more")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2 << 20):
                found = runs_of_texts(part.column("text").to_pylist(), least, times)
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for _, runs, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([n for n, _, _ in found], pa.int64()), pa.array(rows, runs_type), pa.array([k for _, _, k in found], pa.binary())],
                    names=[id_col, "n_words", "runs", "kept"],
                )

    schema = f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept binary"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def repeat_tail(id_col: Column, text: Column) -> Column:
    """The text, its end made periodic if ten divides h, the crc32 of the decimal id: known runs in real text.

    With n words, g = h div 10, a = g % n and p = 1 + (n - a) div (3 + g % 8), each word i from a on becomes word
    a + (i - a) % p. Words are then joined by single blanks. Texts without words and rows without an id stay as they are.
    """
    h = F.crc32(id_col.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        return let(g % n, lambda a: let(F.floor((n - a) / (3 + g % 8)) + 1, lambda p: F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        ), " ")))

    return F.when((h % 10 == 0) & text.rlike(WORD), let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), tail)).otherwise(text)
