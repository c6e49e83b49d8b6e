"""Removal of repeated passages with suffix arrays, built by the difference-cover algorithm.

A byte goes if it lies in a string of ``width`` bytes that also starts in a document with a smaller id. Equal strings have
the same minimizer (the least hash among their ``mer``-byte pieces), so the suffixes are dealt to ranges of the minimizers'
hash space and each range sorts its own:

1. Blocks of documents send their minimizers; a range answers which of them occur in more than one document. Strings whose
   minimizer occurs in one document only cannot repeat and are done with.
2. Runs of the other strings that share a minimizer are sent to its range, equal runs of a block once, with the smallest
   document that has them. A block sends one row to a range, however many parts the range is sorted in. A part keeps the
   strings whose hash occurs again among its distinct runs, as no other can have an equal there, joins them to one text and
   sorts the suffixes: sampled triples at positions 1 and 2 modulo 3 get names, the string of names is sorted by recursion,
   the remaining suffixes are merged in. Adjacent suffixes are compared on their first ``width`` bytes; each group of equals
   has the smallest document of its members.
3. The range answers, a bit a string, whether a smaller document than the sender's has it; blocks cut their documents.

The recursion ends where names cover ``width`` bytes, as nothing longer is compared. A passage that very many documents
share is one run a block. At its edge each document has its own neighbours: the runs of a minimizer with very many different
ones are sent as single strings, each to the range of its own hash, so equal strings still meet.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import cut_points, readable, release_memory, slices, stored, unzip_array, zip_array

NO_ID = 2**63 - 1  # a null id is larger than all others


# Suffix sorting


def _pack(*columns: tuple[np.ndarray, int]) -> np.ndarray:
    """Columns (values, exclusive bound) as one order-preserving integer key; renamed on the way where 63 bits do not do."""
    key, bound = columns[0]
    for values, size in columns[1:]:
        if bound * size >= 2**63:
            distinct, key = np.unique(key, return_inverse=True)
            bound = len(distinct)
        key, bound = key.astype(np.int64) * size + values, bound * size
    return key


def _names(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense order-preserving names from 1 up, and their number."""
    if len(key) and key.max() < 1 << 24:
        seen = np.zeros(int(key.max()) + 1, dtype=np.int32)
        seen[key] = 1
        return np.cumsum(seen, dtype=np.int32)[key].astype(np.int64), int(seen.sum())
    distinct, at = np.unique(key, return_inverse=True)
    return at + 1, len(distinct)


def suffix_ranks(text: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Ranks of all suffixes of an integer string over 0 .. size - 1 by their first ``depth`` symbols or more.

    A suffix's rank is the number of suffixes that are less; the order of ranks never contradicts the order of the first
    ``depth`` symbols. The string should end in ``2 * depth`` zeros or more.
    """
    n = len(text)
    if n < 9:
        tails = [tuple(text[i : i + depth]) for i in range(n)]
        return np.array([sum(t < own for t in tails) for own in tails], dtype=np.int64)
    s = np.concatenate([text.astype(np.int64), np.zeros(3, dtype=np.int64)])
    first, second = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([first, second])
    names, count = _names(_pack((s[sample], size), (s[sample + 1], size), (s[sample + 2], size)))
    rank = np.zeros(n + 3, dtype=np.int64)
    if count < len(sample) and depth > 3:
        rank[sample] = suffix_ranks(names, count + 1, -(-depth // 3)) + 1
    else:
        rank[sample] = names
    top = int(rank.max()) + 1
    rest = np.arange(0, n, 3)

    def keys(i, j, ahead):
        """Keys of remaining and of sampled suffixes, comparable with each other: symbols, then a sampled rank."""
        both = np.concatenate([i, j])
        columns = [(s[both + a], size) for a in range(ahead)] + [(rank[both + ahead], top)]
        packed = _pack(*columns)
        return packed[: len(i)], packed[len(i) :]

    rest_one, first_one = keys(rest, first, 1)
    rest_two, second_two = keys(rest, second, 2)
    own, under_first, over_first = _less(rest_one, first_one)
    _, under_second, over_second = _less(rest_two, second_two)
    below = np.concatenate(([0], np.cumsum(np.bincount(rank[sample], minlength=top))))
    out = np.empty(n, dtype=np.int64)
    out[rest] = own + under_first + under_second
    out[first] = below[rank[first]] + over_first
    out[second] = below[rank[second]] + over_second
    return out


def _less(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``a`` how many of ``a`` and of ``b`` are less, and for each of ``b`` how many of ``a``."""
    order_a, order_b = np.argsort(a), np.argsort(b)
    sorted_a, sorted_b = a[order_a], b[order_b]
    out = []
    for order, values, among in ((order_a, sorted_a, sorted_a), (order_a, sorted_a, sorted_b), (order_b, sorted_b, sorted_a)):
        counts = np.empty(len(values), dtype=np.int64)
        counts[order] = np.searchsorted(among, values)
        out.append(counts)
    return tuple(out)


def least_owner(runs: list[bytes], owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every string of ``width`` bytes in the runs, in order, the least owner of a run that has it.

    Returns them and where each run's begin (one more than runs). A string whose hash no other string has is its run's own;
    the others are sorted, equal stretches of them once.
    """
    text = b"".join(runs)
    at, begins = _places(runs, width)
    out = np.repeat(owners, np.diff(begins))
    again = _again(_hashes(np.frombuffer(text, dtype=np.uint8), width)[at])
    # stretches of such strings that do not cross runs
    edge = np.zeros(len(again) + 1, dtype=bool)
    edge[begins] = True
    here, before = np.append(again, False), np.append(False, again)
    first, last = np.flatnonzero(here & (edge | ~before)), np.flatnonzero(before & (edge | ~here))
    number: dict[bytes, int] = {}
    spans = zip(at[first].tolist(), (at[last - 1] + width).tolist())
    stretch = np.array([number.setdefault(text[lo:hi], len(number)) for lo, hi in spans], dtype=np.int64)
    if number:
        least = np.full(len(number), NO_ID, dtype=np.int64)
        np.minimum.at(least, stretch, out[first])
        found, places = _sorted_owner(list(number), least, width)
        n = last - first
        out[again] = found[np.repeat(places[stretch] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return out, begins


def _places(runs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each string begins in the joined runs, and the number of strings before each run and in all."""
    sizes = np.array([len(r) for r in runs], dtype=np.int64)
    counts = sizes - width + 1
    begins = np.concatenate(([0], np.cumsum(counts)))
    return np.arange(begins[-1]) + np.repeat(np.cumsum(sizes) - sizes - begins[:-1], counts), begins


def _again(hashes: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(hashes)
    values = hashes[order]
    same = values[1:] == values[:-1]
    out = np.zeros(len(hashes), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _sorted_owner(runs: list[bytes], owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``least_owner`` by sorting the suffixes of all runs."""
    text = np.frombuffer(b"".join(runs) + b"\0" * (3 * width + 3), dtype=np.uint8)
    at, begins = _places(runs, width)
    used = np.bincount(text, minlength=256) > 0
    dense = np.cumsum(used)[text]  # bytes that occur, numbered in order from 1
    rank = suffix_ranks(dense, int(used.sum()) + 1, width)[at]
    order = np.argsort(rank, kind="stable")
    # adjacent prefixes: equal or not, in slices of bounded size
    fresh = np.ones(len(order), dtype=bool)
    steps = np.arange(width)
    for lo in range(1, len(order), 1 << 17):
        hi = min(len(order), lo + (1 << 17))
        window = text[at[order[lo - 1 : hi]][:, None] + steps]
        fresh[lo:hi] = (window[1:] != window[:-1]).any(axis=1)
    least = np.minimum.reduceat(np.repeat(owners, np.diff(begins))[order], np.flatnonzero(fresh))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = least[np.cumsum(fresh) - 1]
    return out, begins


# Hashes of pieces

_TABLE = np.random.default_rng(20).integers(0, 2**64, size=256, dtype=np.uint64)
_STEP = 1 << 15  # bytes that stay in the cache


def _hash(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position, from those of halves."""
    power, length = _TABLE[data], 1
    out, done = None, 0
    left = size
    factor = 0x9E3779B97F4A7C15
    while left:
        if left & 1:
            part = power[done : done + len(data) - size + 1]
            out = part.copy() if out is None else out * np.uint64(0xD6E8FEB86659FD93) + part
            done += length
        left >>= 1
        if left:
            ahead = power[length:]
            power = power[:-length] * np.uint64(factor) + (ahead ^ (ahead >> np.uint64(29)))
            factor = factor * 0xBF58476D1CE4E5B9 % 2**64 | 1
            length *= 2
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """``_hash`` step by step."""
    out = np.empty(max(0, len(data) - size + 1), dtype=np.uint64)
    for lo in range(0, len(out), _STEP):
        out[lo : lo + _STEP] = _hash(data[lo : min(lo + _STEP, len(out)) + size - 1], size)
    return out


# Blocks of documents


class Block:
    """Texts of some documents, one after the other, and the runs of their strings that share a minimizer.

    A run is (first string, last + 1, key); a key is the minimizer's hash, spread over the key space.
    """

    def __init__(self, text: bytes, lengths: np.ndarray, docs: np.ndarray, width: int, mer: int):
        self.text, self.lengths, self.docs, self.width, self.mer = text, lengths, docs, width, mer
        self.starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(text, dtype=np.uint8)
        n = max(0, len(data) - width + 1)
        least = np.empty(n, dtype=np.uint64)
        for lo in range(0, n, _STEP):
            part = data[lo : min(lo + _STEP, n) + width - 1]
            least[lo : lo + _STEP] = self._sliding(_hash(part, mer), width - mer + 1)
        # strings that begin in a document and end in another one do not count
        inside = np.ones(n + 1, dtype=bool)
        for start, length in zip(self.starts.tolist(), lengths.tolist()):
            inside[max(0, start + max(0, length - width + 1)) : start + length] = False
        new = np.ones(n + 1, dtype=bool)
        new[1:n] = least[1:] != least[:-1]
        new[np.minimum(self.starts, n)] = True
        new[n] = True
        edges = np.flatnonzero(new | ~inside)
        begins, ends = edges[:-1], edges[1:]
        good = inside[begins]
        self.begins, self.ends = begins[good], ends[good]
        x = least[self.begins]
        # least hashes crowd near zero; an odd factor spreads them over the key space, one to one
        self.keys = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        self.run_docs = docs[np.searchsorted(self.starts, self.begins, side="right") - 1]

    @staticmethod
    def _sliding(values: np.ndarray, width: int) -> np.ndarray:
        """Least of each ``width`` neighbours."""
        size = 1
        while 2 * size <= width:
            values = np.minimum(values[:-size], values[size:])
            size *= 2
        return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values

    def minimizers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, whether more than one document of the block has each, and in how many different runs.

        Runs are told apart by length, first and last eight bytes; the number only decides how the runs are dealt.
        """
        order, at = self._sorted()
        docs = self.run_docs[order]
        if not len(at):
            return self.keys, np.empty(0, dtype=bool), np.empty(0, dtype=np.uint32)
        data, eight = np.frombuffer(self.text, dtype=np.uint8), np.arange(8)
        kinds = np.zeros(len(order), dtype=np.uint64)
        counts = np.diff(np.append(at, len(order)))
        group = np.repeat(np.arange(len(at)), counts)
        several = np.flatnonzero(np.repeat(counts > 1, counts))
        begins, ends = self.begins[order[several]], self.ends[order[several]]
        for places in (begins, ends + self.width - 9):
            kinds[several] = (kinds[several] ^ data[np.clip(places[:, None] + eight, 0, len(data) - 1)].view(np.uint64)[:, 0]) * np.uint64(0x9E3779B97F4A7C15)
        kinds[several] += (ends - begins).astype(np.uint64)
        by = several[np.lexsort((kinds[several], group[several]))]
        again = by[1:][(group[by[1:]] == group[by[:-1]]) & (kinds[by[1:]] == kinds[by[:-1]])]
        runs = (counts - np.bincount(group[again], minlength=len(at))).astype(np.uint32)
        return self.keys[order[at]], np.minimum.reduceat(docs, at) != np.maximum.reduceat(docs, at), runs

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """The runs in key order, and where each distinct key begins there."""
        order = np.argsort(self.keys, kind="stable")
        values = self.keys[order]
        return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1])))

    def dealt(self, repeated: np.ndarray, hot: np.ndarray, ranges: int) -> Dealt:
        """Distinct runs whose minimizer occurs in several documents, by range.

        Runs of a hot minimizer are taken apart: each string goes to the range of its own hash.
        """
        order, at = self._sorted()
        counts = np.diff(np.append(at, len(order)))
        known = np.sort(order[np.repeat(repeated, counts)])
        apart = np.zeros(len(order), dtype=bool)
        apart[order] = np.repeat(hot, counts)
        n = np.where(apart[known], self.ends[known] - self.begins[known], 1)
        known, inside = np.repeat(known, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        apart = apart[known]
        begins = self.begins[known] + inside
        ends = np.where(apart, begins + 1, self.ends[known])
        keys = self.keys[known]
        single = (xxhash.xxh64_intdigest(self.text[lo : lo + self.width]) for lo in begins[apart].tolist())
        keys[apart] = np.fromiter(single, dtype=np.uint64, count=int(apart.sum()))
        part = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        part, begins, ends, docs = part[order].astype(np.int64), begins[order], ends[order], self.run_docs[known[order]]
        number: dict[bytes, int] = {}
        text, more = self.text, self.width - 1
        runs = np.array(
            [number.setdefault(text[lo:hi], len(number)) for lo, hi in zip(begins.tolist(), (ends + more).tolist())], dtype=np.int64
        )
        least = np.full(len(number), NO_ID, dtype=np.int64)
        np.minimum.at(least, runs, docs)
        first = np.unique(runs, return_index=True)[1] if len(runs) else runs
        return Dealt(list(number), part[first], least, ends[first] - begins[first], runs, begins, docs)


@dataclass
class Dealt:
    texts: list[bytes]  # distinct runs, those of a range together
    ranges: np.ndarray  # range of each
    least: np.ndarray  # least document of the block that has it
    strings: np.ndarray  # strings in it
    run: np.ndarray  # run of each place
    begins: np.ndarray  # first string of each place
    docs: np.ndarray  # document of each place


_BLOCK = ["block", "carried", "size", "docs", "lengths", "text"]


def _make_blocks(kind: pa.DataType, block_bytes: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, block_bytes):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                docs = [NO_ID if d is None else d for d in part.column("doc").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([secrets.randbits(62)], pa.int64()),
                        pa.array([part.column("carried").to_pylist()], pa.list_(kind)),
                        pa.array([sum(map(len, texts))], pa.int64()),
                        pa.array([np.array(docs, dtype=np.int64).tobytes()], pa.binary()),
                        pa.array([np.array([len(t) for t in texts], dtype=np.int64).tobytes()], pa.binary()),
                        pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(texts))], pa.binary()),
                    ],
                    names=_BLOCK,
                )

    return run


def _read(columns, r: int, width: int, mer: int) -> Block:
    get = lambda name: columns[name][r].as_py()
    text = zstandard.ZstdDecompressor().decompress(get("text"))
    return Block(text, np.frombuffer(get("lengths"), np.int64), np.frombuffer(get("docs"), np.int64), width, mer)


def _send_minimizers(ranges: int, width: int, mer: int):
    def run(batches):
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for r in range(batch.num_rows):
                keys, many, runs = _read(columns, r, width, mer).minimizers()
                cuts = cut_points(keys, ranges)
                rows = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([columns["block"][r].as_py()] * len(rows), pa.int64()),
                        pa.array([i for i, _, _ in rows], pa.int32()),
                        pa.array([zip_array(np.diff(keys[lo:hi], prepend=np.uint64(0))) for _, lo, hi in rows], pa.binary()),
                        pa.array([np.packbits(many[lo:hi]).tobytes() for _, lo, hi in rows], pa.binary()),
                        pa.array([zip_array(runs[lo:hi]) for _, lo, hi in rows], pa.binary()),
                    ],
                    names=["block", "range", "keys", "many", "runs"],
                )

    return run


def _repeated(most_runs: int):
    def run(group: pa.Table) -> pa.Table:
        """Which minimizers of one range occur in more than one document, and in very many runs, for each block that sent some."""
        keys = [np.cumsum(unzip_array(k, np.uint64), dtype=np.uint64) for k in group.column("keys").to_pylist()]
        sizes, keys = [len(k) for k in keys], np.concatenate(keys)
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(group.column("many").to_pylist(), sizes)])
        order = np.argsort(keys)
        keys = keys[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        del keys
        n = np.diff(np.append(at, len(order)))
        answer = np.empty((len(order), 2), dtype=bool)  # two bits a minimizer
        answer[order, 0] = np.repeat((n > 1) | (np.maximum.reduceat(many[order], at) > 0), n)
        runs = np.concatenate([unzip_array(r, np.uint32) for r in group.column("runs").to_pylist()])
        answer[order, 1] = np.repeat(np.add.reduceat(runs[order], at, dtype=np.int64) > most_runs, n)
        answer = answer.reshape(-1)
        edges = 2 * np.cumsum([0, *sizes])
        bits = [np.packbits(answer[lo:hi]).tobytes() for lo, hi in zip(edges, edges[1:])]
        del answer, at, many, n, order, runs
        release_memory()
        return pa.Table.from_arrays(
            [group.column("block"), group.column("range"), pa.array(np.diff(edges)), pa.array(bits, pa.binary())], names=["block", "range", "n", "bits"]
        )

    return run


def _bits(answers: pa.Table) -> np.ndarray:
    """Answers of all ranges in range order as one array of booleans."""
    order = np.argsort(answers.column("range").to_numpy())
    bits, n = answers.column("bits").to_pylist(), answers.column("n").to_pylist()
    parts = [np.unpackbits(np.frombuffer(bits[i], np.uint8), count=n[i]) for i in order]
    return np.concatenate(parts).astype(bool) if parts else np.empty(0, dtype=bool)


def _send_runs(ranges: int, parts: int, width: int, mer: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if blocks.num_rows and answers.num_rows:
            block = _read({n: blocks.column(n) for n in blocks.schema.names}, 0, width, mer)
            number = blocks.column("block")[0].as_py()
            dealt = block.dealt(*_bits(answers).reshape(-1, 2).T, ranges * parts)
            own = dealt.ranges // parts
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(dealt.texts)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    body = zstandard.ZstdCompressor(level=1).compress(b"".join(dealt.texts[lo:hi]))
                    sizes = (dealt.strings[lo:hi] + width - 1).astype(np.uint32)
                    counts = np.bincount(dealt.ranges[lo:hi] - own[lo] * parts, minlength=parts).astype(np.uint32)
                    rows.append((number, int(own[lo]), body, zip_array(sizes), zip_array(dealt.least[lo:hi]), counts.tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        names = ["block", "range", "text", "sizes", "docs", "counts"]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def _judge(parts: int, width: int):
    def run(group: pa.Table) -> pa.Table:
        """Sort the suffixes of one range, part by part; tell each block which strings a smaller document than the sender's has."""
        sent = [unzip_array(s, np.uint32) for s in group.column("sizes").to_pylist()]
        docs = np.concatenate([unzip_array(d, np.int64) for d in group.column("docs").to_pylist()])
        part = np.concatenate([np.repeat(np.arange(parts), np.frombuffer(c, np.uint32)) for c in group.column("counts").to_pylist()])
        sizes = np.concatenate(sent).astype(np.int64)
        text, end = memoryview(bytearray(int(sizes.sum()))), 0
        for body in group.column("text"):
            body = zstandard.ZstdDecompressor().decompress(body.as_py())
            text[end : end + len(body)] = body
            end += len(body)
        begins, strings = np.cumsum(sizes) - sizes, sizes - width + 1
        answers = np.cumsum(strings) - strings  # where those for each run begin
        later = np.empty(int(strings.sum()), dtype=bool)
        order = np.argsort(part, kind="stable")
        for runs in np.split(order, np.cumsum(np.bincount(part, minlength=parts))[:-1]):
            number: dict[bytes, int] = {}
            spans = zip(begins[runs].tolist(), (begins[runs] + sizes[runs]).tolist())
            place = np.array([number.setdefault(bytes(text[lo:hi]), len(number)) for lo, hi in spans], dtype=np.int64)
            owners = np.full(len(number), NO_ID, dtype=np.int64)
            np.minimum.at(owners, place, docs[runs])
            least, at = least_owner(list(number), owners, width)
            n = strings[runs]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            later[np.repeat(answers[runs], n) + inside] = least[np.repeat(at[place], n) + inside] < np.repeat(docs[runs], n)
        edges = np.append(answers, len(later))[np.cumsum([0, *map(len, sent)])]
        bits = [np.packbits(later[lo:hi]).tobytes() for lo, hi in zip(edges, edges[1:])]
        release_memory()
        return pa.Table.from_arrays(
            [group.column("block"), group.column("range"), pa.array(np.diff(edges)), pa.array(bits, pa.binary())], names=["block", "range", "n", "bits"]
        )

    return run


def _cut(kind: pa.DataType, ranges: int, width: int, mer: int, whole_chars: bool):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        """Bytes to remove from each document, and what is left of it."""
        columns: list = [[], [], [], []]
        if blocks.num_rows:
            block = _read({n: blocks.column(n) for n in blocks.schema.names}, 0, width, mer)
            change = np.zeros(len(block.text) + 1, dtype=np.int32)
            first = answers.filter(pa.compute.equal(answers.column("step"), 1))
            if first.num_rows:
                judged = _bits(answers.filter(pa.compute.equal(answers.column("step"), 2)))
                dealt = block.dealt(*_bits(first).reshape(-1, 2).T, ranges)
                bits = np.cumsum(dealt.strings) - dealt.strings  # where the answers for each run begin
                n = dealt.strings[dealt.run]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                # the block's least document with a run has it before the others do; for itself the range has judged
                later = np.repeat(dealt.docs > dealt.least[dealt.run], n)
                gone = (np.repeat(dealt.begins, n) + inside)[later | judged[np.repeat(bits[dealt.run], n) + inside]]
                change += np.bincount(gone, minlength=len(change)).astype(np.int32)
                change -= np.bincount(gone + width, minlength=len(change)).astype(np.int32)
            covered = np.cumsum(change[:-1]) > 0
            carried = blocks.column("carried")[0].as_py()
            data = np.frombuffer(block.text, dtype=np.uint8)
            if whole_chars and len(data):
                begin = (data & 0xC0) != 0x80
                covered = np.logical_or.reduceat(covered, np.flatnonzero(begin))[np.cumsum(begin) - 1]
            for lo, n in zip(block.starts.tolist(), block.lengths.tolist()):
                own = covered[lo : lo + n]
                edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8))).reshape(-1, 2)
                columns[1].append(n)
                columns[2].append([{"start": a, "end": b} for a, b in edges.tolist()])
                columns[3].append(data[lo : lo + n][~own].tobytes())
            columns[0] = carried
            release_memory()
        kinds = (kind, pa.int64(), pa.list_(span), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["carried", "n_bytes", "removed", "kept"])

    return run


def remove_repeats(
    docs: DataFrame,
    *,
    carry: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 50,
    mer: int = 20,
    whole_chars: bool = False,
    block_bytes: int = 2 << 20,
    range_bytes: int = 1 << 20,
    task_bytes: int = 16 << 20,
    most_runs: int = 20_000,
) -> DataFrame:
    """(carried, n_bytes, removed, kept), one row per input row.

    ``removed`` lists the maximal runs of removed bytes (start, end), ``kept`` is the text's other bytes. Texts are taken as
    UTF-8 bytes and strings never cross documents; what is removed is judged on the input. ``whole_chars`` also removes the
    rest of a character that is cut in part, so that ``kept`` is UTF-8 again. ``carry`` is what goes along (the
    id by default; a struct of the whole row, for instance). Ids are integers; a null id counts as larger than all others,
    and rows with equal ids take nothing from each other. Null texts are empty and, like texts under ``width`` bytes, stay as
    they are. Other columns are ignored. An empty table gives an empty result.

    A block sends its runs to ranges of about ``task_bytes``, a task each, that are sorted in parts of about ``range_bytes``: the
    rows sent are blocks times ranges, so ranges are large, and what is sorted at once is small.

    Runs of a minimizer with more than ``most_runs`` different ones are dealt out string by string.
    Two different strings that a hash takes for one cannot do harm: hashes only deal out the work.
    """
    spark = docs.sparkSession
    rows = docs.select(
        (F.col(id_col) if carry is None else carry).alias("carried"), F.col(id_col).cast("long").alias("doc"), readable(text_col).alias("text")
    )
    kind = rows.schema["carried"].dataType
    arrow = spark.createDataFrame([], T.StructType([rows.schema["carried"]])).toArrow().schema.field(0).type
    schema = T.StructType().add("block", T.LongType()).add("carried", T.ArrayType(kind)).add("size", T.LongType())
    for name in _BLOCK[3:]:
        schema = schema.add(name, T.BinaryType())
    blocks = stored(rows.mapInArrow(_make_blocks(arrow, block_bytes), schema), "repeat-blocks")
    packed, whole = (n or 0 for n in blocks.agg(F.sum(F.octet_length("text")), F.sum("size")).first())
    total = max(packed, whole // 4)  # what a task holds is unpacked
    ranges = max(8, total // task_bytes)
    parts = max(1, total // range_bytes // ranges)
    coarse = max(8, total // (32 << 20))
    tasks = max(8, total // (8 << 20))
    texts = blocks.drop("carried")

    def meet(left: DataFrame, right: DataFrame, run, out) -> DataFrame:
        keyed = [x.repartition(tasks, "block").groupBy("block") for x in (left, right)]
        return keyed[0].cogroup(keyed[1]).applyInArrow(run, out)

    answer = "block long, range int, n long, bits binary"
    sent = texts.mapInArrow(_send_minimizers(coarse, width, mer), "block long, range int, keys binary, many binary, runs binary")
    repeated = stored(sent.repartitionById(coarse, "range").groupBy("range").applyInArrow(_repeated(most_runs), answer), "repeat-minimizers")
    runs = meet(texts, repeated, _send_runs(ranges, parts, width, mer), "block long, range int, text binary, sizes binary, docs binary, counts binary")
    judged = stored(runs.repartitionById(ranges, "range").groupBy("range").applyInArrow(_judge(parts, width), answer), "repeat-judged")
    answers = repeated.withColumn("step", F.lit(1)).unionByName(judged.withColumn("step", F.lit(2)))
    out = T.StructType([rows.schema["carried"], T.StructField("n_bytes", T.LongType())])
    span = T.StructType().add("start", T.LongType()).add("end", T.LongType())
    return meet(blocks, answers, _cut(arrow, ranges * parts, width, mer, whole_chars), out.add("removed", T.ArrayType(span)).add("kept", T.BinaryType()))
