"""Language-model scoring by deleted interpolation.

    P(w | v) = l2[b] * c(v w) / c(v) + l1[b] * c(w) / N + l0[b] / (V + 1)        b: bucket of the context's frequency c(v)

The weights of each bucket are learned by expectation-maximisation on the counts of a deleted part of the training
documents, with estimates from the rest; the model then uses the counts of both.

Counts cover all training documents and are never held in one place. Documents are tokenised once into blocks. Each block
sends the sorted 64-bit hashes of its distinct words and word pairs, with their counts, to ranges of the hash space (a hot
word or pair is one entry a block); each range adds them up and answers every block in the same order. A block then holds
the corpus counts of all its own words and pairs, and scores its documents. Two of n distinct keys share a hash with a
probability of about n^2 / 2^64.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import cut_points, readable, release_memory, slices, stored, unzip_array, zip_array

MAIN, DELETED, UNSEEN = 0, 1, 2  # part of a document: estimates, weights, neither
END = np.uint64(xxhash.xxh64_intdigest(b""))  # no word is empty; also the context of a first word
BUCKETS = 64

_BLOCK = "block long, deleted boolean, ids array<{kind}>, parts binary, lengths binary, hashes binary, tokens binary"
_SENT = "block long, deleted boolean, range int, keys binary, main binary, held binary"
_ANSWER = "block long, deleted boolean, range int, total binary, main binary, n_main long, n_total long, v_total long"
_SCORE = "id {kind}, part int, n_tokens long, n_known long, base_score double, score double"


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes are split at the six ASCII blanks only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def pair_keys(hashes: np.ndarray) -> np.ndarray:
    """Key of each token with the one before it; even, while keys of words are odd."""
    before = np.concatenate(([END], hashes[:-1]))
    x = before * np.uint64(0x9E3779B97F4A7C15) ^ (hashes << np.uint64(31) | hashes >> np.uint64(33))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & ~np.uint64(1)


class Block:
    """Tokens of some documents: distinct word hashes, an index a token (an end after each document), part of each."""

    def __init__(self, hashes: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, parts: np.ndarray):
        self.lengths, self.parts = lengths, parts
        self.words, self.word_at = hashes | np.uint64(1), tokens
        self.pairs, self.pair_at = np.unique(pair_keys(hashes[tokens]), return_inverse=True)
        self.order = np.argsort(both := np.concatenate([self.words, self.pairs]), kind="stable")
        self.keys = both[self.order]

    def counts(self, part: int) -> np.ndarray:
        """Occurrences of each key, in key order, in documents of one part."""
        chosen = np.repeat(self.parts == part, self.lengths)
        return np.concatenate(
            [np.bincount(self.word_at[chosen], minlength=len(self.words)), np.bincount(self.pair_at[chosen], minlength=len(self.pairs))]
        )[self.order].astype(np.uint32)

    def spread(self, answer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts in key order -> for each token those of its context, of itself and of both together."""
        back = np.empty(len(answer), dtype=np.int64)
        back[self.order] = answer
        words, pairs = back[: len(self.words)], back[len(self.words) :]
        own = words[self.word_at]
        end = np.flatnonzero(self.words == END | np.uint64(1))
        return np.concatenate(([words[end[0]]], own[:-1])), own, pairs[self.pair_at]


def _tokenize(kind: pa.DataType, block_bytes: int):
    def make(ids, parts, texts, deleted):
        words: list[bytes] = []
        lengths = []
        for t in texts:
            own = tokens_of(t)
            words += own
            words.append(b"")  # the end
            lengths.append(len(own) + 1)
        coded = pa.array(words, pa.binary()).dictionary_encode()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
        tokens = coded.indices.to_numpy().astype(np.uint32)
        values = [
            pa.array([secrets.randbits(62)], pa.int64()),
            pa.array([deleted]),
            pa.array([ids], pa.list_(kind)),
            pa.array([np.array(parts, dtype=np.uint8).tobytes()], pa.binary()),
            pa.array([zip_array(np.array(lengths, dtype=np.uint32))], pa.binary()),
            pa.array([hashes.tobytes()], pa.binary()),
            pa.array([zip_array(tokens)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(values, names=["block", "deleted", "ids", "parts", "lengths", "hashes", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for piece in slices(batch, block_bytes):
                ids, parts, texts = (piece.column(c).to_pylist() for c in ("id", "part", "text"))
                for deleted in (False, True):
                    rows = [(i, p, t) for i, p, t in zip(ids, parts, texts) if (p == DELETED) == deleted]
                    if rows:
                        yield make(*zip(*rows), deleted)

    return run


def _read(columns: dict, r: int) -> Block:
    get = lambda name: columns[name][r].as_py()
    return Block(
        np.frombuffer(get("hashes"), dtype=np.uint64),
        unzip_array(get("tokens"), np.uint32),
        unzip_array(get("lengths"), np.uint32),
        np.frombuffer(get("parts"), dtype=np.uint8),
    )


def _send(ranges: int):
    def run(batches):
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for r in range(batch.num_rows):
                block = _read(columns, r)
                main, held = block.counts(MAIN), block.counts(DELETED)
                cuts = cut_points(block.keys, ranges)
                out: list[list] = [[], [], [], []]
                for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    if hi > lo:
                        steps = np.diff(block.keys[lo:hi], prepend=np.uint64(0))
                        for column, value in zip(out, (i, zip_array(steps), zip_array(main[lo:hi]), zip_array(held[lo:hi]))):
                            column.append(value)
                n = len(out[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([columns["block"][r].as_py()] * n, pa.int64()),
                        pa.array([columns["deleted"][r].as_py()] * n, pa.bool_()),
                        pa.array(out[0], pa.int32()),
                        *(pa.array(c, pa.binary()) for c in out[1:]),
                    ],
                    names=["block", "deleted", "range", "keys", "main", "held"],
                )

    return run


def zip_counts(values: np.ndarray) -> bytes:
    """Counts as bytes: one byte for the width, four or eight bytes a count before compression."""
    kind = np.uint32 if values.max(initial=0) < 2**32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + zip_array(values.astype(kind))


def unzip_counts(data: bytes) -> np.ndarray:
    return unzip_array(data[1:], np.uint32 if data[0] == 4 else np.uint64)


def _add(group: pa.Table) -> pa.Table:
    """Add up one range of keys and answer each block that sent some."""
    blocks, deleted = group.column("block").to_pylist(), group.column("deleted").to_pylist()
    keys = [np.cumsum(unzip_array(k, np.uint64), dtype=np.uint64) for k in group.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for name in ("main", "held"):
        values = np.concatenate([unzip_array(v, np.uint32) for v in group.column(name).to_pylist()])
        sums.append(np.bincount(at, weights=values, minlength=len(distinct)).astype(np.int64))
    total = sums[0] + sums[1]
    word = (distinct & np.uint64(1)).astype(bool)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    answers = [zip_counts(total[at[lo:hi]]) for lo, hi in zip(edges, edges[1:])]
    mains = [zip_counts(sums[0][at[lo:hi]]) if d else None for lo, hi, d in zip(edges, edges[1:], deleted)]
    stats = [int(sums[0][word].sum()), int(total[word].sum()), int((total[word] > 0).sum())]
    n = len(blocks)
    release_memory()
    first = lambda value: pa.array([value] + [0] * (n - 1), pa.int64())
    return pa.Table.from_arrays(
        [group.column("block"), group.column("deleted"), group.column("range"), pa.array(answers, pa.binary()), pa.array(mains, pa.binary()), *map(first, stats)],
        names=["block", "deleted", "range", "total", "main", "n_main", "n_total", "v_total"],
    )


def bucket(context: np.ndarray) -> np.ndarray:
    """Frequency bucket of a context: 0 for unseen, else one for each power of two."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def _joined(blocks: pa.Table, answers: pa.Table, column: str) -> list[tuple[Block, np.ndarray, list]]:
    """The one block of a group with its answers in key order; a list, empty if either side is missing."""
    if not blocks.num_rows or not answers.num_rows:
        return []
    order = np.argsort(answers.column("range").to_numpy())
    parts = answers.column(column).to_pylist()
    counts = np.concatenate([unzip_counts(parts[i]) for i in order])
    columns = {n: blocks.column(n) for n in blocks.schema.names}
    return [(_read(columns, 0), counts, columns["ids"][0].as_py())]


def _events(n_main: int):
    """Histogram of the deleted part: bucket and eighths of powers of two of both estimates, with their sums."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for block, counts, _ in _joined(blocks, answers, "main"):
            context, own, both = block.spread(counts)
            p2 = both / np.maximum(context, 1)
            p1 = own / max(n_main, 1)
            log = lambda p: np.where(p > 0, np.floor(8 * np.log2(np.maximum(p, 2.0**-120))), -1000).astype(np.int64)
            code = (bucket(context) * 2048 + log(p2) + 1024) * 2048 + log(p1) + 1024
            codes, at = np.unique(code, return_inverse=True)
            out.append((codes, *(np.bincount(at, weights=w, minlength=len(codes)) for w in (np.ones(len(at)), p2, p1))))
        code, n, p2, p1 = (np.concatenate([o[i] for o in out]) if out else np.empty(0) for i in range(4))
        return pa.table({"code": pa.array(code.astype(np.int64)), "n": pa.array(n), "p2": pa.array(p2), "p1": pa.array(p1)})

    return run


def learn_weights(codes, n, p2, p1, v_total: int, rounds: int = 200, tolerance: float = 1e-7) -> np.ndarray:
    """Mixture weights (order 2, 1, 0) of each bucket by EM; buckets without events take those of the next lower one."""
    out = np.tile(np.array([0.4, 0.4, 0.2]), (BUCKETS, 1))
    out[0] = (0.0, 0.8, 0.2)
    buckets = np.asarray(codes, dtype=np.int64) // (2048 * 2048)
    n, p2, p1 = (np.asarray(x, dtype=float) for x in (n, p2, p1))
    for b in range(BUCKETS):
        own = buckets == b
        if not own.any():
            if b > 1:
                out[b] = out[b - 1]
            continue
        weight = n[own]
        estimates = np.stack([p2[own] / weight, p1[own] / weight, np.full(own.sum(), 1 / (v_total + 1))])
        mix = out[b].copy()
        for _ in range(rounds):
            parts = mix[:, None] * estimates
            new = (parts / parts.sum(axis=0) * weight).sum(axis=1) / weight.sum()
            moved, mix = np.abs(new - mix).max(), new
            if moved < tolerance:
                break
        mix = np.maximum(mix, (0.0 if b == 0 else 1e-9, 1e-9, 1e-6))
        out[b] = mix / mix.sum()
    return out


def _scores(kind: pa.DataType, n_total: int, v_total: int, weights: np.ndarray):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        found = _joined(blocks, answers, "total")
        columns: list = [[], [], [], [], [], []]
        for block, counts, ids in found:
            context, own, both = block.spread(counts)
            mix = weights[bucket(context)]
            p = mix[:, 0] * both / np.maximum(context, 1) + mix[:, 1] * own / max(n_total, 1) + mix[:, 2] / (v_total + 1)
            base = np.log10((own + 0.1) / (n_total + 0.1 * (v_total + 1)))
            starts = np.concatenate(([0], np.cumsum(block.lengths)[:-1])).astype(np.int64)
            columns = [
                ids,
                block.parts.astype(np.int32),
                block.lengths.astype(np.int64),
                np.add.reduceat((own > 0).astype(np.int64), starts),
                np.add.reduceat(base, starts),
                np.add.reduceat(np.log10(p), starts),
            ]
        kinds = (kind, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ["id", "part", "n_tokens", "n_known", "base_score", "score"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def interpolated_scores(
    docs: DataFrame,
    part: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 5 << 20,
    range_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per input row: id, part, n_tokens, n_known, train_tokens, base_score, score.

    ``part`` says for each document whether it gives estimates (0), weights (1; it joins the estimates of the final model)
    or nothing (2, also for null). ``score`` is the log10 probability of the text with its end, ``base_score`` that of an
    add-one-tenth unigram model, ``n_known`` the tokens that training has seen, ``train_tokens`` all tokens of training.
    A null text is empty: its end alone is scored. Repeated rows are counted and returned as often as they occur. With no
    training document all tokens are unknown. Other columns are ignored. An empty table gives an empty result.

    A block holds about ``block_bytes`` of text (one document at least); there is a hash range for each ``range_bytes``.
    """
    kind = docs.select(id_col).schema[0].dataType
    arrow = docs.sparkSession.createDataFrame([], f"id {kind.simpleString()}").toArrow().schema.field("id").type
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(part, F.lit(UNSEEN)).cast("int").alias("part"), readable(text_col).alias("text"))
    blocks = stored(rows.mapInArrow(_tokenize(arrow, block_bytes), _BLOCK.format(kind=kind.simpleString())), "lm-blocks")
    total_bytes = blocks.agg(F.sum(F.octet_length("hashes") + F.octet_length("tokens"))).first()[0] or 0
    ranges = max(8, -(-3 * total_bytes // range_bytes))
    sent = blocks.select("block", "deleted", "parts", "lengths", "hashes", "tokens").mapInArrow(_send(ranges), _SENT)
    answers = stored(sent.repartition(ranges, "range").groupBy("range").applyInArrow(_add, _ANSWER), "lm-counts")
    n_main, n_total, v_total = (int(x or 0) for x in answers.agg(F.sum("n_main"), F.sum("n_total"), F.sum("v_total")).first())
    tasks = max(8, -(-total_bytes // (32 << 20)))

    def meet(left: DataFrame, right: DataFrame, run, schema: str) -> DataFrame:
        keyed = [x.repartition(tasks, "block").groupBy("block") for x in (left, right)]
        return keyed[0].cogroup(keyed[1]).applyInArrow(run, schema)

    held = answers.filter("deleted").select("block", "range", "main")
    events = meet(blocks.filter("deleted"), held, _events(n_main), "code long, n double, p2 double, p1 double")
    histogram = events.groupBy("code").agg(F.sum("n"), F.sum("p2"), F.sum("p1")).orderBy("code").collect()  # bounded by its bins
    weights = learn_weights(*([list(x) for x in zip(*histogram)] or [[], [], [], []]), v_total)
    scored = meet(blocks, answers.select("block", "range", "total"), _scores(arrow, n_total, v_total, weights), _SCORE.format(kind=kind.simpleString()))
    return scored.select(
        F.col("id").alias(id_col), "part", "n_tokens", "n_known", F.lit(n_total).cast("long").alias("train_tokens"), "base_score", "score"
    )
