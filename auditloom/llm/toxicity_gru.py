"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word goes in as a learned vector (for words of the training vocabulary) beside the mean of learned vectors of its
character trigrams, so spellings that were never seen still say something. Two gated recurrent layers read a window of words
in both directions, attention pools their states to one vector, and that gives the window's logit. A text is covered by
overlapping windows, all of them scored, and its score is the calibrated logit of its worst window.

Labels are of documents, not of windows: training treats a document as toxic if at least one of its windows is (noisy or),
and between epochs gives each window of a toxic document the probability of being one of those.

What is fitted is bounded: ``sample_rows`` labelled documents and ``sample_windows`` windows a label, ``vocabulary`` words.
Scoring runs over all rows, whole texts, in Arrow batches, without any shuffle; projections are computed once per distinct
word of a batch, so a step of the recurrence is one lookup and one small product.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import first_by_hash, slices, stored

EDGES = b".,;:!?\"'()[]{}<>*_-"
BUCKETS = 1 << 13  # of hashed trigrams


@dataclass
class Network:
    """Sizes and parameters; ``vocabulary`` maps words to rows of ``words`` (row 0: any other word)."""

    vocabulary: dict[bytes, int]
    word_size: int = 12
    char_size: int = 12
    hidden: int = 16
    window: int = 32
    stride: int = 24
    slope: float = 1.0  # calibration of the largest logit
    offset: float = 0.0
    constant: float | None = None  # the score of all texts, if there is nothing to learn from
    empty: float = 0.5  # score of a text without words
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        d, h = self.word_size + self.char_size, self.hidden

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "words": normal(len(self.vocabulary) + 1, self.word_size, scale=0.1),
            "chars": normal(BUCKETS, self.char_size, scale=0.3),
            "attend": normal(2 * h, h, scale=(2 * h) ** -0.5),
            "attend_b": np.zeros(h, np.float32),
            "pick": normal(h, scale=h**-0.5),
            "out": normal(2 * h, scale=(2 * h) ** -0.5),
            "out_b": np.zeros(1, np.float32),
        }
        for way in ("f", "b"):
            self.p[f"in_{way}"] = normal(d, 3 * h, scale=d**-0.5)
            self.p[f"in_b_{way}"] = np.zeros(3 * h, np.float32)
            self.p[f"turn_{way}"] = normal(h, 3 * h, scale=h**-0.5)


def tokens(text: bytes) -> list[bytes]:
    """The words between blanks, A-Z lower-cased, with their punctuation."""
    return text.lower().split()


def windows_of(n: int, window: int, stride: int) -> np.ndarray:
    """Starts of the overlapping windows over ``n`` words: every ``stride`` words, and one that ends with the text."""
    if n <= window:
        return np.zeros(min(n, 1), dtype=np.int64)
    starts = np.arange(0, n - window, stride)
    return np.append(starts, n - window)


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all marked words end to end, and where each word's begin (each word has one at least)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"\x02" + b"\x03\x02".join(words) + b"\x03", np.uint8).astype(np.uint64)
    mixed = (flat[:-2] * np.uint64(0x9E3779B1) + flat[1:-1] * np.uint64(0x85EBCA77) + flat[2:] * np.uint64(0xC2B2AE3D)) if len(flat) > 2 else flat[:1]
    mixed ^= mixed >> np.uint64(15)
    hashed = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)).astype(np.int64)
    # the word's trigrams begin at its mark; the two that reach into the next word are left out
    begin = np.concatenate(([0], np.cumsum(sizes + 2)[:-1])).astype(np.int64)
    many = np.maximum(sizes, 1)
    first = (np.cumsum(many) - many).astype(np.int64)
    where = np.repeat(begin - first, many) + np.arange(int(many.sum()))
    return hashed[np.minimum(where, len(hashed) - 1)], first


def inputs(net: Network, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary rows, trigrams and their starts for distinct words as they stand in the texts."""
    bare = [w.strip(EDGES) or w for w in raw]
    rows = np.fromiter((net.vocabulary.get(w, 0) for w in bare), np.int64, len(bare))
    return rows, *trigrams(bare)


def char_means(net: Network, grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    many = np.diff(np.append(begin, len(grams)))
    return np.add.reduceat(net.p["chars"].take(grams, axis=0), begin, axis=0) / many[:, None].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def _sums(rows: np.ndarray, place: np.ndarray, count: int) -> np.ndarray:
    """Sums of the rows with the same place, 0 where there is none."""
    out = np.zeros((count, rows.shape[1]), rows.dtype)
    order = np.argsort(place, kind="stable")
    sorted_ = place[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    out[sorted_[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def recur(net: Network, way: str, project: np.ndarray, index: np.ndarray, size: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (step, window, hidden) of one direction; ``project`` are input products by word, ``index`` (window, step).

    Windows of fewer words (``size``) keep their state over the missing ones. ``keep`` collects what training needs.
    """
    turn, h = net.p[f"turn_{way}"], net.hidden
    n, steps = index.shape
    short = bool((size < steps).any())
    states = np.empty((steps, n, h), np.float32)
    state = np.zeros((n, h), np.float32)
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        x, s = project.take(index[:, t], axis=0), state @ turn
        gates = _sigmoid(x[:, : 2 * h] + s[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = r * s[:, 2 * h :]
        new += x[:, 2 * h :]
        np.tanh(new, out=new)
        after = state - new
        after *= z
        after += new
        if short:
            after = np.where((t < size)[:, None], after, state)
        if keep is not None:
            keep.append((t, state, z, r, new, s[:, 2 * h :]))
        state = states[t] = after
    return states


def pool(net: Network, states: np.ndarray, size: np.ndarray):
    """Attention over the steps of (step, window, 2 * hidden): logits, and what training needs."""
    steps, n, width = states.shape
    lean = np.tanh(states.reshape(-1, width) @ net.p["attend"] + net.p["attend_b"])
    weight = (lean @ net.p["pick"]).reshape(steps, n)
    weight = np.where(np.arange(steps)[:, None] < size, weight, np.float32(-1e9))
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnw->nw", weight, states)
    return pooled @ net.p["out"] + net.p["out_b"][0], lean, weight, pooled


def projections(net: Network, rows: np.ndarray, grams: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word inputs, and their products for both directions."""
    x = np.concatenate([net.p["words"][rows], char_means(net, grams, begin)], axis=1)
    return x, x @ net.p["in_f"] + net.p["in_b_f"], x @ net.p["in_b"] + net.p["in_b_b"]


def logits(net: Network, forward: np.ndarray, backward: np.ndarray, index: np.ndarray, size: np.ndarray, width: int = 512) -> np.ndarray:
    out = np.empty(len(index), np.float32)
    for at in range(0, len(index), width):
        some, n = index[at : at + width], size[at : at + width]
        both = np.concatenate([recur(net, "f", forward, some, n), recur(net, "b", backward, some, n)], axis=2)
        out[at : at + width] = pool(net, both, n)[0]
    return out


def worst_logits(net: Network, texts: list[bytes | None]) -> np.ndarray:
    """The largest logit over all windows of each text; NaN for texts without words."""
    names: dict[bytes, int] = defaultdict(count().__next__)
    flat, sizes = [], []
    for text in texts:
        words = tokens(text or b"")
        sizes.append(len(words))
        flat.append(np.fromiter(map(names.__getitem__, words), np.int32, len(words)))
    out = np.full(len(texts), np.nan)
    if not names:
        return out
    _, forward, backward = projections(net, *inputs(net, list(names)))
    starts = [windows_of(n, net.window, net.stride) for n in sizes]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    edges = np.concatenate(([0], np.cumsum(sizes)))
    begin = np.concatenate(starts) + edges[owner]
    size = np.minimum(np.array(sizes)[owner], net.window)
    words = np.concatenate(flat)
    # short windows apart, so that whole ones need no mask
    found = np.empty(len(begin), np.float32)
    for some in (np.flatnonzero(size == net.window), np.flatnonzero(size < net.window)):
        steps = int(size[some].max()) if len(some) else 0
        for at in range(0, len(some), 1 << 14):
            part = some[at : at + (1 << 14)]
            index = words[np.minimum(begin[part][:, None] + np.arange(steps), len(words) - 1)]
            found[part] = logits(net, forward, backward, index, size[part])
    np.fmax.at(out, owner, found)
    return out


class Adam:
    """Steps for dense parameters; embeddings are stepped by the rows that a batch touched."""

    def __init__(self, rate: float):
        self.rate, self.moments, self.turn = rate, {}, 0

    def step(self, p: dict, grads: dict, rows: dict, decay: float) -> None:
        self.turn += 1
        for name, g in grads.items():
            m, v = self.moments.setdefault(name, (np.zeros_like(p[name]), np.zeros_like(p[name])))
            at = rows.get(name, slice(None))
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.99 * v[at] + 0.01 * g * g
            size = self.rate * (1 - 0.99**self.turn) ** 0.5 / (1 - 0.9**self.turn)
            if name in rows:
                p[name][at] *= np.float32(1 - decay)
            p[name][at] -= (size * m[at] / (np.sqrt(v[at]) + 1e-6)).astype(np.float32)


def loss_gradients(net: Network, rows, grams, begin, index, size, target, weight):
    """Gradients of the mean cross entropy over windows; (gradients, embedding rows they belong to, probabilities).

    ``rows``, ``grams`` and ``begin`` describe the distinct words that ``index`` (window, step) numbers.
    """
    h, p = net.hidden, net.p
    x, forward, backward = projections(net, rows, grams, begin)
    kept = {"f": [], "b": []}
    states = np.concatenate([recur(net, w, f, index, size, kept[w]) for w, f in (("f", forward), ("b", backward))], axis=2)
    logit, lean, share, pooled = pool(net, states, size)
    probability = _sigmoid(logit.copy())
    d_logit = ((probability - target) * weight / weight.sum()).astype(np.float32)
    g = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["out"]
    d_states = share[:, :, None] * d_pooled
    d_share = np.einsum("nw,tnw->tn", d_pooled, states)
    d_score = share * (d_share - (share * d_share).sum(axis=0))
    g["pick"] = lean.T @ d_score.reshape(-1)
    d_lean = d_score.reshape(-1, 1) * p["pick"] * (1 - lean * lean)
    g["attend"] = states.reshape(-1, 2 * h).T @ d_lean
    g["attend_b"] = d_lean.sum(axis=0)
    d_states += (d_lean @ p["attend"].T).reshape(states.shape)
    d_x = np.zeros_like(x)
    for way, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
        d_turn = np.zeros_like(p[f"turn_{way}"])
        d_inputs = np.empty((index.shape[1], len(index), 3 * h), np.float32)
        d_state = np.zeros((len(index), h), np.float32)
        for t, before, z, r, new, s in reversed(kept[way]):
            d_after = d_state + d_states[t][:, part]
            present = (t < size)[:, None]
            d_here = np.where(present, d_after, 0)
            d_z = d_here * (before - new) * z * (1 - z)
            d_new = d_here * (1 - z) * (1 - new * new)
            d_r = d_new * s * r * (1 - r)
            d_s = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_turn += before.T @ d_s
            d_inputs[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_state = np.where(present, d_here * z, d_after) + d_s @ p[f"turn_{way}"].T
        d_project = _sums(d_inputs.reshape(-1, 3 * h), index.T.reshape(-1), len(x))
        g[f"turn_{way}"] = d_turn
        g[f"in_{way}"] = x.T @ d_project
        g[f"in_b_{way}"] = d_project.sum(axis=0)
        d_x += d_project @ p[f"in_{way}"].T
    known, place = np.unique(rows, return_inverse=True)
    g["words"] = _sums(d_x[:, : net.word_size], place, len(known))
    many = np.diff(np.append(begin, len(grams)))
    used, place = np.unique(grams, return_inverse=True)
    g["chars"] = _sums(np.repeat(d_x[:, net.word_size :] / many[:, None].astype(np.float32), many, axis=0), place, len(used))
    return g, {"words": known, "chars": used}, probability


def train(
    windows: list[list[bytes]], doc: np.ndarray, label: np.ndarray, *, vocabulary: int, steps: int, batch: int, rate: float, seed: int, decay: float = 0.002, unknown: float = 0.2, prior: float = 0.5
) -> Network:
    """A network from windows of at most 32 words; ``doc`` numbers the document of each, ``label`` (0, 1) is the document's.

    Words that stand in three documents or more are the vocabulary, the most frequent first. In each batch a word is taken
    for an unknown one with probability ``unknown``, so that the trigrams learn as well.
    """
    names: dict[bytes, int] = defaultdict(count().__next__)
    flat = [np.fromiter(map(names.__getitem__, words), np.int64, len(words)) for words in windows]
    raw = list(names)
    bare = [w.strip(EDGES) or w for w in raw]
    seen: Counter = Counter()
    for _, w in {(d, bare[i]) for d, ids in zip(doc.tolist(), flat) for i in ids.tolist()}:
        seen[w] += 1
    chosen = sorted((w for w, n in seen.items() if n >= 3), key=lambda w: (-seen[w], w))[:vocabulary]
    net = Network({w: i + 1 for i, w in enumerate(chosen)})
    net.start(seed)
    rows, grams, begin = inputs(net, raw)
    many = np.diff(np.append(begin, len(grams)))
    size = np.array([len(w) for w in windows])
    index = np.zeros((len(windows), net.window), dtype=np.int64)
    for i, ids in enumerate(flat):
        index[i, : len(ids)] = ids
    rng = np.random.default_rng(seed)
    target = (prior * label).astype(np.float32)
    both = np.bincount(label, minlength=2)
    weight = (len(label) / 2 / np.maximum(both, 1))[label].astype(np.float32)
    adam = Adam(rate)
    probability = target.copy()
    batches = -(-len(windows) // batch)
    for _ in range(-(-steps // batches)):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            used, local = np.unique(index[some], return_inverse=True)
            local = local.reshape(len(some), -1)
            starts = np.cumsum(many[used]) - many[used]
            pieces = np.repeat(begin[used] - starts, many[used]) + np.arange(int(many[used].sum()))
            known = np.where(rng.random(len(used)) < unknown, 0, rows[used])
            g, where, probability[some] = loss_gradients(
                net,
                known,
                grams[pieces],
                starts,
                local,
                size[some],
                target[some],
                weight[some],
            )
            adam.step(net.p, g, where, decay)
        # noisy or: the probability that a window is toxic, given that one at least of its document's is
        clear = np.zeros(int(doc.max()) + 1)
        np.add.at(clear, doc, np.log1p(-np.clip(probability, 0, 1 - 1e-6)))
        target = np.where(label == 1, np.clip(probability / np.maximum(1 - np.exp(clear[doc]), 1e-6), 0, 1), 0).astype(np.float32)
    return net


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of a logistic curve, by Newton steps with a little shrinkage towards slope 1."""
    slope, offset = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        e, v = weight * (q - y), weight * q * (1 - q) + 1e-9
        grad = np.array([(e * x).sum() + 0.1 * (slope - 1), e.sum() + 0.01 * offset])
        curve = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(curve, grad)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        slope, offset = max(slope - step[0], 0.05), offset - step[1]
    return float(slope), float(offset)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = 1500,
    sample_windows: int = 12_000,
    vocabulary: int = 20_000,
    steps: int = 300,
    batch: int = 256,
    rate: float = 0.01,
    seed: int = 7,
) -> Network:
    """Learn from at most ``sample_rows`` labelled documents and ``sample_windows`` windows a label, chosen by hashes.

    ``learn`` is a condition on the id column: rows outside it are never read as labels. Labels other than 0 and 1, null
    texts and texts without words teach nothing. A fifth of the documents calibrates the score (all, if that lacks a
    label). With no labelled text of one kind the score is constant: the share of label 1, 0.5 without labels. The choice
    reads at most 64 times ``sample_rows`` rows of a label in one task.
    """
    known = labels.filter(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropDuplicates()
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    chosen = first_by_hash(known, "y", F.xxhash64(F.lit("toxicity"), "id"), "id", sample_rows).drop("rank")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).filter(F.octet_length("text") > 0)
    found = texts.join(F.broadcast(chosen), "id")  # at most 2 * sample_rows ids; an id may have many rows
    sample = stored(first_by_hash(found, "y", F.xxhash64(F.lit("toxicity"), "id", "text"), "id", sample_rows), "toxicity-sample")
    net = Network({}, constant=prior, empty=prior)
    cut = sample.filter("rank % 5 <> 0").select("y", F.xxhash64("id", "text").alias("doc"), "text").mapInArrow(_cut(net.window, net.stride), "y int, doc long, no int, words binary")
    windows = first_by_hash(cut, "y", F.xxhash64("doc", "no"), "doc", sample_windows).drop("rank")
    learn_all = _learn(vocabulary=vocabulary, steps=steps, batch=batch, rate=rate, seed=seed)
    # one task learns, from at most 2 * sample_windows windows, and is run again if it is lost
    learnt = windows.repartition(1).mapInArrow(learn_all, "net binary").collect()
    if not learnt:
        return net
    net = pickle.loads(bytes(learnt[0]["net"]))
    net.empty = prior
    # whole texts of the sample are scored by tasks; only labels and logits come back
    judged = stored(sample.select("y", F.struct("y", "rank").alias("id"), "text").transform(lambda s: _logits(s, net)).select("id.*", "logit"), "toxicity-logits")
    scored = [r for r in judged.filter("rank % 5 = 0 AND logit IS NOT NULL").collect()]
    if {r["y"] for r in scored} != {0, 1}:
        scored = judged.filter("logit IS NOT NULL").collect()
    x, y = np.array([r["logit"] for r in scored]), np.array([r["y"] for r in scored])
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    net.slope, net.offset = calibrate(x, y, weight)
    return net


def _learn(**options):
    """The sampled windows, in one partition -> the network in one row; nothing if a label is missing."""

    def run(batches):
        rows = sorted((y, doc, no, words) for batch in batches for y, doc, no, words in zip(*(batch.column(c).to_pylist() for c in ("y", "doc", "no", "words"))))
        if {r[0] for r in rows} != {0, 1}:
            return
        _, doc = np.unique([r[1] for r in rows], return_inverse=True)
        net = train([r[3].split(b" ") for r in rows], doc, np.array([r[0] for r in rows]), **options)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    return run


def _cut(window: int, stride: int):
    """Sampled texts -> their windows, words joined by single blanks."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1 << 20):
                y, doc, no, out = [], [], [], []
                for label, name, text in zip(*(part.column(c).to_pylist() for c in ("y", "doc", "text"))):
                    words = tokens(text)
                    for i, start in enumerate(windows_of(len(words), window, stride).tolist()):
                        y.append(label), doc.append(name), no.append(i), out.append(b" ".join(words[start : start + window]))
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(out, pa.binary())], names=["y", "doc", "no", "words"])

    return run


def _logits(texts: DataFrame, net: Network) -> DataFrame:
    """(id, text as bytes) -> (id, logit of the worst window)."""
    kind = texts.select("id").schema[0].dataType.simpleString()
    held = texts.sparkSession.sparkContext.broadcast(net)  # bounded by ``vocabulary`` and BUCKETS

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1 << 20):
                found = worst_logits(held.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.float64(), mask=np.isnan(found))], names=["id", "logit"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, logit double")


def score(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, logit of the worst window (null without words), score, the probability of label 1.

    Texts without words, null ones too, get the share of label 1 among the labelled rows. Bytes that are no UTF-8 are taken
    as they are. Repeated rows are kept, other columns ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    if net.constant is not None:
        return rows.select(F.col("id").alias(id_col), F.lit(None).cast("double").alias("logit"), F.lit(float(net.constant)).alias("score"))
    curve = 1 / (1 + F.exp(-(F.col("logit") * net.slope + net.offset)))
    return _logits(rows, net).select(F.col("id").alias(id_col), "logit", F.coalesce(curve, F.lit(float(net.empty))).alias("score"))
