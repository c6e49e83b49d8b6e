"""Language identification with a linear-chain conditional random field.

Every word of a line is labelled with a language. A word's score for each label comes from its character n-grams (those at
its ends are its affixes) and from a lexicon of frequent words; learned weights score the change of label from one word to
the next. Forward-backward gives each word's label probabilities, so a word of two languages is read in its context and
text that switches languages is split where it switches. A document's language is the label with most of the words.

Training fits a bounded sample in memory. Labelling runs over all rows in Arrow batches without any shuffle; scores of a
batch's distinct words are computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import first_by_hash, readable, slices, stored

UNDETERMINED = "und"
EDGES = b".,;:!?\"'()[]{}<>|/\\%&$#*+-=_~`^@0123456789"
ORDERS = (2, 3, 4)
TABLE = 1 << 18  # hashed n-gram features


def normalize(word: bytes) -> bytes:
    """Lower case, without punctuation and digits at its ends; empty if there is no letter."""
    text = word.decode("utf-8", "replace")
    if not any(map(str.isalpha, text)):
        return b""
    return text.lower().encode("utf-8", "replace").strip(EDGES) or b"?"


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words' n-grams with end marks, one after the other, and where each word's begin."""
    flat = np.frombuffer(b"".join([b"\x01" + w + b"\x02" for w in words]), dtype=np.uint8).astype(np.uint32)
    ends = np.cumsum([len(w) + 2 for w in words]) - 1  # a word may hold the marks itself
    starts = np.concatenate(([0], ends[:-1] + 1))
    left = np.repeat(ends, ends - starts + 1) - np.arange(len(flat))  # bytes to the word's end mark
    rows = np.repeat(np.arange(len(words)), ends - starts + 1)
    features, owners = [], []
    code = flat.copy()
    for order in range(2, max(ORDERS) + 1):
        code = code[:-1] * np.uint32(0x01000193) ^ flat[order - 1 :] * np.uint32(0x9E3779B1)
        if order in ORDERS:
            at = np.flatnonzero(left[: len(code)] >= order - 1)
            mixed = code[at]
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            features.append((mixed ^ (mixed >> np.uint32(13))) & np.uint32(TABLE - 1))
            owners.append(rows[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    return np.concatenate(features)[order], np.searchsorted(owner, np.arange(len(words)))


def posteriors(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, change: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Forward-backward over many chains at once.

    ``scores`` has a row of label scores for each word; chains are ranges of rows. Returns each word's label probabilities
    and, with ``pairs``, the expected number of each change of label. Chains are walked side by side, longest first.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    kind = scores.dtype
    psi = np.exp(scores - scores.max(axis=1, keepdims=True))
    step, entry = np.exp(change).astype(kind), np.exp(first).astype(kind)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains longer than t
    ahead = np.empty_like(psi)
    a = np.empty((0, psi.shape[1]), kind)
    for t in range(longest):
        m = active[t]
        at = starts[:m] + t
        a = (entry if t == 0 else a[:m] @ step) * psi[at]
        a /= a.sum(axis=1, keepdims=True)
        ahead[at] = a
    out = np.empty_like(psi)
    expected = np.zeros(step.shape)
    b = np.empty((0, psi.shape[1]), kind)
    for t in range(longest - 1, -1, -1):
        m, n = active[t], len(b)
        at = starts[:m] + t
        now = ahead[at]
        if n:
            inward = psi[at[:n] + 1] * b
            if pairs:
                joint = now[:n, :, None] * step * inward[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = inward @ step.T
            b /= b.sum(axis=1, keepdims=True)
        if m > n:
            b = np.concatenate([b, np.ones((m - n, psi.shape[1]), kind)])
        g = now * b
        out[at] = g / g.sum(axis=1, keepdims=True)
    return (out, expected) if pairs else out


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray  # (TABLE, labels)
    lexicon: dict[bytes, int]  # word -> row of lexical
    lexical: np.ndarray  # (words + 1, labels); the last row is for words outside the lexicon
    change: np.ndarray
    first: np.ndarray

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Label scores of normalised words."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        features, begins = grams(words)
        outside = len(self.lexicon)
        rows = np.array([self.lexicon.get(w, outside) for w in words])
        return np.add.reduceat(self.weights[features], begins, axis=0) + self.lexical[rows]


@dataclass
class Chains:
    words: list[bytes]  # distinct normalised words
    tokens: np.ndarray  # word number of each token
    starts: np.ndarray  # first token of each line
    lengths: np.ndarray  # tokens of each line
    owner: np.ndarray  # text of each token


def chains(texts: list[str | None]) -> Chains:
    """Lines of texts as chains of words; tokens without a letter are left out."""
    tokens: list[bytes] = []
    sizes, texts_of = [], []
    for i, t in enumerate(texts):
        for line in (t or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
            own = line.split()
            if own:
                tokens += own
                sizes.append(len(own))
                texts_of.append(i)
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    number: dict[bytes, int] = {}
    clean = (normalize(w) for w in coded.dictionary.to_pylist())
    to = np.array([number.setdefault(w, len(number)) if w else -1 for w in clean], dtype=np.int64)
    ids = to[coded.indices.to_numpy()] if tokens else np.empty(0, dtype=np.int64)
    kept = ids >= 0
    before = np.concatenate(([0], np.cumsum(kept)))
    ends = np.cumsum(np.array(sizes, dtype=np.int64))
    counts = np.diff(before[np.concatenate(([0], ends))])
    lengths = counts[counts > 0]
    starts = np.cumsum(lengths) - lengths
    return Chains(list(number), ids[kept], starts, lengths, np.repeat(np.array(texts_of, dtype=np.int64), counts))


def label_words(texts: list[str | None], model: LanguageModel) -> tuple[Chains, np.ndarray]:
    """The chains of some texts and the label probabilities of each of their tokens."""
    found = chains(texts)
    scores = model.scores(found.words).astype(np.float32)[found.tokens]
    return found, posteriors(scores, found.starts, found.lengths, model.change, model.first)


def train(
    samples: list[tuple[str, str]], *, lexicon_words: int = 5000, rounds: int = 3, mixed: float = 0.3, piece: int = 120, batch: int = 400, rate: float = 0.1
) -> LanguageModel:
    """Fit by AdaGrad on the conditional likelihood of (label, text) samples.

    Lines are cut to pieces of ``piece`` words. A share ``mixed`` of the chains joins parts of two samples of any labels,
    which is what the weights of label changes are learned from.
    """
    labels = sorted({label for label, _ in samples})
    k = len(labels)
    found = chains([text for _, text in samples])
    gold_of = np.array([labels.index(label) for label, _ in samples], dtype=np.int64)
    rng = np.random.default_rng(7)
    pieces = [(s + o, min(piece, n - o)) for s, n in zip(found.starts, found.lengths) for o in range(0, n, piece)]
    counts = np.zeros((len(found.words), k))
    np.add.at(counts, (found.tokens, gold_of[found.owner]), 1)
    by_count = np.argsort(-counts.sum(axis=1), kind="stable")[:lexicon_words]
    by_count = by_count[counts[by_count].sum(axis=1) >= 5]
    lexicon = {found.words[i]: n for n, i in enumerate(by_count)}
    entry = np.full(len(found.words), len(lexicon))
    entry[by_count] = np.arange(len(by_count))
    model = LanguageModel(labels, np.zeros((TABLE, k)), lexicon, np.zeros((len(lexicon) + 1, k)), np.zeros((k, k)), np.zeros(k))
    if not found.words or k == 1:
        return model
    features, begins = grams(found.words)
    ends = np.append(begins[1:], len(features))
    square = [np.full_like(x, 1e-3) for x in (model.weights, model.lexical, model.change, model.first)]

    def step(value, total, at, gradient):
        total[at] += gradient**2
        value[at] += rate * gradient / np.sqrt(total[at])

    for _ in range(rounds):
        order = rng.permutation(len(pieces))
        at = 0
        while at < len(order):
            parts = []
            lengths = []
            while len(lengths) < batch and at < len(order):
                start, n = pieces[order[at]]
                at += 1
                chain = np.arange(start, start + n)
                if rng.random() < mixed and n > 1:
                    other, m = pieces[rng.integers(len(pieces))]
                    chain = np.concatenate([chain[: rng.integers(1, n)], np.arange(other, other + rng.integers(1, m + 1))])
                parts.append(chain)
                lengths.append(len(chain))
            tokens = np.concatenate(parts)
            n = np.array(lengths)
            starts = np.cumsum(n) - n
            types, word = np.unique(found.tokens[tokens], return_inverse=True)
            gold = gold_of[found.owner[tokens]]
            spans = [features[begins[t] : ends[t]] for t in types]
            sizes = np.array([len(x) for x in spans])
            used = np.concatenate(spans)
            scores = np.add.reduceat(model.weights[used], np.cumsum(sizes) - sizes, axis=0) + model.lexical[entry[types]]
            p, expected = posteriors(scores[word], starts, n, model.change, model.first, pairs=True)
            error = -p
            error[np.arange(len(tokens)), gold] += 1
            by_type = np.stack([np.bincount(word, weights=error[:, i], minlength=len(types)) for i in range(k)], axis=1)
            distinct, back = np.unique(used, return_inverse=True)
            spread = np.repeat(by_type, sizes, axis=0)
            by_feature = np.stack([np.bincount(back, weights=spread[:, i], minlength=len(distinct)) for i in range(k)], axis=1)
            step(model.weights, square[0], distinct, by_feature / batch)
            words_at, back = np.unique(entry[types], return_inverse=True)
            lexical = np.stack([np.bincount(back, weights=by_type[:, i], minlength=len(words_at)) for i in range(k)], axis=1)
            step(model.lexical, square[1], words_at, lexical / batch)
            inner = np.ones(len(tokens), dtype=bool)
            inner[starts] = False
            into = np.flatnonzero(inner)
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[into - 1], gold[into]), 1)
            step(model.change, square[2], slice(None), (seen - expected) / batch)
            step(model.first, square[3], slice(None), error[starts].sum(axis=0) / batch)
    model.weights = model.weights.astype(np.float32)
    model.lexical = model.lexical.astype(np.float32)
    return model


def fit(
    docs: DataFrame,
    learn: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    sample_docs: int = 300,
    sample_lines: int = 2500,
) -> LanguageModel:
    """Learn from at most ``sample_lines`` lines of at most ``sample_docs`` documents a label, chosen by hash.

    ``learn`` is a condition on the columns of ``docs``. Rows with a null label or text teach nothing. A document's label is
    taken for all its words. Without any such row the model has no label, and all texts are undetermined.
    """
    usable = docs.filter(learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label")).distinct()
    chosen = first_by_hash(labelled, "label", F.xxhash64(F.lit("lang"), "id"), "id", sample_docs).drop("rank")
    texts = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), readable(text_col).alias("text"))
    lines = texts.join(F.broadcast(chosen), ["id", "label"]).select("label", F.explode(F.split("text", "\n")).alias("line"))
    kept = first_by_hash(lines.filter(F.length("line") > 0), "label", F.xxhash64("line"), "line", sample_lines)
    rows = stored(kept, "language-lines").orderBy("label", "rank").collect()
    return train([(r["label"], r["line"]) for r in rows])


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """One row per input row: id, lang_pred, score, n_words, shares.

    ``shares`` maps each label to its part of the words; ``lang_pred`` is the largest (of equals the first by name) and
    ``score`` its part. A text that is null, empty or without a letter is ``und`` with score 0 and no shares. Only the text
    is looked at; other columns are ignored, whatever their names.
    """
    schema = T.StructType([docs.select(id_col).schema[0]])
    schema = schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("n_words", T.LongType())
    schema = schema.add("shares", T.MapType(T.StringType(), T.DoubleType()))
    held = docs.sparkSession.sparkContext.broadcast(model)  # TABLE rows and a lexicon of fixed size

    def run(batches):
        labels = held.value.labels
        k = len(labels)
        for batch in batches:
            for part in slices(batch, block_bytes):
                texts = part.column("text").to_pylist()
                n = len(texts)
                sums, words = np.zeros((n, max(k, 1))), np.zeros(n, dtype=np.int64)
                if k:
                    found, p = label_words(texts, held.value)
                    words = np.bincount(found.owner, minlength=n)
                    for i in range(k):
                        sums[:, i] = np.bincount(found.owner, weights=p[:, i], minlength=n)
                shares = sums / np.maximum(words, 1)[:, None]
                best = shares.argmax(axis=1)
                known = words > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([labels[b] if ok else UNDETERMINED for b, ok in zip(best, known)], pa.string()),
                        pa.array(np.where(known, np.minimum(shares.max(axis=1), 1.0), 0.0)),
                        pa.array(words),
                        pa.array([list(zip(labels, row)) if ok else [] for row, ok in zip(shares.tolist(), known)], pa.map_(pa.string(), pa.float64())),
                    ],
                    names=[id_col, "lang_pred", "score", "n_words", "shares"],
                )

    return docs.select(F.col(id_col).alias("id"), readable(text_col).alias("text")).mapInArrow(run, schema)
