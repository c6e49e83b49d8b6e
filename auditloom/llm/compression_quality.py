"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A text is compressed twice, piece by piece, once with a dictionary of good and once with a dictionary of bad text. The
difference of the two sizes over the text's length says which of them it resembles; an isotonic fit on labelled rows that
the dictionaries have not seen turns it into a probability.

What is fitted is bounded: ``dict_bytes`` a dictionary, ``sample_rows`` labelled rows a label. Scoring runs over all rows,
whole texts, in Arrow batches, without any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import first_by_hash, readable, slices, stored


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    knots: np.ndarray  # differences, ascending
    values: np.ndarray  # probability at each knot
    empty: float  # score of a text without any byte
    level: int = 3
    piece: int = 2048

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Compressors with loaded dictionaries; made once in each task."""

    def __init__(self, model: CompressionModel):
        self.model = model
        self.compressors = []
        for content in (model.good, model.bad):
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=model.level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_checksum=False))

    def difference(self, text: str) -> float | None:
        """(size with the bad dictionary - size with the good one) / length; None for an empty text."""
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return None
        good, bad = self.compressors
        total = 0
        for start in range(0, len(data), self.model.piece):
            part = data[start : start + self.model.piece]
            total += len(bad.compress(part)) - len(good.compress(part))
        return total / len(data)

    def score(self, differences: list[float | None]) -> np.ndarray:
        raw = np.array([np.nan if d is None else d for d in differences], dtype=float)
        known = np.interp(raw, self.model.knots, self.model.values)
        return np.where(np.isnan(raw), self.model.empty, known)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: non-decreasing means of ``y`` along ``x``, as knots for linear interpolation."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, weighted x, weighted y
    for xi, yi, wi in zip(x[order], y[order], weight[order]):
        pools.append([wi, wi * xi, wi * yi])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            w, wx, wy = pools.pop()
            pools[-1][0] += w
            pools[-1][1] += wx
            pools[-1][2] += wy
    total = np.array(pools)
    margin = 0.5 / (len(x) + 1)  # half a row keeps scores off 0 and 1
    return total[:, 1] / total[:, 0], np.clip(total[:, 2] / total[:, 0], margin, 1 - margin)


def _gather(texts: list[bytes], limit: int, piece: int) -> bytes:
    """A dictionary of at most ``limit`` bytes: pieces of the texts in turn, so one long text cannot fill it."""
    out, size, turn = [], 0, 0
    while size < limit and any(len(t) > turn * piece for t in texts):
        for t in texts:
            part = t[turn * piece : (turn + 1) * piece]
            if part and size < limit:
                out.append(part[: limit - size])
                size += len(out[-1])
        turn += 1
    return b"".join(out)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = 3000,
    dict_rows: int = 600,
    dict_bytes: int = 384 * 1024,
    level: int = 3,
    piece: int = 2048,
) -> CompressionModel:
    """Learn from at most ``sample_rows`` labelled documents of each label, chosen by a hash of their ids.

    ``learn`` is a condition on the id column: rows outside it are never read as labels. Labels other than 0 and 1, null
    texts and empty texts teach nothing; of a repeated id at most ``sample_rows`` rows count. The first ``dict_rows`` of each label fill the dictionaries, the others calibrate
    (all of them, if there are too few). With no labelled row of one kind the score is constant: the share of label 1.
    """
    known = labels.filter(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.dropDuplicates()
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = first_by_hash(known, "y", F.xxhash64(F.lit("quality"), "id"), "id", sample_rows).drop("rank")
    texts = docs.select(F.col(id_col).alias("id"), readable(text_col).alias("text")).filter(F.length("text") > 0)
    found = texts.join(F.broadcast(chosen), "id")  # at most 2 * sample_rows ids; an id may have many rows
    sample = stored(first_by_hash(found, "y", F.xxhash64(F.lit("quality"), "id"), "text", sample_rows), "quality-sample")
    n_good, n_bad = shares.get(1, 0), shares.get(0, 0)
    prior = n_good / (n_good + n_bad) if n_good + n_bad else 0.5
    seeds = (
        sample.filter(F.col("rank") <= dict_rows)
        .select("y", "rank", "id", F.expr(f"substring(encode(text, 'utf-8'), 1 + {piece} * pmod(xxhash64(id), 1 + cast(octet_length(text) / {4 * piece} as int)), {4 * piece})").alias("part"))
        .collect()
    )
    seeds.sort(key=lambda r: (r["rank"], r["id"], r["part"]))
    contents = [_gather([bytes(r["part"]) for r in seeds if r["y"] == y], dict_bytes, piece) for y in (1, 0)]
    model = CompressionModel(contents[0], contents[1], np.array([0.0]), np.array([prior]), prior, level, piece)
    if len(contents[0]) < 8 or len(contents[1]) < 8:
        model.good = model.bad = b"no labelled text"
        return model
    rest = sample.filter(F.col("rank") > dict_rows)
    scored = differences(rest, model, "y").collect()
    if {r["y"] for r in scored} != {0, 1}:
        scored = differences(sample, model, "y").collect()
    x = np.array([r["difference"] for r in scored])
    y = np.array([r["y"] for r in scored], dtype=float)
    # both labels were sampled alike: weights restore their shares
    w = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    model.knots, model.values = isotonic(x, y, w)
    return model


def differences(sample: DataFrame, model: CompressionModel, keep: str) -> DataFrame:
    """(keep, difference) for a bounded sample of labelled rows."""

    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            found = [scorer.difference(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(found, pa.float64())], names=[keep, "difference"])

    return sample.select(keep, "text").mapInArrow(run, f"{keep} int, difference double")


def score(docs: DataFrame, model: CompressionModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, difference (null for an empty text) and score, the probability of label 1.

    Null texts count as empty; both get the share of label 1 among the labelled rows. Other columns are ignored.
    """
    kind = docs.select(id_col).schema[0].dataType
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most two dictionaries

    def run(batches):
        scorer = held.value.scorer()
        for batch in batches:
            for part in slices(batch, 4 << 20):
                found = [scorer.difference(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(found, pa.float64()), pa.array(scorer.score(found), pa.float64())],
                    names=[id_col, "difference", "score"],
                )

    schema = f"`{id_col}` {kind.simpleString()}, difference double, score double"
    return docs.select(F.col(id_col).alias("id"), readable(text_col).alias("text")).mapInArrow(run, schema)
