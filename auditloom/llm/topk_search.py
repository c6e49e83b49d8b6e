"""Exact top-k search by inner product: term-at-a-time accumulation over postings.

Vectors are packed into blocks of rows. For each pair of a query block and a candidate block, the candidate block is
inverted into one posting list a dimension; each term of a sparse query row scatters its weighted postings into a dense
score array; the best ``k`` of the block are selected by partition and the blocks' lists are merged by rank.

The work is queries times candidates, as an exhaustive search has it. Memory is bounded by two blocks a task, and pairs are
spread evenly, so a hot vector or label changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.llm.common import stored

BLOCK = "block long, n int, dims int, ids binary, weights binary"
HITS = "query_id long, vec_id long, score long"


def quantize(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a long; null if the vector or a component is null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long")))


def pack(rows: DataFrame, block_rows: int) -> DataFrame:
    """(id, vector) -> blocks of at most ``block_rows`` rows; shorter vectors are filled up with zeros."""

    def build(batches):
        ids, vectors = [], []

        def emit():
            dims = max(map(len, vectors))
            matrix = np.zeros((len(vectors), dims), dtype="<i8")
            for i, v in enumerate(vectors):
                matrix[i, : len(v)] = v
            # a number that differs between blocks with near certainty; equal numbers only share a slot
            number = int(ids[0]) * 1_000_003 + int(ids[-1])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number & 0x7FFFFFFFFFFFFFFF], pa.int64()),
                    pa.array([len(ids)], pa.int32()),
                    pa.array([dims], pa.int32()),
                    pa.array([np.asarray(ids, dtype="<i8").tobytes()], pa.binary()),
                    pa.array([matrix.tobytes()], pa.binary()),
                ],
                names=["block", "n", "dims", "ids", "weights"],
            )

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                vectors.append(v)
                if len(ids) == block_rows:
                    yield emit()
                    ids, vectors = [], []
        if ids:
            yield emit()

    return rows.mapInArrow(build, BLOCK)


def postings(matrix: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each dimension the rows that have it and their weights; rows is None where most rows have it."""
    lists = []
    for column in np.ascontiguousarray(matrix.T):
        rows = np.flatnonzero(column)
        lists.append((None, column) if 2 * len(rows) > len(column) else (rows, column[rows]))
    return lists


def accumulate(query: np.ndarray, lists: list, n: int, kind=np.int64) -> np.ndarray:
    """Scores of ``n`` candidates for one query row, a term at a time."""
    scores = np.zeros(n, dtype=kind)
    for term in np.flatnonzero(query[: len(lists)]):
        rows, weights = lists[term]
        if rows is None:
            scores += kind(query[term]) * weights
        elif len(rows):
            scores[rows] += kind(query[term]) * weights
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the ``k`` best, ties to the smaller id, without the query's own row."""
    others = np.flatnonzero(ids != own)
    if len(others) > k:
        values = scores[others]
        floor = np.partition(values, len(values) - k)[len(values) - k]
        others = others[values >= floor]
    return others[np.lexsort((ids[others], -scores[others]))[:k]]


def _score_pairs(k: int):
    def run(batches):
        held, lists = None, None
        for batch in batches:
            cols = {name: batch.column(name) for name in batch.schema.names}
            for r in range(batch.num_rows):
                get = lambda name: cols[name][r].as_py()
                n, dims, m, qdims = get("n"), get("dims"), get("q_n"), get("q_dims")
                ids = np.frombuffer(get("ids"), dtype="<i8")
                queries = np.frombuffer(get("q_weights"), dtype="<i8").reshape(m, qdims)
                matrix = np.frombuffer(get("weights"), dtype="<i8").reshape(n, dims)
                peak = float(np.abs(matrix).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dims, 1)
                kind = np.int32 if peak < 2**31 - 1 else np.int64
                key = (ids.tobytes(), kind)
                if held != key:
                    held, lists = key, postings(matrix.astype(kind))
                out: tuple[list, list, list] = ([], [], [])
                for q, own in zip(queries, np.frombuffer(get("q_ids"), dtype="<i8")):
                    scores = accumulate(q, lists, n, kind)
                    best = select(scores, ids, own, k)
                    out[0].append(np.full(len(best), own, dtype=np.int64))
                    out[1].append(ids[best])
                    out[2].append(scores[best].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"]
                )

    return run


def topk_search(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    scale: int = 64,
    block_rows: int = 4096,
    query_rows: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of every query row; ties go to the smaller id.

    ``is_query`` is a condition on the id column. Every other row is a candidate. Vectors that are null or hold a null or
    non-finite component, and rows without id, take no part. Every row of a
    repeated id is a candidate, and the rows of a query's id are sought together: their candidates compete for the ``k``
    places. A query never meets its own id. Vectors of unequal length count as filled up with zeros; an empty
    vector scores 0 with all. Inner products must fit 64 bits. Other columns are ignored. No queries or no candidates:
    an empty result.
    """
    clean = (
        vectors.select(F.col(id_col).cast("long").alias("id"), quantize(F.col(vector_col), scale).alias("vector"))
        .filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    )
    flagged = clean.withColumnRenamed("id", id_col).withColumn("_asked", F.coalesce(is_query, F.lit(False)))
    rows = stored(flagged.select(F.col(id_col).alias("id"), "vector", "_asked"), "topk-rows")
    blocks = stored(pack(rows.select("id", "vector"), block_rows), "topk-blocks")
    queries = pack(rows.filter("_asked").select("id", "vector"), query_rows)
    slots = max(1, blocks.count())
    # Every query block meets every candidate block: query blocks are copied to all slots, joined on the slot.
    left = blocks.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int"))
    right = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    )
    pairs = left.join(right, "slot").drop("slot", "block", "q_block")
    hits = pairs.mapInArrow(_score_pairs(k), HITS)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
