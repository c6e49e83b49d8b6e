"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.session import scratch_path

# A word: what stands between blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readable(column: str) -> Column:
    """The text for Python to read: bytes that are no UTF-8 become U+FFFD, null stays null."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps survive lost executors and work is done once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")) % modulus


def first_by_hash(rows: DataFrame, group: str, hashed: Column, ties: str, n: int, spread: int = 64) -> DataFrame:
    """The first ``n`` rows of each group by a hash, with their ``rank``.

    A large group is ranked in ``spread`` parts first, so no task reads more than that many times ``n`` rows of it.
    """
    marked = rows.withColumn("_hash", hashed).withColumn("_part", F.pmod("_hash", F.lit(spread)))
    parts = W.partitionBy(group, "_part").orderBy("_hash", ties)
    some = marked.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= n)
    whole = W.partitionBy(group).orderBy("_hash", ties)
    return some.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= n).drop("_hash", "_part")


def release_memory() -> None:
    """Hand freed memory back: Spark keeps idle Python workers, and what they have once allocated counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch, max_bytes: int, column: str = "text") -> Iterator:
    """Cut an Arrow batch into runs of rows whose texts together hold about ``max_bytes`` (one row at least).

    Memory is released after each batch.
    """
    sizes = batch.column(column).nbytes
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, int(rows * max_bytes / max(sizes, 1)))
    for start in range(0, rows, step):
        yield batch.slice(start, step)
    release_memory()


def zip_array(values: np.ndarray) -> bytes:
    """Bytes of one array, planes of equal weight together, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unzip_array(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def cut_points(keys: np.ndarray, ranges: int) -> list[int]:
    """Where sorted 64-bit keys go over from one of ``ranges`` equal parts of the key space to the next."""
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
    return [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
