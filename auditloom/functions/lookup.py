"""Small tables that live in the plan."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of driver-side rows of which Spark knows the size.

    Rows handed over as Arrow become a local relation, so a join with them is a broadcast of that size and the other side is
    not shuffled. A frame made of Python tuples has no known size.
    """
    kinds = T._parse_datatype_string(schema)
    names = [f.name for f in kinds.fields]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    empty = spark.createDataFrame([], kinds).toArrow().schema
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, empty)], schema=empty), kinds)
