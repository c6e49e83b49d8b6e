"""Ordered numbering and lag that never put a whole group into one task.

A plain window sorts each group in a single task; a session or scope that holds a third of the
data would then be one task. Here each group is cut by ``bucket``, a column that does not decrease
along the order. Windows run inside (group, bucket); one summary row per (group, bucket) carries
what the next bucket needs to know, and is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.session import cut_lineage


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = None
    for key in keys:
        term = left[key].eqNullSafe(renamed[f"__r_{key}"])
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def bucketed_row_number(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, output: str = "n"
) -> DataFrame:
    """``row_number`` over ``keys`` by ``order``, computed bucket by bucket."""
    staged = df.withColumn("__bucket", bucket)
    cut = [*keys, "__bucket"]
    counts = staged.groupBy(*cut).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*cut, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    local = staged.withColumn(
        "__local", F.row_number().over(Window.partitionBy(*cut).orderBy(*order))
    )
    joined = _null_safe_join(local, offsets, cut)
    return joined.withColumn(output, F.col("__local") + F.col("__before")).drop(
        "__bucket", "__local", "__before"
    )


def bucketed_lag(
    df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column, output: str
) -> DataFrame:
    """``lag(value)`` over ``keys`` by ``order``, computed bucket by bucket."""
    staged = df.withColumn("__bucket", bucket)
    cut = [*keys, "__bucket"]
    last = staged.groupBy(*cut).agg(
        F.max(F.struct(*order, F.struct(F.col(value).alias("v")).alias("w"))).alias("__last")
    )
    carried = last.select(
        *cut,
        F.lag("__last.w").over(Window.partitionBy(*keys).orderBy("__bucket")).alias("__carry"),
    )
    inside = Window.partitionBy(*cut).orderBy(*order)
    local = staged.withColumns(
        {
            "__rank": F.row_number().over(inside),
            "__prev": F.lag(value).over(inside),
        }
    )
    joined = _null_safe_join(local, carried, cut)
    return joined.withColumn(
        output, F.when(F.col("__rank") == 1, F.col("__carry.v")).otherwise(F.col("__prev"))
    ).drop("__bucket", "__rank", "__prev", "__carry")


def bucketed_running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: Column, bucket: Column, output: str
) -> DataFrame:
    """``sum(value)`` over ``keys`` by ``order`` up to each row (rows of equal order not told apart), bucket by bucket."""
    staged = df.withColumns({"__bucket": bucket, "__value": value})
    cut = [*keys, "__bucket"]
    sums = staged.groupBy(*cut).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*cut, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = staged.withColumn("__local", F.sum("__value").over(inside))
    joined = _null_safe_join(local, offsets, cut)
    return joined.withColumn(output, F.col("__local") + F.col("__before")).drop("__bucket", "__value", "__local", "__before")


def with_order_number(df: DataFrame, order: list[str], output: str = "n") -> DataFrame:
    """A number from 0 along ``order`` over the whole table, without a group or a task that sorts it all.

    Rows are dealt to ranges, numbered in each range and moved up by the ranges before; ``df`` is written once, so that the
    ranges stay what they are.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the low bits count rows of a partition, the high ones partitions
    local = F.monotonically_increasing_id()
    placed = cut_lineage(
        ranged.select(*df.columns, local.alias("__id")).withColumns(
            {"__part": F.shiftright("__id", 33), "__row": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}
        )
    )
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))  # a row for each partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    return placed.join(offsets, "__part").withColumn(output, F.col("__row") + F.col("__before")).drop("__id", "__part", "__row", "__before")
