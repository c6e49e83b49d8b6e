"""Array elements to rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, kept: list, array: Column, name: str, position: str | None = None) -> DataFrame:
    """``kept`` columns and one row per non-null element of a *computed* array.

    For a plain explode Spark infers a filter on the array's size and pushes it towards the scan, so
    the expression that builds the array runs twice, or far more often when it is built in steps.
    The outer form has no such filter; the empty row it adds is dropped afterwards.
    """
    if position:
        rows = df.select(*kept, F.posexplode_outer(array).alias(position, name))
    else:
        rows = df.select(*kept, F.explode_outer(array).alias(name))
    return rows.filter(F.col(name).isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A named intermediate column is not enough: a filter that Spark pushes below it puts the whole
    expression in place of every mention, also inside loops over elements. A lambda variable stays.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
