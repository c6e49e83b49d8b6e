"""Character-frequency text vectors."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.arrays import let


def text_char_embedding(df: DataFrame, text: str = "text", dim: int = 16, output: str = "embedding") -> DataFrame:
    """Add a unit vector: slot ``i % dim`` sums the code points of the lower-cased characters.

    The text becomes an array of code points once; each slot folds over its own positions. Sums are
    whole numbers, so their order does not matter. A text without characters keeps the zero vector.
    """
    characters = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "")
    zero = F.lit(0).cast("bigint")

    def slot(codes: Column, j: int) -> Column:
        places = F.sequence(F.lit(j), F.size(codes) - 1, F.lit(dim))
        total = F.aggregate(places, zero, lambda acc, i: acc + F.get(codes, i))
        return F.when(F.size(codes) > j, total).otherwise(zero)

    def unit(sums: Column) -> Column:
        squares = F.aggregate(sums, F.lit(0.0), lambda acc, s: acc + s.cast("double") * s.cast("double"))
        return let(
            F.sqrt(squares), lambda norm: F.transform(sums, lambda s: F.when(norm > 0, s / norm).otherwise(F.lit(0.0)))
        )

    codes = F.transform(characters, lambda c: F.ascii(c))
    sums = let(codes, lambda c: F.array(*[slot(c, j) for j in range(dim)]))
    return df.withColumn(output, let(sums, unit))


def nearest(vector: str, centroids: list[list[float]]) -> Column:
    """``(dist, cluster)`` of the nearest centroid; the lowest index wins a tie.

    The centroids are one constant of the plan, whatever their number: a text that Spark parses once, when it optimises.
    """
    constant = F.from_json(F.lit(json.dumps([list(map(float, c)) for c in centroids])), "array<array<double>>")

    def option(centroid: Column, i: Column) -> Column:
        squares = F.zip_with(F.col(vector), centroid, lambda a, b: (a - b) * (a - b))
        distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, d: acc + d))
        return F.struct(distance.alias("dist"), i.alias("cluster"))

    return F.array_min(F.transform(constant, option))
