"""Mixing sources to target weights: Efraimidis-Spirakis sampling in DataFrame functions only.

Each document gets an exponential key, scaled by its quality weight: ``-ln(u) / quality`` with ``u`` from a hash of its id,
so heavier documents tend to come first and reruns agree. Sorted by key within a source, sizes are prefix-summed up to the
source's budget. Whole epochs come first; the sorted prefix fills what is left.

Nothing sorts a whole source: keys are cut into ``buckets`` ranges, range sums are prefix-summed (at most ``buckets`` rows
a source), and only the one range that the budget ends in is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.llm.common import WORD, stored

# Characters that rarely stand in prose; their share lowers a document's quality weight.
SYMBOLS = "%&$#*@{}<>|~^=_"


def words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prose_quality(text: Column) -> Column:
    """Quality weight from 0.05 to 1: one less five times the share of symbols. Null and empty texts weigh 1."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.greatest(F.lit(0.05), 1 - 5.0 * symbols / F.nullif(n, F.lit(0))), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``sizes`` (source, source_size), one row a source -> the same with ``target``.

    Sources in code-point order (null last) weigh ``weights`` in turn and share all words by weight. A target stops at
    ``max_epochs`` times its source's size and the excess is shared again by weight. The fixed point is one level: sources
    are capped in order of cap over weight for as long as the level of the rest lies above. The windows run over one row
    a source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("_rank", F.row_number().over(order) - 1)
        .withColumn("_w", pick)
        .withColumn("_cap", F.col("source_size") * max_epochs)
        .withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w"))
    )
    by_ratio = W.orderBy("_ratio", "_rank")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy("_ratio", "_rank")
    levels = (
        ranked.withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_weight", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_open", F.col("_ratio") * F.col("_weight") > F.col("_left"))
    )
    # The first open source in ratio order fixes the level for itself and all after it.
    first = F.min(F.when(F.col("_open"), F.struct("_ratio", "_rank", "_left", "_weight"))).over(whole)
    return (
        levels.withColumn("_first", first)
        .withColumn(
            "target",
            F.when(
                F.col("_first").isNull() | (F.struct("_ratio", "_rank") < F.struct("_first._ratio", "_first._rank")),
                F.col("_cap").cast("double"),
            ).otherwise(F.col("_w") * F.col("_first._left").cast("double") / F.col("_first._weight")),
        )
        .select("source", "source_size", "target")
    )


def key_bucket(key: Column, buckets: int) -> Column:
    """Number of the range that a key lies in; ranges follow the keys.

    A key is exponential with the row's weight, so even ranges of one such distribution would put most rows of another weight
    into the last one. The mean of the distributions of weights from 8 down to 1/1024 spreads rows of any weight between:
    a range holds one in some three hundred of them at most, with 4096 ranges.
    """
    scales = [2.0**k for k in range(3, -11, -1)]
    total = F.lit(0.0)
    for scale in scales:
        total = total + (1 - F.exp(-key * F.lit(scale)))
    return F.least(F.lit(buckets - 1), F.floor(total / F.lit(float(len(scales))) * F.lit(buckets))).cast("int")


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    quality: Column | None = None,
    seed: str = "mix",
    buckets: int = 4096,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, epochs, taken.

    ``taken`` is the words the mix takes from the document: its size for each whole epoch, and once more if it lies in the
    sorted prefix that fills the rest of the budget. The last document goes in if that brings the total nearer, so a source
    misses its target by half a document at most.

    Null or empty texts have size 0 and take 0. A null source is a source of its own. Null ids share the hash of the text
    ``null``. Repeated ids tie and are ordered by size, so the rows as a set are the same on every run. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    weight = prose_quality(F.col(text_col)) if quality is None else quality
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    # 52 bits of the hash give u in (0, 1]
    u = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("sid"),
        words(F.col(text_col)).alias("size"),
        (-F.log(u) / weight).alias("key"),
    )
    rows = stored(keyed.withColumn("bucket", key_bucket(F.col("key"), buckets)), "mix-keys")
    ranges = rows.groupBy("sid", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    sizes = ranges.groupBy("sid").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = (
        source_targets(sizes, weights, max_epochs)
        .withColumn("sid", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
        .withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .drop("source")
    )
    prior = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = (
        ranges.withColumn("before", F.coalesce(F.sum("words").over(prior), F.lit(0)))
        .join(targets, "sid")
        .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
        .select("sid", F.col("bucket").alias("end_bucket"), F.col("before").alias("end_before"))
    )
    budgets = stored(targets.join(ends, "sid", "left"), "mix-budgets")
    joined = rows.join(budgets, "sid")
    open_end = F.col("end_bucket").isNull()
    clear = joined.filter(open_end | (F.col("bucket") != F.col("end_bucket"))).withColumn(
        "extra", F.when(open_end | (F.col("bucket") < F.col("end_bucket")), F.col("size")).otherwise(F.lit(0))
    )
    inside = W.partitionBy("sid").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    edge = (
        joined.filter(F.col("bucket") == F.col("end_bucket"))
        .withColumn("_before", F.col("end_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("extra", F.when(F.col("_before") + F.col("size") / 2 <= F.col("rest"), F.col("size")).otherwise(F.lit(0)))
        .drop("_before")
    )
    return clear.unionByName(edge).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        "epochs",
        (F.col("size") * F.col("epochs") + F.col("extra")).alias("taken"),
    )
