"""Advisories as version ranges, for tables of any size.

``dependencies.cve_hits`` compares each pin with each range of its library, which is right for a handful of ranges. Here
versions become keys that sort as versions compare, all versions and range ends are numbered along one order, and a range is
an interval of numbers:

* ``range_hits`` cuts each interval into the few dyadic blocks that cover it, a version lies in one block of each size, and
  equal blocks meet in an equi-join. All its rows are hits; blocks of one library are different keys, so a library with a
  hundred thousand ranges is spread.
* ``exposure`` only asks how many ranges hold a version, how bad the worst is, and from which version on nothing is known: it
  sweeps the ends with running sums, linear in versions and ranges whatever their overlap.

Ranges have ``ecosystem, library, introduced, fixed`` and any other columns: from ``introduced`` (null: from the start) to
before ``fixed`` (null: without end). Ranges that end where they begin or before hold nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.ordered import bucketed_running_sum, with_order_number
from auditloom.session import cut_lineage

# Severities, the worst first.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
_LENGTH = 9  # digits of a part's length in a key
_LIBRARY = ["ecosystem", "library"]


def version_key(version: Column) -> Column:
    """Text that sorts as ``version_lt`` compares: part by part, parts that are no numbers left out, missing ones 0.

    Each part is written as the number of its digits and the digits, without leading zeros; parts of any length are exact.
    Zeros at the end say nothing and are left out. Null for a null version.
    """
    digits = F.filter(F.split(version, r"\."), lambda part: part.rlike(r"^[0-9]+$"))
    short = F.transform(digits, lambda part: F.regexp_replace(part, "^0+", ""))
    last = F.array_max(F.transform(short, lambda part, i: F.when(part != "", i + 1).otherwise(0)))
    parts = F.transform(F.slice(short, F.lit(1), F.coalesce(last, F.lit(0))), lambda part: F.concat(F.lpad(F.length(part).cast("string"), _LENGTH, "0"), part))
    return F.array_join(parts, "")


def _lo_key(introduced: Column) -> Column:
    return F.coalesce(version_key(introduced), F.lit(""))


def _hi_key(fixed: Column) -> Column:
    # sorts behind every key: keys hold digits only
    return F.coalesce(version_key(fixed), F.lit("~"))


def _pinned(pins: DataFrame) -> DataFrame:
    """(ecosystem, library, version, key) of the different pinned versions, written once."""
    distinct = pins.filter(F.col("version").isNotNull()).select(*_LIBRARY, "version").distinct()
    return cut_lineage(distinct.withColumn("key", version_key(F.col("version"))))


def _different(ranges: DataFrame, pinned: DataFrame, *more: str) -> DataFrame:
    """Different ranges of pinned libraries with the keys of their ends and their number of rows, written once.

    Equal rows are counted as text first: a key is worked out for each different range, not for each advisory.
    """
    asked = ranges.join(pinned.select(*_LIBRARY).distinct(), _LIBRARY, "left_semi")
    counted = asked.groupBy(*_LIBRARY, "introduced", "fixed", *more).agg(F.count(F.lit(1)).alias("rows"))
    keys = {"lo_key": _lo_key(F.col("introduced")), "hi_key": _hi_key(F.col("fixed"))}
    return cut_lineage(counted.withColumns(keys)).filter("lo_key < hi_key")


def _numbered(pinned: DataFrame, different: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct (library, key) of pins and range ends by number; the pins; distinct ranges' ends.

    The start of each library is an end of its own (the empty key), so that open ranges have somewhere to begin, and so is a
    place behind all its versions.
    """
    asked = pinned.select(*_LIBRARY, "key").distinct()
    ends = different.select(*_LIBRARY, "lo_key", "hi_key").distinct()
    keys = asked.unionByName(ends.select(*_LIBRARY, F.explode(F.array("lo_key", "hi_key")).alias("key"))).distinct()
    numbered = with_order_number(keys, [*_LIBRARY, "key"])
    numbered = cut_lineage(numbered)
    lo = numbered.select(*_LIBRARY, F.col("key").alias("lo_key"), F.col("n").alias("lo"))
    hi = numbered.select(*_LIBRARY, F.col("key").alias("hi_key"), F.col("n").alias("hi"))
    intervals = ends.join(lo, [*_LIBRARY, "lo_key"]).join(hi, [*_LIBRARY, "hi_key"])
    versions = asked.join(numbered, [*_LIBRARY, "key"])
    return numbered, versions, intervals


def range_hits(pins: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each pin with each range that holds its version: the columns of both; ``pins`` has ``ecosystem, library, version``.

    Versions and ranges are made distinct first, so many files with one pin cost one lookup. A version asks one block for
    each power of two up to the number of versions, a range is at most two blocks a power. Null versions and libraries hit
    nothing. Columns that both have, other than the library, must be renamed by the caller.
    """
    pinned = _pinned(pins)
    different = _different(ranges, pinned)
    numbered, versions, intervals = _numbered(pinned, different)
    levels = max(1, int(numbered.count()).bit_length())
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    left = F.expr("shiftright(lo + shiftleft(1L, level) - 1, level)")
    right = F.expr("shiftright(hi, level)")
    ends = intervals.select(*_LIBRARY, "lo_key", "hi_key", "lo", "hi", level).withColumns({"l": left, "r": right}).filter("l < r")
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    wanted = F.filter(F.array(F.when(odd("l"), F.col("l")), F.when(odd("r"), F.col("r") - 1)), lambda b: b.isNotNull())
    blocks = ends.select(*_LIBRARY, "lo_key", "hi_key", "level", F.explode(wanted).alias("block"))
    asked = versions.select(*_LIBRARY, "key", "n", level).withColumn("block", F.expr("shiftright(n, level)")).drop("n")
    pairs = asked.join(blocks, [*_LIBRARY, "level", "block"]).select(*_LIBRARY, "key", "lo_key", "hi_key")
    # what a version and a different range have in common is settled before the rows of both come in
    held = pairs.join(different, [*_LIBRARY, "lo_key", "hi_key"]).select(*_LIBRARY, "key", "introduced", "fixed")
    held = held.join(pinned, [*_LIBRARY, "key"]).select(*[F.col(c).alias(f"__{c}") for c in (*_LIBRARY, "version", "introduced", "fixed")])
    of_pin = [c for c in pins.columns if c not in _LIBRARY]
    held = pins.withColumnsRenamed({c: f"__pin_{c}" for c in _LIBRARY}).join(
        held, (F.col("__pin_ecosystem") == F.col("__ecosystem")) & (F.col("__pin_library") == F.col("__library")) & (F.col("version") == F.col("__version"))
    )
    same = (F.col("ecosystem") == F.col("__ecosystem")) & (F.col("library") == F.col("__library")) & F.col("introduced").eqNullSafe(F.col("__introduced")) & F.col("fixed").eqNullSafe(F.col("__fixed"))
    return ranges.join(held, same).select(*_LIBRARY, *of_pin, *[c for c in ranges.columns if c not in _LIBRARY])


def exposure(pins: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row a distinct (ecosystem, library, version) of ``pins`` that any range holds.

    ``advisories`` (ranges that hold it, repeated rows counted), ``severity`` (the worst of them by ``SEVERITIES``; others
    come last, as null) and ``safe_version``: the least range end from which on, for a while, no range holds; null if there
    is none. Ranges need a ``severity`` column. Null versions are left out.
    """
    pinned = _pinned(pins)
    different = _different(ranges, pinned, "severity")
    numbered, versions, _ = _numbered(pinned, different)
    marks = [F.when(F.col("severity").eqNullSafe(F.lit(s)), F.col("rows")).otherwise(F.lit(0)).alias(s) for s in SEVERITIES]
    change = F.explode(
        F.array(
            F.struct(F.col("lo_key").alias("key"), F.lit(1).cast("long").alias("step"), F.lit(None).cast("string").alias("end")),
            F.struct(F.col("hi_key").alias("key"), F.lit(-1).cast("long").alias("step"), F.col("fixed").alias("end")),
        )
    ).alias("c")
    steps = different.select(*_LIBRARY, "rows", *marks, change).groupBy(*_LIBRARY, F.col("c.key").alias("key")).agg(
        F.sum(F.col("c.step") * F.col("rows")).alias("all"), *[F.sum(F.col("c.step") * F.col(s)).alias(s) for s in SEVERITIES], F.min("c.end").alias("end")
    )
    swept = numbered.join(steps, [*_LIBRARY, "key"], "left").na.fill(0, ["all", *SEVERITIES])
    bucket = F.shiftright("n", 14)
    # a library's steps add up to nothing at its last key, so one sum runs over all of them
    for name in ["all", *SEVERITIES]:
        swept = bucketed_running_sum(swept, [], ["n"], F.col(name), bucket, f"n_{name}")
    swept = cut_lineage(swept.select(*_LIBRARY, "key", "n", "end", *[f"n_{s}" for s in ["all", *SEVERITIES]]))
    # versions up to the next number that no range holds share the numbers free so far
    swept = bucketed_running_sum(swept, [], ["n"], (F.col("n_all") == 0).cast("long"), bucket, "free")
    swept = cut_lineage(swept)
    ends = swept.filter("n_all = 0").select(F.col("free").alias("next_free"), F.col("end").alias("safe_version"))
    severity = F.coalesce(*[F.when(F.col(f"n_{s}") > 0, F.lit(s)) for s in SEVERITIES])
    held = swept.filter("n_all > 0").join(versions.select("n"), "n", "left_semi").withColumn("next_free", F.col("free") + 1)
    found = held.join(ends, "next_free", "left").select(
        *_LIBRARY, "key", F.col("n_all").alias("advisories"), severity.alias("severity"), "safe_version"
    )
    return pinned.join(found, [*_LIBRARY, "key"]).drop("key")
