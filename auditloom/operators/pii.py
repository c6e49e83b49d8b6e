"""Masking of personal data with stable, numbered placeholders, and its inverse.

Values are numbered per scope and type in the order a reader would meet them: rows in order, then
patterns in order, then position. A value seen again keeps its first placeholder, whatever pattern
finds it. With the row itself as scope everything is a projection: no shuffle. A wider scope
(a session, a source) numbers distinct values with ``bucketed_row_number``, so a scope that holds a
third of the corpus is still numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.arrays import explode_once, let
from auditloom.functions.ordered import bucketed_row_number
from auditloom.functions.text import any_of
from auditloom.session import cut_lineage

# The patterns in the order they run. Only API_KEY has groups: label, then value.
PII_PATTERNS = [
    ("EMAIL", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"),
    ("IP_ADDRESS", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("API_KEY",
     r"""(?i)((?:key|token|secret|password|passwd|pwd|authentication|auth)(?:\s*[:=]\s*|\s+))"""
     r"""(['"][a-zA-Z0-9_\-\.\~]{8,}['"]|[a-zA-Z0-9_\-\.\~]{8,})"""),
    ("PHONE_NUMBER", r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:\d[ -]*?){13,16}\b"),
]
PII_TYPES = [name for name, _ in PII_PATTERNS]

# What every match of a pattern contains; a cheap test before the pattern itself.
_NEEDED = {"EMAIL": "@", "IP_ADDRESS": r"\d\.\d", "PHONE_NUMBER": r"\d{3}", "CREDIT_CARD": r"\d[ -]*\d"}

# A noncharacter marks a masked span until its number is known. Brackets keep later patterns from
# reaching into it, exactly as with the final placeholder.
_MARK = "\uffff"
_SLOT = r"\[\[\x{FFFF}(" + "|".join(PII_TYPES) + r")\]\]"
_PLACEHOLDER = r"\[\[(?:" + "|".join(PII_TYPES) + r")_\d+\]\]"


def _values(kind: str) -> str:
    return f"__v_{kind}"


def _extraction(text: Column) -> Column:
    """Slotted text, slot order and values of one text, as a struct.

    Each pattern runs on the text that the pattern before left. Every intermediate text is bound with
    ``let``, so it is computed once wherever Spark moves the expression.
    """
    none = F.array().cast("array<string>")

    def stage(i: int, current: Column, values: dict[str, Column]) -> Column:
        if i == len(PII_PATTERNS):
            raw = values["API_KEY"]
            kept = {**values, "API_KEY": F.transform(raw, lambda v: F.btrim(v, F.lit("'\"")))}
            return F.struct(
                current.alias("slotted"),
                F.regexp_extract_all(current, F.lit(_SLOT), F.lit(1)).alias("kinds"),
                F.transform(raw, lambda v: v.substr(1, 1).isin("'", '"')).alias("quoted"),
                *[kept[kind].alias(kind) for kind in PII_TYPES],
            )
        kind, pattern = PII_PATTERNS[i]
        labelled = kind == "API_KEY"
        found = F.regexp_extract_all(current, F.lit(pattern), F.lit(2 if labelled else 0))
        if kind in _NEEDED:
            found = F.when(current.rlike(_NEEDED[kind]), found).otherwise(none)
        slot = ("$1" if labelled else "") + f"[[{_MARK}{kind}]]"

        def rewritten(hits: Column) -> Column:
            # Most texts have no match and are not rewritten.
            text_after = F.when(F.size(hits) > 0, F.regexp_replace(current, pattern, slot)).otherwise(current)
            return let(text_after, lambda after: stage(i + 1, after, {**values, kind: hits}))

        return let(found, rewritten)

    return let(text, lambda t: stage(0, t, {}))


def extract_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__slotted`` (text with unnumbered slots), the values per type and the slot order."""
    staged = df.withColumn("__pii", _extraction(F.col(text)))
    fields = {"__slotted": "slotted", "__kinds": "kinds", "__quoted": "quoted", **{_values(k): k for k in PII_TYPES}}
    return staged.withColumns({name: F.col(f"__pii.{field}") for name, field in fields.items()}).drop("__pii")


def _values_in_text_order() -> Column:
    """The masked values in the order of their slots."""

    def placed(kind: str) -> Column:
        places = F.array_compact(F.transform("__kinds", lambda k, i: F.when(k == kind, i)))
        return F.zip_with(places, F.col(_values(kind)), lambda i, v: F.struct(i.alias("i"), v.alias("v")))

    pairs = F.concat(*[placed(kind) for kind in PII_TYPES])
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def _fill(slotted: Column, pattern: str, fillers: Column) -> Column:
    pieces = F.split(slotted, pattern, -1)
    return F.array_join(
        F.zip_with(pieces, fillers, lambda piece, fill: F.concat(piece, F.coalesce(fill, F.lit("")))), ""
    )


def _drop_work(df: DataFrame, *more: str) -> DataFrame:
    return df.drop("__slotted", "__kinds", "__quoted", *[_values(k) for k in PII_TYPES], *more)


def _distinct_by_type() -> dict[str, Column]:
    """Per type, the values first seen as that type, in numbering order."""
    seen: list[Column] = []
    result = {}
    for kind in PII_TYPES:
        values = F.array_distinct(F.col(_values(kind)))
        result[kind] = F.array_except(values, F.concat(*seen)) if seen else values
        seen.append(F.col(_values(kind)))
    return result


def mask_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``masked`` and ``mapping``, numbering inside each row.

    ``mapping`` is an array of ``(placeholder, value, pii_type, n, quoted)``.
    """
    staged = extract_pii(df, text)

    def entries(kind: str, values: Column) -> Column:
        def entry(value: Column, i: Column) -> Column:
            quoted = F.lit(False)
            if kind == "API_KEY":
                first = F.array_position(F.col(_values(kind)), value)
                quoted = F.element_at("__quoted", first.cast("int"))
            return F.struct(
                F.concat(F.lit(f"[[{kind}_"), (i + 1).cast("string"), F.lit("]]")).alias("placeholder"),
                value.alias("value"),
                F.lit(kind).alias("pii_type"),
                (i + 1).cast("bigint").alias("n"),
                quoted.alias("quoted"),
            )

        return F.transform(values, entry)

    staged = staged.withColumn("mapping", F.concat(*[entries(*item) for item in _distinct_by_type().items()]))
    names = F.map_from_arrays(
        F.transform("mapping", lambda e: e["value"]), F.transform("mapping", lambda e: e["placeholder"])
    )
    staged = staged.withColumns({"__names": names, "__ordered": _values_in_text_order()})
    fillers = let(F.col("__names"), lambda names: F.transform("__ordered", lambda v: F.element_at(names, v)))
    masked = F.when(F.size("__kinds") == 0, F.col("__slotted")).otherwise(
        _fill(F.col("__slotted"), _SLOT, fillers)
    )
    return _drop_work(staged.withColumn("masked", masked), "__names", "__ordered")


def pii_mapping(masked: DataFrame, scope: str) -> DataFrame:
    """The mapping as rows ``(scope, placeholder, value, pii_type, n, quoted)``."""
    return explode_once(masked, [scope], F.col("mapping"), "m").select(scope, "m.*")


def clear_scope(mapping: DataFrame, scope: str, cleared: DataFrame) -> DataFrame:
    """Forget the mappings of the scopes listed in ``cleared``."""
    return mapping.join(cleared.select(scope).distinct(), scope, "left_anti")


def first_sightings(extracted: DataFrame, scope: str, row_id: str) -> DataFrame:
    """(scope, value, row, pat, pos, pii_type, quoted): where each distinct value stands first (a map-side combined minimum)."""

    def sightings(order: int, kind: str) -> Column:
        values = F.col(_values(kind))
        quoted = F.col("__quoted") if kind == "API_KEY" else F.transform(values, lambda v: F.lit(False))
        return F.transform(
            F.arrays_zip(values.alias("v"), quoted.alias("q")),
            lambda z, i: F.struct(
                F.lit(order).alias("pat"), i.alias("pos"), F.lit(kind).alias("pii_type"),
                z["q"].alias("quoted"), z["v"].alias("value"),
            ),
        )

    every = F.concat(*[sightings(i, kind) for i, kind in enumerate(PII_TYPES)])
    seen = explode_once(extracted, [scope, row_id], every, "s")
    first = seen.groupBy(scope, F.col("s.value").alias("value")).agg(
        F.min(F.struct(F.col(row_id).alias("row"), "s.pat", "s.pos", "s.pii_type", "s.quoted")).alias("f")
    )
    return first.select(scope, "value", "f.*")


def _numbered(sightings: DataFrame, scope: str, rows_per_bucket: int) -> DataFrame:
    return bucketed_row_number(
        sightings, [scope, "pii_type"], ["row", "pat", "pos"], F.floor(F.col("row") / rows_per_bucket)
    )


def _entries(numbered: DataFrame, scope: str) -> DataFrame:
    return numbered.select(
        scope, "value", "pii_type", F.col("n").cast("bigint").alias("n"), "quoted",
        F.concat(F.lit("[["), F.col("pii_type"), F.lit("_"), F.col("n").cast("string"), F.lit("]]")).alias(
            "placeholder"
        ),
    )


def pii_first_seen_number(
    extracted: DataFrame, scope: str, row_id: str, rows_per_bucket: int = 65536
) -> DataFrame:
    """Placeholders of a scope wider than a row: ``(scope, value, pii_type, n, quoted, placeholder)``.

    First sightings are numbered per scope and type. ``row_id`` is the integer order of rows.
    """
    return _entries(_numbered(first_sightings(extracted, scope, row_id), scope, rows_per_bucket), scope)


def _lookup(df: DataFrame, keys: Column, mapping: DataFrame, scope: str, row_id: str, key: str, value: Column):
    """Per row, a map from its own keys to ``value`` in ``mapping``; rows stay small, scopes need not."""
    wanted = explode_once(df, [scope, row_id], F.array_distinct(keys), key)
    return (
        wanted.join(mapping.select(scope, key, value.alias("__value")), [scope, key])
        .groupBy(scope, row_id)
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col("__value")))).alias("__names"))
    )


def _staged(df: DataFrame, text: str) -> DataFrame:
    """Texts are searched once: the slotted text is written with its values, which numbering and lookup read alone."""
    return cut_lineage(extract_pii(df, text).withColumn("__ordered", _values_in_text_order()))


def _masked(staged: DataFrame, mapping: DataFrame, scope: str, row_id: str) -> DataFrame:
    found = staged.filter(F.size("__ordered") > 0).select(scope, row_id, "__ordered")
    names = _lookup(found, F.col("__ordered"), mapping, scope, row_id, "value", F.col("placeholder"))
    joined = staged.join(names, [scope, row_id], "left")
    fillers = let(F.col("__names"), lambda names: F.transform("__ordered", lambda v: F.element_at(names, v)))
    masked = F.when(F.size("__kinds") == 0, F.col("__slotted")).otherwise(
        _fill(F.col("__slotted"), _SLOT, fillers)
    )
    return _drop_work(joined.withColumn("masked", masked), "__names", "__ordered")


def mask_pii_scope(df: DataFrame, scope: str, row_id: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Mask with one numbering per ``scope``; returns the rows with ``masked`` and the mapping, which is written once."""
    staged = _staged(df, text)
    mapping = cut_lineage(pii_first_seen_number(staged.filter(F.size("__ordered") > 0), scope, row_id))
    return _masked(staged, mapping, scope, row_id), mapping


DICTIONARY_SCHEMA = "value string, pii_type string, n bigint, quoted boolean, placeholder string"


def read_dictionary(spark: SparkSession, folder: str, scope: str, scope_type: str, load: int) -> DataFrame:
    """Placeholders of the loads 0 to ``load``; none for -1."""
    schema = f"`{scope}` {scope_type}, {DICTIONARY_SCHEMA}"
    if load < 0:
        return spark.createDataFrame([], schema)
    paths = [f"{folder}/load={i}" for i in range(load + 1)]
    return spark.read.schema(schema).option("basePath", folder).parquet(*paths).drop("load")


def mask_pii_load(
    df: DataFrame, scope: str, row_id: str, folder: str, load: int, text: str = "text", rows_per_bucket: int = 65536
) -> tuple[DataFrame, DataFrame]:
    """Mask one load of many with placeholders that stay: the rows with ``masked``, and the dictionary after this load.

    The dictionary in ``folder`` is only appended to, a folder a load (numbered from 0). A value that an earlier load of
    its scope has seen keeps its placeholder and type, new values are numbered after the old ones of their type in the
    order of this load. A load that is run again reads only the loads before it and writes the same entries again.
    """
    spark = df.sparkSession
    kind = df.schema[scope].dataType.simpleString()
    staged = _staged(df, text)
    known = read_dictionary(spark, folder, scope, kind, load - 1)
    sightings = first_sightings(staged.filter(F.size("__ordered") > 0), scope, row_id)
    fresh = sightings.join(known.select(scope, "value"), [scope, "value"], "left_anti")
    last = known.groupBy(F.col(scope).alias("__scope"), F.col("pii_type").alias("__type")).agg(F.max("n").alias("__last"))
    numbered = _numbered(fresh, scope, rows_per_bucket)
    after = numbered.join(last, numbered[scope].eqNullSafe(F.col("__scope")) & (numbered["pii_type"] == F.col("__type")), "left")
    _entries(after.withColumn("n", F.col("n") + F.coalesce("__last", F.lit(0))), scope).write.mode("overwrite").parquet(f"{folder}/load={load}")
    dictionary = read_dictionary(spark, folder, scope, kind, load)
    return _masked(staged, dictionary, scope, row_id), dictionary


def restored_value(value: Column, quoted: Column) -> Column:
    """Values that were quoted come back in double quotes."""
    return F.when(quoted, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)


def _restore(text: Column, names: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(_PLACEHOLDER), F.lit(0))
    fillers = F.transform(found, lambda p: F.coalesce(F.try_element_at(names, p), p))
    return F.when(F.size(found) == 0, text).otherwise(_fill(text, _PLACEHOLDER, fillers))


def unmask_pii(df: DataFrame, text: str = "masked") -> DataFrame:
    """Add ``unmasked`` from the row's own ``mapping``. Unknown placeholders stay.

    Placeholders end in brackets, so none is a prefix of another and the order of replacement
    does not matter.
    """
    names = F.map_from_arrays(
        F.transform("mapping", lambda e: e["placeholder"]),
        F.transform("mapping", lambda e: restored_value(e["value"], e["quoted"])),
    )
    return df.withColumn("__names", names).withColumn(
        "unmasked", _restore(F.col(text), F.col("__names"))
    ).drop("__names")


def unmask_pii_scope(
    df: DataFrame, mapping: DataFrame, scope: str, row_id: str, text: str = "masked"
) -> DataFrame:
    """Add ``unmasked`` from a mapping table keyed by ``scope``."""
    found = F.regexp_extract_all(text, F.lit(_PLACEHOLDER), F.lit(0))
    names = _lookup(
        df, found, mapping, scope, row_id, "placeholder", restored_value(F.col("value"), F.col("quoted"))
    )
    joined = df.join(names, [scope, row_id], "left")
    empty = F.create_map().cast("map<string,string>")
    return joined.withColumn("__names", F.coalesce("__names", empty)).withColumn(
        "unmasked", _restore(F.col(text), F.col("__names"))
    ).drop("__names")


def pii_leak_check(parts: DataFrame, case: str, text: str, raw_values: list[str]) -> DataFrame:
    """Per case, whether any raw value is still present in any part."""
    leaked = any_of([F.col(text).contains(v) for v in raw_values])
    return parts.groupBy(case).agg(F.coalesce(F.bool_or(leaked), F.lit(False)).alias("leaked"))
