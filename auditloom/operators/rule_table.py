"""Rules as rows of a table: thousands of them at the price of a few.

``scan.scan`` writes every rule into the plan, which is right for a fixed registry. Here the literals of all rules
(``needs``) make one automaton, built once in each task; a pass over a line finds the rules that have a literal in it, and
only their patterns are tried on it, in the JVM as for the registry. The number of rules decides the automaton's size, not
the time a line takes.

A table with more rules than one process should hold stays a table: hashes of the literals are joined with those of the texts
in a line that are as long as a literal. A Bloom filter, all that the driver gets, leaves out nearly all other texts before
the join.

Rules have ``rule, pattern, severity, needs`` (lower-case literals, one at least of which every match contains; null or
empty: unknown, so the pattern is tried on every line).
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.lookup import inline_table
from auditloom.functions.rules import Rule
from auditloom.functions.text import strip
from auditloom.session import scratch_path

RULE_SCHEMA = "rule string, pattern string, severity string, needs array<string>"
_WINDOW = 32  # characters of a literal that are hashed
_BASE, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PROBES = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_CHARS = 2_000_000  # of lines that are hashed at once


class TooManyRules(ValueError):
    pass


def rule_rows(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return inline_table(spark, [(r.name, r.pattern, r.severity, list(r.needs)) for r in rules], RULE_SCHEMA)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _mixed(sums: np.ndarray, length: int) -> np.ndarray:
    mixed = (sums ^ np.uint64(length)) * _ODD
    return (mixed ^ (mixed >> np.uint64(32))) * _ODD


def _literal_keys(literals: list[str]) -> np.ndarray:
    """A hash for each literal's first characters."""
    keys, lengths = np.zeros(len(literals), np.uint64), np.array([min(len(x), _WINDOW) for x in literals], np.int64)
    for length in set(lengths.tolist()):
        at = np.flatnonzero(lengths == length)
        letters = _codes([literals[i][:length] for i in at]).reshape(len(at), length).astype(np.uint64)
        sums = np.zeros(len(at), np.uint64)
        for column in letters.T:
            sums = sums * _BASE + column
        keys[at] = _mixed(sums, length)
    return keys


def _window_keys(codes: np.ndarray, lengths: list[int]):
    """(length, hash of that many characters from each place on), put together from windows of 1, 2, 4, ... characters."""
    doubled, power = [codes.astype(np.uint64)], [_BASE]
    for length in sorted(lengths):
        while 2 ** len(doubled) <= length:
            half, step = doubled[-1], 2 ** (len(doubled) - 1)
            doubled.append(half[:-step] * power[-1] + half[step:] if len(half) > step else half[:0])
            power.append(power[-1] * power[-1])
        n = len(codes) - length + 1
        if n <= 0:
            return
        sums, done = np.zeros(n, np.uint64), 0
        for k in range(len(doubled) - 1, -1, -1):
            if length >> k & 1:
                sums = sums * power[k] + doubled[k][done : done + n]
                done += 2**k
        yield length, _mixed(sums, length)


def _bits_of(keys: np.ndarray, probe: np.uint64, bits: int) -> np.ndarray:
    return (keys * probe) >> np.uint64(64 - bits)


def _bloom(keys: DataFrame, rules: int) -> tuple[np.ndarray, int]:
    """A filter of at most 32 MB over ``__key``, put together in the tasks."""
    bits = min(28, max(16, (32 * rules).bit_length()))

    def places(batches):
        for batch in batches:
            held = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_bits_of(held, p, bits) for p in _PROBES]).astype(np.int64))], names=["bit"])

    split = keys.select("__key").mapInArrow(places, "bit long").selectExpr("bit DIV 32768 AS part", "bit % 32768 AS place")
    filled = np.zeros(2**bits // 8, np.uint8)
    for row in split.groupBy("part").agg(F.bitmap_construct_agg("place").alias("b")).toLocalIterator():
        filled[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(row["b"], np.uint8)
    return filled, bits


def _scan_by_keys(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """``scan_rule_table`` for a table of any size."""
    spark = lines.sparkSession
    kept = [c for c in lines.columns if c not in ("raw", "line")]
    table = rules.select(F.col("rule"), F.col("pattern").alias("__pattern"), "severity", F.array_sort(F.array_distinct(F.filter(F.coalesce("needs", F.array().cast("array<string>")), lambda n: n.isNotNull()))).alias("__needs"))
    everywhere = (F.size("__needs") == 0) | F.array_contains("__needs", "")
    needy = table.filter(~everywhere).withColumn("__need", F.explode("__needs"))

    def keyed(batches):
        for batch in batches:
            yield batch.append_column("__key", pa.array(_literal_keys(batch.column("__need").to_pylist()).view(np.int64)))

    literals = needy.mapInArrow(keyed, "rule string, __pattern string, severity string, __needs array<string>, __need string, __key long")
    lengths = [r[0] for r in needy.select(F.least(F.length("__need"), F.lit(_WINDOW))).distinct().collect()]
    filled, bits = _bloom(literals, literals.count())
    held = spark.sparkContext.broadcast(filled)

    def hits(texts: list[str]):
        """(which text, key) of what passes the filter, each once."""
        codes = np.concatenate([np.append(_codes([t]), np.uint32(0x110000)) for t in texts])  # what is no character parts two lines
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        found = []
        for _, keys in _window_keys(codes, lengths):
            at = np.arange(len(keys))
            for probe in _PROBES:
                bit = _bits_of(keys[at], probe, bits)
                at = at[(held.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            found.append(np.stack([owner[at], keys[at].view(np.int64)], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def propose(batches):
        for batch in batches:
            texts = batch.column("__lowered").to_pylist()
            first = 0
            while first < len(texts):
                last, chars = first, 0
                while last < len(texts) and (last == first or chars + len(texts[last]) <= _CHARS):
                    chars += len(texts[last])
                    last += 1
                found = hits(texts[first:last])
                out = batch.select([*kept, "raw", "__lowered"]).take(pa.array(found[:, 0] + first, pa.int64()))
                yield out.append_column("__key", pa.array(found[:, 1], pa.int64()))
                first = last

    lowered = lines.filter("raw IS NOT NULL").select(*kept, "raw", F.lower("raw").alias("__lowered"))
    names = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in lowered.schema), "__key long"])
    # a rule counts once for a line, by the first of its literals that the line holds
    first_held = F.get(F.filter("__needs", lambda n: F.contains(F.col("__lowered"), n)), F.lit(0))
    tried = lowered.mapInArrow(propose, names).join(literals, "__key").filter(first_held == F.col("__need")).select(*kept, "raw", "rule", "__pattern", "severity")
    always = table.filter(everywhere).drop("__needs")
    if not always.isEmpty():
        tried = tried.unionByName(lowered.drop("__lowered").crossJoin(always))
    return tried.filter(F.expr("raw RLIKE __pattern")).select(*kept, "rule", strip(F.col("raw")).alias("content"), "severity")


def scan_rule_table(lines: DataFrame, rules: DataFrame, most_rules: int | None = None, held_rules: int = 20_000) -> DataFrame:
    """One row per (line, matching rule): the columns of ``lines`` but ``raw`` and ``line``, rule, content, severity.

    Up to ``held_rules`` rules are read to the driver, more stay a table. More than ``most_rules`` of them raise
    ``TooManyRules``, none are left out. Rules without a pattern match nothing, rules of one name each count. Null lines match
    nothing.
    """
    chosen = rules.select(*[x.split()[0] for x in RULE_SCHEMA.split(", ")]).filter("pattern IS NOT NULL")
    if most_rules is not None and chosen.limit(most_rules + 1).count() > most_rules:
        raise TooManyRules(f"over {most_rules} rules")
    rows = sorted(chosen.limit(held_rules + 1).collect(), key=lambda r: (str(r["rule"]), r["pattern"], str(r["severity"])))
    if len(rows) > held_rules:
        return _scan_by_keys(lines, chosen)
    spark = lines.sparkSession
    literals: dict[str, list[int]] = {}
    always = []
    for i, row in enumerate(rows):
        needs = {n for n in row["needs"] or [] if n is not None}
        if not needs or "" in needs:
            always.append(i)
        for need in needs - {""} if "" not in needs else ():
            literals.setdefault(need, []).append(i)
    held = spark.sparkContext.broadcast((literals, always))  # held_rules bounds it
    kept = [c for c in lines.columns if c not in ("raw", "line")]

    def propose(batches):
        words, everywhere = held.value
        automaton = ahocorasick.Automaton()
        for word, ids in words.items():
            automaton.add_word(word, ids)
        if words:
            automaton.make_automaton()
        for batch in batches:
            places, found = [], []
            for i, text in enumerate(batch.column("__lowered").to_pylist()):
                if text is None:
                    continue
                hits = set(everywhere)
                if words:
                    for _, ids in automaton.iter(text):
                        hits.update(ids)
                places += [i] * len(hits)
                found += sorted(hits)
            out = batch.select([*kept, "raw"]).take(pa.array(places, pa.int64()))
            yield out.append_column("__rule", pa.array(found, pa.int32()))

    names = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.select(*kept, "raw").schema), "__rule int"])
    proposed = lines.select(*kept, "raw", F.lower("raw").alias("__lowered")).mapInArrow(propose, names)
    table = inline_table(spark, [(i, r["rule"], r["pattern"], r["severity"]) for i, r in enumerate(rows)], "__rule int, rule string, __pattern string, severity string")
    return (
        proposed.join(table, "__rule")
        .filter(F.expr("raw RLIKE __pattern"))
        .select(*kept, "rule", strip(F.col("raw")).alias("content"), "severity")
    )


def rule_scan_sink(rules: Callable[[], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that scans each trigger's lines with the rules as they are then.

    ``rules`` reads the rule table anew for each trigger, so rules that were added, changed or taken away count from the next
    trigger on. Each trigger writes a folder of its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        scan_rule_table(batch, rules()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_rule_scan(lines: DataFrame, rules: Callable[[], DataFrame], path: str, checkpoint: str | None = None) -> None:
    """Scan what is there and stop; called again with the same folders, goes on."""
    (
        lines.writeStream.foreachBatch(rule_scan_sink(rules, path))
        .option("checkpointLocation", checkpoint or scratch_path(lines.sparkSession, "checkpoint"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
