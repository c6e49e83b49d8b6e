"""Benchmark decontamination by pigeonhole edit matching.

With a budget of k edits, a test item is cut into k + 1 pieces: wherever the item occurs with k edits or fewer, one piece at
least occurs unchanged. An Aho-Corasick automaton finds all pieces in one pass over a document, and Myers' bit-parallel
distance decides around each hit. Items are compared after lower-casing and after every run of blanks and ASCII punctuation
has become one blank. Items of fewer than ``short_chars`` characters are sought without edits, as whole words: an edit would
make them another item.

Documents are read once for each chunk of items (of ``chunk_chars`` characters at most, so that the automaton is bounded);
nothing is shuffled.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import readable, slices

_BLANK = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def normalize(text: str | None) -> str:
    """Lower case; blanks and ASCII punctuation become single blanks, none at the ends."""
    raw = (text or "").lower().encode("utf-8", "replace").translate(_BLANK)
    return b" ".join(raw.split()).decode("utf-8")


@dataclass
class Pattern:
    """An item prepared for Myers' algorithm: bit i of ``at[c]`` is set where its character i is c."""

    text: str
    budget: int

    def __post_init__(self):
        self.at = self._masks(self.text)
        self.back = self._masks(self.text[::-1])

    @staticmethod
    def _masks(text: str) -> dict[str, int]:
        masks: dict[str, int] = {}
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | 1 << i
        return masks

    def pieces(self) -> Iterator[tuple[str, int]]:
        """budget + 1 pieces of nearly equal length and where each begins."""
        n = min(self.budget + 1, len(self.text))
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        for lo, hi in zip(cuts, cuts[1:]):
            yield self.text[lo:hi], lo

    def best(self, window: str) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best occurrence within the budget, the first of equals; None if there is none."""
        at = window.find(self.text)
        if at >= 0:
            return 0, at, at + len(self.text)
        found = _search(self.at, len(self.text), window, self.budget)
        if found is None:
            return None
        distance, end = found
        # the reversed item, anchored at the found end, gives the start
        back = _search(self.back, len(self.text), window[:end][::-1], distance, anchored=True)
        return distance, end - back[1], end


def _search(masks: dict[str, int], m: int, window: str, budget: int, anchored: bool = False) -> tuple[int, int] | None:
    """Myers' bit-parallel search: least distance of the pattern to a substring, and the first end where it is reached.

    ``anchored`` makes the substring start where the window starts.
    """
    full = (1 << m) - 1
    top = 1 << (m - 1)
    up, down, score = full, 0, m
    best = (m, 0) if m <= budget else None
    for i, c in enumerate(window):
        eq = masks.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        plus = (down | ~(across | up)) & full
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1 | anchored) & full
        minus = minus << 1 & full
        level = eq | down
        up = (minus | ~(level | plus)) & full
        down = plus & level
        if score <= budget and (best is None or score < best[0]):
            best = (score, i + 1)
    return best


def _bounded(text: str, lo: int, hi: int) -> bool:
    """Whether [lo, hi) neither begins nor ends inside a word; scripts that set no blanks (from U+2E80 on) have no inside."""

    def joined(i: int) -> bool:
        return 0 < i < len(text) and all(c.isalnum() and c < "\u2e80" for c in text[i - 1 : i + 1])

    return not joined(lo) and not joined(hi)


class Matcher:
    """Automaton over the pieces of some items; those under ``short`` characters have no budget and need word bounds."""

    def __init__(self, items: list[tuple[object, str]], rate: float, short: int = 0):
        self.items = [(i, Pattern(text, int(rate * len(text)) if len(text) >= short else 0)) for i, text in items]
        self.short = short
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, pattern) in enumerate(self.items):
            for piece, offset in pattern.pieces():
                places.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def leaks(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item, distance, start, end) of each item's best occurrence in a text; positions are in the normalised text."""
        clean = normalize(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.automaton.iter(clean):
            for n, offset in where:
                pattern = self.items[n][1]
                if len(pattern.text) < self.short and not _bounded(clean, end + 1 - length, end + 1):
                    continue
                lo = end + 1 - length - offset - pattern.budget
                hi = lo + len(pattern.text) + 2 * pattern.budget
                own = windows.setdefault(n, [])
                if own and lo <= own[-1][1] and own[-1][0] <= hi:
                    own[-1] = [min(lo, own[-1][0]), max(hi, own[-1][1])]
                else:
                    own.append([lo, hi])
        found = []
        for n, spans in windows.items():
            item, pattern = self.items[n]
            best = None
            for lo, hi in spans:
                lo = max(lo, 0)
                hit = pattern.best(clean[lo:hi])
                if hit and (best is None or (hit[0], lo + hit[1]) < best[:2]):
                    best = (hit[0], lo + hit[1], lo + hit[2])
            if best:
                found.append((item, *best))
        return sorted(found, key=lambda x: (x[2], x[3], str(x[0])))


def _chunks(items: DataFrame, limit: int) -> Iterator[list[tuple[object, str]]]:
    """Normalised items in chunks of at most ``limit`` characters, fetched a partition at a time; equal rows once."""
    chunk, size = [], 0
    for row in items.dropDuplicates().toLocalIterator():
        text = normalize(row["text"])
        if not text:
            continue
        if chunk and size + len(text) > limit:
            yield chunk
            chunk, size = [], 0
        chunk.append((row["item"], text))
        size += len(text)
    if chunk:
        yield chunk


def find_leaks(
    docs: DataFrame,
    chunk: list[tuple[object, str]],
    item_type: T.DataType,
    *,
    carry: Column,
    text_col: str = "text",
    rate: float = 0.08,
    short_chars: int = 20,
) -> DataFrame:
    """(carried, leaks), a row per document in input order, for one chunk of normalised items.

    ``carried`` is what goes along (an id, or a struct of the whole row); ``leaks`` has a struct (item, distance, start, end)
    for every item of the chunk that occurs with at most ``rate`` edits a character (short ones: none): its best occurrence.
    """
    spark = docs.sparkSession
    rows = docs.select(carry.alias("carried"), readable(text_col).alias("text"))
    leak = T.StructType().add("item", item_type).add("distance", T.IntegerType()).add("start", T.IntegerType()).add("end", T.IntegerType())
    schema = T.StructType([rows.schema["carried"], T.StructField("leaks", T.ArrayType(leak))])
    arrow = spark.createDataFrame([], T.StructType([schema["leaks"]])).toArrow().schema.field(0).type
    held = spark.sparkContext.broadcast(chunk)

    def run(batches):
        matcher = Matcher(held.value, rate, short_chars)
        for batch in batches:
            for part in slices(batch, 4 << 20):
                found = [[dict(zip(("item", "distance", "start", "end"), x)) for x in matcher.leaks(t)] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("carried"), pa.array(found, arrow)], names=["carried", "leaks"])

    return rows.mapInArrow(run, schema)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = 0.08,
    short_chars: int = 20,
    chunk_chars: int = 1_000_000,
) -> DataFrame:
    """(id, item, distance, start, end): one row for each document and each test item that occurs in it.

    Positions are in the normalised text. Items under ``short_chars`` normalised characters must occur unchanged, as whole
    words; items that normalise to nothing, null and empty texts match nothing. Items with equal texts are all reported, equal item rows once, repeated
    documents each. An empty table on either side gives an empty result. Other columns are ignored.
    """
    chosen = items.select(F.col(item_col).alias("item"), readable(item_text_col).alias("text"))
    kind = chosen.schema["item"].dataType
    out = None
    for chunk in _chunks(chosen, chunk_chars) if items.head(1) else ():
        found = find_leaks(docs, chunk, kind, carry=F.col(id_col), text_col=text_col, rate=rate, short_chars=short_chars)
        rows = found.select("carried", F.explode("leaks").alias("leak")).select(
            F.col("carried").alias(id_col), F.col("leak.item").alias(item_col), "leak.distance", "leak.start", "leak.end"
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        empty = T.StructType([docs.select(F.col(id_col).alias(id_col)).schema[0], T.StructField(item_col, kind)])
        out = docs.sparkSession.createDataFrame([], empty.add("distance", T.IntegerType()).add("start", T.IntegerType()).add("end", T.IntegerType()))
    return out


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = 0.08,
    short_chars: int = 20,
    chunk_chars: int = 1_000_000,
) -> DataFrame:
    """The documents, with all their columns, in which no test item occurs; cases as in ``contaminated``."""
    chosen = items.select(F.col(item_col).alias("item"), readable(item_text_col).alias("text"))
    kept = docs
    for chunk in _chunks(chosen, chunk_chars):
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        found = find_leaks(kept, chunk, chosen.schema["item"].dataType, carry=whole, text_col=text_col, rate=rate, short_chars=short_chars)
        kept = found.filter(F.size("leaks") == 0).select("carried.*")
    return kept
