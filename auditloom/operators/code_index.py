"""A trigram index over file contents, so that searches read only files that can match.

The index is kept by content, not by file: each different content is cut into its trigrams (lower-cased) once, whenever it
first appears, and files only point to it. A load therefore tokenises changed and new contents only, and copies cost a row.
A literal can only occur where all its trigrams do; what the index proposes is searched by the plain operators, so results
are theirs. Literals of fewer than three characters, literals with line breaks and rules without literals fall back to all
contents.

Folders of an index, one of each a load (a load that is run again writes the same folders):

    files/load=N      repo, path, digest and size of all files of that load
    contents/load=N   digest, content of those that no earlier load has, numbered
    postings/load=N   trigram and the numbers of the same that have it, by bucket of the trigram

Postings are lists: a row holds the contents of one slice of 32,768 numbers, as offsets in it, so a content costs two bytes a
different trigram before compression. A search sends the lists of the trigrams it asks for to the tasks of their slices, turns
them into one bit a content there, and filters the contents with that, without shuffling them.

A load does not shuffle contents that no other file and no earlier load has: bitmaps over hashes of the digests tell them
apart, and only what they leave open is grouped by its digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.lookup import inline_table
from auditloom.functions.rules import Rule
from auditloom.operators.scan import keyword_matches, scan, split_lines

_FILES = "repo string, path string, digest string"
_CONTENTS = "digest string, content string, slice bigint, place int"
_LISTS = "trigram string, slice bigint, places array<smallint>"
_POSTINGS = f"{_LISTS}, bucket int"
_SLICE = 32_768  # the bits of one bitmap of Spark's
_CHARS = 4_000_000  # of texts that are cut into trigrams at once
_BYTES = 2**25  # of contents that are numbered in a task at least: slices are to be full
_MARKS = 2_048  # bitmaps, 8 MB, over the hashes of a load's digests


def trigrams(literal: str) -> set[str]:
    """The trigrams that a text with ``literal`` must have; empty if they say nothing."""
    folded = literal.lower()
    if "\n" in folded or "\r" in folded:
        return set()
    return {folded[i : i + 3] for i in range(len(folded) - 2)}


class CodeIndex:
    """An index in ``folder``; ``load`` is the last one written that it shows, counted from 0."""

    def __init__(self, spark: SparkSession, folder: str, load: int, buckets: int = 64):
        self.spark, self.folder, self.load, self.buckets = spark, folder, load, buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{name}/load={i}" for i in range(self.load + 1)]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*paths)

    @property
    def files(self) -> DataFrame:
        return self.spark.read.schema(_FILES).parquet(f"{self.folder}/files/load={self.load}")

    @property
    def contents(self) -> DataFrame:
        """Each content that a file of this load has, once."""
        # contents of the first load that none has changed since are all shown
        return self._chosen(self._shown()) if self.load else self._read("contents", _CONTENTS).select("digest", "content")

    @property
    def postings(self) -> DataFrame:
        return self._read("postings", _POSTINGS)

    def _shown(self) -> DataFrame:
        """(load, slice, bits) of the contents that a file of this load has."""
        numbers = self._read("contents", _CONTENTS).select("load", "slice", "place", "digest")
        shown = numbers.join(self.files.select("digest").distinct(), "digest", "left_semi")
        return shown.groupBy("load", "slice").agg(F.bitmap_construct_agg("place").alias("bits"))

    def _chosen(self, bits: DataFrame) -> DataFrame:
        """(digest, content) of the contents whose bits are set.

        The bitmaps are broadcast, 4 KB for 32,768 contents, so the contents stay where they are.
        """
        numbered = self._read("contents", _CONTENTS).join(F.broadcast(bits), ["load", "slice"])
        return numbered.filter(_bit("bits", "place")).select("digest", "content")

    def bucket(self, trigram):
        return F.pmod(F.xxhash64(trigram), F.lit(self.buckets)).cast("int")

    def with_literal(self, literals: list[str]) -> DataFrame:
        """(load, slice, literal, bits) of contents that have all trigrams of a literal; every literal needs some."""
        wanted = [(t, literal, len(trigrams(literal))) for literal in sorted(set(literals)) for t in sorted(trigrams(literal))]
        asked = inline_table(self.spark, wanted, "trigram string, literal string, size long")
        # few buckets are read, and of them only row groups that can hold a wanted trigram
        names = sorted({t for t, _, _ in wanted})
        buckets = [r[0] for r in inline_table(self.spark, [(t,) for t in names], "t string").select(self.bucket(F.col("t"))).distinct().collect()]
        rows = self.postings.filter(F.col("bucket").isin(buckets) & F.col("trigram").isin(names))
        # lists travel once, as they are; what is made of a slice stays in its task
        lists = rows.select("load", "slice", "trigram", "places").repartition("load", "slice")
        placed = lists.select("load", "slice", "trigram", F.explode("places").alias("place"))
        held = placed.groupBy("load", "slice", "trigram").agg(F.bitmap_construct_agg("place").alias("held"))
        both = held.join(asked, "trigram").groupBy("load", "slice", "literal", "size").agg(F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("held").alias("bits"))
        return both.filter("n = size").select("load", "slice", "literal", "bits")

    def contents_with(self, literals: list[str]) -> DataFrame:
        """Contents that may hold any of the literals; all contents if one of them says nothing."""
        if not all(trigrams(literal) for literal in literals):
            return self.contents
        found = self.with_literal(literals).groupBy("load", "slice").agg(F.bitmap_or_agg("bits").alias("bits"))
        if self.load:
            shown = found.unionByName(self._shown()).groupBy("load", "slice")
            found = shown.agg(F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("bits").alias("bits")).filter("n = 2")
        return self._chosen(found.select("load", "slice", "bits"))

    def _lines(self, contents: DataFrame) -> DataFrame:
        return split_lines(contents)

    def keyword_matches(self, query: str) -> DataFrame:
        """(repo, path, line_no, raw, line) of every line that holds ``query``, ignoring case, as ``scan.keyword_matches``."""
        found = keyword_matches(self._lines(self.contents_with([query])), query)
        return found.join(self.files, "digest").select("repo", "path", "line_no", "raw", "line")

    def scan(self, rules: list[Rule]) -> DataFrame:
        """(repo, path, line_no, rule, content, severity), as ``scan.scan`` on the lines of all files.

        Rules whose literals the index knows run on the contents that have one of them, the others on all.
        """
        known = [r for r in rules if r.needs and all(trigrams(need) for need in r.needs)]
        others = [r for r in rules if r not in known]
        parts = []
        if known:
            parts.append(scan(self._lines(self.contents_with([need for r in known for need in r.needs])), known))
        if others:
            parts.append(scan(self._lines(self.contents), others))
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return found.join(self.files, "digest").select("repo", "path", "line_no", "rule", "content", "severity")


def _bit(bits: str, place: str) -> Column:
    """Whether the bit at ``place`` of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.col(place).cast("int") % 8) == 1


def _hashed(digest: str) -> list[Column]:
    """(mark, at): the bitmap of a digest's hash and the place in it."""
    number = F.pmod(F.xxhash64(digest), F.lit(_SLICE * _MARKS))
    return [F.floor(number / _SLICE).alias("mark"), (number % _SLICE).alias("at")]


def _marks(digests: DataFrame, before: DataFrame) -> DataFrame:
    """(mark, alone, open): bitmaps over the hashes of ``digests``, one row a file, of which no load in ``before`` has one.

    ``alone``: one file has the hash and nothing else does. ``open``: contents of this hash are new, but one at least is a copy
    or shares its hash with another one. Hashes without a new content are in neither.
    """
    files = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).withColumn("old", F.lit(0))
    known = files.unionByName(before.select("digest", F.lit(0).alias("n"), F.lit(1).alias("old")))
    found = known.groupBy("digest").agg(F.sum("n").alias("n"), F.max("old").alias("old")).select(*_hashed("digest"), "n", "old")
    hashes = found.groupBy("mark", "at").agg(F.sum("n").alias("n"), F.max("old").alias("old"), F.bool_or(F.expr("n > 0 AND old = 0")).alias("fresh"))
    alone = F.expr("fresh AND n = 1 AND old = 0")
    return hashes.filter("fresh").groupBy("mark").agg(
        F.bitmap_construct_agg(F.when(alone, F.col("at"))).alias("alone"), F.bitmap_construct_agg(F.when(~alone, F.col("at"))).alias("open")
    )


def _lists(texts: list[str], slice_no: int, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``_LISTS`` of texts in one slice, in the order of their places."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)  # a line break parts two texts
    alphabet = np.flatnonzero(np.bincount(codes))
    n, size = len(texts), len(alphabet)
    if n > 1 and size**3 * n >= 2**63:
        half = n // 2
        yield from _lists(texts[:half], slice_no, places[:half])
        yield from _lists(texts[half:], slice_no, places[half:])
        return
    owner = np.repeat(np.arange(n, dtype=np.int64), [len(t) + 1 for t in texts])[:-2]
    letter = np.searchsorted(alphabet, codes).astype(np.int64)
    grams = (letter[:-2] * size + letter[1:-1]) * size + letter[2:]
    inside = (codes != 10) & (codes != 13)
    pairs = np.sort((grams * n + owner)[inside[:-2] & inside[1:-1] & inside[2:]])
    if not len(pairs):
        return
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    grams, owner = pairs // n, pairs % n
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    found = grams[starts]
    letters = np.stack([alphabet[found // size**2], alphabet[found // size % size], alphabet[found % size]], 1)
    written = letters.astype("<u4").tobytes().decode("utf-32-le")
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([written[i : i + 3] for i in range(0, len(written), 3)], pa.string()),
            pa.array(np.full(len(found), slice_no), pa.int64()),
            pa.ListArray.from_arrays(np.append(starts, len(owner)).astype(np.int32), pa.array(places[owner].astype(np.int16))),
        ],
        names=["trigram", "slice", "places"],
    )


def _posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, place, folded) to rows of ``_LISTS``, some millions of characters at once."""
    for batch in batches:
        texts = batch.column("folded").to_pylist()
        slices, places = batch.column("slice").to_numpy(), batch.column("place").to_numpy()
        first, chars = 0, 0
        for i, text in enumerate(texts):
            if i > first and (slices[i] != slices[first] or chars + len(text) > _CHARS):
                yield from _lists(texts[first:i], slices[first], places[first:i])
                first, chars = i, 0
            chars += len(text)
        if texts:
            yield from _lists(texts[first:], slices[first], places[first:])


def build_index(files: DataFrame, folder: str, load: int = 0, buckets: int = 64) -> CodeIndex:
    """Take in all ``files(repo, path, content)`` of a load; loads are numbered from 0 and written in turn.

    Files that are not in ``files`` any more are gone from the index. A null content counts as empty. Only contents that no
    load before had are tokenised. ``files`` is read three times.
    """
    spark = files.sparkSession
    named = files.select("repo", "path", F.coalesce("content", F.lit("")).alias("content")).withColumn(
        "digest", F.sha2(F.col("content").cast("binary"), 256)
    )
    index = CodeIndex(spark, folder, load, buckets)

    def write(rows: DataFrame, name: str, *by: str) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{folder}/{name}/load={load}")

    write(named.select("repo", "path", "digest", F.octet_length("content").alias("size")), "files")
    size = spark.read.schema("size int").parquet(f"{folder}/files/load={load}").agg(F.sum("size")).first()[0] or 0
    digests = index.files.select("digest")
    before = CodeIndex(spark, folder, load - 1, buckets)._read("contents", _CONTENTS).select("digest") if load else digests.filter(F.lit(False))
    marks = F.broadcast(_marks(digests, before))
    marked = named.select("digest", "content", *_hashed("digest")).join(marks, "mark")
    copies = marked.filter(_bit("open", "at")).select("digest", "content")
    if load:
        copies = copies.join(before, "digest", "left_anti")
    copies = copies.groupBy("digest").agg(F.any_value("content").alias("content"))
    fresh = marked.filter(_bit("alone", "at")).select("digest", "content").unionByName(copies)
    numbered = fresh.coalesce(max(1, size // _BYTES)).withColumn("number", F.monotonically_increasing_id())
    place = (F.col("number") % _SLICE).cast("int").alias("place")
    write(numbered.select("digest", "content", F.expr(f"number DIV {_SLICE}").alias("slice"), place), "contents")
    new = spark.read.schema(_CONTENTS).parquet(f"{folder}/contents/load={load}")
    lists = new.select("slice", "place", F.lower("content").alias("folded")).mapInArrow(_posting_lists, _LISTS)
    # a bucket of many rows is dealt out over several tasks
    dealt = lists.withColumn("bucket", index.bucket(F.col("trigram"))).hint("rebalance", "bucket")
    write(dealt.sortWithinPartitions("bucket", "trigram"), "postings", "bucket")
    return index
