"""The text of agent runs without gathering a run: its lines, and fixed-size segments, as rows.

``findings.accumulate_text`` makes one value of a run. Here running sums over the parts of a run say where each part stands
(in lines, in characters), and only what belongs to one line or one segment is put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.arrays import explode_once
from auditloom.functions.ordered import bucketed_lag, bucketed_running_sum
from auditloom.functions.text import TEXT_BREAK, strip
from auditloom.session import cut_lineage

_ORDER = ["event_no", "part_no"]


def _parts(events: DataFrame, events_per_bucket: int) -> DataFrame:
    """Non-empty text parts (report_id, event_no, part_no, text, span)."""
    parts = events.select("report_id", "event_no", F.posexplode("parts").alias("part_no", "part")).select(
        "report_id", "event_no", "part_no", F.col("part.text").alias("text"), F.floor(F.col("event_no") / events_per_bucket).alias("span")
    )
    return parts.filter(F.coalesce("text", F.lit("")) != "")


def _joined(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of equal keys put together in order."""
    gathered = F.array_sort(F.collect_list(F.struct(*_ORDER, "piece")))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(gathered, lambda p: p["piece"]), "").alias("text"))


def run_lines(events: DataFrame, events_per_bucket: int = 4096) -> DataFrame:
    """(report_id, line_no, code): the lines of each run's text, as ``report_lines(accumulate_text(events))`` gives them.

    ``events`` has ``report_id, event_no, parts array<struct<text>>``. A part adds its line breaks to a running count; a
    break that two parts share (one ends with a carriage return, the next begins with a line feed) counts once. Only the
    pieces of one line meet in a task. Runs without text have no lines.
    """
    parts = _parts(events, events_per_bucket).withColumn("end", F.right("text", F.lit(1)))
    parts = bucketed_lag(parts, ["report_id"], _ORDER, "end", F.col("span"), "before")
    shared = F.coalesce(F.col("before") == "\r", F.lit(False)) & F.col("text").startswith("\n")
    body = F.when(shared, F.substring("text", 2, 2**31 - 1)).otherwise(F.col("text"))
    split = cut_lineage(parts.select("report_id", *_ORDER, "span", F.split(body, TEXT_BREAK, -1).alias("pieces")))
    breaks = F.size("pieces").cast("long") - 1
    counted = bucketed_running_sum(split, ["report_id"], _ORDER, breaks, F.col("span"), "until")
    pieces = explode_once(counted.withColumn("first", F.col("until") - breaks), ["report_id", *_ORDER, "first"], F.col("pieces"), "piece", "pos")
    lines = _joined(pieces.withColumn("line_no", F.col("first") + F.col("pos")), ["report_id", "line_no"])
    last = counted.groupBy("report_id").agg(F.max("until").alias("last"))
    whole = lines.join(last, "report_id").filter((F.col("line_no") < F.col("last")) | (F.col("text") != ""))
    return whole.select("report_id", "line_no", strip(F.col("text")).alias("code"))


def text_segments(events: DataFrame, size: int = 1 << 20, events_per_bucket: int = 4096) -> DataFrame:
    """(report_id, segment_no, text): each run's text in segments of ``size`` characters, the last one shorter.

    In order they are the run's text; a writer that takes them by ``report_id, segment_no`` never holds a run.
    """
    parts = _parts(events, events_per_bucket).withColumn("length", F.length("text").cast("long"))
    placed = bucketed_running_sum(parts, ["report_id"], _ORDER, F.col("length"), F.col("span"), "until")
    placed = placed.withColumn("start", F.col("until") - F.col("length"))
    numbers = F.sequence(F.floor(F.col("start") / size), F.floor((F.col("until") - 1) / size))
    pieces = placed.select("report_id", *_ORDER, "start", "text", F.explode(numbers).alias("segment_no"))
    lo = F.greatest(F.col("segment_no") * size, F.col("start"))
    length = (F.col("segment_no") + 1) * size - lo
    piece = F.col("text").substr((lo - F.col("start") + 1).cast("int"), length.cast("int"))
    return _joined(pieces.withColumn("piece", piece), ["report_id", "segment_no"])

