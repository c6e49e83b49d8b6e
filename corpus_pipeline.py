"""The corpus pipeline: five stages over ``documents``, each written to the shared folder before the next one reads it.

    python corpus_pipeline.py SF_DIR OUT_DIR

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that it keeps, with the
columns of ``documents``. The last one returns the mixing plan.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.llm import crf_language, decontamination, simhash_trie, source_mixing, suffix_dedup
from auditloom.llm.common import fold, stored, table

# A document goes if no language has this share of its words.
LEAST_SHARE = 0.4


def names(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a main language; a missing ``lang`` is filled in. Learns from four fifths of the labelled rows."""
    model = crf_language.fit(docs, fold(F.col("doc_id"), 5) != 0)
    whole = docs.select(F.struct(*names(docs)).alias("row"), "text")
    found = crf_language.identify(whole, model, id_col="row")
    kept = found.filter((F.col("lang_pred") != crf_language.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("row", F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred"))).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose SimHashes link (three-word shingles, three bits), keeps the one with the smallest id.

    Rows are told apart by id and text: rows of different groups stay even if their ids are equal or null, and of rows that
    repeat id and text one stays. Null ids come after all others.
    """
    digest = F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 32)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("digest"))
    keyed = docs.select(key.alias("key"), F.struct(*names(docs)).alias("row"))
    found = simhash_trie.near_duplicates(keyed.select("key", F.col("row.text").alias("text")), id_col="key")
    heads = found.select(F.col("component_id").alias("head")).distinct()
    order = W.partitionBy("key").orderBy("row.lang", "row.source", "row.n_chars")
    kept = keyed.join(heads, F.col("key") == F.col("head"), "left_semi").withColumn("n", F.row_number().over(order))
    return kept.filter("n = 1").select("row.*")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes or more that stand in an earlier document; documents that lose all their text go.

    A character of which only a part is cut goes wholly.
    """
    others = F.struct(*[n for n in names(docs) if n != "`text`"])
    carried = F.struct(others.alias("row"), F.col("doc_id").alias("id"), F.col("text").isNull().alias("no_text"))
    cut = suffix_dedup.remove_repeats(docs, carry=carried, whole_chars=True)
    gone = (F.size("removed") > 0) & (F.octet_length("kept") == 0)
    cleaned = cut.filter(~gone).withColumn("text", F.when(~F.col("carried.no_text"), F.decode("kept", "UTF-8")))
    new = {
        "`text`": F.col("text"),
        "`n_chars`": F.when(F.size("removed") == 0, F.col("carried.row.n_chars")).otherwise(F.length("text").cast("long")),
    }
    return cleaned.select(*[new.get(n, F.col(f"carried.row.{n}")).alias(n[1:-1]) for n in names(docs)])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the training mix takes from each document."""
    return source_mixing.mix_sources(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix),
]

# Models, fingerprints and edit distances are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


if __name__ == "__main__":
    from auditloom.session import build_session

    run(build_session(), sys.argv[1]).write.parquet(sys.argv[2])
