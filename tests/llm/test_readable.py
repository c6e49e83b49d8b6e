"""Bytes that are no UTF-8 are read as U+FFFD by every operator that reads texts in Python."""

import pytest
from pyspark.sql import functions as F

from auditloom.llm import chat_format, compression_quality, crf_language, decontamination, interpolated_lm, simhash_trie, suffix_dedup
from auditloom.llm.common import readable


@pytest.fixture(scope="module")
def docs(spark):
    odd = "CAST(concat(unhex('FF41C328'), encode(' good words of a text and more of them \\n', 'utf-8')) AS STRING)"
    return spark.sql(f"SELECT id AS doc_id, IF(id % 2 = 0, {odd}, 'good words of a text and more of them') AS text, 'xx' AS lang FROM range(8)").cache()


def test_invalid_bytes_become_one_character(docs):
    text = docs.filter("doc_id = 0").select(readable("text").alias("t")).first()["t"]
    assert text.startswith("�A�(") and docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("t")).select(readable("t")).first()[0] is None


def test_all_operators_read_them(docs, spark):
    labels = spark.range(8).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    items = docs.selectExpr("doc_id AS item_id", "text")
    assert crf_language.identify(docs, crf_language.fit(docs, F.lit(True))).count() == 8
    assert interpolated_lm.interpolated_scores(docs, F.lit(interpolated_lm.MAIN)).count() == 8
    assert compression_quality.score(docs, compression_quality.fit(docs, labels, F.lit(True))).count() == 8
    assert suffix_dedup.remove_repeats(docs).count() == 8
    assert decontamination.contaminated(docs, items).count() > 8
    found = simhash_trie.near_duplicates(docs).collect()
    assert len(found) == 8 and len({r["component_id"] for r in found if r["doc_id"] % 2 == 0}) == 1
    turns = docs.selectExpr("1L AS conv_id", "doc_id AS turn", "IF(doc_id % 2 = 0, 'user', 'assistant') AS role", "text")
    assert chat_format.read_back(chat_format.format_turns(turns), ordered=True).first()["n_turns"] == 8
