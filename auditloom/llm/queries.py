"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import (
    chat_format,
    compression_quality,
    crf_language,
    decontamination,
    interpolated_lm,
    periodic_runs,
    simhash_trie,
    source_mixing,
    spelling_permuterm,
    suffix_dedup,
    topk_search,
    toxicity_gru,
    warc_zstd,
)
from auditloom.llm.common import fold, table


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = crf_language.fit(docs, fold(F.col("doc_id"), 5) != 0)
    return crf_language.identify(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "n_words"
    )


def op2_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = fold(F.col("doc_id"), 10)
    part = F.when(remainder == 0, interpolated_lm.UNSEEN).when(remainder == 1, interpolated_lm.DELETED).otherwise(interpolated_lm.MAIN)
    scored = interpolated_lm.interpolated_scores(table(spark, sf_dir, "documents"), part)
    return scored.select(
        "doc_id",
        (F.col("part") == interpolated_lm.UNSEEN).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    records = warc_zstd.read_archives(spark, warc_zstd.write_archives(pages), payloads=False)
    return records.select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        "problem",
    )


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') "
        "AS t(conv_id, turn, role, text)"
    )
    return chat_format.read_back(chat_format.format_turns(rows.unionByName(extra)), ordered=True)


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = compression_quality.fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return compression_quality.score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "difference",
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        F.col("carried").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.topk_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_spelling_permuterm(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling_permuterm.letter_runs(table(spark, sf_dir, "documents"))
    words = runs.select(spelling_permuterm.lose_letters(runs, 31).alias("word"))
    return spelling_permuterm.spelling_variants(spelling_permuterm.word_counts(words))


def op12_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity_gru.fit(docs, labels, fold(F.col("doc_id"), 4) != 2)
    return toxicity_gru.score(docs, net).select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "logit",
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", periodic_runs.repeat_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.periodic_runs(planted)
    # runs come by start, then period, so the first of equal ratios stays
    steeper = lambda a, r: r["length"] * a["period"] > a["length"] * r["period"]
    first = F.get("runs", F.lit(0))
    best = F.aggregate("runs", first, lambda a, r: F.when(steeper(a, r), r).otherwise(a))
    comma, end = F.lit(","), F.lit("\n")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), comma, r["length"].cast("string"), comma, r["period"].cast("string"), end))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
        "n_words",
    )


QUERIES = {
    "op1_crf_language": op1_crf_language,
    "op2_interpolated_lm": op2_interpolated_lm,
    "op3_warc_zstd": op3_warc_zstd,
    "op4_source_mixing": op4_source_mixing,
    "op5_chat_format": op5_chat_format,
    "op6_compression_quality": op6_compression_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_topk_search": op9_topk_search,
    "op10_simhash_trie": op10_simhash_trie,
    "op11_spelling_permuterm": op11_spelling_permuterm,
    "op12_toxicity_gru": op12_toxicity_gru,
    "op13_periodic_runs": op13_periodic_runs,
}

_CONTROLS = r"<s>|\[INST\]|\[/INST\]|\[OUT\]|</s>|\[SYS\]|\[/SYS\]|\[ROLE\]|\[/ROLE\]|\[BODY\]|\[/BODY\]"

ORACLE = {
    "op3_warc_zstd": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS n, sha256(body) AS digest FROM p),
        f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
        SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
            CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
        FROM d LEFT JOIN f ON d.digest = f.digest
    """,
    "op4_source_mixing": """
        WITH sized AS (
            SELECT doc_id, source,
                CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size,
                CASE WHEN text IS NULL OR text = '' THEN 1.0::DOUBLE ELSE greatest(0.05::DOUBLE, 1::DOUBLE - 5.0::DOUBLE *
                    (length(text) - length(regexp_replace(text, '[%&$#*@{}<>|~^=_]', '', 'g'))) / length(text)::DOUBLE) END AS w,
                (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 1)
                    / 4503599627370496.0::DOUBLE AS u
            FROM documents
        ),
        sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM sums),
        caps AS (SELECT *, rk % 3 + 1 AS wt, 3 * source_size AS cap, (3 * source_size)::DOUBLE / (rk % 3 + 1) AS ratio FROM ranked),
        levels AS (
            SELECT *,
                sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
                sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight,
                row_number() OVER (ORDER BY ratio, rk) AS place
            FROM caps
        ),
        first AS (SELECT place AS p, remaining AS l, weight AS g FROM levels WHERE ratio * weight::DOUBLE > remaining::DOUBLE ORDER BY place LIMIT 1),
        targets AS (
            SELECT source, source_size, CASE WHEN p IS NULL OR place < p THEN cap::DOUBLE ELSE wt * l::DOUBLE / g::DOUBLE END AS target
            FROM levels LEFT JOIN first ON true
        ),
        planned AS (
            SELECT s.*, t.source_size, t.target,
                CASE WHEN t.source_size = 0 THEN 0 ELSE CAST(floor(t.target / t.source_size) AS BIGINT) END AS epochs,
                coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY -ln(u) / w, doc_id, size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, CAST(size * epochs
            + CASE WHEN prior + size / 2.0::DOUBLE <= target - epochs * source_size THEN size ELSE 0 END AS BIGINT) AS taken
        FROM planned
    """,
    "op5_chat_format": rf"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        turns AS (
            SELECT *,
                length(regexp_replace(text, '(\\*)({_CONTROLS})', '\1\1\\\2', 'g'))
                + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 WHEN 'system' THEN 13
                    ELSE 30 + length(regexp_replace(role, '(\\*)({_CONTROLS})', '\1\1\\\2', 'g')) END AS chars
            FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars) + 3 AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id
    """,
    "op9_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20
    """,
    # crc32 has no function in SQL: a table made by its rule, then byte by byte
    "op11_spelling_permuterm": r"""
        WITH RECURSIVE t AS (
            SELECT list_transform(range(256), lambda k: list_reduce(list_concat([k], range(8)), lambda a, b:
                CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS crc
        ),
        runs AS (
            SELECT doc_id, run, count(*) AS copies FROM (
                SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
                FROM documents) r
            WHERE length(run) >= 7 GROUP BY ALL
        ),
        hashed AS (
            SELECT run, copies, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
                    string_split(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run, ''),
                    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6 & 63))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))),
                lambda a, b: xor(a >> 8, crc[CAST(xor(a & 255, b) AS INT) + 1]))) AS h
            FROM runs, t
        ),
        garbled AS (
            SELECT copies, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word
            FROM hashed
        ),
        words AS (SELECT word, CAST(sum(copies) AS BIGINT) AS n FROM garbled WHERE length(word) >= 7 GROUP BY word HAVING sum(copies) >= 2),
        cuts AS (
            SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
            FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words) w
        ),
        near AS (
            SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word
            UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word
        ),
        counted AS (
            SELECT p.word, p.other, o.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near,
                row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS place
            FROM near p JOIN words o ON o.word = p.other
        ),
        formed AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
            FROM words w LEFT JOIN counted c ON c.word = w.word AND place = 1
        ),
        follow AS (
            SELECT word, word AS root, 0 AS step FROM formed
            UNION ALL SELECT f.word, g.form, step + 1 FROM follow f JOIN formed g ON g.word = f.root WHERE g.form IS NOT NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, step) AS root FROM follow GROUP BY word) r USING (word)
    """,
}
