"""Masking on the driver's documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import pii as ops
from auditloom.plans import bridges as b
from auditloom.session import scratch_path

_DOCS_SQL = "SELECT doc_id, source, text FROM @documents"


# Scopes to forget.
_CLEARED_SQL = "SELECT source FROM @documents GROUP BY source HAVING min(doc_id) % 3 = 0"


def _docs(spark, sf):
    return b.run_spread(spark, sf, _DOCS_SQL)


def _masked(spark, sf):
    return ops.mask_pii(_docs(spark, sf))


def _scope(spark, sf):
    return ops.mask_pii_scope(_docs(spark, sf), "source", "doc_id")


def _unmask_scope(spark, sf):
    masked, mapping = _scope(spark, sf)
    return ops.unmask_pii_scope(masked, mapping, "source", "doc_id").select("source", "doc_id", "unmasked")


def _loads(spark, sf):
    """The documents of two languages first, then all: those of the first load are masked again and keep their placeholders."""
    folder = scratch_path(spark, "placeholders")
    docs = _docs(spark, sf).join(b.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    ops.mask_pii_load(docs.filter("lang IN ('en', 'de')"), "source", "doc_id", folder, 0)
    return ops.mask_pii_load(docs, "source", "doc_id", folder, 1)


def _leaks(spark, sf):
    """Whether the known raw values are left in each source's masked documents, per language."""
    raw_values = ["@example.com", "token = \"", "555-"]
    return ops.pii_leak_check(_masked(spark, sf), "source", "masked", raw_values)


QUERIES = {
    "mask_pii": lambda s, d: _masked(s, d).select("doc_id", "masked"),
    "mask_pii_pages": lambda s, d: ops.mask_pii(
        b.run_spread(s, d, "SELECT page_id, html FROM @pages"), "html"
    ).select("page_id", "masked"),
    "pii_mapping": lambda s, d: ops.pii_mapping(_masked(s, d), "doc_id"),
    "unmask_pii": lambda s, d: ops.unmask_pii(_masked(s, d)).select("doc_id", "unmasked"),
    "pii_first_seen_number": lambda s, d: _scope(s, d)[1],
    "mask_pii_scope": lambda s, d: _scope(s, d)[0].select("source", "doc_id", "masked"),
    "unmask_pii_scope": _unmask_scope,
    "mask_pii_load": lambda s, d: _loads(s, d)[0].select("source", "doc_id", "masked"),
    "pii_dictionary": lambda s, d: _loads(s, d)[1],
    "pii_leak_check": _leaks,
    "clear_scope": lambda s, d: ops.clear_scope(
        _scope(s, d)[1], "source", b.run(s, d, _CLEARED_SQL)
    ),
}

_MARK = "chr(65535)"


def _stages(source: str, keys: str, text: str) -> str:
    """CTEs t0..t5: the text after each pattern with the values found before it."""
    parts = [f"t0 AS (SELECT {keys}, {text} AS t FROM {source})"]
    for i, (kind, pattern) in enumerate(ops.PII_PATTERNS):
        group, label = (2, "\\1") if kind == "API_KEY" else (0, "")
        slot = f"'{label}[[' || {_MARK} || '{kind}]]'"
        earlier = "".join(f", v_{k}" for k in ops.PII_TYPES[:i])
        parts.append(
            f"t{i + 1} AS (SELECT {keys}{earlier}, regexp_extract_all(t, {b.sql_text(pattern)}, {group}) AS v_{kind}, "
            f"regexp_replace(t, {b.sql_text(pattern)}, {slot}, 'g') AS t FROM t{i})"
        )
    return ", ".join(parts)


def _sightings(keys: str, row: str) -> str:
    """One row per masked span: pattern order, position, type, value, quoted."""
    arms = []
    for i, kind in enumerate(ops.PII_TYPES):
        quoted = "left(v, 1) IN ('''', '\"')" if kind == "API_KEY" else "false"
        value = "trim(v, '''\"')" if kind == "API_KEY" else "v"
        arms.append(
            f"SELECT {keys}, {i} AS pat, pos, '{kind}' AS pii_type, {value} AS value, {quoted} AS quoted "
            f"FROM (SELECT {keys}, unnest(v_{kind}) AS v, generate_subscripts(v_{kind}, 1) AS pos FROM t5) u"
        )
    return f"seen AS ({' UNION ALL '.join(arms)})"


def _ctes(source: str, keys: str, scope: str, row: str, text: str) -> str:
    """Everything up to the masked text, with one numbering per ``scope``."""
    kinds = "|".join(ops.PII_TYPES)
    slot = f"'\\[\\[' || {_MARK} || '({kinds})\\]\\]'"
    return f"""
        {_stages(source, keys, text)}, {_sightings(keys, row)},
        firsts AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY {scope}, value ORDER BY {row}, pat, pos) = 1),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY {scope}, pii_type ORDER BY {row}, pat, pos) AS n FROM firsts),
        named AS (SELECT {scope}, value, pii_type, n, quoted, '[[' || pii_type || '_' || CAST(n AS VARCHAR) || ']]' AS placeholder FROM numbered),
        pieces AS (SELECT {keys}, string_split_regex(t, '\\[\\[' || {_MARK} || '(?:{kinds})\\]\\]') AS p,
                          regexp_extract_all(t, {slot}, 1) AS k FROM t5),
        flat AS (SELECT {keys}, unnest(p) AS piece, unnest(list_concat(k, [NULL])) AS kind, generate_subscripts(p, 1) AS i FROM pieces),
        nth AS (SELECT *, row_number() OVER (PARTITION BY {keys}, kind ORDER BY i) AS pos FROM flat),
        filled AS (
            SELECT {', '.join('f.' + c for c in keys.split(', '))}, f.i, f.piece || coalesce(m.placeholder, '') AS part
            FROM nth f
            LEFT JOIN seen s ON s.pii_type = f.kind AND s.pos = f.pos AND {' AND '.join(f's.{c} = f.{c}' for c in keys.split(', '))}
            LEFT JOIN named m ON m.value = s.value AND m.{scope} = s.{scope}),
        masked AS (SELECT {keys}, string_agg(part, '' ORDER BY i) AS masked FROM filled GROUP BY {keys})
    """


_DOC = _ctes("documents", "doc_id", "doc_id", "doc_id", "text")
_PAGE = _ctes("pages", "page_id", "page_id", "page_id", "html")
_SRC = _ctes("documents", "source, doc_id", "source", "doc_id", "text")
_LOADED = "(SELECT *, CASE WHEN lang IN ('en', 'de') THEN 0 ELSE 1 END AS later FROM documents) d"
_LOADS = _ctes(_LOADED, "source, doc_id, later", "source", "later, doc_id", "text")
_BY_DOC = _ctes("documents", "source, doc_id", "doc_id", "doc_id", "text")
# Quoted values come back in double quotes, so single quotes around a masked key change.
_BACK = r"""regexp_replace(text, '(?i)((?:key|token|secret|password|passwd|pwd|authentication|auth)(?:\s*[:=]\s*|\s+))[''"]([a-zA-Z0-9_\-\.\~]{8,})[''"]', '\1"\2"', 'g')"""

ORACLE = {
    "mask_pii": f"WITH {_DOC} SELECT doc_id, masked FROM masked",
    "mask_pii_pages": f"WITH {_PAGE} SELECT page_id, masked FROM masked",
    "pii_mapping": f"WITH {_DOC} SELECT doc_id, placeholder, value, pii_type, n, quoted FROM named",
    "unmask_pii": f"SELECT doc_id, {_BACK} AS unmasked FROM documents",
    "pii_first_seen_number": f"WITH {_SRC} SELECT source, value, pii_type, n, quoted, placeholder FROM named",
    "clear_scope": f"WITH {_SRC} SELECT source, value, pii_type, n, quoted, placeholder FROM named "
    f"WHERE source NOT IN ({b.for_duckdb(_CLEARED_SQL)})",
    "mask_pii_scope": f"WITH {_SRC} SELECT source, doc_id, masked FROM masked",
    "unmask_pii_scope": f"SELECT source, doc_id, {_BACK} AS unmasked FROM documents",
    "mask_pii_load": f"WITH {_LOADS} SELECT source, doc_id, masked FROM masked",
    "pii_dictionary": f"WITH {_LOADS} SELECT source, value, pii_type, n, quoted, placeholder FROM named",
    "pii_leak_check": f"""
        WITH {_BY_DOC}
        SELECT source, bool_or(contains(masked, '@example.com') OR contains(masked, 'token = "') OR contains(masked, '555-')) AS leaked
        FROM masked GROUP BY source
    """,
}
