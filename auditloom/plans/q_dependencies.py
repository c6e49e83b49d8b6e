"""Manifest checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import dependencies as ops
from auditloom.operators import version_ranges
from auditloom.operators.scan import file_filter
from auditloom.plans import bridges as b
from auditloom.session import cut_lineage


def _files(spark, sf):
    return b.run_spread(spark, sf, b.MANIFESTS_SQL)


def _manifests(spark, sf):
    return ops.manifests(file_filter(_files(spark, sf)))


def _advisories(spark, sf):
    """One advisory per supplier whose key names a known library, the least key for each library."""
    names = F.array(*[F.lit(row[1]) for row in ops.VULNERABLE_VERSIONS])
    supplier = b.table(spark, sf, "supplier")
    library = F.element_at(names, (F.col("s_suppkey") % len(ops.VULNERABLE_VERSIONS) + 1).cast("int"))
    return supplier.groupBy(library.alias("library")).agg(
        F.format_string("ADV-%d", F.min("s_suppkey")).alias("cve"),
        F.min("s_name").alias("name"),
        F.lit("CRITICAL").alias("severity"),
    )


def _pins(spark, sf):
    return ops.dependency_versions(_manifests(spark, sf))


def _range_hits(spark, sf):
    """Each version that is pinned anywhere with each advisory whose range holds it."""
    versions = cut_lineage(_pins(spark, sf).select("ecosystem", "library", "version").distinct())
    return version_ranges.range_hits(versions, b.run(spark, sf, b.ADVISORY_RANGES_SQL)).drop("severity")


QUERIES = {
    "is_manifest": lambda s, d: _files(s, d).select(
        "path", ops.is_manifest(F.col("path")).alias("manifest")
    ),
    "manifest_ecosystem": lambda s, d: _files(s, d).select(
        "path", ops.manifest_ecosystem(F.col("path")).alias("ecosystem")
    ),
    "license_risk": lambda s, d: ops.license_risk(_manifests(s, d)),
    "typosquat_hits": lambda s, d: ops.typosquat_hits(_manifests(s, d)),
    "unstable_pin": lambda s, d: ops.unstable_pin(_manifests(s, d)),
    "dependency_versions": lambda s, d: ops.dependency_versions(_manifests(s, d)),
    "version_lt": lambda s, d: ops.dependency_versions(_manifests(s, d)).select(
        "path", "library", "version",
        ops.version_lt(F.col("version"), F.lit("2.13.4")).alias("below"),
        ops.version_lt(F.lit("1.26.17"), F.col("version")).alias("above"),
    ),
    "cve_range_join": lambda s, d: ops.cve_range_join(_manifests(s, d)),
    "advisory_enrichment": lambda s, d: ops.advisory_enrichment(_manifests(s, d), _advisories(s, d)),
    "advisory_range_hits": _range_hits,
    "advisory_exposure": lambda s, d: version_ranges.exposure(_pins(s, d), b.run(s, d, b.ADVISORY_RANGES_SQL)),
    "all_findings": lambda s, d: ops.all_findings(_manifests(s, d), _advisories(s, d)),
}


def _names(values) -> str:
    return ", ".join(b.sql_text(v) for v in values)


_NAME = "string_split(path, '/')[-1]"
_REQ = f"({_NAME} LIKE 'requirements-%' AND {_NAME} LIKE '%.txt')"
_IS = f"({_NAME} IN ({_names(ops.MANIFEST_NAMES)}) OR {_REQ})"
_ECO = (
    f"CASE WHEN {_NAME} IN ({_names(ops.PYTHON_MANIFESTS)}) OR {_REQ} THEN 'python' "
    f"WHEN {_NAME} IN ({_names(ops.JVM_MANIFESTS)}) THEN 'jvm' WHEN {_NAME} IN ({_names(ops.NODE_MANIFESTS)}) THEN 'node' END"
)
_FILES = f"files AS ({b.for_duckdb(b.MANIFESTS_SQL)})"
_MAN = f"""man AS (SELECT path, content, {_ECO} AS ecosystem FROM files
    WHERE {_IS} AND NOT regexp_matches(path, '/\\.git/') AND NOT path LIKE '%.lock')"""
_VULN = "vuln(ecosystem, library, fixed, advisory, title, advisory_severity) AS (VALUES " + ", ".join(
    "(" + _names(row) + ")" for row in ops.VULNERABLE_VERSIONS
) + ")"


def _pin(ecosystem: str, library: str) -> str:
    pattern = b.sql_text(ops.PIN_PATTERNS[ecosystem].format(lib=library))
    value = f"nullif(regexp_extract(content, {pattern}, 1), '')"
    if ecosystem == "jvm":
        value = f"coalesce({value}, nullif(regexp_extract(content, {pattern}, 2), ''))"
    return f"{{'library': '{library}', 'eco': '{ecosystem}', 'version': {value}}}"


_PINS = f"""pins AS (
    SELECT path, ecosystem, pin.library AS library, pin.version AS version
    FROM (SELECT path, ecosystem, content, unnest([{', '.join(_pin(r[0], r[1]) for r in ops.VULNERABLE_VERSIONS)}]) AS pin FROM man) x
    WHERE pin.eco = ecosystem AND contains(lower(content), pin.library) AND pin.version IS NOT NULL)"""


def _parts(expression: str) -> str:
    return (
        f"list_transform(list_filter(string_split({expression}, '.'), lambda x: regexp_matches(x, '^[0-9]+$')), "
        "lambda x: CAST(x AS BIGINT))"
    )


def _lt(left: str, right: str) -> str:
    def padded(side: str, other: str) -> str:
        return f"list_resize({_parts(side)}, greatest(len({_parts(side)}), len({_parts(other)})), CAST(0 AS BIGINT))"

    return f"({padded(left, right)} < {padded(right, left)})"


_HITS = f"hits AS (SELECT p.*, v.* EXCLUDE (ecosystem, library) FROM pins p JOIN vuln v USING (ecosystem, library) WHERE {_lt('version', 'fixed')})"
_ADV = f"""adv AS (
    SELECT list_extract([{_names(r[1] for r in ops.VULNERABLE_VERSIONS)}], CAST(s_suppkey % {len(ops.VULNERABLE_VERSIONS)} + 1 AS INT)) AS library,
           'ADV-' || CAST(min(s_suppkey) AS VARCHAR) AS cve, min(s_name) AS name, 'CRITICAL' AS severity
    FROM supplier GROUP BY 1)"""
_LICENSE = b.sql_text(ops.LICENSE_PATTERN)
_LIC = "coalesce(" + ", ".join(f"nullif(regexp_extract(content, {_LICENSE}, {g}), '')" for g in (1, 2, 3)) + ")"
_PIN0 = f"nullif(regexp_extract(content, {b.sql_text(ops.UNSTABLE_PATTERN)}, 0), '')"

_Q1 = f"""
    SELECT path, 'multiple' AS dependency, 'N/A' AS version,
           'SCA License Risk: Copyleft license ''' || {_LIC} || ''' detected. This may require disclosing proprietary source code.' AS rule,
           'HIGH' AS severity, 1 AS check_order FROM man WHERE {_LIC} IS NOT NULL
"""
_Q2 = f"""
    SELECT path, name AS dependency, 'N/A' AS version,
           'SCA Malicious Package: Potential typosquatting/dependency confusion attack targeting ''' || name || '''' AS rule,
           'CRITICAL' AS severity, 2 AS check_order
    FROM (SELECT path, content, unnest([{_names(ops.TYPOSQUAT_NAMES)}]) AS name FROM man) t WHERE contains(lower(content), name)
"""
_Q3 = f"""
    SELECT path, 'multiple' AS dependency, {_PIN0} AS version,
           'SCA Outdated Dependency: Pinned to unstable/pre-1.0.0 version ''' || {_PIN0} || '''' AS rule,
           'INFO' AS severity, 3 AS check_order FROM man WHERE {_PIN0} IS NOT NULL
"""
_Q4 = """
    SELECT path, library AS dependency, version, 'SCA Vulnerable Dependency: ' || title || ' (' || advisory || ')' AS rule,
           advisory_severity AS severity, 4 AS check_order FROM hits
"""
_Q5 = """
    SELECT path, library AS dependency, version, 'SCA Premium Zero-Day: ' || name || ' (' || cve || ') via L402 AP2' AS rule,
           severity, 5 AS check_order FROM hits JOIN adv USING (library)
"""


def _holds(version: str) -> str:
    return f"(introduced IS NULL OR NOT {_lt(version, 'introduced')}) AND (fixed IS NULL OR {_lt(version, 'fixed')})"


_RANGED = f"""ranges AS ({b.for_duckdb(b.ADVISORY_RANGES_SQL)}),
    ranged AS (SELECT r.*, version FROM (SELECT DISTINCT ecosystem, library, version FROM pins) p JOIN ranges r USING (ecosystem, library)
               WHERE {_holds('version')})"""
# the ends that no range holds; versions of one number count once
_FREE = f"""free AS (SELECT ecosystem, library, version AS fixed FROM (SELECT DISTINCT ecosystem, library, fixed AS version FROM ranges WHERE fixed IS NOT NULL) e
    WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.ecosystem = e.ecosystem AND r.library = e.library AND {_holds('version')}))"""


def _sql(body: str) -> str:
    return f"WITH {_FILES}, {_MAN}, {_VULN}, {_PINS}, {_HITS}, {_ADV}, {_RANGED}, {_FREE} {body}"


ORACLE = {
    "is_manifest": _sql(f"SELECT path, {_IS} AS manifest FROM files"),
    "manifest_ecosystem": _sql(f"SELECT path, {_ECO} AS ecosystem FROM files"),
    "license_risk": _sql(_Q1),
    "typosquat_hits": _sql(_Q2),
    "unstable_pin": _sql(_Q3),
    "dependency_versions": _sql("SELECT path, ecosystem, library, version FROM pins"),
    "version_lt": _sql(
        f"SELECT path, library, version, {_lt('version', b.sql_text('2.13.4'))} AS below, "
        f"{_lt(b.sql_text('1.26.17'), 'version')} AS above FROM pins"
    ),
    "cve_range_join": _sql(_Q4),
    "advisory_enrichment": _sql(_Q5),
    "advisory_range_hits": _sql("SELECT ecosystem, library, version, introduced, fixed, advisory FROM ranged"),
    "advisory_exposure": _sql(f"""
        SELECT x.*, (SELECT f.fixed FROM free f WHERE f.ecosystem = x.ecosystem AND f.library = x.library AND {_lt('x.version', 'f.fixed')}
                     ORDER BY {_parts('f.fixed')}, f.fixed LIMIT 1) AS safe_version
        FROM (SELECT ecosystem, library, version, count(*) AS advisories,
                     CASE min(CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END)
                         WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 4 THEN 'LOW' END AS severity
              FROM ranged GROUP BY ALL) x
    """),
    "all_findings": _sql(" UNION ALL ".join([_Q1, _Q2, _Q3, _Q4, _Q5])),
}
