"""Dependency manifests: licence, look-alike packages, unstable pins, vulnerable versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.lookup import inline_table
from auditloom.functions.arrays import explode_once, let
from auditloom.functions.text import null_if_empty
from auditloom.operators.scan import base_name

# Manifest file names. ``requirements-*.txt`` counts as well.
MANIFEST_NAMES = [
    "requirements.txt", "pyproject.toml", "uv.lock", "pom.xml", "build.gradle", "package.json",
    "build.gradle.kts", "ivy.xml", "build.sbt", "poetry.lock", "Pipfile", "Pipfile.lock",
    "setup.py", "setup.cfg", "Package.swift", "Package.resolved", "Podfile", "Podfile.lock",
    "Cartfile", "Cartfile.private", "Cartfile.resolved", "go.mod", "go.sum", "Gopkg.lock",
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock",
]
PYTHON_MANIFESTS = [
    "requirements.txt", "pyproject.toml", "uv.lock", "poetry.lock", "Pipfile", "Pipfile.lock",
    "setup.py", "setup.cfg",
]
JVM_MANIFESTS = ["pom.xml", "build.gradle", "build.gradle.kts", "ivy.xml", "build.sbt"]
NODE_MANIFESTS = [
    "package.json", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock",
]
TYPOSQUAT_NAMES = ["pythoon", "reqeusts", "lodas", "exprees", "cryptographhy", "django-secure-config"]

# Ecosystem, library, first safe version, advisory, title, severity.
VULNERABLE_VERSIONS = [
    ("python", "pyjwt", "2.4.0", "CVE-2022-29217", "PyJWT key confusion bypass", "CRITICAL"),
    ("python", "requests", "2.31.0", "CVE-2023-32681", "Requests Proxy-Authorization leak", "HIGH"),
    ("python", "django", "4.0.7", "CVE-2022-34265", "Django SQL Injection", "CRITICAL"),
    ("python", "flask", "2.2.0", "CVE-2023-30861", "Flask session signing evasion", "HIGH"),
    ("python", "cryptography", "39.0.1", "CVE-2023-23931", "Cryptography cipher bypass", "HIGH"),
    ("python", "urllib3", "1.26.17", "CVE-2023-43804", "urllib3 Proxy-Authorization leak", "HIGH"),
    ("python", "jinja2", "3.1.3", "CVE-2024-22143", "Jinja2 sandbox escape", "HIGH"),
    ("node", "lodash", "4.17.21", "CVE-2020-8203", "Lodash Prototype Pollution", "HIGH"),
    ("node", "express", "4.19.2", "CVE-2024-43796", "Express open redirect / path traversal", "HIGH"),
    ("node", "axios", "1.6.0", "CVE-2023-45857", "Axios SSRF header leak", "HIGH"),
    ("node", "jsonwebtoken", "9.0.0", "CVE-2022-23540", "jsonwebtoken signature validation bypass", "CRITICAL"),
    ("node", "mongoose", "7.0.0", "CVE-2023-26117", "Mongoose prototype pollution", "HIGH"),
    ("node", "semver", "7.5.2", "CVE-2023-35116", "Semver ReDoS vulnerability", "HIGH"),
    ("jvm", "log4j-core", "2.17.0", "CVE-2021-44228", "Log4Shell RCE", "CRITICAL"),
    ("jvm", "spring-beans", "5.3.18", "CVE-2022-22965", "Spring4Shell RCE", "CRITICAL"),
    ("jvm", "spring-core", "5.3.18", "CVE-2022-22965", "Spring4Shell RCE", "CRITICAL"),
    ("jvm", "jackson-databind", "2.13.4", "CVE-2022-42003", "Jackson-databind deserialization RCE", "CRITICAL"),
    ("jvm", "commons-text", "1.10.0", "CVE-2022-42889", "Text4Shell RCE", "CRITICAL"),
]

# Licence and pin patterns, and how each ecosystem writes a pinned version.
# Each of the three licence spellings has its own group, so the name is always reported.
_COPYLEFT = "(?:GPL|AGPL|LGPL|MPL)"
LICENSE_PATTERN = (
    rf"""(?i)(?:"license"\s*:\s*"([^"]*{_COPYLEFT}[^"]*)"|<license>([^<]*{_COPYLEFT}[^<]*)</license>"""
    rf"""|license\s*=\s*['"]([^'"]*{_COPYLEFT}[^'"]*)['"])"""
)
UNSTABLE_PATTERN = r"""(?i)(?:==|:|"|\b)0\.[0-9]+\.[0-9]+"""
PIN_PATTERNS = {
    "python": r"(?i){lib}==([0-9\.]+)",
    "jvm": r"<artifactId>{lib}</artifactId>\s*<version>([0-9\.]+)</version>|{lib}:([0-9\.]+)",
    "node": r'"{lib}"\s*:\s*"[~\^]?([0-9\.]+)"',
}

FINDING_COLUMNS = ["path", "dependency", "version", "rule", "severity", "check_order"]


def is_manifest(path: Column) -> Column:
    name = base_name(path)
    return name.isin(MANIFEST_NAMES) | (name.startswith("requirements-") & name.endswith(".txt"))


def manifest_ecosystem(path: Column) -> Column:
    """python, jvm or node; NULL for manifests that get only the generic checks."""
    name = base_name(path)
    python = name.isin(PYTHON_MANIFESTS) | (name.startswith("requirements-") & name.endswith(".txt"))
    return F.when(python, "python").when(name.isin(JVM_MANIFESTS), "jvm").when(name.isin(NODE_MANIFESTS), "node")


def manifests(files: DataFrame) -> DataFrame:
    return files.filter(is_manifest(F.col("path")))


def _finding(dependency, version, rule, severity, order):
    return [
        "path", dependency.alias("dependency"), version.alias("version"), rule.alias("rule"),
        severity.alias("severity"), F.lit(order).alias("check_order"),
    ]


def _licence(content: Column) -> Column:
    return F.coalesce(*[null_if_empty(F.regexp_extract(content, LICENSE_PATTERN, g)) for g in (1, 2, 3)])


def _licence_rule(name: Column) -> Column:
    return F.concat(
        F.lit("SCA License Risk: Copyleft license '"), name,
        F.lit("' detected. This may require disclosing proprietary source code."),
    )


def _lookalikes(lowered: Column, names: list[str] | None = None) -> Column:
    return F.array_compact(F.array(*[F.when(lowered.contains(n), F.lit(n)) for n in names or TYPOSQUAT_NAMES]))


def _lookalike_rule(name: Column) -> Column:
    return F.concat(
        F.lit("SCA Malicious Package: Potential typosquatting/dependency confusion attack targeting '"), name, F.lit("'")
    )


def _unstable(content: Column) -> Column:
    return null_if_empty(F.regexp_extract(content, UNSTABLE_PATTERN, 0))


def _unstable_rule(pin: Column) -> Column:
    return F.concat(F.lit("SCA Outdated Dependency: Pinned to unstable/pre-1.0.0 version '"), pin, F.lit("'"))


def license_risk(files: DataFrame) -> DataFrame:
    """First copyleft licence of each manifest."""
    return (
        files.withColumn("license", _licence(F.col("content")))
        .filter(F.col("license").isNotNull())
        .select(*_finding(F.lit("multiple"), F.lit("N/A"), _licence_rule(F.col("license")), F.lit("HIGH"), 1))
    )


def typosquat_hits(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Each look-alike package name that occurs anywhere in a manifest."""
    lowered = files.withColumn("__lowered", F.lower("content"))
    return explode_once(lowered, ["path"], _lookalikes(F.col("__lowered"), names), "name").select(
        *_finding(F.col("name"), F.lit("N/A"), _lookalike_rule(F.col("name")), F.lit("CRITICAL"), 2)
    )


def unstable_pin(files: DataFrame) -> DataFrame:
    """First pre-1.0 version of each manifest, with the character that introduces it."""
    return (
        files.withColumn("pin", _unstable(F.col("content")))
        .filter(F.col("pin").isNotNull())
        .select(*_finding(F.lit("multiple"), F.col("pin"), _unstable_rule(F.col("pin")), F.lit("INFO"), 3))
    )


def _pins(known: list[tuple[str, str]]) -> Column:
    """(library, version) of the known libraries; needs the columns content, ecosystem and __lowered."""

    def pinned(ecosystem: str, library: str) -> Column:
        pattern = PIN_PATTERNS[ecosystem].format(lib=library)
        groups = (1, 2) if ecosystem == "jvm" else (1,)
        version = F.coalesce(*[null_if_empty(F.regexp_extract("content", pattern, g)) for g in groups])
        asked = (F.col("ecosystem") == ecosystem) & F.col("__lowered").contains(library)
        return F.when(asked, F.struct(F.lit(library).alias("library"), version.alias("version")))

    return F.filter(F.array(*[pinned(e, lib) for e, lib in known]), lambda pin: pin["version"].isNotNull())


def _staged(files: DataFrame) -> DataFrame:
    return files.withColumns({"ecosystem": manifest_ecosystem(F.col("path")), "__lowered": F.lower("content")})


def dependency_versions(files: DataFrame, libraries: list[tuple[str, str]] | None = None) -> DataFrame:
    """First pinned version of every known library of the manifest's ecosystem."""
    known = libraries or [(row[0], row[1]) for row in VULNERABLE_VERSIONS]
    staged = _staged(files).filter(F.col("ecosystem").isNotNull())
    return explode_once(staged, ["path", "ecosystem"], _pins(known), "pin").select(
        "path", "ecosystem", "pin.library", "pin.version"
    )


def version_parts(version: Column) -> Column:
    digits = F.filter(F.split(version, r"\."), lambda part: part.rlike(r"^[0-9]+$"))
    return F.transform(digits, lambda part: part.try_cast("bigint"))


def version_lt(version: Column, fixed: Column) -> Column:
    """Numeric comparison part by part; non-numeric parts are skipped, missing ones count as 0."""
    left, right = version_parts(version), version_parts(fixed)
    width = F.greatest(F.size(left), F.size(right))

    def padded(parts: Column) -> Column:
        return F.concat(parts, F.array_repeat(F.lit(0).cast("bigint"), width - F.size(parts)))

    return F.coalesce(padded(left) < padded(right), F.lit(False))


def vulnerable_versions(spark: SparkSession) -> DataFrame:
    return inline_table(
        spark,
        VULNERABLE_VERSIONS,
        "ecosystem STRING, library STRING, fixed STRING, advisory STRING, title STRING, advisory_severity STRING",
    )


def cve_hits(pins: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pins below the first safe version. The size of ``ranges`` decides how Spark joins."""
    return pins.join(ranges, ["ecosystem", "library"]).filter(
        version_lt(F.col("version"), F.col("fixed"))
    )


def cve_range_join(files: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    ranges = ranges if ranges is not None else vulnerable_versions(files.sparkSession)
    rule = F.format_string("SCA Vulnerable Dependency: %s (%s)", F.col("title"), F.col("advisory"))
    return cve_hits(dependency_versions(files), ranges).select(
        *_finding(F.col("library"), F.col("version"), rule, F.col("advisory_severity"), 4)
    )


def advisory_enrichment(files: DataFrame, advisories: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """A second finding for each vulnerable pin whose library has a row in ``advisories``.

    ``advisories`` has ``library, cve, name, severity``.
    """
    ranges = ranges if ranges is not None else vulnerable_versions(files.sparkSession)
    rule = F.format_string("SCA Premium Zero-Day: %s (%s) via L402 AP2", F.col("name"), F.col("cve"))
    hits = cve_hits(dependency_versions(files), ranges).select("path", "library", "version")
    return hits.join(advisories, "library").select(
        *_finding(F.col("library"), F.col("version"), rule, F.col("severity"), 5)
    )


def all_findings(files: DataFrame, advisories: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """All manifest checks, numbered in their reporting order, in one pass over the manifests.

    Each manifest yields one array: the findings of the three text checks, and its pins. A pin becomes a finding where a
    range holds it, and a second one for each advisory on its library.
    """
    ranges = ranges if ranges is not None else vulnerable_versions(files.sparkSession)

    def found(dependency: Column, version: Column, rule: Column, severity: str, order: int, ecosystem: Column | None = None) -> Column:
        return F.struct(
            dependency.alias("dependency"), version.alias("version"), rule.alias("rule"), F.lit(severity).cast("string").alias("severity"),
            F.lit(order).alias("check_order"), (F.lit(None).cast("string") if ecosystem is None else ecosystem).alias("ecosystem"),
        )

    content, none = F.col("content"), F.lit("N/A")
    checks = F.concat(
        let(_licence(content), lambda v: F.when(v.isNotNull(), F.array(found(F.lit("multiple"), none, _licence_rule(v), "HIGH", 1))).otherwise(F.array())),
        F.transform(_lookalikes(F.col("__lowered")), lambda v: found(v, none, _lookalike_rule(v), "CRITICAL", 2)),
        let(_unstable(content), lambda v: F.when(v.isNotNull(), F.array(found(F.lit("multiple"), v, _unstable_rule(v), "INFO", 3))).otherwise(F.array())),
        F.transform(
            _pins([(row[0], row[1]) for row in VULNERABLE_VERSIONS]),
            lambda p: found(p["library"], p["version"], F.lit(None).cast("string"), None, 4, F.col("ecosystem")),
        ),
    )
    rows = explode_once(_staged(files), ["path"], checks, "f").select("path", "f.*")
    # text checks have no ecosystem, so they meet no range
    held = rows.join(ranges.withColumnRenamed("library", "dependency"), ["ecosystem", "dependency"], "left").filter(
        F.col("ecosystem").isNull() | version_lt(F.col("version"), F.col("fixed"))
    )
    twice = held.withColumn("check_order", F.explode(F.when(F.col("ecosystem").isNull(), F.array("check_order")).otherwise(F.array(F.lit(4), F.lit(5)))))
    more = advisories.select(
        F.col("library").alias("dependency"), F.lit(5).alias("check_order"), F.col("cve"), F.col("name"), F.col("severity").alias("premium_severity"),
        F.lit(True).alias("premium"),
    )
    range_rule = F.format_string("SCA Vulnerable Dependency: %s (%s)", F.col("title"), F.col("advisory"))
    premium = F.format_string("SCA Premium Zero-Day: %s (%s) via L402 AP2", F.col("name"), F.col("cve"))
    order = F.col("check_order")
    return (
        twice.join(more, ["dependency", "check_order"], "left")
        .filter((order < 5) | F.col("premium"))
        .select(
            "path", "dependency", "version",
            F.when(order < 4, F.col("rule")).when(order == 4, range_rule).otherwise(premium).alias("rule"),
            F.when(order < 4, F.col("severity")).when(order == 4, F.col("advisory_severity")).otherwise(F.col("premium_severity")).alias("severity"),
            "check_order",
        )
    )
