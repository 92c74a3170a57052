"""The vulnerability table: feeds in, upsert, lookups, title search, expiry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus import schemas
from lynceus.operators.advisories import cve_alias
from lynceus.functions.severity import first_cvss_severity
from lynceus.scale import BROADCAST_BYTES, join_lookup

NVD, OSV = "nvd", "osv"

# Fixed values: (ecosystem, package) pairs an advisory sync covers by default.
SEED_PACKAGES = (
    ("npm", "lodash"),
    ("npm", "minimist"),
    ("npm", "node-fetch"),
    ("npm", "axios"),
    ("npm", "express"),
    ("npm", "json5"),
    ("npm", "qs"),
    ("npm", "semver"),
    ("npm", "path-to-regexp"),
    ("npm", "ws"),
    ("PyPI", "Django"),
    ("PyPI", "Flask"),
    ("PyPI", "Pillow"),
    ("PyPI", "cryptography"),
    ("PyPI", "requests"),
    ("PyPI", "PyYAML"),
    ("PyPI", "paramiko"),
    ("PyPI", "sqlalchemy"),
    ("PyPI", "urllib3"),
    ("PyPI", "certifi"),
    ("Go", "github.com/gin-gonic/gin"),
    ("Go", "golang.org/x/crypto"),
    ("Go", "golang.org/x/net"),
    ("Go", "github.com/golang-jwt/jwt"),
    ("Go", "gopkg.in/yaml.v3"),
    ("crates.io", "openssl"),
    ("crates.io", "rustls"),
    ("crates.io", "hyper"),
    ("crates.io", "tokio"),
    ("crates.io", "serde"),
    ("Maven", "org.apache.logging.log4j:log4j-core"),
    ("Maven", "org.springframework:spring-core"),
    ("Maven", "commons-collections:commons-collections"),
    ("Maven", "com.fasterxml.jackson.core:jackson-databind"),
)

def seed_df(spark: SparkSession, pairs=SEED_PACKAGES) -> DataFrame:
    """A constant table, whose size the optimizer knows."""
    quoted = lambda text: "'" + text.replace("'", "\\'") + "'"
    rows = ", ".join(f"({quoted(e)}, {quoted(p)})" for e, p in pairs)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS seeds(ecosystem, package_name)")


def flatten_nvd(feed: DataFrame) -> DataFrame:
    """Incoming rows of NVD documents. ``feed_pos`` is a text that sorts in feed order.

    The English description is preferred, then the first one, then empty text.
    """
    cve = F.col("item.cve")
    texts = cve["descriptions"]
    english = F.filter(texts, lambda d: d["lang"] == "en")
    first_metric = F.get(cve["metrics"]["cvssMetricV31"], F.lit(0))
    return feed.select("feed_pos", F.posexplode("vulnerabilities").alias("n", "item")).select(
        cve["id"].alias("cve_id"),
        F.coalesce(F.lower(first_metric["cvssData"]["baseSeverity"]), F.lit("medium")).alias(
            "severity"
        ),
        F.concat(F.lit("Vulnerability "), cve["id"]).alias("title"),
        F.coalesce(
            F.get(english, F.lit(0))["value"], F.get(texts, F.lit(0))["value"], F.lit("")
        ).alias("description"),
        F.lit(NVD).alias("data_source"),
        F.lit(None).cast("string").alias("ecosystem"),
        F.lit(None).cast("string").alias("package_name"),
        F.concat_ws("|", "feed_pos", F.lpad(F.col("n").cast("string"), 9, "0")).alias("feed_pos"),
    )


def osv_packages(feed: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """One row per OSV record and package it names, optionally only seeded packages."""
    named = (
        feed.select("*", F.explode("affected").alias("hit"))
        .withColumn("ecosystem", F.col("hit.package.ecosystem"))
        .withColumn("package_name", F.col("hit.package.name"))
    )
    if seeds is None:
        return named
    return join_lookup(
        named,
        seeds.select("ecosystem", "package_name").distinct(),
        ["ecosystem", "package_name"],
        "left_semi"
    )


def flatten_osv(feed: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Incoming rows of OSV records, keyed by CVE where an alias names one."""
    return osv_packages(feed, seeds).select(
        cve_alias(F.col("id"), F.col("aliases"), strict=False).alias("cve_id"),
        first_cvss_severity(F.col("severity")).alias("severity"),
        F.format_string("%s (%s@%s)", "id", "package_name", "ecosystem").alias("title"),
        F.coalesce(
            "summary", F.concat(F.lit("Vulnerability in "), F.col("package_name"))
        ).alias("description"),
        F.lit(OSV).alias("data_source"),
        "ecosystem",
        "package_name",
        "feed_pos",
    )


def _field(struct: Column, kind: T.DataType, name: str) -> Column:
    """A field of a feed record, NULL where the feed was read without it."""
    return struct[name] if name in kind.names else F.lit(None).cast("string")


def osv_advisories(feed: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Advisory ranges of OSV records: one row per introduced event, and one per listed version.

    An introduced event is paired with the first fixed or last-affected event after it.
    Ranges of commits are left out, as they hold no versions.
    """
    named = osv_packages(feed, seeds).select(
        F.col("id").alias("advisory_id"),
        cve_alias(F.col("id"), F.col("aliases")).alias("cve_id"),
        "ecosystem",
        "package_name",
        first_cvss_severity(F.col("severity")).alias("severity"),
        "summary",
        "hit",
    )
    hit = named.schema["hit"].dataType
    event = hit["ranges"].dataType.elementType["events"].dataType.elementType
    ranges = named.select("*", F.explode("hit.ranges").alias("range")).where(
        F.coalesce(F.upper("range.type"), F.lit("")) != "GIT"
    )
    events = F.col("range.events")
    starts = ranges.select("*", F.posexplode(events).alias("n", "event")).where("event.introduced IS NOT NULL")
    ends = lambda e: e["fixed"].isNotNull() | _field(e, event, "last_affected").isNotNull()
    end = F.get(F.filter(F.slice(events, F.col("n") + 1, F.size(events)), ends), F.lit(0))
    columns = ("advisory_id", "cve_id", "ecosystem", "package_name", "introduced", "fixed", "last_affected", "severity", "summary")
    rows = starts.withColumns(
        {
            "introduced": F.col("event.introduced"),
            "fixed": end["fixed"],
            "last_affected": F.when(end["fixed"].isNull(), _field(end, event, "last_affected")),
        }
    ).select(*columns)
    if "versions" in hit.names:
        listed = named.select("*", F.explode(F.array_distinct("hit.versions")).alias("introduced")).withColumns(
            {"fixed": F.lit(None).cast("string"), "last_affected": F.col("introduced")}
        )
        rows = rows.unionByName(listed.select(*columns))
    return rows.withColumn("source", F.lit(OSV))


def feed_order(*feeds: DataFrame) -> DataFrame:
    """Feeds appended in the order they are applied; a later feed overwrites."""
    parts = [
        f.withColumn("ord", F.struct(F.lit(i).alias("feed"), F.col("feed_pos").alias("pos")))
        for i, f in enumerate(feeds, start=1)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("feed_pos")


def upsert(table: DataFrame, incoming: DataFrame, now: datetime) -> DataFrame:
    """The table after all incoming rows, keyed by ``cve_id``.

    A new key is inserted. A known key gets description, severity and, from
    OSV rows, ecosystem and package; title, source and creation time keep their
    first value. One aggregate replaces row-by-row updates: stored rows come
    before all feeds, and ``min_by`` and ``max_by`` aggregate before the
    shuffle, so a key repeated in a third of a feed costs one row per task.
    """
    stored = table.select(
        *[f.name for f in schemas.VULNERABILITIES.fields],
        F.struct(F.lit(0).alias("feed"), F.lit("").alias("pos")).alias("ord"),
    )
    moment = F.lit(now).cast("timestamp")
    fresh = incoming.select(
        "cve_id",
        F.lit(None).cast("string").alias("cwe_id"),
        "severity",
        "title",
        "description",
        moment.alias("published_at"),
        moment.alias("last_modified_at"),
        "data_source",
        moment.alias("created_at"),
        moment.alias("updated_at"),
        "ecosystem",
        "package_name",
        "ord",
    )
    first = lambda c: F.min_by(c, "ord").alias(c)
    last = lambda c: F.max_by(c, "ord").alias(c)
    # An NVD row leaves the package columns alone, unless it is the only row.
    owner = F.when(
        (F.col("ord.feed") == 0) | (F.col("data_source") == OSV), F.col("ord")
    )
    package = lambda c: F.max_by(c, owner).alias(c)
    return (
        stored.unionByName(fresh)
        .groupBy("cve_id")
        .agg(
            first("cwe_id"),
            last("severity"),
            first("title"),
            last("description"),
            first("published_at"),
            first("last_modified_at"),
            first("data_source"),
            first("created_at"),
            last("updated_at"),
            package("ecosystem"),
            package("package_name"),
        )
    )


def enrich_titles(
    findings: DataFrame, vulnerabilities: DataFrame, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Findings with the stored title of their CVE where there is one."""
    titles = (
        vulnerabilities.where("cve_id IS NOT NULL")
        .groupBy("cve_id")
        .agg(F.min("title").alias("stored_title"))
    )
    joined = join_lookup(
        findings, titles, ["cve_id"], "left", max_bytes=max_bytes
    )
    return joined.withColumn("title", F.coalesce("stored_title", "title")).select(
        *findings.columns
    )


def by_package(vulnerabilities: DataFrame, packages: DataFrame) -> DataFrame:
    """Rows of the named (ecosystem, package_name) pairs."""
    return join_lookup(
        vulnerabilities,
        packages.select("ecosystem", "package_name").distinct(),
        ["ecosystem", "package_name"],
        "left_semi"
    )


def by_severity(vulnerabilities: DataFrame, *levels: str) -> DataFrame:
    return vulnerabilities.where(F.col("severity").isin(*levels))


def fresh_entries(cache: DataFrame, now: datetime) -> DataFrame:
    """Cached records that have not expired."""
    return cache.where(F.col("expires_at") > F.lit(now))


def ids_to_refresh(wanted: DataFrame, cache: DataFrame, now: datetime) -> DataFrame:
    """Wanted CVE ids without a live cache record."""
    ids = wanted.select("cve_id").where("cve_id IS NOT NULL").distinct()
    return ids.join(fresh_entries(cache, now).select("cve_id"), "cve_id", "left_anti")
