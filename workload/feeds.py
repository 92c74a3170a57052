"""Queries of advisory feeds and the vulnerability table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus import schemas
from lynceus.functions.severity import cvss_severity, first_cvss_severity, parse_level_column, rank_of
from lynceus.operators import vulnerabilities as V
from lynceus.operators.advisories import cve_alias
from lynceus.operators.findings import to_findings
from lynceus.operators.reports import advisory_link
from lynceus.operators.title_search import similar_titles, title_search
from lynceus.plans.advisory_sync import sync_advisories
from lynceus.scale import work_dir
from lynceus.sources.feeds import read_analyzer, read_nvd, read_osv
from lynceus.sources.sinks import write_version
from workload.base import NOW, NOW_SQL, derived, in_parts, query, table

SCORE = """CASE c_custkey % 7 WHEN 0 THEN 'CVSS:3.1/AV:N/AC:L' WHEN 1 THEN '' WHEN 2 THEN concat(CAST(c_custkey % 11 AS STRING), '.0/x')
 ELSE concat(CAST(c_custkey % 10 AS STRING), '.', CAST(c_custkey % 9 AS STRING)) END"""
LEVEL_SQL = "CASE WHEN {n} >= 9 THEN 'critical' WHEN {n} >= 7 THEN 'high' WHEN {n} >= 4 THEN 'medium' ELSE 'low' END"
SCORE_LEVEL = LEVEL_SQL.format(
    n="CASE c_custkey % 7 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN c_custkey % 11 ELSE c_custkey % 10 + (c_custkey % 9) / 10.0 END"
)


@query("cvss_severity", f"SELECT c_custkey, {SCORE_LEVEL} AS severity FROM customer")
def cvss(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey", f"{SCORE} AS score").select(
        "c_custkey", cvss_severity(F.col("score")).alias("severity")
    )


@query(
    "severity_names",
    """SELECT o_orderpriority, level, CAST(CASE level WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS BIGINT) AS rank, count(*) AS n
       FROM (SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS level FROM orders) GROUP BY ALL""",
)
def severity_names(spark, sf):
    """Level names in any case; anything else is low."""
    name = F.regexp_replace(F.regexp_replace("o_orderpriority", "^[0-9]-", ""), "URGENT", "Critical")
    level = parse_level_column(name)
    return table(spark, sf, "orders").groupBy("o_orderpriority", level.alias("level")).agg(
        F.count("*").alias("n")
    ).select("o_orderpriority", "level", rank_of(F.col("level")).alias("rank"), "n")


# NVD pages: one customer gives one page of two records ------------------------

NVD_ITEM = """named_struct('cve', named_struct(
  'id', concat('CVE-2024-', CAST((c_custkey * 3 + {i}) % 700 AS STRING)),
  'descriptions', CASE WHEN c_custkey % 5 = 0 THEN array()
     WHEN c_custkey % 5 = 1 THEN array(named_struct('lang', 'fr', 'value', c_mktsegment))
     ELSE array(named_struct('lang', 'es', 'value', 'otro'), named_struct('lang', 'en', 'value', concat(c_name, ' {i}'))) END,
  'metrics', CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE named_struct('cvssMetricV31', array(named_struct('cvssData', named_struct(
     'baseSeverity', CASE c_custkey % 4 WHEN 1 THEN 'HIGH' WHEN 2 THEN 'CRITICAL' ELSE 'LOW' END)))) END))"""
NVD_ROW_SQL = """SELECT concat('CVE-2024-', CAST((c_custkey * 3 + {i}) % 700 AS STRING)) AS cve_id,
  CASE c_custkey % 4 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' WHEN 2 THEN 'critical' ELSE 'low' END AS severity,
  concat('Vulnerability CVE-2024-', CAST((c_custkey * 3 + {i}) % 700 AS STRING)) AS title,
  CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN c_mktsegment ELSE concat(c_name, ' {i}') END AS description,
  c_custkey AS k, {i} AS i FROM customer"""
NVD_SQL = f"{NVD_ROW_SQL.format(i=0)} UNION ALL {NVD_ROW_SQL.format(i=1)}"


def nvd_pages(spark, sf):
    item = ", ".join(NVD_ITEM.format(i=i) for i in (0, 1))
    return in_parts(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")).selectExpr(
        f"array({item}) AS vulnerabilities", "lpad(CAST(c_custkey AS STRING), 12, '0') AS feed_pos"
    )


@query("nvd_feed", f"SELECT cve_id, severity, title, description, 'nvd' AS data_source FROM ({NVD_SQL})")
def nvd_feed(spark, sf):
    """Pages written as JSON lines and read back as a feed."""
    path = work_dir(spark, "nvd")
    nvd_pages(spark, sf).drop("feed_pos").write.json(path)
    feed = read_nvd(spark, path, multi_line=False)
    return V.flatten_nvd(feed).select("cve_id", "severity", "title", "description", "data_source")


# OSV records: one per order ----------------------------------------------------

SEEDS = V.SEED_PACKAGES
PACKAGE = "CASE CAST(o_custkey AS BIGINT) % {m} {whens} ELSE '{other}' END"
OSV_ECO = PACKAGE.format(
    m=len(SEEDS) * 2, other="npm", whens=" ".join(f"WHEN {i} THEN '{e}'" for i, (e, _) in enumerate(SEEDS))
)
OSV_PKG = PACKAGE.format(
    m=len(SEEDS) * 2, other="left-pad", whens=" ".join(f"WHEN {i} THEN '{p}'" for i, (_, p) in enumerate(SEEDS))
)
OSV_ID = "concat('GHSA-', CAST(o_orderkey AS STRING))"
OSV_CVE = "concat('CVE-2024-', CAST(o_orderkey % 900 AS STRING))"
OSV_COLUMNS = (
    f"CASE WHEN o_orderkey % 10 = 9 THEN concat('CVE-2023-', CAST(o_orderkey AS STRING)) ELSE {OSV_ID} END AS id",
    "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('Flaw ', o_orderpriority) END AS summary",
    f"CASE o_orderkey % 3 WHEN 0 THEN array('X-1', {OSV_CVE}) WHEN 1 THEN array('Y') ELSE NULL END AS aliases",
    """CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN array(named_struct('type', 'OTHER', 'score', '9.9'), named_struct('type', 'CVSS_V3', 'score', concat(CAST(o_orderkey % 10 AS STRING), '.5')))
       WHEN 2 THEN array(named_struct('type', 'OTHER', 'score', '9.9')) ELSE array(named_struct('type', 'CVSS_V2', 'score', 'AV:N/AC:L')) END AS severity""",
    f"""array(named_struct('package', named_struct('name', {OSV_PKG}, 'ecosystem', {OSV_ECO}), 'ranges', array(named_struct('type', 'SEMVER', 'events', array(
       named_struct('introduced', '0', 'fixed', CAST(NULL AS STRING)), named_struct('introduced', CAST(NULL AS STRING), 'fixed', concat('1.', CAST(o_orderkey % 9 AS STRING))),
       named_struct('introduced', '2.0', 'fixed', CAST(NULL AS STRING))))))) AS affected""",
    "lpad(CAST(o_orderkey AS STRING), 12, '0') AS feed_pos",
)
OSV_LEVEL = "CASE WHEN o_orderkey % 4 = 1 THEN " + LEVEL_SQL.format(n="(o_orderkey % 10 + 0.5)") + " ELSE 'medium' END"
OSV_SQL = f"""SELECT id, eco AS ecosystem, pkg AS package_name, level AS severity, k,
   CASE WHEN k % 3 = 0 THEN {OSV_CVE.replace('o_orderkey', 'k')} ELSE id END AS cve_lenient,
   CASE WHEN k % 3 = 0 THEN {OSV_CVE.replace('o_orderkey', 'k')} WHEN k % 10 = 9 THEN id END AS cve_strict,
   coalesce(summary, concat('Vulnerability in ', pkg)) AS description, concat(id, ' (', pkg, '@', eco, ')') AS title, summary
   FROM (SELECT o_orderkey AS k, {OSV_ECO} AS eco, {OSV_PKG} AS pkg, {OSV_LEVEL} AS level,
         CASE WHEN o_orderkey % 10 = 9 THEN concat('CVE-2023-', CAST(o_orderkey AS STRING)) ELSE {OSV_ID} END AS id,
         CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('Flaw ', o_orderpriority) END AS summary FROM orders)"""
SEEDED = f"({', '.join(repr(p) for _, p in SEEDS)})"


def osv_records(spark, sf):
    return in_parts(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")).selectExpr(*OSV_COLUMNS)


@query(
    "osv_feed",
    f"SELECT cve_lenient AS cve_id, severity, title, description, 'osv' AS data_source, ecosystem, package_name FROM ({OSV_SQL})",
)
def osv_feed(spark, sf):
    path = work_dir(spark, "osv")
    osv_records(spark, sf).drop("feed_pos").write.json(path)
    return V.flatten_osv(read_osv(spark, path)).drop("feed_pos")


@query("seed_packages", f"SELECT ecosystem, package_name, count(*) AS n FROM ({OSV_SQL}) WHERE package_name IN {SEEDED} GROUP BY ALL")
def seed_packages(spark, sf):
    rows = V.osv_packages(osv_records(spark, sf), V.seed_df(spark))
    return rows.groupBy("ecosystem", "package_name").agg(F.count("*").alias("n"))


@query(
    "osv_ranges",
    f"""SELECT id AS advisory_id, cve_strict AS cve_id, '0' AS introduced, concat('1.', CAST(k % 9 AS STRING)) AS fixed FROM ({OSV_SQL})
        UNION ALL SELECT id, cve_strict, '2.0', NULL FROM ({OSV_SQL})""",
)
def osv_ranges(spark, sf):
    rows = V.osv_advisories(osv_records(spark, sf))
    return rows.select("advisory_id", "cve_id", "introduced", "fixed")


@query("first_cvss_entry", f"SELECT id, severity FROM ({OSV_SQL})")
def first_cvss(spark, sf):
    return osv_records(spark, sf).select("id", first_cvss_severity(F.col("severity")).alias("severity"))


@query("cve_aliases", f"SELECT id, cve_strict AS strict, cve_lenient AS lenient FROM ({OSV_SQL})")
def cve_aliases(spark, sf):
    return osv_records(spark, sf).select(
        "id",
        cve_alias(F.col("id"), F.col("aliases")).alias("strict"),
        cve_alias(F.col("id"), F.col("aliases"), strict=False).alias("lenient"),
    )


# Upsert -------------------------------------------------------------------------

EARLIER = NOW - timedelta(days=30)
EARLIER_SQL = f"({NOW_SQL} - INTERVAL 30 DAY)"
STORED_SQL = f"""SELECT concat('CVE-2024-', CAST(s_suppkey * 2 AS STRING)) AS cve_id, 'low' AS severity, s_name AS title, 'old' AS description,
   'nvd' AS data_source, 'npm' AS ecosystem, 'stored' AS package_name FROM supplier"""
INCOMING_SQL = f"""
   SELECT cve_id, severity, title, description, data_source, ecosystem, package_name, 0 AS feed, 0 AS k, 0 AS i FROM ({STORED_SQL})
   UNION ALL SELECT cve_id, severity, title, description, 'nvd', NULL, NULL, 1, k, i FROM ({NVD_SQL})
   UNION ALL SELECT cve_lenient, severity, title, description, 'osv', ecosystem, package_name, 2, k, 0 FROM ({OSV_SQL}) WHERE package_name IN {SEEDED}"""
UPSERT_SQL = f"""
   SELECT cve_id, arg_max(severity, o) AS severity, arg_min(title, o) AS title, arg_max(description, o) AS description,
          arg_min(data_source, o) AS data_source,
          arg_max(ecosystem, o) FILTER (WHERE feed <> 1) AS ecosystem, arg_max(package_name, o) FILTER (WHERE feed <> 1) AS package_name,
          CASE WHEN min(feed) = 0 THEN {EARLIER_SQL} ELSE {NOW_SQL} END AS created_at,
          CASE WHEN max(feed) = 0 THEN {EARLIER_SQL} ELSE {NOW_SQL} END AS updated_at
   FROM (SELECT *, feed * 100000000000 + k * 10 + i AS o FROM ({INCOMING_SQL})) GROUP BY cve_id"""


def stored_table(spark, sf):
    then = F.lit(EARLIER).cast("timestamp")
    return table(spark, sf, "supplier").select(
        F.expr("concat('CVE-2024-', CAST(s_suppkey * 2 AS STRING))").alias("cve_id"),
        F.lit(None).cast("string").alias("cwe_id"), F.lit("low").alias("severity"),
        F.col("s_name").alias("title"), F.lit("old").alias("description"),
        then.alias("published_at"), then.alias("last_modified_at"), F.lit("nvd").alias("data_source"),
        then.alias("created_at"), then.alias("updated_at"),
        F.lit("npm").alias("ecosystem"), F.lit("stored").alias("package_name"),
    )


def synced(spark, sf):
    return sync_advisories(
        stored_table(spark, sf), NOW, nvd_pages(spark, sf), osv_records(spark, sf), V.seed_df(spark)
    )


def stored_vulnerabilities(spark, sf):
    """The table a sync has stored, as lookups find it."""
    return derived(spark, sf, "vulnerabilities", lambda: synced(spark, sf))


UPSERTED = "cve_id severity title description data_source ecosystem package_name".split()


@query("upsert", f"SELECT {', '.join(UPSERTED)}, CAST(created_at AS STRING) AS created_at, CAST(updated_at AS STRING) AS updated_at FROM ({UPSERT_SQL})")
def upserted(spark, sf):
    return synced(spark, sf).select(
        *UPSERTED, F.col("created_at").cast("string").alias("created_at"),
        F.col("updated_at").cast("string").alias("updated_at"),
    )


@query("upsert_twice", f"SELECT {', '.join(UPSERTED)} FROM ({UPSERT_SQL})")
def upsert_twice(spark, sf):
    """A sync is written as a version, read back, and the same feeds change nothing more."""
    base = work_dir(spark, "vulnerabilities")
    first = write_version(synced(spark, sf), base, 1)
    table_ = spark.read.schema(schemas.VULNERABILITIES).parquet(first)
    again = sync_advisories(table_, NOW, nvd_pages(spark, sf), osv_records(spark, sf), V.seed_df(spark))
    second = write_version(again, base, 2)
    return spark.read.schema(schemas.VULNERABILITIES).parquet(second).select(*UPSERTED)


@query("package_lookup", f"SELECT cve_id, ecosystem, package_name FROM ({UPSERT_SQL}) WHERE package_name IN ('lodash', 'Django', 'stored') AND ecosystem IN ('npm', 'PyPI')")
def package_lookup(spark, sf):
    wanted = V.seed_df(spark, [("npm", "lodash"), ("PyPI", "Django"), ("npm", "stored")])
    return V.by_package(stored_vulnerabilities(spark, sf), wanted).select("cve_id", "ecosystem", "package_name")


@query("vulnerability_severity", f"SELECT severity, count(*) AS n FROM ({UPSERT_SQL}) WHERE severity IN ('critical', 'high') GROUP BY severity")
def vulnerability_severity(spark, sf):
    return V.by_severity(stored_vulnerabilities(spark, sf), "critical", "high").groupBy("severity").agg(F.count("*").alias("n"))


# Findings of the order lines, half of them with a CVE ---------------------------

FOUND_CVE = "CASE WHEN l_partkey % 2 = 0 THEN concat('CVE-2024-', CAST(l_partkey % 1500 AS STRING)) END"


def cve_findings(spark, sf):
    raw = table(spark, sf, "lineitem").selectExpr(
        "'sca' AS engine", "concat('R', CAST(l_partkey AS STRING)) AS rule_id", f"{FOUND_CVE} AS cve_id",
        "CAST(NULL AS STRING) AS cwe_id", "'high' AS severity", "3 AS sev_rank",
        "concat('found ', CAST(l_partkey AS STRING)) AS title", "'x' AS vulnerable_code", "'' AS description",
        "l_linenumber AS line_start", "l_linenumber AS line_end",
        "concat(CAST(l_orderkey AS STRING), '/', CAST(l_partkey AS STRING), '/', CAST(l_suppkey AS STRING)) AS file_path",
    )
    return to_findings(raw, NOW)


ENRICHED = f"""WITH v AS ({UPSERT_SQL})
  SELECT f.cve_id, coalesce(v.title, f.title) AS title, count(*) AS n
  FROM (SELECT {FOUND_CVE} AS cve_id, concat('found ', CAST(l_partkey AS STRING)) AS title FROM lineitem) f
  LEFT JOIN v ON v.cve_id = f.cve_id GROUP BY ALL"""


@query("title_enrichment", ENRICHED)
def title_enrichment(spark, sf):
    found = V.enrich_titles(cve_findings(spark, sf), stored_vulnerabilities(spark, sf))
    return found.groupBy("cve_id", "title").agg(F.count("*").alias("n"))


@query("title_enrichment_salted", ENRICHED)
def title_enrichment_salted(spark, sf):
    """The same when the table is too large to broadcast; findings without a CVE are spread."""
    found = V.enrich_titles(cve_findings(spark, sf), stored_vulnerabilities(spark, sf), max_bytes=0)
    return found.groupBy("cve_id", "title").agg(F.count("*").alias("n"))


@query("advisory_links", f"SELECT DISTINCT concat('https://nvd.nist.gov/vuln/detail/', {FOUND_CVE}) AS link FROM lineitem WHERE l_partkey % 2 = 0")
def advisory_links(spark, sf):
    found = cve_findings(spark, sf).where("cve_id IS NOT NULL")
    return found.select(advisory_link(F.col("cve_id")).alias("link")).distinct()


@query(
    "cache_refresh",
    f"""SELECT DISTINCT {FOUND_CVE} AS cve_id FROM lineitem WHERE l_partkey % 2 = 0 AND {FOUND_CVE} NOT IN (
        SELECT concat('CVE-2024-', CAST(o_orderkey % 1500 AS STRING)) FROM orders
        WHERE o_orderdate + INTERVAL 24 HOUR > TIMESTAMP '2001-01-01 00:00:00')""",
)
def cache_refresh(spark, sf):
    cache = table(spark, sf, "orders").selectExpr(
        "concat('CVE-2024-', CAST(o_orderkey % 1500 AS STRING)) AS cve_id",
        "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 24 HOURS AS expires_at",
    )
    return V.ids_to_refresh(cve_findings(spark, sf), cache, NOW.replace(year=2001, hour=0))


@query(
    "cache_fresh",
    "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 24 HOUR > TIMESTAMP '2001-01-01 00:00:00'",
)
def cache_fresh(spark, sf):
    cache = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 24 HOURS AS expires_at"
    )
    return V.fresh_entries(cache, NOW.replace(year=2001, hour=0)).select("o_orderkey")


# Title search ---------------------------------------------------------------------

TITLE = "concat(p_name, ' ', p_brand, ' ', p_type)"


def search_sql(score: float, select: str) -> str:
    grams = """SELECT t, substring('  ' || w || ' ', i, 3) AS g FROM (
        SELECT t, w, unnest(range(1, length(w) + 2)) AS i FROM (
          SELECT t, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+')) AS w FROM ("""
    docs = f"SELECT DISTINCT t, g FROM ({grams} SELECT DISTINCT {TITLE} AS t FROM part))))"
    asked = f"SELECT DISTINCT t, g FROM ({grams} SELECT DISTINCT p_name AS t FROM part))))"
    return f"""WITH d AS ({docs}), q AS ({asked}),
      dn AS (SELECT t, count(*) AS n FROM d GROUP BY t), qn AS (SELECT t, count(*) AS n FROM q GROUP BY t),
      both_ AS (SELECT q.t AS query, d.t AS title, count(*) AS c FROM q JOIN d USING (g) GROUP BY ALL),
      pairs AS (SELECT query, title, c / (qn.n + dn.n - c) AS score FROM both_ JOIN qn ON qn.t = query JOIN dn ON dn.t = title)
      {select} WHERE score >= {score}"""


@query("similar_titles", search_sql(0.4, "SELECT query, title, round(score, 6) AS score FROM pairs"))
def similar(spark, sf):
    titles = table(spark, sf, "part").selectExpr(f"{TITLE} AS title")
    asked = table(spark, sf, "part").selectExpr("p_name AS query")
    found = similar_titles(titles, asked, 0.4)
    return found.select("query", "title", F.round("score", 6).alias("score"))


@query(
    "title_search",
    search_sql(0.5, f"SELECT query, p_partkey AS id, round(score, 6) AS score FROM pairs JOIN part ON {TITLE} = title"),
)
def search(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey AS cve_id", f"{TITLE} AS title")
    asked = table(spark, sf, "part").selectExpr("p_name AS query")
    found = title_search(rows, asked, 0.5)
    return found.select("query", F.col("cve_id").alias("id"), F.round("score", 6).alias("score"))


# Analyzer reports -------------------------------------------------------------------


@query(
    "analyzer_import",
    """SELECT concat('py.rule.r', CAST(l_partkey % 50 AS STRING)) AS rule_id, concat('r', CAST(l_partkey % 50 AS STRING)) AS title,
       concat('src/', CAST(l_orderkey AS STRING), '.py') AS file_path, CAST(l_linenumber AS BIGINT) AS line_start,
       CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS severity,
       CASE WHEN l_suppkey % 5 = 0 THEN concat('CVE-1-', CAST(l_suppkey AS STRING)) END AS cve_id FROM lineitem""",
)
def analyzer_import(spark, sf):
    path = work_dir(spark, "analyzer")
    table(spark, sf, "lineitem").selectExpr(
        """array(named_struct('check_id', concat('py.rule.r', CAST(l_partkey % 50 AS STRING)),
             'path', concat('src/', CAST(l_orderkey AS STRING), '.py'),
             'start', named_struct('line', l_linenumber, 'col', 1),
             'extra', named_struct('severity', CASE l_returnflag WHEN 'A' THEN 'ERROR' WHEN 'N' THEN 'WARNING' ELSE 'INFO' END,
                'message', 'm', 'metadata', named_struct('cve', CASE WHEN l_suppkey % 5 = 0 THEN concat('CVE-1-', CAST(l_suppkey AS STRING)) END)))) AS results"""
    ).write.json(path)
    found = read_analyzer(spark, path, multi_line=False)
    return found.select("rule_id", "title", "file_path", "line_start", "severity", "cve_id")
