"""Queries of the dependency engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.functions.versions import version_key
from lynceus.operators import manifests as M
from lynceus.operators.advisories import affected, affected_versions, coverage, sca_findings
from lynceus.operators.findings import to_findings
from lynceus.plans.scan import as_files, scan
from workload.base import NOW, dealt, query, quoted, table

# Dependencies of the manifest that each part gives: (name, version) expressions.
DEPS = [
    (
        f"concat('{prefix}', CAST((p_partkey * {k} + {k}) % 500 AS STRING))",
        f"concat(CAST(p_size AS STRING), '.', CAST((p_partkey + {k}) % 13 AS STRING), '.{k}')",
    )
    for prefix, k in (("core-", 1), ("net-", 2), ("io-", 3), ("lib.", 4))
]
NL = "chr(10)"


def joined(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def text(kind: str) -> str:
    """Manifest text of one part."""
    q = quoted
    if kind in (M.CARGO, M.POETRY):
        head = q("version = 3") if kind == M.CARGO else q("# lock file")
        blocks = [
            joined(q("[[package]]"), NL, q('name = "'), n, q('"'), NL, q('version = "'), v, q('"'), NL, q('dependencies = ["x"]'), NL, NL)
            for n, v in DEPS
        ]
        return joined(head, NL, NL, *blocks)
    if kind == M.NPM:
        rows = [joined(q(',"node_modules/a/node_modules/' if i % 2 else ',"node_modules/'), n, q('":{"version":"'), v, q('","dev":true}')) for i, (n, v) in enumerate(DEPS)]
        return joined(q('{"name":"app","packages":{"":{"version":"0.0.1"},"node_modules/linked":{"link":true}'), *rows, q("}}"))
    if kind == M.PIP:
        ops = ["==", ">=", " ~= ", "<"]
        rows = [joined(q("  " if i else ""), n, q(op), v, q(" ; os_name" if i == 1 else ""), NL) for i, ((n, v), op) in enumerate(zip(DEPS, ops))]
        return joined(q("# pinned"), NL, *rows, q("unpinned"), NL)
    if kind == M.GO:
        rows = [joined(q("example.com/"), n, q(" v"), v, q(" h1:a="), NL, q("example.com/"), n, q(" v"), v, q("/go.mod h1:b="), NL) for n, v in DEPS]
        return joined(*rows)
    if kind == M.MAVEN:
        rows = [
            joined(q("<dependency>"), NL, q("<groupId>org.shop</groupId>"), q("<artifactId>"), n, q("</artifactId>"), NL,
                   *((q("<version>"), v, q("</version>")) if i else (q(""),)), q("</dependency>"), NL)
            for i, (n, v) in enumerate(DEPS)
        ]
        return joined(q("<project><dependencies>"), *rows, q("</dependencies></project>"))
    if kind == M.YARN:
        rows = [joined(q('"@s/') if i == 0 else q(""), n, q('@^1.0.0":') if i == 0 else joined(q("@^1.0.0, "), n, q("@~1.1.0:")), NL, q('  version "'), v, q('"'), NL, NL) for i, (n, v) in enumerate(DEPS)]
        return joined(q("# yarn lockfile v1"), NL, NL, *rows)
    if kind == M.PNPM:
        rows = [joined(q("  /"), n, q("@") if i % 2 else q("/"), v, q(":"), NL, q("    dev: false"), NL, NL) for i, (n, v) in enumerate(DEPS)]
        return joined(q("packages:"), NL, NL, *rows)
    if kind == M.PIPFILE:
        part = lambda pair: joined(q('"'), pair[0], q('":{"version":"=='), pair[1], q('"}'))
        return joined(q('{"default":{'), part(DEPS[0]), q(","), part(DEPS[1]), q('},"develop":{'), part(DEPS[2]), q(","), part(DEPS[3]), q("}}"))
    raise ValueError(kind)


NAMES = {
    M.CARGO: "Cargo.lock", M.NPM: "package-lock.json", M.PIP: "requirements.txt", M.GO: "go.sum",
    M.MAVEN: "pom.xml", M.YARN: "yarn.lock", M.PNPM: "pnpm-lock.yaml", M.PIPFILE: "Pipfile.lock",
    M.POETRY: "poetry.lock",
}


def path(name: str) -> str:
    return f"concat('part', CAST(p_partkey AS STRING), '/{name}')"


def manifest_files(spark, sf, kind, name=None):
    rows = dealt(spark, sf, "part", ("p_partkey", "p_size"))
    return as_files(rows.selectExpr(f"{path(name or NAMES[kind])} AS path", f"{text(kind)} AS code"))


def expected(kind: str, name: str | None = None) -> str:
    prefix = {M.GO: "'example.com/' || ", M.MAVEN: "'org.shop:' || "}.get(kind, "")
    rows = []
    for i, (n, v) in enumerate(DEPS):
        name_sql = ("'@s/' || " if kind == M.YARN and i == 0 else prefix) + n
        version_sql = "'unknown'" if kind == M.MAVEN and i == 0 else v
        rows.append(
            f"SELECT {path(name or NAMES[kind])} AS file_path, {name_sql} AS name, {version_sql} AS version,"
            f" '{M.ECOSYSTEM[kind]}' AS ecosystem FROM part"
        )
    return " UNION ALL ".join(rows)


for _kind in NAMES:

    @query(f"manifest_{_kind}", expected(_kind))
    def manifest(spark, sf, kind=_kind):
        return M.parse(manifest_files(spark, sf, kind), kind)


def all_manifests(spark, sf):
    files = None
    for kind in NAMES:
        part = manifest_files(spark, sf, kind)
        files = part if files is None else files.unionByName(part)
    return files


@query("manifest_dispatch", " UNION ALL ".join(f"({expected(k)})" for k in NAMES))
def manifest_dispatch(spark, sf):
    return M.extract_dependencies(all_manifests(spark, sf), by_content=False)


BY_CONTENT = {M.CARGO: "deps", M.PIP: "deps.TXT", M.MAVEN: "build.xml"}


@query("manifest_by_content", " UNION ALL ".join(f"({expected(k, n)})" for k, n in BY_CONTENT.items()))
def manifest_by_content(spark, sf):
    files = None
    for kind, name in BY_CONTENT.items():
        part = manifest_files(spark, sf, kind, name)
        files = part if files is None else files.unionByName(part)
    return M.extract_dependencies(files)


KIND_SQL = """CASE {} END""".format(
    " ".join(
        f"WHEN lower(path) LIKE '%{end}' THEN '{kind}'" for kind, ends in M.ENDINGS for end in ends
    )
    + " WHEN contains(code, '[[package]]') THEN 'cargo'"
    " WHEN lower(path) LIKE '%.txt' AND contains(code, '==') THEN 'pip'"
    " WHEN lower(path) LIKE '%.xml' AND contains(code, '<groupId>') THEN 'maven'"
    " WHEN starts_with(trim(code), '{') AND contains(code, '\"dependencies\"') THEN 'npm'"
    " WHEN contains(code, '<groupId>') THEN 'maven'"
)


@query(
    "manifest_kinds",
    f"""SELECT coalesce({KIND_SQL}, 'none') AS kind, count(*) AS n FROM (
        {' UNION ALL '.join(f"SELECT {path(n)} AS path, {text(k)} AS code FROM part" for k, n in [*NAMES.items(), *BY_CONTENT.items()])}
        UNION ALL SELECT concat('documents/', CAST(doc_id AS STRING), '.txt'), text FROM documents) GROUP BY 1""",
)
def manifest_kinds(spark, sf):
    files = all_manifests(spark, sf)
    for kind, name in BY_CONTENT.items():
        files = files.unionByName(manifest_files(spark, sf, kind, name))
    docs = table(spark, sf, "documents").selectExpr(
        "concat('documents/', CAST(doc_id AS STRING), '.txt') AS path", "text AS code"
    )
    kind = M.manifest_kind(F.col("path"), F.col("code"))
    return (
        files.select("path", "code").unionByName(docs)
        .groupBy(F.coalesce(kind, F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))
    )


# Installed versions from the order lines, advisories from the parts -----------

ECO = "CASE CAST({} AS BIGINT) % 5 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' WHEN 2 THEN 'Go' WHEN 3 THEN 'crates.io' ELSE 'Maven' END"
INSTALLED = (
    "concat('order', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '/', CAST(l_suppkey AS STRING)) AS file_path",
    "concat('pkg-', CAST(l_partkey AS STRING)) AS name",
    "concat(CASE WHEN l_linenumber = 6 THEN 'rev' ELSE '' END, CAST(CAST(l_quantity AS BIGINT) AS STRING), '.', CAST(l_linenumber AS STRING), CASE WHEN l_linenumber = 7 THEN '-rc1' ELSE '.0' END) AS version",
    f"{ECO.format('l_partkey')} AS ecosystem",
)
ADVISORIES = (
    "concat('ADV-', CAST(p_partkey AS STRING)) AS advisory_id",
    "CASE WHEN p_partkey % 3 = 0 THEN concat('CVE-2024-', CAST(p_partkey AS STRING)) END AS cve_id",
    f"{ECO.format('p_partkey')} AS ecosystem",
    "concat('pkg-', CAST(p_partkey AS STRING)) AS package_name",
    "CASE WHEN p_size <= 10 THEN '0' ELSE concat(CAST(p_size - 10 AS STRING), '.0') END AS introduced",
    "CASE WHEN p_partkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE concat(CAST(p_size AS STRING), '.3') END AS fixed",
    "CASE WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'low' END AS severity",
    "CASE WHEN p_partkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE p_name END AS summary",
    "'osv' AS source",
)
HITS_SQL = f"""
    deps AS (SELECT {', '.join(INSTALLED)}, CAST(l_quantity AS BIGINT) * 100 + l_linenumber AS num, l_linenumber <> 6 AS usable FROM lineitem),
    advs AS (SELECT {', '.join(ADVISORIES)}, CASE WHEN p_size <= 10 THEN 0 ELSE (p_size - 10) * 100 END AS lo,
             CASE WHEN p_partkey % 4 = 0 THEN 1000000 ELSE p_size * 100 + 3 END AS hi FROM part),
    hits AS (SELECT d.file_path, d.name, d.version, d.ecosystem, a.advisory_id, a.cve_id, a.severity, a.summary
             FROM deps d JOIN advs a ON a.ecosystem = d.ecosystem AND a.package_name = d.name
             WHERE d.usable AND d.num >= a.lo AND d.num < a.hi)"""


def installed(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*INSTALLED)


def advisories(spark, sf):
    return table(spark, sf, "part").selectExpr(*ADVISORIES)


@query("affected_dependencies", f"WITH {HITS_SQL} SELECT file_path, name, version, ecosystem, advisory_id, severity FROM hits")
def affected_dependencies(spark, sf):
    hits = affected(installed(spark, sf), advisories(spark, sf))
    return hits.select("file_path", "name", "version", "ecosystem", "advisory_id", "severity")


@query("affected_salted", f"WITH {HITS_SQL} SELECT advisory_id, count(*) AS n FROM hits GROUP BY 1")
def affected_salted(spark, sf):
    """The same join when the advisories are too large to broadcast."""
    hits = affected(installed(spark, sf), advisories(spark, sf), max_bytes=0)
    return hits.groupBy("advisory_id").agg(F.count("*").alias("n"))


@query("affected_versions", f"WITH {HITS_SQL} SELECT DISTINCT ecosystem, name, version, advisory_id FROM hits")
def affected_version_rows(spark, sf):
    return affected_versions(installed(spark, sf), advisories(spark, sf)).select(
        "ecosystem", "name", "version", "advisory_id"
    )


@query(
    "sca_findings",
    f"""WITH {HITS_SQL} SELECT file_path, advisory_id AS rule_id, cve_id, severity,
        concat('Dependency ', name, ' ', version, ': ', coalesce(summary, concat('advisory for ', name, '@', version))) AS title,
        concat(name, '@', version, ' (', ecosystem, ')') AS vulnerable_code,
        concat(coalesce(summary, ''), ' (ID: ', advisory_id, ')') AS description,
        CAST(0 AS BIGINT) AS line_start FROM hits""",
)
def sca(spark, sf):
    raw = sca_findings(affected(installed(spark, sf), advisories(spark, sf)))
    return to_findings(raw, NOW).select(
        "file_path", "rule_id", "cve_id", "severity", "title", "vulnerable_code", "description", "line_start"
    )


@query(
    "dependency_coverage",
    f"""WITH {HITS_SQL},
        versions AS (SELECT ecosystem, name, version, count(*) AS uses, bool_and(usable) AS usable FROM deps GROUP BY ALL),
        hit AS (SELECT DISTINCT ecosystem, name, version, 1 AS hit FROM hits)
        SELECT ecosystem, CAST(sum(uses) AS BIGINT) AS dependencies, count(*) AS versions, count(hit) AS vulnerable_versions,
        CAST(coalesce(sum(CASE WHEN hit = 1 THEN uses END), 0) AS BIGINT) AS vulnerable_dependencies,
        count(CASE WHEN NOT usable THEN 1 END) AS uncheckable_versions
        FROM versions LEFT JOIN hit USING (ecosystem, name, version) GROUP BY ecosystem""",
)
def dependency_coverage(spark, sf):
    return coverage(installed(spark, sf), advisories(spark, sf))


@query(
    "distinct_dependencies",
    f"SELECT DISTINCT 'all' AS file_path, name, version, ecosystem FROM (SELECT {', '.join(INSTALLED)} FROM lineitem)",
)
def distinct_dependencies(spark, sf):
    return M.distinct_dependencies(installed(spark, sf).withColumn("file_path", F.lit("all")))


@query(
    "version_order",
    """WITH v AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS a, l_linenumber AS b FROM lineitem)
       SELECT concat('v', CAST(a AS STRING), '.', CAST(b % 3 AS STRING), '.0') AS version,
       CAST(dense_rank() OVER (ORDER BY a, b % 3) AS BIGINT) AS place FROM v""",
)
def version_order(spark, sf):
    """Rank of each version through its comparable key. Few distinct versions reach the window."""
    versions = table(spark, sf, "lineitem").select(
        F.col("l_quantity").cast("bigint").alias("a"), F.col("l_linenumber").alias("b")
    ).distinct()
    text_ = F.expr("concat('v', CAST(a AS STRING), '.', CAST(b % 3 AS STRING), '.0')")
    keyed = versions.select(text_.alias("version"), version_key(text_).alias("key"))
    from pyspark.sql import Window

    return keyed.select("version", F.dense_rank().over(Window.orderBy("key")).alias("place"))


# Versions in the order that each ecosystem's public rules give them. Versions between bars are equal.
ORDERS = {
    "PyPI": "{n}.dev0 {n}.0.dev456 {n}.0a1.dev1 {n}.0a1|{n}alpha1 {n}.0a2.dev456 {n}.0a12.dev456 {n}.0a12 {n}.0b1.dev456 {n}.0b2"
    " {n}.0b2.post345.dev456 {n}.0b2.post345 {n}.0rc1.dev456 {n}.0rc1|{n}-c1|{n}.pre1 {n}.0|{n}|v{n}.0.0 {n}.0+abc.5 {n}.0+abc.7 {n}.0+5"
    " {n}.0.post1.dev1 {n}.0-1|{n}.post1|{n}.0.rev1 {n}.0.post456.dev34 {n}.0.post456 {n}.0.15 {n}.1.dev1 {n}.1 1!{n}.0a1 1!{n}.2",
    "npm": "{n}.0.0-1 {n}.0.0-Beta {n}.0.0-alpha|{n}.0.0-alpha+x {n}.0.0-alpha.1 {n}.0.0-alpha.beta {n}.0.0-alpha10 {n}.0.0-alpha2 {n}.0.0-beta"
    " {n}.0.0-beta.2 {n}.0.0-beta.11 {n}.0.0-patch.1 {n}.0.0-pre {n}.0.0-rc {n}.0.0-rc.1 {n}.0.0|{n}|{n}.0.0+build.5 {n}.0.1-0 {n}.0.1 {n}.2.0 {n}.10.0",
    "Go": "v{n}.0.0-20190101000000-abcdef012345 v{n}.0.0-20200101000000-0bcdef012345 v{n}.0.0-alpha v{n}.0.0-rc.1.0.20200101000000-abcdef012345"
    " v{n}.0.0|v{n}.0.0+incompatible v{n}.0.1-0.20200101000000-abcdef012345 v{n}.0.1 v{n}.10.0",
    "Maven": "{n}-alpha-1|{n}.0-a1 {n}-alpha-2 {n}-beta-2|{n}b2 {n}-beta-10 {n}-milestone-1|{n}-m1 {n}-rc-1|{n}-CR1 {n}-SNAPSHOT"
    " {n}|{n}.0|{n}.0.0|{n}-ga|{n}.Final|{n}.0.RELEASE {n}-sp {n}-sp-1 {n}-foo {n}-jre {n}-1|{n}.0-1 {n}-2 {n}.0.1 {n}.1-SNAPSHOT {n}.1 {n}.10",
}
ORDER_ROWS = [(eco, place, i, v) for eco, line in ORDERS.items() for place, same in enumerate(line.split()) for i, v in enumerate(same.split("|"))]


@query(
    "version_grammars",
    " UNION ALL ".join(
        f"SELECT '{eco}' AS ecosystem, CAST(p_partkey AS BIGINT) AS n, replace('{v}', '{{n}}', CAST(p_partkey AS STRING)) AS version, CAST({place + 1} AS BIGINT) AS place FROM part"
        for eco, place, _, v in ORDER_ROWS
    ),
)
def version_grammars(spark, sf):
    """For every part a list of versions of each ecosystem, placed by their keys; equal versions share a place."""
    from pyspark.sql import Window

    each = F.explode(F.array(*[F.struct(F.lit(eco).alias("ecosystem"), F.lit(v).alias("form")) for eco, _, _, v in ORDER_ROWS]))
    parts = dealt(spark, sf, "part", ("p_partkey",))
    rows = parts.select(F.col("p_partkey").cast("bigint").alias("n"), each.alias("x")).select("n", "x.*")
    rows = rows.withColumn("version", F.replace("form", F.lit("{n}"), F.col("n").cast("string")))
    keyed = rows.select("ecosystem", "n", "version", version_key(F.col("version"), F.col("ecosystem")).alias("key"))
    # a window holds the few versions of one list
    return keyed.select("ecosystem", "n", "version", F.dense_rank().over(Window.partitionBy("ecosystem", "n").orderBy("key")).alias("place"))


HOT_VERSION = "concat(CAST(l_orderkey % 10000 AS STRING), '.', CAST(l_linenumber AS STRING), '.0')"
HOT_ADVISORY = (
    "concat('HOT-', CAST(o_orderkey AS STRING)) AS advisory_id",
    "CAST(NULL AS STRING) AS cve_id",
    "'npm' AS ecosystem",
    "'hot' AS package_name",
    "CASE WHEN o_orderkey % 1000 = 3 THEN '0' ELSE concat(CAST(o_custkey % 9000 AS STRING), '.2') END AS introduced",
    "CASE WHEN o_orderkey % 4 <> 1 AND o_orderkey % 1000 <> 7 THEN concat(CAST(o_custkey % 9000 + 2 AS STRING), '.3.0') END AS fixed",
    "CASE WHEN o_orderkey % 4 = 1 THEN concat(CAST(o_custkey % 9000 + 1 AS STRING), '.4') END AS last_affected",
    "'high' AS severity", "'s' AS summary", "'osv' AS source",
)


@query(
    "affected_hot_package",
    """WITH v AS (SELECT DISTINCT (l_orderkey % 10000) * 10 + l_linenumber AS x FROM lineitem),
        r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 3 THEN 0 ELSE (o_custkey % 9000) * 10 + 2 END AS lo,
              CASE WHEN o_orderkey % 4 = 1 THEN (o_custkey % 9000 + 1) * 10 + 4.5 WHEN o_orderkey % 1000 = 7 THEN 1e9 ELSE (o_custkey % 9000 + 2) * 10 + 3 END AS hi FROM orders)
        SELECT concat('HOT-', CAST(o_orderkey AS STRING)) AS advisory_id, count(*) AS versions, CAST(sum(x) AS BIGINT) AS total
        FROM v JOIN r ON x >= lo AND x < hi GROUP BY 1""",
)
def affected_hot_package(spark, sf):
    """One package with a version of every order line and an advisory of every order."""
    rows = table(spark, sf, "lineitem").selectExpr("'f' AS file_path", "'npm' AS ecosystem", "'hot' AS name", f"{HOT_VERSION} AS version")
    hits = affected_versions(rows, table(spark, sf, "orders").selectExpr(*HOT_ADVISORY))
    parts = F.split("version", r"\.")
    number = parts[0].cast("bigint") * 10 + parts[1].cast("bigint")
    return hits.groupBy("advisory_id").agg(F.count("*").alias("versions"), F.sum(number).alias("total"))


@query(
    "scan_dependencies",
    f"""WITH advs AS (SELECT ecosystem, package_name, advisory_id, severity, CAST(split_part(fixed, '.', 1) AS BIGINT) AS hi FROM ({{0}})),
        deps AS ({expected(M.CARGO)} UNION ALL {expected(M.PIP)} UNION ALL {expected(M.NPM)})
        SELECT advisory_id AS rule_id, d.ecosystem, advs.severity, count(*) AS n FROM deps d JOIN advs ON advs.ecosystem = d.ecosystem AND advs.package_name = d.name
        WHERE CAST(split_part(version, '.', 1) AS BIGINT) < hi GROUP BY ALL""".replace(
        "{0}",
        " UNION ALL ".join(
            f"SELECT '{eco}' AS ecosystem, concat('{prefix}', CAST(p_partkey % 500 AS STRING)) AS package_name, concat('{eco}-', CAST(p_partkey AS STRING)) AS advisory_id,"
            f" CASE WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'low' END AS severity, concat(CAST(p_size AS STRING), '.0') AS fixed FROM part WHERE p_partkey % 20 = {k}"
            for k, (eco, prefix) in enumerate((("crates.io", "core-"), ("PyPI", "net-"), ("npm", "io-")))
        ),
    ),
)
def scan_dependencies(spark, sf):
    """The whole dependency engine on manifests of three ecosystems."""
    files = manifest_files(spark, sf, M.CARGO).unionByName(manifest_files(spark, sf, M.PIP)).unionByName(manifest_files(spark, sf, M.NPM))
    advs = None
    for k, (eco, prefix) in enumerate((("crates.io", "core-"), ("PyPI", "net-"), ("npm", "io-"))):
        part = table(spark, sf, "part").where(f"p_partkey % 20 = {k}").selectExpr(
            f"concat('{eco}-', CAST(p_partkey AS STRING)) AS advisory_id", "CAST(NULL AS STRING) AS cve_id", f"'{eco}' AS ecosystem",
            f"concat('{prefix}', CAST(p_partkey % 500 AS STRING)) AS package_name", "'0' AS introduced", "concat(CAST(p_size AS STRING), '.0') AS fixed",
            "CASE WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'low' END AS severity", "p_name AS summary", "'osv' AS source",
        )
        advs = part if advs is None else advs.unionByName(part)
    found = scan(files, ["sca"], "info", advisories=advs, detected_at=NOW)
    ecosystem = F.regexp_extract("vulnerable_code", r"\((.*)\)$", 1)
    return found.groupBy("rule_id", ecosystem.alias("ecosystem"), "severity").agg(F.count("*").alias("n"))


@query(
    "scan_manifests",
    f"""WITH advs AS (SELECT concat('core-', CAST(p_partkey % 500 AS STRING)) AS name, p_partkey % 500 AS k, max(p_size) AS hi FROM part GROUP BY 1, 2),
        deps AS (SELECT {path('Cargo.lock')} AS file_path, {DEPS[0][0]} AS name, {DEPS[0][1]} AS version,
                 p_size * 10000 + ((p_partkey + 1) % 13) * 100 + 1 AS num FROM part)
        SELECT file_path, concat('A-', name) AS rule_id, concat(name, '@', version, ' (crates.io)') AS vulnerable_code, severity FROM (
          SELECT d.file_path, d.name, d.version, CASE WHEN a.k % 2 = 0 THEN 'critical' ELSE 'medium' END AS severity
          FROM deps d JOIN advs a ON a.name = d.name WHERE d.num < a.hi * 10000) WHERE severity = 'critical'""",
)
def scan_manifests(spark, sf):
    """Manifests to findings above a level, in one call."""
    advs = (
        table(spark, sf, "part")
        .groupBy(F.expr("p_partkey % 500").alias("k")).agg(F.max("p_size").alias("hi"))
        .selectExpr(
            "concat('A-core-', CAST(k AS STRING)) AS advisory_id", "CAST(NULL AS STRING) AS cve_id",
            "'crates.io' AS ecosystem", "concat('core-', CAST(k AS STRING)) AS package_name",
            "'0' AS introduced", "CAST(hi AS STRING) AS fixed",
            "CASE WHEN k % 2 = 0 THEN 'critical' ELSE 'medium' END AS severity",
            "CAST(NULL AS STRING) AS summary", "'osv' AS source",
        )
    )
    found = scan(manifest_files(spark, sf, M.CARGO), ["sca"], "high", advisories=advs, detected_at=NOW)
    return found.select("file_path", "rule_id", "vulnerable_code", "severity")
