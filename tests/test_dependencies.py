import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus import schemas
from lynceus.functions.severity import cvss_severity
from lynceus.functions.versions import version_key
from lynceus.operators import vulnerabilities as V
from lynceus.operators.advisories import affected, affected_versions, coverage, sca_findings, unusable_ranges
from lynceus.operators.manifests import extract_dependencies, manifest_kind
from lynceus.operators.findings import to_findings
from lynceus.operators.title_search import similar_titles, title_search
from lynceus.plans.advisory_sync import sync_advisories
from lynceus.plans.scan import as_files, scan

NOW = datetime(2024, 5, 1, 12)

MANIFESTS = {
    "Cargo.lock": (
        'version = 3\n\n[[package]]\nname = "anyhow"\nversion = "1.0.70"\n\n'
        '[[package]]\nname = "tokio"\nversion = "1.28.0"\ndependencies = [\n "bytes",\n]\n',
        {("anyhow", "1.0.70", "crates.io"), ("tokio", "1.28.0", "crates.io")},
    ),
    "requirements.txt": (
        "requests==2.28.0\nflask>=2.0.0\n# comment\n\n  Django==3.2.0 ; python_version > '3'\nplain\n",
        {("requests", "2.28.0", "PyPI"), ("flask", "2.0.0", "PyPI"), ("Django", "3.2.0", "PyPI")},
    ),
    "go.sum": (
        "golang.org/x/text v0.3.7 h1:abc\ngolang.org/x/text v0.3.7/go.mod h1:def\n",
        {("golang.org/x/text", "0.3.7", "Go")},
    ),
    "package-lock.json": (
        '{"name":"a","packages":{"":{"version":"9.9.9"},"node_modules/lodash":{"version":"4.17.15"},'
        '"node_modules/a/node_modules/@s/b":{"version":"1.0.0"},"node_modules/l":{"link":true}}}',
        {("lodash", "4.17.15", "npm"), ("@s/b", "1.0.0", "npm")},
    ),
    "pom.xml": (
        "<project><dependencies>\n<dependency>\n <groupId>org.a</groupId>\n <artifactId>core</artifactId>\n"
        " <version>2.14.0</version>\n</dependency>\n<dependency><groupId>org.b</groupId>"
        "<artifactId>web</artifactId></dependency></dependencies></project>",
        {("org.a:core", "2.14.0", "Maven"), ("org.b:web", "unknown", "Maven")},
    ),
    "yarn.lock": (
        '# yarn lockfile v1\n\n"@babel/core@^7.0.0":\n  version "7.1.2"\n  resolved "x"\n\n'
        'lodash@^4.17.0, lodash@^4.0.0:\n  version "4.17.21"\n',
        {("@babel/core", "7.1.2", "npm"), ("lodash", "4.17.21", "npm")},
    ),
    "pnpm-lock.yaml": (
        "packages:\n\n  /lodash@4.17.21:\n    resolution: {x: y}\n\n  /@s/b@1.2.3(react@18.0.0):\n"
        "    dev: true\n\n  /old/1.0.0:\n    dev: false\n",
        {("lodash", "4.17.21", "npm"), ("@s/b", "1.2.3", "npm"), ("old", "1.0.0", "npm")},
    ),
    "Pipfile.lock": (
        '{"default":{"django":{"version":"==3.2.1"}},"develop":{"pytest":{"version":"==7.0.0"},"loc":{"path":"."}}}',
        {("django", "3.2.1", "PyPI"), ("pytest", "7.0.0", "PyPI")},
    ),
    "poetry.lock": (
        '[[package]]\nname = "attrs"\nversion = "22.1.0"\n',
        {("attrs", "22.1.0", "PyPI")},
    ),
    "main.py": ('password = "x"\nx == 1\n', set()),
}


@pytest.mark.parametrize("name", list(MANIFESTS))
def test_manifests(spark, name):
    text, expected = MANIFESTS[name]
    files = as_files(spark.createDataFrame([(f"/p/{name}", text)], "path STRING, code STRING"))
    rows = [(r["name"], r["version"], r["ecosystem"]) for r in extract_dependencies(files).collect()]
    assert sorted(rows) == sorted(expected)


def test_kind_by_content(spark):
    rows = [
        ("a.lock", "x\n[[package]]\n", "cargo"),
        ("deps.txt", "a==1\n", "pip"),
        ("m.xml", "<groupId>", "maven"),
        ("x", ' \n{"dependencies": {}}', "npm"),
        ("y", "<groupId>a</groupId>", "maven"),
        ("z.py", "a==1", None),
        (None, "a==1", None),
    ]
    df = spark.createDataFrame(rows, "path STRING, code STRING, want STRING")
    got = df.select("want", manifest_kind(F.col("path"), F.col("code")).alias("kind")).collect()
    assert all(r["want"] == r["kind"] for r in got)


def test_cvss(spark):
    cases = {"9.8": "critical", "7.5": "high", "5.4": "medium", "2.1": "low",
             "CVSS:3.1/AV:N/AC:L": "medium", "": "medium", "9.0/x": "critical",
             "NaN": "medium", " 9": "medium", "1e1": "critical", "0": "low"}
    df = spark.createDataFrame(list(cases.items()), "s STRING, want STRING")
    assert df.where(cvss_severity(F.col("s")) != F.col("want")).count() == 0


def test_version_order(spark):
    ordered = ["0.9", "1.2", "1.9.3", "1.10.0", "2", "v2.0.1", "10.0"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ordered)], "i INT, v STRING")
    got = [r["i"] for r in df.orderBy(version_key(F.col("v"))).collect()]
    assert got == list(range(len(ordered)))
    same = spark.createDataFrame([("1.2", "1.2.0.0"), ("v1", "1.0")], "a STRING, b STRING")
    assert same.where(version_key(F.col("a")) == version_key(F.col("b"))).count() == 2
    staged = [
        "1.0.dev3", "1.0a1", "1.0-beta", "1.0b2", "1.0-rc.2", "1.0rc10", "1.0-SNAPSHOT", "1.0.Final", "1.0.post1", "1.0.0.1",
        "20210101120000", "123456789012345678901234567890.1",
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(staged)], "i INT, v STRING")
    assert [r["i"] for r in df.orderBy(version_key(F.col("v"))).collect()] == list(range(len(staged)))
    go = spark.createDataFrame([(0, "v0.0.0-20190101000000-ab"), (1, "v0.0.0-20210101000000-aa"), (2, "v0.0.0"), (3, "0.0.1+build")], "i INT, v STRING")
    assert [r["i"] for r in go.orderBy(version_key(F.col("v"))).collect()] == [0, 1, 2, 3]
    jre = spark.createDataFrame([("31.1-jre",)], "v STRING").select(version_key(F.col("v"), F.lit("Maven")) > version_key(F.lit("31.1"), F.lit("Maven")))
    assert jre.first()[0]
    odd = spark.createDataFrame([("unknown",), ("",), ("main",)], "v STRING")
    assert odd.where(version_key(F.col("v")).isNotNull()).count() == 0


def deps_and_advisories(spark):
    deps = spark.createDataFrame(
        [(f"f{i}", "lodash", f"4.17.{i % 30}", "npm") for i in range(60)]
        + [("f0", "hyper", "0.14.10", "crates.io"), ("f1", "hyper", "0.14.10-rc1", "crates.io")],
        schemas.DEPENDENCIES,
    )
    adv = spark.createDataFrame(
        [
            ("GHSA-1", "CVE-2021-1", "npm", "lodash", "4.17.0", "4.17.21", "high", "Command injection", "osv"),
            ("GHSA-1", "CVE-2021-1", "npm", "lodash", "4.17.5", "4.17.12", "high", "Command injection", "osv"),
            ("GHSA-2", None, "npm", "lodash", "0", "4.17.12", "medium", None, "osv"),
            ("RS-1", None, "crates.io", "hyper", "0.14.9", None, "low", "x", "osv"),
            ("RS-2", None, "crates.io", "hyper", "bad", "0.15", "low", "x", "osv"),
        ],
        schemas.ADVISORIES,
    )
    return deps, adv


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_affected_is_a_range_join(spark, max_bytes):
    deps, adv = deps_and_advisories(spark)
    got = {(r["file_path"], r["advisory_id"]) for r in affected(deps, adv, max_bytes).collect()}
    want = {(f"f{i}", "GHSA-1") for i in range(60) if i % 30 < 21}
    want |= {(f"f{i}", "GHSA-2") for i in range(60) if i % 30 < 12}
    want |= {("f0", "RS-1"), ("f1", "RS-1")}
    assert got == want
    assert affected(deps, adv, max_bytes).count() == len(want)
    versions = affected_versions(deps, adv, max_bytes)
    assert versions.count() == 21 + 12 + 2


def test_sca_findings_and_coverage(spark):
    deps, adv = deps_and_advisories(spark)
    found = to_findings(sca_findings(affected(deps, adv)))
    row = found.where("file_path = 'f0' AND rule_id = 'GHSA-2'").first()
    assert row["title"] == "Dependency lodash 4.17.0: advisory for lodash@4.17.0"
    assert row["vulnerable_code"] == "lodash@4.17.0 (npm)"
    assert row["description"] == " (ID: GHSA-2)"
    assert (row["line_start"], row["cwe_id"], row["sev_rank"]) == (0, None, 2)
    cov = {r["ecosystem"]: r.asDict() for r in coverage(deps, adv).collect()}
    assert cov["npm"]["dependencies"] == 60 and cov["npm"]["vulnerable_versions"] == 21
    assert cov["npm"]["vulnerable_dependencies"] == 42
    assert cov["crates.io"]["uncheckable_versions"] == 0


def feeds(spark):
    nvd = spark.createDataFrame(
        [
            ("0", [
                {"cve": {"id": "CVE-1", "descriptions": [{"lang": "fr", "value": "f"}, {"lang": "en", "value": "e"}],
                         "metrics": {"cvssMetricV31": [{"cvssData": {"baseSeverity": "HIGH"}}]}}},
                {"cve": {"id": "CVE-2", "descriptions": [], "metrics": None}},
                {"cve": {"id": "CVE-1", "descriptions": [{"lang": "en", "value": "later"}], "metrics": None}},
            ])
        ],
        schemas.T.StructType([schemas.T.StructField("feed_pos", schemas._S), *schemas.NVD_FEED.fields]),
    )
    def osv_row(pos, i, summary, aliases, sev, eco, pkg):
        return (pos, i, summary, aliases, sev, [{"package": {"name": pkg, "ecosystem": eco},
                "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.2"}, {"introduced": "2.0"}]}]}])
    osv = spark.createDataFrame(
        [
            osv_row("1", "GHSA-a", "sum a", ["X", "CVE-1"], [{"type": "CVSS_V3", "score": "9.8"}], "npm", "lodash"),
            osv_row("2", "GHSA-b", None, None, None, "npm", "axios"),
            osv_row("3", "GHSA-c", "c", [], [{"type": "OTHER", "score": "9"}], "npm", "unseeded"),
        ],
        schemas.T.StructType([schemas.T.StructField("feed_pos", schemas._S), *schemas.OSV_RECORD.fields]),
    )
    return nvd, osv


def test_sync(spark):
    nvd, osv = feeds(spark)
    empty = spark.createDataFrame([], schemas.VULNERABILITIES)
    table = sync_advisories(empty, NOW, nvd, osv, V.seed_df(spark))
    rows = {r["cve_id"]: r for r in table.collect()}
    assert set(rows) == {"CVE-1", "CVE-2", "GHSA-b"}
    one = rows["CVE-1"]
    assert (one["title"], one["data_source"]) == ("Vulnerability CVE-1", "nvd")
    assert (one["description"], one["severity"], one["ecosystem"], one["package_name"]) == ("sum a", "critical", "npm", "lodash")
    assert (rows["CVE-2"]["severity"], rows["CVE-2"]["description"]) == ("medium", "")
    assert rows["GHSA-b"]["description"] == "Vulnerability in axios"
    assert rows["GHSA-b"]["title"] == "GHSA-b (axios@npm)"
    later = datetime(2024, 6, 1)
    again = sync_advisories(table, later, nvd, osv, V.seed_df(spark))
    assert again.drop("updated_at").exceptAll(table.drop("updated_at")).count() == 0
    assert {r["updated_at"] for r in again.collect()} == {later}
    only_nvd = sync_advisories(table, later, nvd)
    kept = only_nvd.where("cve_id = 'CVE-1'").first()
    assert (kept["ecosystem"], kept["description"]) == ("npm", "later")


def test_osv_ranges(spark):
    _, osv = feeds(spark)
    rows = V.osv_advisories(osv, V.seed_df(spark)).where("advisory_id = 'GHSA-a'").collect()
    assert {(r["introduced"], r["fixed"]) for r in rows} == {("0", "1.2"), ("2.0", None)}


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_title_enrichment(spark, max_bytes):
    deps, adv = deps_and_advisories(spark)
    found = to_findings(sca_findings(affected(deps, adv)))
    vulns = spark.createDataFrame([("CVE-2021-1", "Stored title")], "cve_id STRING, title STRING")
    got = V.enrich_titles(found, vulns, max_bytes)
    assert got.columns == found.columns and got.count() == found.count()
    assert got.where("cve_id = 'CVE-2021-1' AND title <> 'Stored title'").count() == 0
    assert got.where("cve_id IS NULL AND title = 'Stored title'").count() == 0


def test_scan_with_all_engines(spark):
    _, adv = deps_and_advisories(spark)
    files = as_files(spark.createDataFrame(
        [("requirements.txt", "x==1\n"), ("Cargo.lock", '[[package]]\nname = "hyper"\nversion = "0.14.10"\n'),
         ("a.py", "eval(x)\n")], "path STRING, code STRING"))
    got = {(r["engine"], r["rule_id"]) for r in scan(files, advisories=adv, detected_at=NOW).collect()}
    assert got == {("sca", "RS-1"), ("sast", "S05")}


def test_cache_expiry(spark):
    cache = spark.createDataFrame(
        [("CVE-1", datetime(2024, 5, 2)), ("CVE-2", datetime(2024, 5, 1))], "cve_id STRING, expires_at TIMESTAMP")
    wanted = spark.createDataFrame([("CVE-1",), ("CVE-2",), ("CVE-3",), (None,)], "cve_id STRING")
    assert {r[0] for r in V.ids_to_refresh(wanted, cache, NOW).collect()} == {"CVE-2", "CVE-3"}


def py_grams(text):
    import re
    out = set()
    for w in re.findall(r"[^\W_]+", text.lower()):
        p = f"  {w} "
        out |= {p[i:i + 3] for i in range(len(p) - 2)}
    return out


@pytest.mark.parametrize("score", [0.1, 0.3, 0.6, 1.0])
def test_title_search_against_brute_force(spark, score):
    titles = ["Vulnerability in lodash", "Vulnerability in lodash core", "Heap overflow in openssl",
              "Vulnerability CVE-1", "openssl overflow", "Denial of service", "lodash", "Lodash"]
    queries = ["lodash", "openssl overflow", "vulnerability", "service denial", "zzz"]
    v = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(titles)], "cve_id STRING, title STRING")
    q = spark.createDataFrame([(x,) for x in queries], "query STRING")
    got = {(r["query"], r["title"], round(r["score"], 9)) for r in similar_titles(v, q, score).collect()}
    want = set()
    for x in queries:
        for t in titles:
            a, b = py_grams(x), py_grams(t)
            s = len(a & b) / len(a | b)
            if s >= score:
                want.add((x, t, round(s, 9)))
    assert got == want
    assert title_search(v, q, score).count() == len(want)


def test_advisories_of_real_records(spark):
    """Ends inside the range, listed versions, commit ranges and staged ends, as feeds have them."""
    def record(name, ranges=(), versions=None, eco="PyPI"):
        return {
            "id": f"A-{name}", "affected": [{"package": {"name": name, "ecosystem": eco}, "ranges": list(ranges), "versions": versions}],
        }

    def span(kind="ECOSYSTEM", **events):
        return {"type": kind, "events": [{"introduced": "0"}] + [{k: v} for k, v in events.items()]}

    records = [
        record("last", [span(last_affected="1.0.0")]), record("git", [span("GIT")]), record("listed", versions=["5.0.0", "weekly"]),
        record("staged", [span(fixed="6.0.0-rc1")]), record("long", [span(fixed="20210101120000")]),
        record("org:mvn", [span(fixed="31.1-jre")], eco="Maven"), record("go", [span("SEMVER", fixed="0.0.0-20210101000000-aa")], eco="Go"),
        record("odd", [span(fixed="trunk")]),
    ]
    rows = [(json.dumps(r | {"feed_pos": str(i)}),) for i, r in enumerate(records)]
    schema = T.StructType([*schemas.OSV_RECORD.fields, T.StructField("feed_pos", T.StringType())])
    feed = spark.createDataFrame(rows, "value string").select(F.from_json("value", schema).alias("r")).select("r.*")
    advisories = V.osv_advisories(feed)
    cases = {
        ("last", "5.0.0", "PyPI"): False, ("last", "1.0", "PyPI"): True, ("last", "1.0.0.1", "PyPI"): False,
        ("git", "5.0.0", "PyPI"): False, ("listed", "5.0.0", "PyPI"): True, ("listed", "weekly", "PyPI"): True,
        ("listed", "5.0.1", "PyPI"): False, ("staged", "5.0.0", "PyPI"): True, ("staged", "6.0.0rc1", "PyPI"): False,
        ("staged", "6.0.0-beta", "PyPI"): True, ("long", "20200101120000", "PyPI"): True, ("long", "20220101120000", "PyPI"): False,
        ("org:mvn", "31.1", "Maven"): True, ("org:mvn", "31.1-jre", "Maven"): False, ("go", "v0.0.0-20200101000000-ff", "Go"): True,
        ("go", "v0.0.0", "Go"): False, ("odd", "1.0", "PyPI"): False,
    }
    deps = spark.createDataFrame([(f"f{i}", n, v, e) for i, (n, v, e) in enumerate(cases)], schemas.DEPENDENCIES)
    for max_bytes in (0, 1 << 20):
        hits = {(r["name"], r["version"]) for r in affected(deps, advisories, max_bytes).collect()}
        assert hits == {(n, v) for (n, v, _), hit in cases.items() if hit}
    assert [tuple(r) for r in unusable_ranges(advisories).collect()] == [("PyPI", 1)]


def test_sweep_gives_the_rows_of_every_range(spark):
    """Random ranges, open and closed, equal versions, versions without a key, blocks smaller than a package."""
    import random

    from lynceus.operators import advisories as A

    rng = random.Random(8)
    version = lambda: rng.choice(["{}.{}", "{}.{}.0", "{}.{}-rc1", "v{}.{}"]).format(rng.randint(0, 9), rng.randint(0, 9))
    installed = [("f", rng.choice("ab"), version(), "npm") for _ in range(400)] + [("f", "a", "odd", "npm"), ("f", None, "1.0", "npm"), ("f", "a", None, "npm")]
    rows = []
    for i in range(120):
        low, end = rng.choice(["0", version()]), rng.choice([None, version()])
        fixed = end if rng.random() < 0.5 else None
        rows.append((f"A{i % 60}", None, "npm", rng.choice("ab"), low, fixed, None if fixed else end, "low", "s", "osv"))
    rows.append(("A-odd", None, "npm", "a", "odd", None, "odd", "low", "s", "osv"))
    names = "advisory_id string, cve_id string, ecosystem string, package_name string, introduced string, fixed string, last_affected string, severity string, summary string, source string"
    deps = spark.createDataFrame(installed, "file_path string, name string, version string, ecosystem string")
    advs = spark.createDataFrame(rows, names)
    rows_of = lambda df: sorted(map(tuple, df.select("file_path", "name", "version", "advisory_id", "severity").collect()))
    plain = rows_of(affected(deps, advs))
    assert any(r[3] == "A-odd" for r in plain) and len(plain) > 1000
    for block in (1, 5, 64):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(A, "CROWDED", 3)
            patch.setattr(A.swept, "__defaults__", (block,))
            assert rows_of(affected(deps, advs)) == plain
            versions = affected_versions(deps, advs).select("name", "version", "advisory_id")
            assert sorted(map(tuple, versions.collect())) == sorted({(r[1], r[2], r[3]) for r in plain})
    # as many compared one by one
    keyed = advs.select("advisory_id", F.col("package_name").alias("p"), "introduced", "fixed", "last_affected")
    key = lambda c: version_key(F.col(c), F.lit("npm"))
    inside = ((F.col("introduced") == "0") | (key("version") >= key("introduced"))) & F.coalesce(key("version") < key("fixed"), key("version") <= key("last_affected"), F.lit(True))
    brute = deps.join(keyed, (F.col("name") == F.col("p")) & inside & key("version").isNotNull()).select("file_path", "name", "version", "advisory_id", F.lit("low").alias("severity"))
    counted = brute.dropDuplicates(["name", "version", "advisory_id"]).select("name", "version", "advisory_id")
    assert sorted(map(tuple, counted.collect())) == sorted({(r[1], r[2], r[3]) for r in plain if r[3] != "A-odd"})


def test_version_grammars(spark):
    from workload.dependencies import ORDER_ROWS

    rows = [(eco, place, form.replace("{n}", n)) for eco, place, _, form in ORDER_ROWS for n in ("1", "12")]
    df = spark.createDataFrame(rows, "eco string, place int, v string").select("*", version_key(F.col("v"), F.col("eco")).alias("key"))
    assert df.where("key IS NULL").count() == 0
    a, b = df.alias("a"), df.alias("b")
    pairs = a.join(b, (F.col("a.eco") == F.col("b.eco")) & (F.regexp_extract("a.v", r"(12|1)", 1) == F.regexp_extract("b.v", r"(12|1)", 1)))
    wrong = pairs.where(((F.col("a.place") < F.col("b.place")) != (F.col("a.key") < F.col("b.key"))) & ~F.col("a.v").startswith("1!") & ~F.col("b.v").startswith("1!"))
    assert wrong.select("a.v", "b.v").collect() == []
    for eco, low, high in (
        ("PyPI", "3.0", "1!2.0"), ("PyPI", "1.0", "1.0-1"), ("PyPI", "1.0a1.dev1", "1.0a1"), ("PyPI", "1.0.post1.dev1", "1.0.post1"), ("PyPI", "1.0", "1.0+local1"),
        ("npm", "1.0.0-patch.1", "1.0.0"), ("npm", "1.0.0-alpha10", "1.0.0-alpha2"), ("npm", "1.0.0-pre", "1.0.0-rc"), ("npm", "1.0.0-Beta", "1.0.0-alpha"),
    ):
        got = spark.range(1).select(version_key(F.lit(low), F.lit(eco)) < version_key(F.lit(high), F.lit(eco))).first()[0]
        assert got, (eco, low, high)
    odd = [("PyPI", "1.0-jre"), ("npm", "latest"), ("Maven", "${v}"), ("Go", ""), ("PyPI", None), ("npm", "x1")]
    assert spark.createDataFrame(odd, "eco string, v string").where(version_key(F.col("v"), F.col("eco")).isNotNull()).count() == 0


def test_numbered_has_no_gaps(spark):
    from lynceus.scale import numbered

    rows = spark.range(1000).select((F.col("id") % 37).alias("k"), F.col("id").alias("i"))
    got = [tuple(r) for r in numbered(rows, ["k", "i"], "at").select("at", "k", "i").collect()]
    assert [r[0] for r in sorted(got, key=lambda r: r[1:])] == list(range(1000))
    assert numbered(rows.limit(0), ["k", "i"], "at").collect() == []


def test_requirement_lines(spark):
    from lynceus.operators import manifests as M

    code = "a==1.0\nreq[sec, x] >= 2.1,<3 ; python_version > '3'\nz.y-w_v===4.0.dev1 # note\n-e git+x==1\nb~=5\nplain\n# c==1\nd != 6.0\n"
    got = spark.createDataFrame([(code,)], "code string").select(M.requirements(F.col("code")).alias("p")).first()["p"]
    assert [tuple(x)[:2] for x in got] == [("a", "1.0"), ("req", "2.1"), ("z.y-w_v", "4.0.dev1"), ("b", "5"), ("d", "6.0")]


def test_larger_lookups_are_never_broadcast_on_an_estimate(spark, tmp_path):
    from lynceus.scale import join_lookup

    # rows that compress to a small file, as written keys and ranges do
    spark.range(20000).selectExpr("id % 7 AS k", "repeat('x', 50) AS text").write.parquet(str(tmp_path / "lookup"))
    lookup = spark.read.parquet(str(tmp_path / "lookup"))
    joined = join_lookup(spark.range(50).selectExpr("id AS k", "id AS n"), lookup, ["k"], "left", max_bytes=1000)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert joined.count() == 20000 + 43


def test_sweep_finds_a_pair_once_and_carries_the_advisory(spark):
    from lynceus.operators.advisories import OPEN_END, swept

    ranges = spark.createDataFrame(
        [
            ("npm", "p", "A", [("", "5", False, None), ("2", "3", False, None), ("2", OPEN_END, False, None), ("4", "4", True, "4"), (None, None, True, "odd")], "high"),
            ("npm", "p", "B", [("1", "1", True, "1")], "low"),
            ("npm", "p", None, [("", OPEN_END, False, None)], "low"),
        ],
        "ecosystem string, name string, advisory_id string, ranges array<struct<lo:string,hi:string,closed:boolean,exact:string>>, severity string",
    )
    rows = [("npm", "p", v, v) for v in "123456789"] + [("npm", "p", "odd", None), ("npm", "p", "other", None), ("npm", "q", "1", "1")]
    versions = spark.createDataFrame(rows, "ecosystem string, name string, version string, key string")
    got = swept(versions, ranges, 2)
    assert sorted(map(tuple, got.select("version", "advisory_id", "severity").collect())) == sorted(
        [(v, "A", "high") for v in [*"123456789", "odd"]] + [("1", "B", "low")]
    )


def test_rows_without_a_key_are_spread(spark):
    from lynceus.scale import join_lookup

    left = spark.range(2000).selectExpr("CASE WHEN id % 2 = 0 THEN id END AS k", "id AS n")
    right = spark.createDataFrame([(4, "a"), (4, "b"), (None, "c")], "k bigint, t string")
    joined = join_lookup(left, right, ["k"], "left", max_bytes=0)
    assert joined.columns == ["k", "n", "t"]
    assert sorted((r.n, r.t) for r in joined.where("t IS NOT NULL").collect()) == [(4, "a"), (4, "b")]
    assert joined.count() == 2001
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_spread" in plan.split("hashpartitioning(k")[1].split(")")[0], plan


def test_sweep_takes_rows_with_further_columns(spark):
    """Repeated dependencies are matched as they are, so that no pairs are joined with them afterwards; ranges of all block sizes."""
    from lynceus.operators.advisories import swept

    n = 600
    rows = spark.range(n).selectExpr("'npm' AS ecosystem", "'p' AS name", "lpad(CAST(id % 50 AS STRING), 2, '0') AS version", "id AS a", "lpad(CAST(id % 50 AS STRING), 2, '0') AS key")
    ranges = spark.range(400).selectExpr(
        "'npm' AS ecosystem", "'p' AS name", "CAST(id AS STRING) AS advisory_id",
        "array(named_struct('lo', '', 'hi', lpad(CAST(id % 50 AS STRING), 2, '0'), 'closed', false, 'exact', CAST(NULL AS STRING))) AS ranges",
    )
    got = swept(rows, ranges, 1)
    assert got.columns == ["ecosystem", "name", "version", "a", "advisory_id"]
    pairs = {(r.a, r.advisory_id) for r in got.collect()}
    assert pairs == {(a, str(i)) for a in range(n) for i in range(400) if a % 50 < i % 50}
    assert got.count() == len(pairs) > 100_000
