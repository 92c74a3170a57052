import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lynceus import schemas, scan
from lynceus.functions.languages import language_from_ext, language_from_name
from lynceus.functions.text import extension, to_lines
from lynceus.operators import events as E
from lynceus.operators import explain as X
from lynceus.operators import reports as R
from lynceus.plans.scan import as_files
from lynceus.sources import feeds, sinks, tree, workspace
from lynceus.streaming.scan import read_file_stream, scan_stream, start_scan_job

NOW = datetime(2024, 5, 1, 12)


def found(spark, *codes, engines=("sast", "secrets", "ai_code"), level="info"):
    rows = [(f"src/f{i}.py", c) for i, c in enumerate(codes)]
    files = as_files(spark.createDataFrame(rows, "path STRING, code STRING"))
    return files, scan(files, engines, level, detected_at=NOW)


@pytest.mark.parametrize(
    "text, lines",
    [
        ("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb", ["a", "b"]), ("\n", [""]),
        ("a\n\n", ["a", ""]), ("a\r", ["a\r"]), ("a\r\r\n", ["a\r"]), ("a\n\nb\n", ["a", "", "b"]),
    ],
)
def test_lines(spark, text, lines):
    df = spark.createDataFrame([("p", text)], "path STRING, code STRING")
    got = to_lines(df).orderBy("line_no").collect()
    assert [r["line"] for r in got] == lines
    assert [r["line_no"] for r in got] == list(range(1, len(lines) + 1))


def test_extensions_and_languages(spark):
    cases = [("a/b.py", "py"), (".env", None), ("x/.hidden", None), ("a.tar.json", "json"), ("Makefile", None), ("d.x/Makefile", None)]
    df = spark.createDataFrame(cases, "p STRING, want STRING")
    assert df.where(~extension(F.col("p")).eqNullSafe(F.col("want"))).count() == 0
    names = spark.createDataFrame([("PY", "python", "python"), ("kts", "kotlin", "unknown"), ("golang", "unknown", "go"), ("c++", "unknown", "cpp"), (None, "unknown", "unknown")], "x STRING, e STRING, n STRING")
    assert names.where((language_from_ext(F.col("x")) != F.col("e")) | (language_from_name(F.col("x")) != F.col("n"))).count() == 0


def test_code_tree(spark, tmp_path):
    def put(name, data):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)

    put("src/a.py", "eval(x)\n# é\n".encode())
    put("src/B.JS", b"eval(y)\n")
    put("src/bad.py", b"eval(\xff)\n")
    put("src/notes.txt", b"eval(z)\n")
    put("src/requirements.txt", b"x==1\n")
    put("Dockerfile", b"FROM x\n")
    put(".env", b"A=1\n")
    put("node_modules/m/i.js", b"eval(z)\n")
    put("src/dist/i.js", b"eval(z)\n")
    put("src/__init__.py", b"z = 1\n")
    put(".github/wf.yml", b"on: push\n")
    put("src/big.py", b"x" * 2000)
    files = tree.read_code_tree(spark, str(tmp_path), max_bytes=1000)
    names = {os.path.basename(r["path"]): r["language"] for r in files.collect()}
    seen = {"a.py": "python", "B.JS": "javascript", "requirements.txt": "unknown", "Dockerfile": "unknown"}
    assert names == {**seen, ".env": "unknown", "__init__.py": "python", "wf.yml": "unknown"}
    plain = tree.read_code_files(spark, str(tmp_path), max_bytes=1000)
    assert {os.path.basename(r["path"]): r["language"] for r in plain.collect()} == seen
    rounds = tree.list_tree(spark, str(tmp_path), entries_per_task=2)
    assert rounds.count() == tree.list_tree(spark, f"file://{tmp_path}").count() == 10
    assert scan(files, ["sast"]).where("rule_id = 'S05'").count() == 2
    refused = tree.tree_rejects(spark, str(tmp_path), max_bytes=1000).collect()
    assert {(os.path.basename(r["path"]), r["bytes"], r["reason"]) for r in refused} == {
        ("bad.py", 8, "not UTF-8 text"), ("big.py", 2000, "over 1000 bytes")
    }
    gone = spark.createDataFrame([(str(tmp_path / "gone.py"), 1)], "path STRING, bytes BIGINT")
    assert [r["reason"] for r in tree._contents(gone, str(tmp_path)).collect()] == ["not found"]
    folder = spark.createDataFrame([(str(tmp_path / "src"), 1)], "path STRING, bytes BIGINT")
    with pytest.raises(Exception, match="(?i)director|regular file"):
        tree._contents(folder, str(tmp_path)).collect()
    one = tree.read_file(spark, str(tmp_path / "src/notes.txt")).collect()
    assert one[0]["code"] == "eval(z)\n"
    with pytest.raises(Exception, match="not UTF-8"):
        tree.read_file(spark, str(tmp_path / "src/bad.py")).collect()


def test_workspace_and_limits(spark, tmp_path):
    req = {"files": [{"path": "a", "code": "x" * 10, "language": "golang"}, {"path": "b.py", "code": "x" * 30, "language": "ts"}], "engines": ["sast"]}
    (tmp_path / "r.json").write_text(json.dumps(req) + "\n")
    files = workspace.read_workspace(spark, str(tmp_path))
    assert {r["path"]: r["language"] for r in files.collect()} == {"a": "go", "b.py": "typescript"}
    kept, rejects = workspace.split_oversize(files, 20)
    assert [r["path"] for r in kept.collect()] == ["a"]
    assert [(r["path"], r["bytes"]) for r in rejects.collect()] == [("b.py", 30)]
    batches = files.withColumn("batch", F.lit(1)).unionByName(files.where("path = 'a'").withColumn("batch", F.lit(2)))
    kept, rejects = workspace.split_oversize_batches(batches, "batch", 20)
    assert [r["batch"] for r in kept.collect()] == [2] and [r["bytes"] for r in rejects.collect()] == [40]


def test_feed_files(spark, tmp_path):
    nvd = {"resultsPerPage": 1, "vulnerabilities": [{"cve": {"id": "CVE-9", "descriptions": [{"lang": "en", "value": "d"}]}}]}
    (tmp_path / "nvd.json").write_text(json.dumps(nvd, indent=2))
    from lynceus.operators.vulnerabilities import flatten_nvd, flatten_osv
    rows = flatten_nvd(feeds.read_nvd(spark, str(tmp_path / "nvd.json"))).collect()
    assert [(r["cve_id"], r["severity"], r["description"]) for r in rows] == [("CVE-9", "medium", "d")]
    osv = {"id": "GHSA-1", "affected": [{"package": {"name": "p", "ecosystem": "npm"}}], "severity": [{"type": "CVSS_V3", "score": "7.1"}]}
    (tmp_path / "osv.jsonl").write_text("\n".join(json.dumps({**osv, "id": f"G{i}"}) for i in range(3)))
    rows = flatten_osv(feeds.read_osv(spark, str(tmp_path / "osv.jsonl"))).orderBy("feed_pos").collect()
    assert [(r["cve_id"], r["severity"]) for r in rows] == [(f"G{i}", "high") for i in range(3)]


def test_analyzer_import(spark, tmp_path):
    doc = {"results": [{"check_id": "python.sql.tainted", "path": "a.py", "start": {"line": 42, "col": 5},
                        "extra": {"severity": "ERROR", "message": "m", "metadata": {"cve": "CVE-1"}}},
                       {"check_id": "x", "path": "b.py", "start": {"line": 1, "col": 1}, "extra": {"severity": "INFO", "message": "n", "metadata": {}}}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    rows = {r["rule_id"]: r for r in feeds.read_analyzer(spark, str(tmp_path)).collect()}
    assert (rows["python.sql.tainted"]["severity"], rows["python.sql.tainted"]["line_start"]) == ("high", 42)
    assert (rows["x"]["severity"], rows["x"]["cve_id"]) == ("low", None)


def test_reports(spark, tmp_path):
    files, f = found(spark, "eval(x)\nh = md5(a)\n", "host = 'localhost'\n", "clean\n")
    totals = R.severity_totals(f, files).first()
    assert (totals["total"], totals["high"], totals["medium"], totals["info"], totals["files"]) == (3, 1, 1, 1, 3)
    line = sinks.summary_line(R.severity_totals(f, files)).first()[0]
    assert line == "3 finding(s) (0 critical, 1 high, 1 medium, 0 low) in 3 file(s)"
    none = sinks.summary_line(R.severity_totals(f.where("false"), files)).first()[0]
    assert none.startswith("Nothing found")
    assert R.fails(f, "high").first()[0] is True and R.fails(f, "critical").first()[0] is False
    assert R.fails(f.where("false"), "low").first()[0] is False
    d = {r["rule_id"]: r for r in R.diagnostics(f, "info").collect()}
    assert (d["S05"]["line"], d["S05"]["level"], d["S11"]["level"], d["S01"]["level"]) == (0, "error", "information", "warning")
    assert {r["rule_id"] for r in R.diagnostics(f, "bogus").collect()} == {"S05", "S01"}
    block = sinks.text_report(f).where("rule_id = 'S05'").first()["value"]
    assert block.startswith("HIGH — Dangerous Use of eval()\n  src/f0.py  line 1\n")
    sinks.write_text_report(f, files, str(tmp_path / "txt"))
    written = spark.read.option("wholetext", True).text(str(tmp_path / "txt/findings"))
    assert "".join(r[0] for r in written.collect()).startswith("HIGH — ")
    sinks.write_json_report(f, str(tmp_path / "json"))
    assert spark.read.schema(schemas.FINDINGS).json(str(tmp_path / "json")).count() == 3
    per = {r["file_path"]: r for r in R.by_file(f).collect()}
    assert per["src/f0.py"]["total"] == 2 and per["src/f0.py"]["top_severity"] == "high"


def test_persist_and_history(spark, tmp_path):
    _, f = found(spark, "eval(x)\nh = md5(a)\n")
    out = str(tmp_path / "store")
    sinks.persist(f.withColumn("scan_id", F.lit("s1")), out, "python", "Manual Scan", NOW)
    sinks.persist(f.where("rule_id = 'S05'").withColumn("scan_id", F.lit("s2")), out, "python", "Manual Scan", datetime(2024, 5, 2))
    scans = spark.read.parquet(f"{out}/scans")
    rows = {r["scan_id"]: r for r in scans.collect()}
    assert rows["s1"]["findings_count"] == 2 and rows["s1"]["severity_counts"] == {"high": 1, "medium": 1}
    assert rows["s2"]["findings_count"] == 1
    raw = spark.read.parquet(f"{out}/scan_results")
    assert raw.where("explanation IS NOT NULL").count() == 0
    back = sinks.read_scan_results(spark, out)
    assert back.where("explanation = ''").count() == 3
    assert sinks.results_of_scan(back, "s1").count() == 2
    dash = R.dashboard(scans).first()
    assert (dash["total_scans"], dash["total_findings"], dash["critical_findings"]) == (2, 3, 0)
    hist = {r["scan_id"]: r for r in R.history_report(scans, datetime(2024, 5, 2, 13)).collect()}
    assert (hist["s1"]["age"], hist["s2"]["age"], hist["s1"]["top_severity"]) == ("Yesterday", "13 hours ago", "High")
    assert [r["scan_id"] for r in R.newest(scans, 1).collect()] == ["s2"]
    assert R.orphan_results(back, scans.where("scan_id = 's1'")).count() == 1
    assert R.without_scans(back, scans.where("scan_id = 's1'")).count() == 1


def test_explain(spark):
    _, f = found(spark, "eval(x)\neval(x)\nh = md5(a)\nlocalhost\n", "eval(x)\n")
    calls = spark.sparkContext.accumulator(0)

    def ask(prompt):
        calls.add(1)
        if "MD5" in prompt:
            raise RuntimeError("down")
        return "because"

    got, made = X.explain(f, ask, lambda p: "fix")
    assert made.count() == 1 and calls.value == 2
    rows = {(r["rule_id"], r["explanation"], r["fixed_code"]) for r in got.collect()}
    assert rows == {("S05", "because", "fix"), ("S01", X.UNAVAILABLE, "fix"), ("S11", "", "")}
    assert got.count() == f.count() and calls.value == 2
    _, again = X.explain(f, ask, lambda p: "fix", cache=made)
    assert again.count() == 0 and calls.value == 3  # what failed is asked again
    plain, _ = X.explain(f)
    assert plain.where("rule_id = 'S05' AND explanation LIKE 'Dangerous%'").count() == 3


def test_events_and_replay(spark):
    _, f = found(spark, "eval(x)\n")
    scans = spark.createDataFrame([("s1",)], "scan_id STRING")
    ev = E.scan_events(scans, f.withColumn("scan_id", F.lit("s1")), ["sast", "secrets", "ai_code"])
    rows = [json.loads(r["event"]) for r in ev.orderBy("phase", "step").collect()]
    assert [r["type"] for r in rows] == ["progress"] * 4 + ["finding", "complete"]
    assert [r["data"]["percentage"] for r in rows[:4]] == [0, 33, 66, 100]
    assert rows[2]["data"]["message"] == "Running AI Code engine..."
    assert rows[4]["data"]["rule_id"] == "S05"
    feed = spark.createDataFrame(
        [("a", 1, "progress", "{}", datetime(2024, 5, 1, 11, 50)), ("a", 2, "complete", None, datetime(2024, 5, 1, 11, 54)),
         ("b", 1, "finding", "{}", datetime(2024, 5, 1, 11, 54)), ("b", 2, "complete", None, datetime(2024, 5, 1, 11, 56)),
         ("c", 1, "progress", "{}", datetime(2024, 5, 1, 10))], schemas.SCAN_EVENT)
    assert {r["scan_id"] for r in E.live_events(feed, NOW).collect()} == {"b", "c"}
    assert [r["seq"] for r in E.replay(feed, "b", NOW).collect()] == [1, 2]


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    codes = ["eval(x)\n", "user_id = 3\nverify=False\n", 'password = "hunter2222"\n']
    for i, c in enumerate(codes):
        (src / f"{i}.json").write_text(json.dumps({"path": f"f{i}.py", "code": c, "language": "python"}) + "\n")
    stream = read_file_stream(spark, str(src), files_per_batch=1)
    q = (scan_stream(stream, detected_at=NOW).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    batch = scan(as_files(spark.read.schema(schemas.WORKSPACE_FILE).json(str(src))), detected_at=NOW)
    got = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    assert got.count() == 4
    assert batch.exceptAll(got).count() == 0 and got.exceptAll(batch).count() == 0

    job = start_scan_job(stream, str(tmp_path / "job"), str(tmp_path / "cp2"), engines=["sast", "secrets", "ai_code"])
    job.awaitTermination()
    scans = spark.read.parquet(str(tmp_path / "job/scans"))
    assert scans.count() == 3 and scans.agg(F.sum("findings_count")).first()[0] == 4


def test_salted_join_matches_plain_join(spark):
    from lynceus.scale import salted_join
    left = spark.range(500).select("id", F.when(F.col("id") < 300, 1).when(F.col("id") < 400, F.col("id")).alias("k"))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (350, "c")], "k BIGINT, v STRING")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, "k", how)
        salted = salted_join(left, right, ["k"], how, salts=7).select(*plain.columns)
        assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0


def test_event_numbers(spark, tmp_path):
    """Numbers run from 1 within each scan, also for equal events and unnamed scans; micro-batches go on behind each other."""
    from lynceus.streaming.events import feed, finding_events, follow, write_finding_events

    rows = [(f"s{i % 3}" if i % 10 else None, 1, 0, f"f{i % 7}", "{}") for i in range(200)]
    events = spark.createDataFrame(rows, "scan_id string, phase int, step int, finding_id string, event string").repartition(5)
    got = E.numbered_events(events).collect()
    for scan_id in ("s0", "s1", "s2", None):
        own = sorted((r.seq, r.finding_id) for r in got if r.scan_id == scan_id)
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [f for _, f in own] == sorted(f for _, f in own)
    assert E.numbered_events(events.limit(0)).collect() == []

    rows = [(f"s{i % 2}", f"f{i}", "x", NOW) for i in range(40)]
    df = spark.createDataFrame(rows, "scan_id string, finding_id string, title string, detected_at timestamp")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    found = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second start finds nothing new
        write_finding_events(found, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    written = feed(spark, f"{tmp_path}/out").collect()
    assert len(written) == 40 == len({(r.scan_id, r.seq) for r in written})
    middle = sorted(r.seq for r in written if r.scan_id == "s0")[9]
    out = follow(spark, f"{tmp_path}/out", "s0", middle).writeStream.format("memory").queryName("followed").trigger(availableNow=True)
    out.option("checkpointLocation", f"{tmp_path}/followed").start().awaitTermination()
    assert sorted(r.seq for r in spark.table("followed").collect()) == sorted(r.seq for r in written if r.scan_id == "s0" and r.seq > middle)
    with pytest.raises(ValueError):
        finding_events(found)


def test_numbering_makes_its_events_once(spark):
    """Range partitions are drawn from a sample; what gives the events, such as a scan, is not run again for it."""
    made = spark.sparkContext.accumulator(0)

    def count(text):
        made.add(1)
        return text

    rows = spark.range(300).select(F.lit("s").alias("scan_id"), F.udf(count, "string")(F.concat(F.lit("f"), "id")).alias("finding_id"))
    got = E.numbered_in_scan(rows, ["finding_id"]).collect()
    assert [r.seq for r in sorted(got, key=lambda r: r.finding_id)] == list(range(1, 301))
    assert made.value == 300
