"""Queries of reports, history, stored results, sources and sinks."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from lynceus import schemas
from lynceus.functions.languages import language_from_ext, language_from_name
from lynceus.functions.severity import label, rank_of
from lynceus.functions.text import empty_if_none, extension, none_if_empty
from lynceus.operators import events as E
from lynceus.operators import explain as X
from lynceus.operators import reports as R
from lynceus.operators.findings import to_findings
from lynceus.functions.prompts import with_prompts
from lynceus.plans.scan import scan
from lynceus.scale import work_dir
from lynceus.sources import sinks, tree, workspace
from workload.base import (
    CODE_PATH,
    NOW,
    NOW_SQL,
    corpus,
    corpus_sql,
    derived,
    lines_sql,
    query,
    table,
)
from workload.rules_sql import RANK_SQL, SAST, SNIPPET, every_match, findings_cte
from workload.scanning import LINE_ENGINES, line_scan

# Findings derived row by row from the order lines; every column has a plain expression.
LEVEL = "CASE l_linenumber WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' WHEN 5 THEN 'info' WHEN 6 THEN 'high' ELSE 'low' END"
PATH = "CASE WHEN l_suppkey % 3 = 0 THEN CAST(NULL AS STRING) ELSE concat('src/', CAST(l_suppkey AS STRING), '.py') END"
CVE = "CASE WHEN l_partkey % 4 = 0 THEN concat('CVE-2024-', CAST(l_partkey AS STRING)) END"
ENGINE = "CASE l_returnflag WHEN 'A' THEN 'sast' WHEN 'N' THEN 'ai_code' ELSE 'secrets' END"
TITLE = "concat('Rule ', CAST(l_partkey % 40 AS STRING))"
CODE = "concat('line ', CAST(l_partkey % 400 AS STRING))"
SCAN_ID = "concat('scan-', CAST(l_orderkey AS STRING))"
FOUND_SQL = f"""SELECT {SCAN_ID} AS scan_id, {LEVEL} AS severity, {PATH} AS file_path, {CVE} AS cve_id, {ENGINE} AS engine,
   {TITLE} AS title, {CODE} AS vulnerable_code, concat('R', CAST(l_partkey % 40 AS STRING)) AS rule_id, CAST(l_quantity AS BIGINT) - 1 AS line_start,
   l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem"""
ROW_RANK = RANK_SQL


def findings(spark, sf):
    raw = table(spark, sf, "lineitem").selectExpr(
        f"{SCAN_ID} AS scan_id", f"{LEVEL} AS severity", f"{PATH} AS file_path", f"{CVE} AS cve_id",
        f"{ENGINE} AS engine", f"{TITLE} AS title", f"{CODE} AS vulnerable_code",
        "concat('R', CAST(l_partkey % 40 AS STRING)) AS rule_id",
        "CAST(l_quantity AS INT) - 1 AS line_start", "CAST(l_quantity AS INT) - 1 AS line_end",
        "concat('about ', CAST(l_partkey % 40 AS STRING)) AS description", "'CWE-1' AS cwe_id",
    ).withColumn("sev_rank", rank_of(F.col("severity")))
    return to_findings(raw, NOW, keep=("scan_id",))


# Scalar functions ------------------------------------------------------------------


@query(
    "languages_by_extension",
    f"""SELECT ext, CASE lower(ext) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript'
        WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'cs' THEN 'csharp' WHEN 'cpp' THEN 'cpp' WHEN 'h' THEN 'c' WHEN 'rb' THEN 'ruby'
        WHEN 'php' THEN 'php' WHEN 'swift' THEN 'swift' WHEN 'kts' THEN 'kotlin' ELSE 'unknown' END AS language, count(*) AS n
        FROM (SELECT CASE WHEN contains(split_part(path, '/o', 2), '.') THEN split_part(path, '.', 2) END AS ext FROM (SELECT {CODE_PATH} AS path FROM lineitem)) GROUP BY ALL""",
)
def languages_by_extension(spark, sf):
    ext = extension(F.col("path"))
    files = table(spark, sf, "lineitem").selectExpr(f"{CODE_PATH} AS path")
    return files.groupBy(ext.alias("ext")).agg(F.count("*").alias("n")).select(
        "ext", language_from_ext(F.col("ext")).alias("language"), "n"
    )


NAMES = ("Python", "py", "JavaScript", "golang", "C++", "csharp", "cobol", "KT", "ruby", "c")
NAMED = "CASE CAST(o_custkey AS BIGINT) % 10 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"


@query(
    "languages_by_name",
    f"""SELECT name, CASE name WHEN 'Python' THEN 'python' WHEN 'py' THEN 'python' WHEN 'JavaScript' THEN 'javascript' WHEN 'golang' THEN 'go'
        WHEN 'C++' THEN 'cpp' WHEN 'csharp' THEN 'csharp' WHEN 'KT' THEN 'kotlin' WHEN 'ruby' THEN 'ruby' WHEN 'c' THEN 'c' ELSE 'unknown' END AS language,
        count(*) AS n FROM (SELECT {NAMED} AS name FROM orders) GROUP BY ALL""",
)
def languages_by_name(spark, sf):
    names = table(spark, sf, "orders").selectExpr(f"{NAMED} AS name")
    return names.groupBy("name", language_from_name(F.col("name")).alias("language")).agg(F.count("*").alias("n"))


@query(
    "scannable_paths",
    f"""SELECT path FROM (SELECT {CODE_PATH} AS path FROM lineitem)
        WHERE NOT regexp_matches(path, '(^|/)(\\.git|node_modules|target|\\.venv|__pycache__|dist|build)(/|$)')
        AND regexp_matches(path, '(?i)\\.(py|js|ts|jsx|rs|go|java|cs|cpp|h|rb|php|swift|kts|yaml|toml|json|xml|tf|vue)$')""",
)
def scannable_paths(spark, sf):
    files = table(spark, sf, "lineitem").selectExpr(f"{CODE_PATH} AS path")
    path = F.col("path")
    return files.where(~tree.in_pruned_folder(path) & tree.is_scannable(path))


@query("empty_to_null", "SELECT count(v) AS kept, count(*) - count(v) AS nulls, count(back) AS restored FROM (SELECT nullif(t, '') AS v, coalesce(nullif(t, ''), '') AS back FROM (SELECT CASE WHEN l_partkey % 3 = 0 THEN '' ELSE l_shipmode END AS t FROM (SELECT l_partkey, l_returnflag AS l_shipmode FROM lineitem)))")
def empty_to_null(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("CASE WHEN l_partkey % 3 = 0 THEN '' ELSE l_returnflag END AS t")
    v = rows.select(none_if_empty(F.col("t")).alias("v")).withColumn("back", empty_if_none(F.col("v")))
    return v.agg(F.count("v").alias("kept"), (F.count("*") - F.count("v")).alias("nulls"), F.count("back").alias("restored"))


@query(
    "labels",
    f"""SELECT upper(severity) AS level, CASE engine WHEN 'sast' THEN 'SAST' WHEN 'ai_code' THEN 'AI Code' ELSE 'Secrets' END AS engine, count(*) AS n
        FROM ({FOUND_SQL}) GROUP BY ALL""",
)
def labels(spark, sf):
    return findings(spark, sf).groupBy(
        label(F.col("severity")).alias("level"), E.engine_label(F.col("engine")).alias("engine")
    ).agg(F.count("*").alias("n"))


@query(
    "prompts",
    f"""SELECT 'Explain a security finding to a developer without security training.' || chr(10) || chr(10) || 'Title: ' || title || chr(10) || 'Severity: ' || upper(severity) || chr(10)
        || coalesce('CVE: ' || cve_id || chr(10), '') || 'CWE: CWE-1' || chr(10) || 'Code:' || chr(10) || '```' || chr(10) || vulnerable_code || chr(10) || '```' || chr(10) || chr(10)
        || 'Say what is wrong, what harm it can do and how it would be attacked, in plain words and at most 200 words.' AS explain_prompt,
        'Correct this insecure code.' || chr(10) || chr(10) || 'Title: ' || title || chr(10) || 'Code:' || chr(10) || '```' || chr(10) || vulnerable_code || chr(10) || '```' || chr(10) || chr(10)
        || 'Answer with the corrected code and nothing else.' AS fix_prompt FROM ({FOUND_SQL})""",
)
def prompts(spark, sf):
    return with_prompts(findings(spark, sf)).select("explain_prompt", "fix_prompt")


# Counts and summaries -----------------------------------------------------------------

COUNTS = "count(*) FILTER (WHERE severity = '{0}') AS {0}"
ALL_COUNTS = ", ".join(COUNTS.format(v) for v in ("critical", "high", "medium", "low", "info"))


@query("scan_summary", f"SELECT scan_id, count(*) AS findings_count, {ALL_COUNTS} FROM ({FOUND_SQL}) GROUP BY scan_id")
def scan_summary(spark, sf):
    s = R.scan_summary(findings(spark, sf))
    at = lambda k: F.coalesce(F.try_element_at("severity_counts", F.lit(k)), F.lit(0)).alias(k)
    return s.select("scan_id", "findings_count", *[at(k) for k in ("critical", "high", "medium", "low", "info")])


@query(
    "severity_totals",
    f"WITH {findings_cte()} SELECT count(*) AS total, {ALL_COUNTS}, (SELECT count(*) FROM lineitem) AS files, CAST(90000 AS BIGINT) AS duration_ms FROM found",
)
def severity_totals(spark, sf):
    files = corpus(spark, sf)
    return R.scan_report(line_scan(spark, sf), files, NOW, NOW + timedelta(seconds=90))


@query(
    "summary_line",
    f"""WITH {findings_cte('documents')} SELECT concat(CAST(count(*) AS STRING), ' finding(s) (', CAST(count(*) FILTER (WHERE severity = 'critical') AS STRING), ' critical, ',
        CAST(count(*) FILTER (WHERE severity = 'high') AS STRING), ' high, ', CAST(count(*) FILTER (WHERE severity = 'medium') AS STRING), ' medium, ',
        CAST(count(*) FILTER (WHERE severity = 'low') AS STRING), ' low) in ', CAST((SELECT count(*) FROM documents) AS STRING), ' file(s)') AS value FROM found""",
)
def summary_line(spark, sf):
    totals = R.severity_totals(line_scan(spark, sf, "documents"), corpus(spark, sf, "documents"))
    return sinks.summary_line(totals)


@query("findings_by_file", f"SELECT coalesce(file_path, 'unknown') AS file_path, count(*) AS total, {ALL_COUNTS}, arg_max(severity, {ROW_RANK}) AS top_severity FROM ({FOUND_SQL}) GROUP BY 1")
def findings_by_file(spark, sf):
    return R.by_file(findings(spark, sf))


@query("shown_counts", f"SELECT severity, count(*) AS n FROM ({FOUND_SQL}) WHERE severity <> 'info' GROUP BY severity")
def shown_counts(spark, sf):
    return R.shown_counts(findings(spark, sf))


@query("fail_gate", f"SELECT engine, bool_or({ROW_RANK} >= 4) AS failed FROM ({FOUND_SQL}) GROUP BY engine UNION ALL SELECT 'none', false")
def fail_gate(spark, sf):
    found = findings(spark, sf)
    none = R.fails(found.where("false"), "critical").select(F.lit("none").alias("engine"), "failed")
    return R.fails(found, "critical", "engine").unionByName(none)


@query(
    "severity_cube",
    f"SELECT severity, engine, language, count(*) AS n FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'go' ELSE 'rust' END AS language FROM ({FOUND_SQL})) GROUP BY CUBE (severity, engine, language)",
)
def severity_cube(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        f"{LEVEL} AS severity", f"{ENGINE} AS engine", "CASE WHEN l_suppkey % 2 = 0 THEN 'go' ELSE 'rust' END AS language"
    )
    return R.severity_cube(rows)


# History --------------------------------------------------------------------------------

SCANS = (
    "concat('s', CAST(o_orderkey AS STRING)) AS scan_id",
    "CASE o_orderstatus WHEN 'F' THEN 0 ELSE CAST(o_custkey % 20 AS INT) END AS findings_count",
    "CASE o_orderstatus WHEN 'F' THEN 0 ELSE o_custkey % 3 END AS critical",
    "CASE o_orderstatus WHEN 'F' THEN 0 ELSE o_custkey % 5 END AS high",
    "CASE o_orderstatus WHEN 'F' THEN 0 ELSE o_custkey % 2 END AS low",
)


def scans(spark, sf, created_at="CAST(o_orderdate AS TIMESTAMP)"):
    rows = table(spark, sf, "orders").selectExpr(*SCANS, f"{created_at} AS created_at")
    counts = F.map_filter(
        F.create_map(*[x for k in ("critical", "high", "low") for x in (F.lit(k), F.col(k).cast("bigint"))]),
        lambda _, n: n > 0,
    )
    return rows.select(
        "scan_id", F.lit("python").alias("language"), F.lit("Manual Scan").alias("target_name"),
        "findings_count", counts.alias("severity_counts"), "created_at",
    )


@query("dashboard", f"SELECT count(*) AS total_scans, CAST(sum(findings_count) AS BIGINT) AS total_findings, CAST(sum(critical) AS BIGINT) AS critical_findings FROM (SELECT {', '.join(SCANS)} FROM orders)")
def dashboard(spark, sf):
    return R.dashboard(scans(spark, sf))


@query(
    "history",
    f"""SELECT scan_id, CASE WHEN mins < 1 THEN 'just now' WHEN mins < 60 THEN concat(CAST(mins AS STRING), ' min ago') WHEN mins // 60 = 1 THEN '1 hour ago'
        WHEN mins // 60 < 24 THEN concat(CAST(mins // 60 AS STRING), ' hours ago') WHEN mins // 1440 = 1 THEN 'Yesterday' ELSE concat(CAST(mins // 1440 AS STRING), ' days ago') END AS age,
        CASE WHEN critical > 0 THEN 'Critical' WHEN high > 0 THEN 'High' WHEN low > 0 THEN 'Low' WHEN findings_count = 0 THEN 'None' ELSE 'Info' END AS top_severity
        FROM (SELECT {', '.join(SCANS)}, date_diff('minute', o_orderdate + to_minutes(o_orderkey % 1440), {NOW_SQL}) AS mins FROM orders)""",
)
def history(spark, sf):
    at = "CAST(o_orderdate AS TIMESTAMP) + make_interval(0, 0, 0, 0, 0, CAST(o_orderkey % 1440 AS INT))"
    return R.history_report(scans(spark, sf, at), NOW).select("scan_id", "age", "top_severity")


NEWEST = "SELECT concat('s', CAST(o_orderkey AS STRING)) AS scan_id FROM orders ORDER BY o_orderdate DESC, scan_id LIMIT {}"


@query("newest_scans", NEWEST.format(50))
def newest_scans(spark, sf):
    return R.newest(scans(spark, sf)).select("scan_id")


@query("recent_scans", NEWEST.format(5))
def recent_scans(spark, sf):
    return R.recent(scans(spark, sf)).select("scan_id")


@query("workspace_files", f"SELECT path FROM ({corpus_sql()}) ORDER BY path LIMIT 100")
def workspace_files(spark, sf):
    return R.workspace_files(corpus(spark, sf)).select("path")


# Diagnostics -----------------------------------------------------------------------------

DIAGNOSTICS = f"""SELECT coalesce(file_path, 'unknown') AS path, greatest(line_start - 1, 0) AS line, CAST(0 AS BIGINT) AS start_column, CAST(500 AS BIGINT) AS end_column,
   CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'info' THEN 'information' ELSE 'warning' END AS level,
   concat('[', upper(engine), '] ', title, chr(10), chr(10), chr(10), chr(10), 'Suggested fix:', chr(10)) AS message, 'lynceus' AS source, cve_id AS code, rule_id
   FROM ({FOUND_SQL}) WHERE {ROW_RANK} >= {{}}"""


@query("diagnostics", DIAGNOSTICS.format(2))
def diagnostics(spark, sf):
    return R.diagnostics_by_file(R.diagnostics(findings(spark, sf)))


@query("diagnostics_all", f"SELECT level, count(*) AS n FROM ({DIAGNOSTICS.format(0)}) GROUP BY level")
def diagnostics_all(spark, sf):
    return R.diagnostics(findings(spark, sf), "info").groupBy("level").agg(F.count("*").alias("n"))


# Stored results ----------------------------------------------------------------------------


@query("scan_results_sink", f"SELECT scan_id, rule_id, severity, CAST(NULL AS STRING) AS explanation, file_path, '2002-01-01' AS scan_date FROM ({FOUND_SQL})")
def scan_results_sink(spark, sf):
    """Findings stored with their scans and read back, before the texts are restored."""
    path = work_dir(spark, "store")
    sinks.persist(findings(spark, sf), path, "python", "Manual Scan", NOW)
    rows = spark.read.parquet(f"{path}/scan_results")
    return rows.select("scan_id", "rule_id", "severity", "explanation", "file_path", F.col("scan_date").cast("string").alias("scan_date"))


@query("scans_sink", f"SELECT scan_id, 'python' AS language, 'Manual Scan' AS target_name, count(*) AS findings_count, count(*) FILTER (WHERE severity = 'high') AS high FROM ({FOUND_SQL}) GROUP BY scan_id")
def scans_sink(spark, sf):
    path = work_dir(spark, "store")
    sinks.persist(findings(spark, sf), path, "python", "Manual Scan", NOW)
    rows = spark.read.schema(schemas.SCANS).parquet(f"{path}/scans")
    high = F.coalesce(F.try_element_at("severity_counts", F.lit("high")), F.lit(0))
    return rows.select("scan_id", "language", "target_name", "findings_count", high.alias("high"))


STORED = "SELECT scan_id, rule_id FROM ({}) WHERE l_orderkey {} (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"


@query("orphan_results", STORED.format(FOUND_SQL, "NOT IN"))
def orphan_results(spark, sf):
    kept = table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("concat('scan-', CAST(o_orderkey AS STRING)) AS scan_id")
    return R.orphan_results(findings(spark, sf), kept).select("scan_id", "rule_id")


@query("results_of_scans", STORED.format(FOUND_SQL, "IN"))
def results_of_scans(spark, sf):
    wanted = table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("concat('scan-', CAST(o_orderkey AS STRING)) AS scan_id")
    return R.results_of_scans(findings(spark, sf), wanted).select("scan_id", "rule_id")


@query("results_after_delete", f"SELECT severity, count(*) AS n FROM ({FOUND_SQL}) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY severity")
def results_after_delete(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("concat('scan-', CAST(o_orderkey AS STRING)) AS scan_id")
    return R.without_scans(findings(spark, sf), gone).groupBy("severity").agg(F.count("*").alias("n"))


# Sources and file sinks ----------------------------------------------------------------------


@query("json_report", f"WITH {findings_cte('conversations')} SELECT path AS file_path, rule_id, line_no AS line_start, severity FROM found")
def json_report(spark, sf):
    path = work_dir(spark, "report")
    sinks.write_json_report(line_scan(spark, sf, "conversations"), path)
    rows = spark.read.schema(schemas.FINDINGS).json(path)
    return rows.select("file_path", "rule_id", "line_start", "severity")


@query(
    "json_rows",
    f"""SELECT json_extract_string(j, '$.severity') AS severity, count(*) AS n FROM (SELECT to_json({{'severity': severity}}) AS j FROM ({FOUND_SQL})) GROUP BY 1""",
)
def json_rows(spark, sf):
    rows = sinks.to_json_rows(findings(spark, sf))
    return rows.groupBy(F.get_json_object("value", "$.severity").alias("severity")).agg(F.count("*").alias("n"))


@query(
    "text_report",
    f"""SELECT concat(upper(severity), ' — ', title, chr(10), CASE WHEN file_path IS NULL THEN '' ELSE concat('  ', file_path, '  line ', CAST(line_start AS STRING), chr(10)) END,
        coalesce('  CVE: ' || cve_id || chr(10), ''), chr(10), '  ', vulnerable_code, chr(10), chr(10), repeat('─', 60)) AS value FROM ({FOUND_SQL})""",
)
def text_report(spark, sf):
    return sinks.text_report(findings(spark, sf)).select("value")


@query("workspace_batches", f"SELECT path, CASE WHEN path LIKE '%.go' THEN 'go' ELSE 'python' END AS language, length(code) AS chars FROM ({corpus_sql()})")
def workspace_batches(spark, sf):
    """Scan requests written as JSON lines and read back as files."""
    path = work_dir(spark, "requests")
    corpus(spark, sf).selectExpr(
        "array(named_struct('path', path, 'code', code, 'language', CASE WHEN path LIKE '%.go' THEN 'golang' ELSE 'Python' END)) AS files",
        "array('sast') AS engines",
    ).write.json(path)
    return workspace.read_workspace(spark, path).select("path", "language", F.length("code").alias("chars"))


@query(
    "workspace_scans",
    f"""WITH {findings_cte('conversations')} SELECT path AS file_path, rule_id, engine FROM found
        WHERE (engine = 'sast' AND path NOT LIKE '%/1.md') OR (engine = 'secrets' AND path LIKE '%/1.md')""",
)
def workspace_scans(spark, sf):
    """Requests that ask for different engines, scanned in one pass."""
    from lynceus.plans.scan import scan_workspaces

    path = work_dir(spark, "requests")
    corpus(spark, sf, "conversations").selectExpr(
        "array(named_struct('path', path, 'code', code, 'language', 'md')) AS files",
        "CASE WHEN path LIKE '%/1.md' THEN array('secrets', 'none') ELSE array('sast') END AS engines",
    ).write.json(path)
    found = scan_workspaces(workspace.read_requests(spark, path), "info", detected_at=NOW)
    return found.select("file_path", "rule_id", "engine")


@query("oversize_files", "SELECT concat('documents/', CAST(doc_id AS STRING), '.txt') AS path, strlen(text) AS bytes, strlen(text) > 8192 AS rejected FROM documents")
def oversize_files(spark, sf):
    kept, rejects = workspace.split_oversize(corpus(spark, sf, "documents"), 8192)
    return kept.select("path", F.octet_length("code").alias("bytes"), F.lit(False).alias("rejected")).unionByName(
        rejects.select("path", "bytes", F.lit(True).alias("rejected"))
    )


@query(
    "oversize_batches",
    """WITH b AS (SELECT conv_id, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS files FROM conversations GROUP BY conv_id)
       SELECT 'kept' AS kind, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM b WHERE bytes <= 4096
       UNION ALL SELECT 'rejected', sum(files)::BIGINT, sum(bytes)::BIGINT FROM b WHERE bytes > 4096""",
)
def oversize_batches(spark, sf):
    files = table(spark, sf, "conversations").selectExpr("conv_id", "CAST(turn AS STRING) AS path", "text AS code")
    kept, rejects = workspace.split_oversize_batches(files, "conv_id", 4096)
    return kept.agg(F.lit("kept").alias("kind"), F.count("*").alias("files"), F.sum(F.octet_length("code")).alias("bytes")).unionByName(
        rejects.agg(F.lit("rejected").alias("kind"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    )


@query("code_tree", f"WITH {findings_cte('conversations')} SELECT rule_id, count(*) AS n FROM found GROUP BY rule_id UNION ALL SELECT 'files', 1")
def code_tree(spark, sf):
    """All texts written twice, below a source folder and below a pruned one; the tree has them once."""
    root = work_dir(spark, "tree")
    texts = table(spark, sf, "conversations").select("text")
    for folder in ("src/a", "node_modules/b"):
        texts.write.text(f"{root}/{folder}")
    files = tree.read_code_tree(spark, root, extensions=("txt",))
    found = scan(files, LINE_ENGINES, "info", detected_at=NOW)
    nonempty = files.where("length(code) > 0").agg(F.lit("files").alias("rule_id"), F.count_if(F.lit(True)).alias("n"))
    return found.groupBy("rule_id").agg(F.count("*").alias("n")).unionByName(nonempty)


# Explanations -----------------------------------------------------------------------------------

KEY = "sha256(concat(rule_id, '|', sha256(vulnerable_code)))"


@query("explain_questions", f"SELECT DISTINCT {KEY} AS cache_key FROM ({FOUND_SQL}) WHERE {ROW_RANK} >= 2")
def explain_questions(spark, sf):
    return X.questions(findings(spark, sf)).select("cache_key")


@query("explain_unanswered", f"SELECT DISTINCT {KEY} AS cache_key FROM ({FOUND_SQL}) WHERE {ROW_RANK} >= 2 AND rule_id NOT LIKE 'R1%'")
def explain_unanswered(spark, sf):
    found = findings(spark, sf)
    cached = X.questions(found.where("rule_id LIKE 'R1%'"))
    cache = cached.select("cache_key", F.lit("").alias("explanation"), F.lit("").alias("fixed_code"))
    return X.unanswered(X.questions(found), cache).select("cache_key")


def reply(prompt: str) -> str:
    if "line 7" in prompt:
        raise TimeoutError("no answer")
    return f"{len(prompt)} characters asked"


@query(
    "explain",
    f"""SELECT rule_id, vulnerable_code, severity, CASE WHEN NOT asked THEN 'none' WHEN vulnerable_code LIKE 'line 7%' THEN 'AI explanation unavailable.' ELSE 'made' END AS explanation, count(*) AS n
        FROM (SELECT *, max({ROW_RANK}) OVER (PARTITION BY rule_id, vulnerable_code) >= 2 AS asked FROM ({FOUND_SQL})) GROUP BY ALL""",
)
def explain(spark, sf):
    """A caller's function answers each distinct question once; some calls fail."""
    got, _ = X.explain(findings(spark, sf), reply, reply)
    kind = F.when(F.col("explanation").endswith("asked"), "made").when(F.col("explanation") == "", "none").otherwise(F.col("explanation"))
    return got.groupBy("rule_id", "vulnerable_code", "severity", kind.alias("explanation")).agg(F.count("*").alias("n"))


@query("explain_described", f"SELECT rule_id, severity, CASE WHEN {ROW_RANK} >= 2 THEN concat(title, '. about ', substring(rule_id, 2)) ELSE '' END AS explanation, count(*) AS n FROM ({FOUND_SQL}) GROUP BY ALL")
def explain_described(spark, sf):
    got, _ = X.explain(findings(spark, sf))
    return got.groupBy("rule_id", "severity", "explanation").agg(F.count("*").alias("n"))


# Events -------------------------------------------------------------------------------------------


@query(
    "progress_events",
    """SELECT concat('s', CAST(o_orderkey AS STRING)) AS scan_id, CAST(p AS BIGINT) AS percentage, m AS message FROM orders,
       (VALUES (0, 'Running SAST engine...'), (33, 'Running Secrets engine...'), (66, 'Running AI Code engine...'), (100, 'Scanning complete. Preparing results...')) v(p, m)""",
)
def progress_events(spark, sf):
    return E.progress_events(scans(spark, sf), LINE_ENGINES).select("scan_id", "percentage", "message")


@query(
    "scan_events",
    f"""SELECT scan_id, 'finding' AS type, count(*) AS n FROM ({FOUND_SQL}) GROUP BY scan_id
        UNION ALL SELECT DISTINCT concat('scan-', CAST(l_orderkey AS STRING)), 'progress', 4 FROM lineitem
        UNION ALL SELECT DISTINCT concat('scan-', CAST(l_orderkey AS STRING)), 'complete', 1 FROM lineitem""",
)
def scan_events(spark, sf):
    found = findings(spark, sf)
    ids = found.select("scan_id").distinct()
    events = E.scan_events(ids, found, LINE_ENGINES)
    return events.groupBy("scan_id", F.get_json_object("event", "$.type").alias("type")).agg(F.count("*").alias("n"))


@query("error_events", "SELECT concat('documents/', CAST(doc_id AS STRING), '.txt') AS scan_id, 'error' AS type, 'text of more than 8 KiB' AS data FROM documents WHERE strlen(text) > 8192")
def error_events(spark, sf):
    _, rejects = workspace.split_oversize(corpus(spark, sf, "documents"), 8192)
    events = E.error_events(rejects.select(F.col("path").alias("scan_id"), "reason"))
    return events.select("scan_id", F.get_json_object("event", "$.type").alias("type"), F.get_json_object("event", "$.data").alias("data"))
