"""Counts, summaries, history and editor diagnostics.

Counts aggregate before the shuffle. Nothing collects the rows of a file or a
scan into one value: details stay flat rows next to their group's counts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.severity import LEVELS, RANK, at_least, label, level_of, parse_level
from lynceus.functions.text import empty_if_none
from lynceus.scale import cut_lineage, join_lookup

UNKNOWN_PATH = "unknown"
HISTORY_ROWS = 50
RECENT_ROWS = 5
WORKSPACE_FILES = 100

# End column of a diagnostic, and the advisory page of a CVE.
LINE_END_COLUMN = 500
ADVISORY_PAGE = "https://nvd.nist.gov/vuln/detail/"


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by, F.lower("severity").alias("severity")).agg(
        F.count("*").alias("n")
    )


def scan_summary(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Per scan: number of findings and a map of level to count.

    A map has at most one entry per level, built from the counts. With ``scans``, every
    ``scan_id`` there has a row, also one without findings.
    """
    counted = (
        severity_counts(findings, "scan_id")
        .groupBy("scan_id")
        .agg(
            F.sum("n").alias("findings_count"),
            F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("severity_counts"),
        )
    )
    if scans is None:
        return counted
    none = F.create_map().cast(counted.schema["severity_counts"].dataType)
    return scans.join(counted, "scan_id", "left").withColumns(
        {
            "findings_count": F.coalesce("findings_count", F.lit(0)),
            "severity_counts": F.coalesce("severity_counts", none),
        }
    )


def level_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == level).alias(level) for level in reversed(LEVELS)]


def severity_totals(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row: findings in all and per level, and files scanned."""
    totals = findings.agg(F.count("*").alias("total"), *level_counts()).withColumn("k", F.lit(1))
    scanned = files.agg(F.count("*").alias("files")).withColumn("k", F.lit(1))
    return totals.join(F.broadcast(scanned), "k").drop("k")


def scan_report(findings: DataFrame, files: DataFrame, started: datetime, ended: datetime) -> DataFrame:
    """Totals with the duration of the scan in milliseconds."""
    millis = int((ended - started).total_seconds() * 1000)
    return severity_totals(findings, files).withColumn("duration_ms", F.lit(millis).cast("bigint"))


def shown_counts(findings: DataFrame) -> DataFrame:
    """Counts of the levels a report page shows; a level without findings has no row."""
    return severity_counts(findings.where(F.lower("severity") != "info"))


def by_file(findings: DataFrame) -> DataFrame:
    """Per file: findings in all, per level, and the highest level."""
    return findings.groupBy(
        F.coalesce("file_path", F.lit(UNKNOWN_PATH)).alias("file_path")
    ).agg(
        F.count("*").alias("total"),
        *level_counts(),
        level_of(F.max("sev_rank")).alias("top_severity"),
    )


def fails(findings: DataFrame, level: str, *by: str) -> DataFrame:
    """Whether any finding reaches the level: one row, or one per value of the named columns."""
    return findings.groupBy(*by).agg(
        F.coalesce(F.max("sev_rank") >= RANK[parse_level(level)], F.lit(False)).alias("failed")
    )


def severity_cube(findings: DataFrame) -> DataFrame:
    """Counts by severity, engine and file language with all subtotals."""
    return findings.cube("severity", "engine", "language").agg(F.count("*").alias("n"))


# History -----------------------------------------------------------------


def dashboard(scans: DataFrame) -> DataFrame:
    """Totals over the history: scans, findings and critical findings."""
    return scans.agg(
        F.count("*").alias("total_scans"),
        F.coalesce(F.sum("findings_count"), F.lit(0)).alias("total_findings"),
        F.coalesce(
            F.sum(F.coalesce(F.try_element_at("severity_counts", F.lit("critical")), F.lit(0))),
            F.lit(0),
        ).alias("critical_findings"),
    )


def age_label(at: Column, now: datetime) -> Column:
    """How long ago, in words."""
    minutes = F.floor(
        (F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(at.cast("timestamp"))) / 60000
    )
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, text(minutes, " min ago"))
        .when(hours == 1, "1 hour ago")
        .when(hours < 24, text(hours, " hours ago"))
        .when(days == 1, "Yesterday")
        .otherwise(text(days, " days ago"))
    )


def top_severity(counts: Column, findings_count: Column) -> Column:
    """Highest level that has findings."""
    out = F
    for level in ("critical", "high", "medium", "low"):
        out = out.when(
            F.coalesce(F.try_element_at(counts, F.lit(level)), F.lit(0)) > 0, level.capitalize()
        )
    return out.when(findings_count == 0, "None").otherwise("Info")


def history_report(scans: DataFrame, now: datetime) -> DataFrame:
    """Scans with their age and highest level."""
    return scans.withColumns(
        {
            "age": age_label(F.col("created_at"), now),
            "top_severity": top_severity(F.col("severity_counts"), F.col("findings_count")),
        }
    )


def newest(scans: DataFrame, n: int = HISTORY_ROWS) -> DataFrame:
    """The latest scans, newest first: a top-k per task, then of the candidates."""
    return scans.orderBy(F.desc("created_at"), "scan_id").limit(n)


def recent(scans: DataFrame) -> DataFrame:
    return newest(scans, RECENT_ROWS)


def workspace_files(files: DataFrame, n: int = WORKSPACE_FILES) -> DataFrame:
    """The files an editor sends in one workspace scan."""
    return files.orderBy("path").limit(n)


def advisory_link(cve_id: Column) -> Column:
    return F.concat(F.lit(ADVISORY_PAGE), cve_id)


# Diagnostics ---------------------------------------------------------------


def diagnostics(findings: DataFrame, min_severity: str = "medium", source: str = "lynceus") -> DataFrame:
    """Editor diagnostics: 0-based line, column span, level, message and code."""
    shown = at_least(findings, min_severity, default="medium")
    level = (
        F.when(F.col("severity").isin("critical", "high"), "error")
        .when(F.col("severity") == "info", "information")
        .otherwise("warning")
    )
    message = F.format_string(
        "[%s] %s\n\n%s\n\nSuggested fix:\n%s",
        label(F.col("engine")),
        "title",
        empty_if_none(F.col("explanation")),
        empty_if_none(F.col("fixed_code")),
    )
    line = F.greatest(F.col("line_start") - 1, F.lit(0))
    return shown.select(
        F.coalesce("file_path", F.lit(UNKNOWN_PATH)).alias("path"),
        line.alias("line"),
        F.lit(0).alias("start_column"),
        F.lit(LINE_END_COLUMN).alias("end_column"),
        level.alias("level"),
        message.alias("message"),
        F.lit(source).alias("source"),
        F.col("cve_id").alias("code"),
        "rule_id",
    )


def diagnostics_by_file(found: DataFrame) -> DataFrame:
    """Diagnostics with a file's rows next to each other, in line order.

    A range partitioning over (path, line) is used instead of one list per
    path, so the rows without a path, or of one huge file, span many tasks. It
    samples its input, which is therefore written first.
    """
    return cut_lineage(found, "diagnostics").repartitionByRange("path", "line", "rule_id").sortWithinPartitions(
        "path", "line", "rule_id"
    )


# Retention -----------------------------------------------------------------


def _by_scan(results: DataFrame, scans: DataFrame, how: str) -> DataFrame:
    """Join on the scan; one scan may own most of the findings."""
    ids = scans.select("scan_id").distinct()
    return join_lookup(results, ids, ["scan_id"], how)


def orphan_results(results: DataFrame, scans: DataFrame) -> DataFrame:
    """Stored findings whose scan is gone."""
    return _by_scan(results, scans, "left_anti")


def without_scans(results: DataFrame, deleted: DataFrame) -> DataFrame:
    """Stored findings after the given scans were deleted."""
    return _by_scan(results, deleted, "left_anti")


def results_of_scans(results: DataFrame, scans: DataFrame) -> DataFrame:
    """Stored findings of a set of scans."""
    return _by_scan(results, scans, "left_semi")
