"""Reports and stored tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus import schemas
from lynceus.functions.severity import label, rank_order
from lynceus.functions.text import empty_if_none, none_if_empty
from lynceus.operators.reports import scan_summary, severity_totals
from lynceus.scale import cut_lineage

SEPARATOR = "─" * 60


def to_json_rows(findings: DataFrame) -> DataFrame:
    """One JSON text per finding; fields without a value are left out."""
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("value"))


def write_json_report(findings: DataFrame, path: str) -> None:
    findings.write.mode("errorifexists").json(path)


def text_report(findings: DataFrame) -> DataFrame:
    """One readable block per finding, next to the columns that order it."""
    place = F.when(
        F.col("file_path").isNotNull(),
        F.format_string("  %s  line %s", "file_path", F.col("line_start").cast("string")),
    )
    cve = F.when(F.col("cve_id").isNotNull(), F.concat(F.lit("  CVE: "), F.col("cve_id")))
    section = lambda title, c: F.when(
        empty_if_none(F.col(c)) != "", F.concat(F.lit(f"  {title}:\n  "), F.col(c), F.lit("\n"))
    )
    block = F.concat_ws(
        "\n",
        F.format_string("%s — %s", label(F.col("severity")), "title"),
        place,
        cve,
        F.concat(F.lit("\n  "), F.col("vulnerable_code"), F.lit("\n")),
        section("Why it matters", "explanation"),
        section("How to fix it", "fixed_code"),
        F.lit(SEPARATOR),
    )
    return findings.select(
        "sev_rank", "engine", "file_path", "line_start", "rule_id", "finding_id", block.alias("value")
    )


def summary_line(summary: DataFrame) -> DataFrame:
    """Closing line of a text report, from :func:`lynceus.operators.reports.severity_totals`."""
    none = F.format_string(
        "Nothing found in %s file(s)", F.col("files").cast("string")
    )
    counts = F.format_string(
        "%s finding(s) (%s critical, %s high, %s medium, %s low) in %s file(s)",
        *[F.col(c).cast("string") for c in ("total", "critical", "high", "medium", "low", "files")],
    )
    return summary.select(F.when(F.col("total") == 0, none).otherwise(counts).alias("value"))


def write_text_report(findings: DataFrame, files: DataFrame, path: str) -> None:
    """Blocks in report order below ``path/findings``, the closing line in ``path/summary``.

    The findings are written once; the order and the counts both read them back.
    """
    stored = cut_lineage(findings, "findings")
    blocks = rank_order(text_report(stored), stored=True)
    blocks.select("value").write.text(f"{path}/findings")
    summary_line(severity_totals(stored, files)).write.text(f"{path}/summary")


def scan_result_rows(findings: DataFrame, scan_id: str | None = None) -> DataFrame:
    """Rows of the ``scan_results`` table; empty explanation and fix become NULL."""
    rows = findings if scan_id is None else findings.withColumn("scan_id", F.lit(scan_id))
    return rows.select(
        "scan_id",
        *[
            none_if_empty(F.col(c)).alias(c) if c in ("explanation", "fixed_code") else F.col(c)
            for c in schemas.FINDINGS.names
        ],
        F.col("detected_at").alias("created_at"),
        F.to_date("detected_at").alias("scan_date"),
    )


def read_scan_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored findings; NULL explanation and fix read as empty text."""
    rows = spark.read.parquet(f"{path}/scan_results")
    return rows.withColumns(
        {c: empty_if_none(F.col(c)) for c in ("explanation", "fixed_code")}
    )


def results_of_scan(rows: DataFrame, scan_id: str) -> DataFrame:
    """Findings of one scan, oldest first."""
    return rows.where(F.col("scan_id") == scan_id).orderBy("created_at", "finding_id")


def persist(
    findings: DataFrame,
    path: str,
    language: str,
    target_name: str,
    created_at: datetime,
    load_id: str | None = None,
    scans: DataFrame | None = None,
) -> None:
    """Store findings that carry a ``scan_id``, and a summary row per scan.

    ``scans`` lists the scans (scan_id, and their own language and target_name where it has
    them); each has a row, with or without findings.

    Each call writes one folder below the date of the scan, and the summary is
    computed from that folder: the two cannot disagree, the scan runs once and
    nothing older is read. A repeated call with the same ``load_id`` replaces
    what the first one wrote.
    """
    spark = findings.sparkSession
    place = f"scan_date={created_at.date().isoformat()}/load={load_id or uuid.uuid4().hex}"
    rows = scan_result_rows(findings).drop("scan_date")
    rows.write.mode("overwrite").parquet(f"{path}/scan_results/{place}")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/scan_results/{place}")
    summary = scan_summary(stored, scans)
    own = lambda c, value: F.coalesce(c, F.lit(value)) if c in summary.columns else F.lit(value)
    summary = summary.select(
        "scan_id",
        own("language", language).alias("language"),
        own("target_name", target_name).alias("target_name"),
        F.col("findings_count").cast("int").alias("findings_count"),
        "severity_counts",
        F.lit(created_at).cast("timestamp").alias("created_at"),
    )
    summary.write.mode("overwrite").parquet(f"{path}/scans/{place}")


def write_version(table: DataFrame, path: str, version: int) -> str:
    """Write a table as a new version folder; readers switch by version number."""
    target = f"{path}/v{version:08d}"
    table.write.mode("errorifexists").parquet(target)
    return target
