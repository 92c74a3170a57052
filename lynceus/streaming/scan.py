"""Scanning of files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lynceus import schemas
from lynceus.operators.reports import scan_summary
from lynceus.plans.scan import as_files, scan
from lynceus.rules.model import AI_CODE, SAST, SECRETS
from lynceus.sources.sinks import scan_result_rows

LINE_ENGINES = (SAST, SECRETS, AI_CODE)


def read_file_stream(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    schema: T.StructType = schemas.WORKSPACE_FILE,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Files as they arrive in a folder, as JSON or Parquet rows (path, code, language)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def scan_stream(
    files: DataFrame, engines: Sequence[str] = LINE_ENGINES, min_severity: str = "low", **options
) -> DataFrame:
    """Findings of the line engines over a stream. Stateless: the batch plan as it is."""
    line_engines = [e for e in engines if e in LINE_ENGINES]
    return scan(as_files(files), line_engines, min_severity, **options)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch to its own folder; a repeated batch replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def stored_scans(spark: SparkSession, path: str) -> DataFrame:
    """One row per scan of a job's folder: findings in all and per level, over all micro-batches."""
    rows = spark.read.parquet(f"{path}/scans")
    counts = rows.select("scan_id", F.explode_outer("severity_counts").alias("severity", "n"))
    levels = counts.groupBy("scan_id", "severity").agg(F.sum("n").alias("n"))
    known = F.filter(F.collect_list(F.struct("severity", "n")), lambda x: x["severity"].isNotNull())
    return levels.groupBy("scan_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("findings_count"), F.map_from_entries(known).alias("severity_counts")
    )


def start_scan_job(
    files: DataFrame,
    path: str,
    checkpoint: str,
    scan_id_column: str | None = None,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Scan every micro-batch with any engine, store findings and completion summary.

    Each micro-batch is one scan unless a column names the scan. The id goes through the
    scan with each file. The findings are written once, and the summary aggregates what was
    written, with a row for scans without findings too. A scan over several
    micro-batches has a row in each; :func:`stored_scans` adds them up.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = F.lit(f"batch-{batch_id:09d}") if scan_id_column is None else F.col(scan_id_column)
        named = batch.withColumn("scan_id", own.cast("string"))
        rows = scan_result_rows(scan(as_files(named, ("scan_id",)), keep=("scan_id",), **options))
        write_batch(rows, f"{path}/scan_results", batch_id)
        stored = spark.read.schema(rows.schema).parquet(f"{path}/scan_results/batch_id={batch_id}")
        counted = scan_summary(stored, named.select("scan_id").distinct())
        write_batch(counted, f"{path}/scans", batch_id)

    return (
        files.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
