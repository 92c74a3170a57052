"""Event feed of a running scan, and its replay for late readers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lynceus import schemas
from lynceus.operators.events import FINDING, REPLAY_SECONDS, numbered_in_scan, replay


# Numbers of a phase: findings come between progress and completion. Within findings a micro-batch has
# numbers of its own, behind those of the micro-batches before it.
PHASE_EVENTS = 1 << 56
BATCH_EVENTS = 1 << 32


def finding_events(findings: DataFrame, batch_id: int = 0) -> DataFrame:
    """Finding events of a batch of findings, as rows of the feed, each with a number of its own in its scan.

    Findings are numbered in the order of their id. ``batch_id`` puts them behind those of earlier batches.
    A stream of findings is written by :func:`write_finding_events`.
    """
    if findings.isStreaming:
        raise ValueError("findings of a stream are numbered by write_finding_events")
    scan = F.col("scan_id") if "scan_id" in findings.columns else F.lit(None).cast("string")
    body = [c for c in findings.columns if c != "scan_id"]
    rows = findings.select(
        scan.alias("scan_id"),
        "finding_id",
        F.lit(FINDING).alias("type"),
        F.to_json(F.struct(*body)).alias("data"),
        F.col("detected_at").alias("at"),
    )
    number = F.lit(PHASE_EVENTS + batch_id * BATCH_EVENTS) + F.col("seq")
    return numbered_in_scan(rows, ["finding_id", "data"]).select("scan_id", number.alias("seq"), "type", "data", "at")


def write_finding_events(
    findings: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append the finding events of a stream of findings to a feed's folder.

    Each micro-batch is numbered on its own and written to a folder of its own, which a repeated
    micro-batch replaces, so a number stands for one event even after a restart.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        finding_events(batch, batch_id).write.mode("overwrite").parquet(f"{path}/findings-{batch_id:09d}")

    return (
        findings.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def feed_rows(events: DataFrame, at: Column) -> DataFrame:
    """Events of :func:`lynceus.operators.events.scan_events` or ``error_events`` as rows of the feed."""
    part = lambda name: F.get_json_object("event", f"$.{name}")
    return events.select(
        "scan_id",
        (F.col("phase").cast("bigint") * PHASE_EVENTS + F.col("step")).alias("seq"),
        part("type").alias("type"),
        part("data").alias("data"),
        at.cast("timestamp").alias("at"),
    )


def write_events(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append an event stream to a Parquet folder. The file sink writes exactly once."""
    return (
        events.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def feed(spark: SparkSession, path: str) -> DataFrame:
    """All events of a feed's folder, those of every writer."""
    return spark.read.schema(schemas.SCAN_EVENT).option("recursiveFileLookup", True).parquet(path)


def follow(spark: SparkSession, path: str, scan_id: str | None = None, after: int | None = None) -> DataFrame:
    """Live events, read from the feed's folder as they are written: of one scan or of all, and those behind a number."""
    events = spark.readStream.schema(schemas.SCAN_EVENT).option("recursiveFileLookup", True).parquet(path)
    if scan_id is not None:
        events = events.where(F.col("scan_id") == scan_id)
    return events if after is None else events.where(F.col("seq") > after)


def catch_up(
    spark: SparkSession, path: str, scan_id: str, now: datetime, ttl_seconds: int = REPLAY_SECONDS
) -> DataFrame:
    """Events a late subscriber gets from the feed's folder."""
    return replay(feed(spark, path), scan_id, now, ttl_seconds)
