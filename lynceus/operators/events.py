"""Scan events: progress, findings, completion, errors; and their replay."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.text import sql_map
from lynceus.rules.model import ENGINE_LABELS, parse_engines
from lynceus.scale import cut_lineage, fits_broadcast, numbered

# Event types, messages and the time finished events stay replayable.
PROGRESS, FINDING, COMPLETE, ERROR = "progress", "finding", "complete", "error"
FINISHING = "Scanning complete. Preparing results..."
REPLAY_SECONDS = 300


def engine_label(engine: Column) -> Column:
    return F.coalesce(F.try_element_at(sql_map(ENGINE_LABELS), engine), engine)


def progress_percent(done: Column, total: Column) -> Column:
    return F.floor(done * 100 / total).cast("int")


def progress_events(scans: DataFrame, engines: Sequence[str]) -> DataFrame:
    """Progress of every scan: one event before each engine and one at 100 percent."""
    engines = parse_engines(engines)
    n = len(engines)
    names = F.array(*[F.lit(e) for e in engines]) if n else F.array().cast("array<string>")
    started = scans.select("scan_id", F.posexplode(names).alias("step", "engine")).select(
        "scan_id",
        "step",
        progress_percent(F.col("step"), F.lit(n)).alias("percentage"),
        F.concat(F.lit("Running "), engine_label(F.col("engine")), F.lit(" engine...")).alias("message"),
    )
    finished = scans.select(
        "scan_id",
        F.lit(n).alias("step"),
        F.lit(100).alias("percentage"),
        F.lit(FINISHING).alias("message"),
    )
    return started.unionByName(finished)


def _event(kind: str, data: Column | None) -> Column:
    fields = [F.lit(kind).alias("type")]
    if data is not None:
        fields.append(data.alias("data"))
    return F.to_json(F.struct(*fields))


def scan_events(scans: DataFrame, findings: DataFrame, engines: Sequence[str]) -> DataFrame:
    """JSON events of scans. ``phase``, ``step`` and ``finding_id`` give their order, :func:`numbered_events` their numbers."""
    none = F.lit(None).cast("string")
    progress = progress_events(scans, engines).select(
        "scan_id", F.lit(0).alias("phase"), "step", none.alias("finding_id"),
        _event(PROGRESS, F.struct("percentage", "message")).alias("event"),
    )
    body = F.struct(*[F.col(c) for c in findings.columns if c != "scan_id"])
    found = findings.select(
        "scan_id", F.lit(1).alias("phase"), F.lit(0).alias("step"), "finding_id",
        _event(FINDING, body).alias("event"),
    )
    complete = scans.select(
        "scan_id", F.lit(2).alias("phase"), F.lit(0).alias("step"), none.alias("finding_id"),
        _event(COMPLETE, None).alias("event"),
    )
    return progress.unionByName(found).unionByName(complete)


def numbered_in_scan(events: DataFrame, by: Sequence[str], out: str = "seq") -> DataFrame:
    """``events`` with a running number from 1 within their scan, in the order of ``by``.

    All events are numbered in one order by scan, over range partitions, so no task holds a scan; a scan's
    number starts behind those before it. Rows alike in all of ``by`` get different numbers. The events are
    written once, as the range partitions are drawn from a sample, for which a scan would run a second time.
    """
    order = numbered(cut_lineage(events, "events"), ["scan_id", *by], "_at", "event-order")
    first = order.groupBy(F.col("scan_id").alias("_scan")).agg(F.min("_at").alias("_first"))
    first = F.broadcast(first) if fits_broadcast(first) else first
    own = order.join(first, F.equal_null("scan_id", "_scan"))
    return own.withColumn(out, F.col("_at") - F.col("_first") + 1).drop("_at", "_scan", "_first")


def numbered_events(events: DataFrame) -> DataFrame:
    """Events of :func:`scan_events` or :func:`error_events` with ``seq``, their running number within the scan."""
    return numbered_in_scan(events, ["phase", "step", "finding_id", "event"])


def error_events(failures: DataFrame) -> DataFrame:
    """Error events of (scan_id, reason) rows."""
    return failures.select(
        "scan_id", F.lit(2).alias("phase"), F.lit(0).alias("step"),
        F.lit(None).cast("string").alias("finding_id"),
        _event(ERROR, F.col("reason")).alias("event"),
    )


def live_events(events: DataFrame, now: datetime, ttl_seconds: int = REPLAY_SECONDS) -> DataFrame:
    """Events of scans that are running or finished within the last ``ttl_seconds``.

    A scan's age counts from its completion event; ``at`` is the event time.
    """
    done = events.where(F.col("type").isin(COMPLETE, ERROR)).groupBy("scan_id").agg(
        F.max("at").alias("done_at")
    )
    expired = done.where(
        F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("done_at").cast("timestamp"))
        >= ttl_seconds * 1_000_000
    )
    return events.join(expired.select("scan_id"), "scan_id", "left_anti")


def replay(
    events: DataFrame, scan_id: str, now: datetime, ttl_seconds: int = REPLAY_SECONDS
) -> DataFrame:
    """Events a late subscriber of one scan gets, in order."""
    own = events.where(F.col("scan_id") == scan_id)
    return live_events(own, now, ttl_seconds).orderBy("at", "seq")
