"""Streaming form of the debounce: one session per key and burst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.operators.debounce import GAP_MICROS


def debounce_stream(
    changes: DataFrame,
    key: str,
    ts: str,
    change_id: str,
    gap_micros: int = GAP_MICROS,
    late: str = "10 seconds",
) -> DataFrame:
    """Last change of every burst, emitted once the watermark has passed its end.

    Sessions of a micro-batch are merged per task before the shuffle when
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is set.
    """
    rest = [c for c in changes.columns if c not in (key, ts)]
    timed = changes.withColumn(ts, F.col(ts).cast("timestamp"))
    return (
        timed.withWatermark(ts, late)
        .groupBy(key, F.session_window(ts, f"{gap_micros} microseconds"))
        .agg(
            F.max_by(F.struct(ts, *rest), F.struct(ts, change_id)).alias("last"),
            F.count("*").alias("changes"),
        )
        .select(key, "last.*", "changes")
    )
