"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan at run time: coalesce small shuffle partitions, split skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Matching costs much more time per byte than reading, so splits are small.
    "spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024),
    # Times are stored and compared in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Bursts of one key are merged before the shuffle of a streaming debounce.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(builder: SparkSession.Builder, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """A session builder with the settings; give two to four shuffle partitions per core."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder
