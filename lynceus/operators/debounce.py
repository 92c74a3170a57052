"""Last change of every burst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.functions.times import micros, time_bucket

# Fixed value: silence that ends a burst.
GAP_MICROS = 1_500_000


def debounce(
    changes: DataFrame, key: str, ts: str, change_id: str, gap_micros: int = GAP_MICROS
) -> DataFrame:
    """Changes that no change of the same key follows within the gap.

    Time is cut into buckets as long as the gap. Of a bucket only the latest
    change can survive, and only a change in the next bucket can stop it, so
    two aggregates decide everything. They combine before the shuffle and hash
    by (key, bucket): a hot key is spread like any other.
    """
    rest = [c for c in changes.columns if c not in (key, ts, change_id)]
    row = F.struct(F.col("_t"), F.col(change_id), F.col(ts), *rest)
    buckets = (
        changes.withColumn("_t", micros(F.col(ts)))
        .withColumn("_bucket", time_bucket(F.col("_t"), gap_micros))
        .groupBy(key, "_bucket")
        .agg(
            F.max_by(row, F.struct("_t", change_id)).alias("last"),
            F.min("_t").alias("first_t"),
        )
    )
    following = buckets.select(
        F.col(key).alias("_key"), (F.col("_bucket") - 1).alias("_before"), F.col("first_t").alias("_next")
    )
    return (
        buckets.join(
            following,
            F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_before")),
            "left",
        )
        .where(F.col("_next").isNull() | (F.col("_next") - F.col("last._t") > gap_micros))
        .select(
            key,
            *[F.col("last").getField(c).alias(c) for c in [ts, change_id, *rest]],
        )
        .select(*changes.columns)
    )
