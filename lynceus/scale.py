"""Choices that depend on measured sizes: broadcasts, salting, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
SPREAD_BYTES = 256 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
# Estimates from here on say that the optimizer doesn't know.
UNKNOWN_BYTES = 2**60


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local
    session without the setting, as in tests, gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="lynceus-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result once and read it back, so later stages never recompute it."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it; names differ by more than case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound_batches(spark: SparkSession, max_bytes: int = BATCH_BYTES) -> None:
    """Arrow batches of at most ``max_bytes``, so that a worker never holds thousands of long texts at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= max_bytes:
        spark.conf.set(key, str(max_bytes))


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's own size estimate; costs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, max_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Small inputs dealt out to all cores before heavy per-row work.

    A file with few row groups gives few tasks. Up to ``max_bytes`` the rows of
    few files are moved, which is cheap at that size; larger inputs already
    split into enough tasks and stay where they are.
    """
    if df.isStreaming or planned_bytes(df) > max_bytes:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores * 3)


def _row_bytes(df: DataFrame) -> Column:
    size = F.lit(16 * (len(df.columns) + 1))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        elif not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
    return size


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the rows, measured in one aggregate, fit under ``max_bytes``.

    The estimate of a plan may be far too high, so only a plan that looks
    hopeless (1000 times the limit) is refused without measuring. A plan of unknown
    size is measured.
    """
    if max_bytes <= 0 or max_bytes * 1000 < planned_bytes(df) < UNKNOWN_BYTES:
        return False
    total = df.agg(F.sum(_row_bytes(df)).alias("n")).first()["n"] or 0
    return total <= max_bytes


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    condition: Column | None = None,
    salts: int = SALTS,
    salt_by: Sequence[str] | None = None,
) -> DataFrame:
    """Equi join where one key of ``left`` may hold a large share of its rows.

    Rows of ``left`` are spread over ``salts`` sub-keys and ``right`` is
    repeated once per sub-key, so a hot key becomes ``salts`` tasks. NULL keys
    are spread as well. ``how`` may be inner, left, left_semi or left_anti.
    ``condition`` names further columns of the two sides.
    """
    spread = [F.col(c) for c in (salt_by or left.columns)]
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns],
        F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salts)])).alias("_r_salt"),
    )
    on = F.col("_salt") == F.col("_r_salt")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    if condition is not None:
        on = on & condition
    joined = left.join(renamed, on, how)
    return joined.drop("_salt", "_r_salt", *[f"_r_{k}" for k in keys])


def join_lookup(
    left: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    condition: Column | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a large side to a lookup side.

    A lookup that measures small is broadcast, and the large side is not
    shuffled. A larger one is joined by its keys, where Spark splits partitions
    that measure skewed; nothing is copied but the other side of those. It is never broadcast on an
    estimate, as a written table is many times its file in memory. Rows that a left join keeps without a key meet
    nothing; they are spread over ``SALTS`` sub-keys, not sent to one task. The two sides
    may share no column names but the keys.
    """
    small = fits_broadcast(lookup, max_bytes)
    renamed = lookup.select(
        *[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in lookup.columns]
    )
    on = condition if condition is not None else F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    if how == "left" and not small:
        missing = lambda prefix: reduce(or_, [F.col(f"{prefix}{k}").isNull() for k in keys])
        atomic = [f.name for f in left.schema.fields if isinstance(f.dataType, T.AtomicType)]
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in atomic]), F.lit(SALTS)) + 1
        left = left.withColumn("_spread", F.when(missing(""), salt).otherwise(F.lit(0)))
        # from the keys, as the optimizer would take a constant out of the join
        renamed = renamed.withColumn("_r_spread", F.when(missing("_r_"), F.lit(-1)).otherwise(F.lit(0)).cast("bigint"))
        on = on & (F.col("_spread") == F.col("_r_spread"))
    joined = left.join(F.broadcast(renamed) if small else renamed.hint("merge"), on, how)
    return joined.drop(*[f"_r_{k}" for k in keys], "_spread", "_r_spread")


def numbered(
    rows: DataFrame, by: Sequence[str | Column], out: str, purpose: str = "numbered", unkept: Sequence[str] = ()
) -> DataFrame:
    """``rows`` with a running number from 0 in the order of ``by``, without gaps and without one task for all.

    Rows are range-partitioned and sorted; a row's number is its place in the partition and the sizes of the
    partitions before, of which there are as many as partitions. End ``by`` with columns that tell rows apart where many are alike.
    ``unkept`` names columns that only give the order and are not written.
    """
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop(*unkept)
    # a partition's number in the high bits, a row's in the low 33
    placed = cut_lineage(ordered.withColumn("_place", F.monotonically_increasing_id()), purpose)
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    number = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return placed.join(starts, part == F.col("_part")).withColumn(out, number).drop("_place", "_part", "_before")
