"""Workspace batches and the size limits of scan inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus import schemas
from lynceus.scale import join_lookup

# Largest single input, and largest workspace batch, in bytes.
MAX_FILE_BYTES = 512 * 1024
MAX_WORKSPACE_BYTES = 5 * MAX_FILE_BYTES


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON scan requests, one per line, with an id made of their content."""
    requests = spark.read.schema(schemas.WORKSPACE_REQUEST).json(path)
    body = F.to_json(F.struct("files", "engines"))
    return requests.select(F.sha2(body, 256).alias("scan_id"), "files", "engines")


def read_workspace(spark: SparkSession, path: str) -> DataFrame:
    """Files of JSON scan requests ``{"files": [...], "engines": [...]}``, one per line."""
    from lynceus.plans.scan import as_files

    requests = spark.read.schema(schemas.WORKSPACE_REQUEST).json(path)
    return as_files(requests.select(F.inline("files")))


def split_oversize(
    files: DataFrame, max_bytes: int = MAX_FILE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Files within the limit, and the rejected ones with a reason instead of their text."""
    size = F.coalesce(F.octet_length("code"), F.lit(0))
    rejects = files.where(size > max_bytes).select(
        "path",
        size.alias("bytes"),
        F.lit(f"text of more than {max_bytes // 1024} KiB").alias("reason"),
    )
    return files.where(size <= max_bytes), rejects


def split_oversize_batches(
    files: DataFrame, batch: str, max_bytes: int = MAX_WORKSPACE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Files of workspace batches within the limit, and the batches over it.

    Sizes aggregate before the shuffle, and the texts are not shuffled as long
    as the list of rejected batches measures small.
    """
    sizes = files.groupBy(batch).agg(
        F.sum(F.coalesce(F.octet_length("code"), F.lit(0))).alias("bytes"), F.count("*").alias("files")
    )
    rejects = sizes.where(F.col("bytes") > max_bytes).select(
        batch,
        "bytes",
        "files",
        F.lit(f"workspace of more than {max_bytes / 2**20:g} MiB").alias("reason"),
    )
    kept = join_lookup(files, rejects.select(batch), [batch], "left_anti")
    return kept, rejects
