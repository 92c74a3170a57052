"""Advisory feeds and analyzer reports, read from files with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus import schemas
from lynceus.functions.severity import rank_of
from lynceus.functions.text import none_if_empty, sql_map
from lynceus.rules.model import SAST

# Analyzer levels.
ANALYZER_LEVEL = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}


def _position() -> Column:
    """Text that sorts by file, then by place in the file."""
    number = lambda c: F.lpad(c.cast("string"), 20, "0")
    return F.concat_ws(
        "|",
        F.col("_metadata.file_path"),
        number(F.col("_metadata.file_block_start")),
        number(F.monotonically_increasing_id()),
    )


def _read(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return raw.select("*", _position().alias("feed_pos"))


def read_nvd(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """NVD documents; every page of a feed is one file, or one line."""
    return _read(spark, path, schemas.NVD_FEED, multi_line)


def read_osv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """OSV records, one per line or one per file."""
    return _read(spark, path, schemas.OSV_RECORD, multi_line)


def read_analyzer(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw findings of an external analyzer's JSON report."""
    return analyzer_findings(
        spark.read.schema(schemas.ANALYZER_REPORT).option("multiLine", multi_line).json(path)
    )


def analyzer_findings(reports: DataFrame) -> DataFrame:
    """Results of analyzer reports as raw findings."""
    level = F.coalesce(
        F.try_element_at(sql_map(ANALYZER_LEVEL), F.upper("hit.extra.severity")), F.lit("low")
    )
    return reports.select(F.explode("results").alias("hit")).select(
        F.lit(SAST).alias("engine"),
        F.col("hit.check_id").alias("rule_id"),
        none_if_empty(F.col("hit.extra.metadata.cve")).alias("cve_id"),
        F.lit(None).cast("string").alias("cwe_id"),
        level.alias("severity"),
        rank_of(level).alias("sev_rank"),
        F.substring_index("hit.check_id", ".", -1).alias("title"),
        F.lit("").alias("vulnerable_code"),
        F.col("hit.extra.message").alias("description"),
        F.col("hit.start.line").alias("line_start"),
        F.col("hit.start.line").alias("line_end"),
        F.col("hit.path").alias("file_path"),
    )
