"""Severity levels: ranks, parsing, CVSS thresholds, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Level names, lowest first. The position is the rank.
LEVELS = ("info", "low", "medium", "high", "critical")
RANK = {level: rank for rank, level in enumerate(LEVELS)}

DEFAULT_SCORE = 5.0
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def parse_level(name: str | None, default: str = "low") -> str:
    """Level named by a user; an unknown name falls back to ``default``."""
    name = (name or "").lower()
    return name if name in RANK else default


def rank_of(level: Column, default: int | None = None) -> Column:
    """Rank of a level name in any case; ``default`` for an unknown one."""
    position = F.array_position(F.array(*[F.lit(v) for v in LEVELS]), F.lower(level))
    found = F.nullif(position, F.lit(0)).cast("int") - 1
    return found if default is None else F.coalesce(found, F.lit(default))


def level_of(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in LEVELS]), rank)


def parse_level_column(name: Column, default: str = "low") -> Column:
    return level_of(rank_of(name, RANK[default]))


def with_rank(df: DataFrame) -> DataFrame:
    return df.withColumn("sev_rank", rank_of(F.col("severity"), 0))


def at_least(df: DataFrame, level: str | None, default: str = "low") -> DataFrame:
    return df.where(F.col("sev_rank") >= RANK[parse_level(level, default)])


def label(level: Column) -> Column:
    return F.upper(level)


def cvss_severity(score: Column) -> Column:
    """Level of a CVSS score text; text before the first slash, 5.0 if no number."""
    first = F.split_part(score, F.lit("/"), F.lit(1))
    number = F.coalesce(
        F.when(first.rlike(NUMBER), first.try_cast("float")), F.lit(DEFAULT_SCORE).cast("float")
    )
    return (
        F.when(number >= 9.0, "critical")
        .when(number >= 7.0, "high")
        .when(number >= 4.0, "medium")
        .otherwise("low")
    )


def first_cvss_severity(entries: Column) -> Column:
    """Level of the first severity entry whose type names CVSS, else medium."""
    first = F.get(F.filter(entries, lambda e: F.contains(e["type"], F.lit("CVSS"))), F.lit(0))
    return F.when(first.isNull(), "medium").otherwise(cvss_severity(first["score"]))


def rank_order(findings: DataFrame, stored: bool = False) -> DataFrame:
    """Most severe first.

    The tie-break names every column that tells two findings apart, so the
    order is total and the range partitioner can split a level that holds most
    of the rows. The sort samples its input before it runs. Unless the findings
    are ``stored`` already they are written first, so the scan behind them runs
    once.
    """
    from lynceus.rules.model import ENGINES
    from lynceus.scale import cut_lineage

    if not stored:
        findings = cut_lineage(findings, "findings")
    engines = F.array(*[F.lit(e) for e in ENGINES])
    return findings.orderBy(
        F.desc("sev_rank"),
        F.array_position(engines, F.col("engine")),
        "file_path",
        "line_start",
        "rule_id",
        "finding_id",
    )
