"""The findings row: ids, detection time, column order, engine union."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus import schemas
from lynceus.functions.text import line_contexts
from lynceus.scale import cut_lineage, join_lookup


def finding_id() -> Column:
    """Id built from the finding itself, so a retried or repeated scan gives the same."""
    return F.sha2(
        F.concat_ws(
            "|",
            F.coalesce("file_path", F.lit("")),
            "rule_id",
            F.col("line_start").cast("string"),
            "vulnerable_code",
        ),
        256,
    )


def to_findings(
    raw: DataFrame, detected_at: datetime | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Raw findings in the ``FINDINGS`` schema; columns an engine lacks are empty."""
    when = F.current_timestamp() if detected_at is None else F.lit(detected_at)
    made = {
        "finding_id": finding_id(),
        "explanation": F.lit(""),
        "fixed_code": F.lit(""),
        "detected_at": when.cast("timestamp"),
    }
    columns = []
    for f in schemas.FINDINGS.fields:
        if f.name in raw.columns:
            col = F.col(f.name)
        else:
            col = made.get(f.name, F.lit(None))
        columns.append(col.cast(f.dataType).alias(f.name))
    return raw.select(*keep, *columns)


def append_engines(results: Sequence[DataFrame]) -> DataFrame:
    """Results of several engines, appended."""
    return reduce(lambda a, b: a.unionByName(b), results)


def new_findings(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Findings of the current scan that the previous one did not have. Repeated ids on either side change nothing."""
    return current.join(previous.select("finding_id"), "finding_id", "left_anti")


def fixed_findings(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Findings of the previous scan that are gone."""
    return new_findings(previous, current)


def _words(text: Column) -> Column:
    """A text without the white space that formatters change; one with single blanks alone only pays for substring tests."""
    more = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in ("  ", "\t", "\n", "\x0b", "\f", "\r")])
    return F.btrim(F.when(more, F.regexp_replace(text, r"\s+", " ")).otherwise(text))


def with_context(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with ``context``, a hash of the lines before and after them without white space.

    The findings are written once. No text is shuffled: of each line only its place and hash travel, and where the findings'
    places measure small, only those of lines with findings.
    A scan of files at hand gives the same column by itself (``context``), where no line travels.
    Findings without a line, or whose file is not among ``files`` (path, code), have none.
    """
    findings = cut_lineage(findings, "found")
    lines = files.select(F.col("path").alias("file_path"), F.posexplode(line_contexts(F.col("code"))).alias("_pos", "context"))
    lines = lines.select("file_path", (F.col("_pos") + 1).alias("line_start"), "context")
    place = ["file_path", "line_start"]
    wanted = join_lookup(lines, findings.select(*place).distinct(), place, "left_semi")
    one = wanted.groupBy(*place).agg(F.min("context").alias("context"))
    return findings.join(one, place, "left").select(*findings.columns, "context")


def compare_scans(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Current findings with ``is_new``, told apart from moved ones; both sides have a ``context``.

    A finding is known by its file, rule and snippet without regard to white space, not by its line. Several
    that are alike so are paired first where their neighbouring lines are alike too, in line
    order, then the rest in line order; what is left over is new. Groups are parts of one
    file, whose size bounds them. Swap the sides to learn what was fixed. Repeated rows are one finding;
    a finding without file or line is known by the rest.
    """
    file, rule = (F.coalesce(c, F.lit("")) for c in ("file_path", "rule_id"))
    code = F.coalesce(F.concat(F.lit("="), _words(F.col("vulnerable_code"))), F.lit(""))
    text = F.concat(F.octet_length(file), F.lit(" "), F.octet_length(rule), F.lit(" "), file, rule, code)
    alike = F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("_alike")
    key = [alike, F.coalesce("context", F.lit(0)).alias("_near"), F.col("line_start").alias("_line")]
    # the rows travel once, by key; of the previous ones only the key
    carried = [f for f in current.schema.fields if f.name != "line_start"]
    rows = current.select(*key, F.lit(True).alias("_now"), *[F.col(f.name).alias(f"_row_{f.name}") for f in carried])
    none = [F.lit(None).cast(f.dataType).alias(f"_row_{f.name}") for f in carried]
    both = rows.unionByName(previous.select(*key, F.lit(False).alias("_now"), *none)).repartition("_alike")
    both = _paired(both.withColumn("_paired", F.lit(False)), ["_alike", "_near"])
    both = _paired(both, ["_alike"])
    line = F.col("_line").cast(current.schema["line_start"].dataType)
    row = [(line if c == "line_start" else F.col(f"_row_{c}")).alias(c) for c in current.columns]
    return both.where("_now").select(*row, (~F.col("_paired")).alias("is_new"))


def _paired(both: DataFrame, group: Sequence[str]) -> DataFrame:
    """``both`` sides with ``_paired`` also where the n-th of a group without a partner meets the n-th of the other side.

    Rows of one place are one, so they share a number, and the other side's greatest number says how many it has.
    """
    order = [c for c in ("_line", "_near") if c not in group]
    nth = F.dense_rank().over(Window.partitionBy(*group, "_paired", "_now").orderBy(*order))
    whole = Window.partitionBy(*group)
    most = lambda now: F.max(F.when(~F.col("_paired") & (F.col("_now") == now), F.col("_nth"))).over(whole)
    told = both.withColumn("_nth", nth).withColumns({"_of_now": most(True), "_of_before": most(False)})
    met = F.col("_nth") <= F.coalesce(F.when(F.col("_now"), F.col("_of_before")).otherwise(F.col("_of_now")), F.lit(0))
    return told.withColumn("_paired", F.col("_paired") | met).drop("_nth", "_of_now", "_of_before")
