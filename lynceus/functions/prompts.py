"""Prompts for explanations and fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.severity import label


def _optional(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\n")), F.lit(""))


def explain_prompt() -> Column:
    return F.concat(
        F.lit("Explain a security finding to a developer without security training.\n\nTitle: "),
        F.col("title"),
        F.lit("\nSeverity: "),
        label(F.col("severity")),
        F.lit("\n"),
        _optional("CVE", F.col("cve_id")),
        _optional("CWE", F.col("cwe_id")),
        F.lit("Code:\n```\n"),
        F.col("vulnerable_code"),
        F.lit(
            "\n```\n\nSay what is wrong, what harm it can do and how it would be attacked,"
            " in plain words and at most 200 words."
        ),
    )


def fix_prompt() -> Column:
    return F.concat(
        F.lit("Correct this insecure code.\n\nTitle: "),
        F.col("title"),
        F.lit("\nCode:\n```\n"),
        F.col("vulnerable_code"),
        F.lit("\n```\n\nAnswer with the corrected code and nothing else."),
    )


def with_prompts(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"explain_prompt": explain_prompt(), "fix_prompt": fix_prompt()})
