"""Explanations and fixes for findings.

The answering function is supplied by the caller. It is asked once per distinct
(rule, code): equal findings collapse before the shuffle and share the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.prompts import with_prompts
from lynceus.functions.severity import RANK
from lynceus.scale import cut_lineage, join_lookup

# Fixed value: text of an explanation that could not be made.
UNAVAILABLE = "AI explanation unavailable."
DEFAULT_LEVEL = "medium"

ANSWERS = "cache_key string, explanation string, fixed_code string"
ATTEMPTS = f"{ANSWERS}, ok boolean"

Ask = Callable[[str], str]


def cache_key() -> Column:
    """Key of an answer: the rule and the code it was found in."""
    return F.sha2(F.concat_ws("|", "rule_id", F.sha2("vulnerable_code", 256)), 256)


def questions(findings: DataFrame, min_level: str = DEFAULT_LEVEL) -> DataFrame:
    """One row with prompts per distinct answer that findings of a level need."""
    asked = findings.where(F.col("sev_rank") >= RANK[min_level])
    one = ("title", "severity", "cve_id", "cwe_id", "vulnerable_code")
    return with_prompts(
        asked.withColumn("cache_key", cache_key())
        .groupBy("cache_key")
        .agg(F.min(F.struct(*one)).alias("f"))
        .select("cache_key", "f.*")
    ).select("cache_key", "explain_prompt", "fix_prompt")


def unanswered(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Questions without a cached answer."""
    return asked.join(cache.select("cache_key"), "cache_key", "left_anti")


def answer(asked: DataFrame, explain: Ask, fix: Ask, tasks: int | None = None) -> DataFrame:
    """Answers to questions, ``ok`` where both calls succeeded. A call that fails gives the fallback text.

    Calls are slow, so the questions are dealt out by number, not by size; they
    may cost money, so the answers are written once and read back: a later
    stage that is retried does not ask again.
    """
    tasks = tasks or asked.sparkSession.sparkContext.defaultParallelism * 4

    def attempt(ask: Ask, prompt: str) -> str | None:
        try:
            return ask(prompt)
        except Exception:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = [attempt(explain, p) for p in pdf["explain_prompt"]]
            fixed = [attempt(fix, p) for p in pdf["fix_prompt"]]
            yield pd.DataFrame(
                {
                    "cache_key": pdf["cache_key"],
                    "explanation": [UNAVAILABLE if t is None else t for t in told],
                    "fixed_code": [f or "" for f in fixed],
                    "ok": [t is not None and f is not None for t, f in zip(told, fixed)],
                }
            )

    return cut_lineage(asked.repartition(tasks).mapInPandas(run, ATTEMPTS), "answers")


def with_answers(findings: DataFrame, answers: DataFrame) -> DataFrame:
    """Findings with their answers; a finding without one keeps empty texts."""
    found = answers.select(
        "cache_key",
        F.col("explanation").alias("_explanation"),
        F.col("fixed_code").alias("_fixed_code"),
    )
    joined = join_lookup(
        findings.withColumn("cache_key", cache_key()),
        found,
        ["cache_key"],
        "left"
    )
    return joined.withColumns(
        {
            "explanation": F.coalesce("_explanation", "explanation"),
            "fixed_code": F.coalesce("_fixed_code", "fixed_code"),
        }
    ).select(*findings.columns)


def described(findings: DataFrame, min_level: str = DEFAULT_LEVEL) -> DataFrame:
    """Findings explained by their rule's own description. Needs no provider or join."""
    text = F.concat_ws(" ", F.concat("title", F.lit(".")), "description")
    wanted = F.col("sev_rank") >= RANK[min_level]
    return findings.withColumn("explanation", F.when(wanted, text).otherwise(F.col("explanation")))


def explain(
    findings: DataFrame,
    ask_explanation: Ask | None = None,
    ask_fix: Ask | None = None,
    cache: DataFrame | None = None,
    min_level: str = DEFAULT_LEVEL,
) -> tuple[DataFrame, DataFrame | None]:
    """Explained findings, and the answers to add to the cache.

    Only answers whose calls succeeded are to be cached, so that what failed is asked again. Without functions the rule descriptions are used and there is nothing to cache.
    """
    if ask_explanation is None or ask_fix is None:
        return described(findings, min_level), None
    asked = questions(findings, min_level)
    if cache is not None:
        asked = unanswered(asked, cache)
    made = answer(asked, ask_explanation, ask_fix)
    new = made.where("ok").drop("ok")
    known = made.drop("ok") if cache is None else made.drop("ok").unionByName(cache.select(*new.columns))
    return with_answers(findings, known), new
