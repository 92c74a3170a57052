"""Masking of secret values in reported snippets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lynceus.functions.entropy import assigned_literals
from lynceus.rules.model import Rule

SHOWN = 4


def mask(value: Column, shown: int = SHOWN) -> Column:
    """First characters kept, at most a quarter of them, the rest starred; the length stays the same."""
    seen = F.least(F.lit(shown), F.floor(F.length(value) / 4).cast("int"))
    return F.rpad(F.left(value, seen), F.length(value), "*")


def redact(text: Column, rules: Iterable[Rule], entropy: bool = False) -> Column:
    """Text with every value that any of the rules captures masked.

    All rules are applied, not only the reported one, because a line may hold
    several credentials. Longer values go first, so that a value inside another
    does not leave the rest of it in sight.
    """
    captured = [
        F.regexp_extract_all(text, F.lit(r.regex), F.lit(r.value_group))
        for r in rules
        if r.value_group
    ]
    if entropy:
        captured.append(assigned_literals(text))
    if not captured:
        return text
    values = F.array_distinct(F.flatten(F.array(*captured)))
    longest = F.sort_array(F.transform(values, lambda v: F.struct((-F.length(v)).alias("less"), v.alias("value"))))
    return F.aggregate(longest, text, lambda acc, v: F.replace(acc, v["value"], mask(v["value"])))
