"""Shannon entropy of a text, computed inside the row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits per character above which a literal looks random, and the
# shortest literal considered.
THRESHOLD = 4.5
MIN_LENGTH = 20

# A quoted literal on the right of an assignment.
ASSIGNED_LITERAL = r"""[=:]\s*['"]([^'"\s]{%d,})['"]""" % MIN_LENGTH


def entropy(text: Column) -> Column:
    """Bits per character.

    The distinct characters of one text are folded in the row: no character
    becomes a row of its own and nothing is shuffled.
    """
    size = F.length(text)

    def add(total: Column, ch: Column) -> Column:
        share = (size - F.length(F.replace(text, ch, F.lit("")))) / size
        return total - share * F.log2(share)

    characters = F.array_distinct(F.split(text, ""))
    return F.when(size > 0, F.aggregate(characters, F.lit(0.0), add)).otherwise(F.lit(0.0))


def assigned_literals(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?dU)" + ASSIGNED_LITERAL), F.lit(1))


def has_random_literal(line: Column, threshold: float = THRESHOLD) -> Column:
    """Whether a line assigns a literal above an entropy; a line without an assignment or a quote only pays for substring tests."""
    holds = lambda *texts: reduce(or_, [F.contains(line, F.lit(t)) for t in texts])
    return holds("=", ":") & holds("'", '"') & F.exists(assigned_literals(line), lambda v: entropy(v) > threshold)
