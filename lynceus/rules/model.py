"""Rule records and catalogs.

A catalog is configuration: a few dozen records that become literals of the
query plan. Rules kept as a table are matched by
:mod:`lynceus.operators.rule_tables`, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from lynceus import schemas
from lynceus.functions.severity import RANK

SAST, SCA, SECRETS, AI_CODE = "sast", "sca", "secrets", "ai_code"

# Engine names in default order, and their display names.
ENGINES = (SAST, SCA, SECRETS, AI_CODE)
ENGINE_LABELS = {SAST: "SAST", SCA: "SCA", SECRETS: "Secrets", AI_CODE: "AI Code"}

# Texts that many rules require. Tested once per line and before rarer ones.
CALL = ("(",)
ASSIGN = ("=", ":")
QUOTE = ("'", '"')

# Engines that report only the first matching rule of a line.
FIRST_MATCH = frozenset({SECRETS, AI_CODE})


def then(*parts: str) -> str:
    """Pattern of a line that holds the parts one after another, with any text between.

    The first place of a part leaves the most room for the next, so it is never
    given up for a later one. A very long line costs linear time.
    """
    return r"\A" + "".join(f"(?>.*?(?:{p}))" for p in parts[:-1]) + f".*(?:{parts[-1]})"


@dataclass(frozen=True)
class Rule:
    """One line pattern.

    ``needles`` holds groups of lower-case texts; a matching line contains at
    least one text of every group. They only save regex work and never change
    a result. ``multiline`` patterns see the whole file and report the line
    their match starts on. ``languages`` limits a rule to some languages. A
    ``random_value`` rule also needs a literal of high entropy.
    """

    rule_id: str
    engine: str
    title: str
    pattern: str
    severity: str
    cwe_id: str | None = None
    description: str = ""
    needles: tuple[tuple[str, ...], ...] = ()
    languages: tuple[str, ...] | None = None
    ignore_case: bool = True
    multiline: bool = False
    value_group: int = 0
    random_value: bool = False

    @property
    def regex(self) -> str:
        """Java form: Unicode classes, LF as the only line end for the dot."""
        return ("(?idU)" if self.ignore_case else "(?dU)") + self.pattern

    @property
    def sev_rank(self) -> int:
        return RANK[self.severity]


@dataclass(frozen=True)
class Catalog:
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        ids = [r.rule_id for r in self.rules]
        repeated = sorted({i for i in ids if ids.count(i) > 1})
        if repeated:
            raise ValueError(f"rule ids used twice: {', '.join(repeated)}")

    def of(self, *engines: str) -> Catalog:
        return Catalog(tuple(r for r in self.rules if r.engine in engines))

    def plus(self, rules: Iterable[Rule]) -> Catalog:
        """Catalog with a user's rules appended after the built-in ones."""
        return Catalog(self.rules + tuple(rules))

    def scoped(self, languages: dict[str, Sequence[str]]) -> Catalog:
        """Catalog where the named rules apply to the given languages only."""
        return Catalog(
            tuple(
                replace(r, languages=tuple(languages[r.rule_id]))
                if r.rule_id in languages
                else r
                for r in self.rules
            )
        )

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (
                r.rule_id,
                r.engine,
                position,
                r.title,
                r.regex,
                r.severity,
                r.sev_rank,
                r.cwe_id,
                r.description,
                ",".join(r.languages) if r.languages else None,
            )
            for position, r in enumerate(self.rules)
        ]
        return spark.createDataFrame(rows, schemas.RULES)


def parse_engines(names: Iterable[str]) -> tuple[str, ...]:
    """Known engine names in the order given; unknown names are dropped."""
    return tuple(n for n in names if n in ENGINES)


def without_engines(disabled: str | None) -> tuple[str, ...]:
    """Default engines minus a comma list such as ``"sca, secrets"``."""
    off = {part.strip().lower() for part in (disabled or "").split(",")}
    return tuple(e for e in ENGINES if e not in off)
