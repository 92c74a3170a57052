"""Rule matching over lines.

One pass serves all engines. Rules are literals of one projection, so a line is
read once whatever the number of engines, and no line is shuffled:

    files -> explode lines -> rule bits per line -> explode hits

Each rule tests cheap substrings before its regex; a substring that several
rules need is tested once per line. The bits of the rules that
report every match share one long, and an engine that reports the first match
is one ``CASE`` in catalog order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions import entropy as entropy_fn
from lynceus.functions import redact as redact_fn
from lynceus.functions.severity import RANK
from lynceus.functions.text import line_array, neighbours_hash, replaced, sql_text, trimmed_line, with_neighbours
from lynceus.rules import secrets as secret_rules
from lynceus.rules.model import FIRST_MATCH, SECRETS, Catalog, Rule

BITS = 60
# Any one character; a text may hold it.
MARK = "\uffff"
# Columns of the lines before and after a line.
NEIGHBOURS = {"before": "_before", "after": "_after"}

# Path parts that mark tests and examples.
TEST_PATH = r"\.env\.example|test_|_test\.|fixture"


def folded(text: Column) -> Column:
    """Lower case for substring tests; the long s folds to s as in the patterns."""
    return F.lower(replaced(text, "ſ", "s"))


def needle_test(
    groups: Iterable[tuple[str, ...]], text: str, known: dict[str, str] | None = None
) -> str | None:
    """SQL condition that a text holds a needle of every group.

    ``known`` names columns that already hold the test of a needle.
    """
    known = known or {}
    tests = [
        " OR ".join(known.get(n, f"contains({text}, {sql_text(n)})") for n in group)
        for group in groups
    ]
    return " AND ".join(f"({t})" for t in tests) if tests else None


def match_starts(code: Column, regex: str) -> Column:
    """For line 0, 1, ... whether a whole-file pattern starts to match there; NULL where it matches nowhere.

    The text is cut in front of each match, rid of the mark, joined with the mark, and cut
    into lines: the work grows with the text, whatever the number of matches. A line
    end put in front makes the first line number 1.
    """
    flags, pattern = regex[: regex.index(")") + 1], regex[regex.index(")") + 1 :]
    pieces = F.split(F.concat(F.lit("\n"), code), f"{flags}(?={pattern})", -1)
    bare = F.transform(pieces, lambda p: F.replace(p, F.lit(MARK), F.lit("")))
    lines = F.split(F.array_join(bare, MARK), "\n", -1)
    return F.when(F.size(pieces) > 1, F.transform(lines, lambda line: F.contains(line, F.lit(MARK))))


def _multiline_column(rule: Rule) -> str:
    return f"_starts_{rule.rule_id}"


def _match_starts(rule: Rule) -> Column:
    """Whether a whole-file rule matches, by line; most files only pay for a sign test.

    Needles without letters are looked up in the text as it is. The branches
    are nested, so the text is folded only where those are present.
    """
    hits = match_starts(F.col("code"), rule.regex)
    signs = [g for g in rule.needles if not any(n.upper() != n for n in g)]
    words = [g for g in rule.needles if g not in signs]
    if words:
        test = needle_test(words, "lower(replace(code, 'ſ', 's'))")
        hits = F.when(F.expr(test), hits)
    if signs:
        hits = F.when(F.expr(needle_test(signs, "code")), hits)
    return hits


def _condition(rule: Rule, known: dict[str, str]) -> str:
    """SQL condition that a rule matches the current line, cheapest tests first."""
    tests = []
    if rule.languages is not None:
        tests.append(f"language IN ({', '.join(map(sql_text, rule.languages))})")
    if rule.multiline:
        tests.append(f"get(`{_multiline_column(rule)}`, line_no)")
    else:
        needles = needle_test(rule.needles, "_low", known)
        if needles is not None:
            tests.append(needles)
        tests.append(f"line RLIKE {sql_text(rule.regex)}")
    if rule.random_value:
        tests.append("_random")
    return " AND ".join(tests)


def exploded_lines(files: DataFrame, catalog: Catalog, keep: list[str], context: bool = False) -> DataFrame:
    """Lines with what the rules read: folded text, and hits of whole-file patterns; with ``context`` also their neighbours."""
    whole_file = [r for r in catalog.rules if r.multiline]
    names = [_multiline_column(r) for r in whole_file]
    if whole_file:
        marks = [_match_starts(r).alias(_multiline_column(r)) for r in whole_file]
        files = files.select(*keep, "code", *marks)
    lines, carried = line_array(F.col("code")), [F.col("_line").alias("line")]
    if context:
        # bound once
        files = files.select(*keep, *names, lines.alias("_lines"))
        lines, carried = with_neighbours(F.col("_lines")), [F.col(f"_line.{c}").alias(a) for c, a in (("line", "line"), *NEIGHBOURS.items())]
    return files.select(
        *keep, *names, F.posexplode(lines).alias("_pos", "_line")
    ).select(
        *keep,
        *names,
        (F.col("_pos") + 1).alias("line_no"),
        *carried,
    ).select(
        "*",
        folded(F.col("line")).alias("_low"),
    )


def _shared_needles(rules: list[Rule]) -> dict[str, str]:
    """Needles that several rules test, with the column that holds each test."""
    uses = Counter(n for r in rules if not r.multiline for n in {n for g in r.needles for n in g})
    shared = sorted(n for n, count in uses.items() if count > 1)
    return {n: f"_has{i}" for i, n in enumerate(shared)}


def rule_hits(
    files: DataFrame, catalog: Catalog, min_level: str = "info", keep: tuple[str, ...] = (), context: bool = False
) -> DataFrame:
    """One row per reported (line, rule): path, language, line and catalog position.

    A level threshold acts in the plan. Rules of an all-match engine below it
    are not evaluated; in a first-match engine they still claim their line.
    """
    rules = catalog.rules
    floor = RANK[min_level]
    every = [
        i for i, r in enumerate(rules) if r.engine not in FIRST_MATCH and r.sev_rank >= floor
    ]
    chains: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        if r.engine in FIRST_MATCH:
            chains.setdefault(r.engine, []).append(i)
    wanted = {}
    for engine, chain in chains.items():
        reported = [i for i in chain if rules[i].sev_rank >= floor]
        if reported:
            wanted[engine] = (chain[: chain.index(reported[-1]) + 1], reported)

    positions = sorted(set(every).union(*(chain for chain, _ in wanted.values())))
    used = [rules[i] for i in positions]
    known = _shared_needles(used)
    carried = ["path", "language", *keep]
    lines = exploded_lines(files, Catalog(tuple(used)), carried, context)
    if context:
        carried += NEIGHBOURS.values()
    if any(r.random_value for r in used):
        lines = lines.withColumn("_random", entropy_fn.has_random_literal(F.col("line")))

    tested, hits, found = [], [], []
    for start in range(0, len(every), BITS):
        part = every[start : start + BITS]
        name = f"_bits{start}"
        bits = " | ".join(
            f"CASE WHEN {_condition(rules[i], known)} THEN {1 << k}L ELSE 0L END"
            for k, i in enumerate(part)
        )
        tested.append(f"{bits} AS {name}")
        found.append(f"{name} <> 0")
        hits += [f"CASE WHEN {name} & {1 << k}L <> 0 THEN {i} END" for k, i in enumerate(part)]
    for engine, (chain, reported) in wanted.items():
        name = f"_first_{engine}"
        cases = " ".join(f"WHEN {_condition(rules[i], known)} THEN {i}" for i in chain)
        tested.append(f"CASE {cases} END AS {name}")
        here = name
        if len(reported) < len(chain):
            here = f"CASE WHEN {name} IN ({', '.join(map(str, reported))}) THEN {name} END"
        found.append(f"{here} IS NOT NULL")
        hits.append(here)

    any_hit = " OR ".join(found) if found else "false"
    array = f"array({', '.join(hits)})" if hits else "CAST(array() AS ARRAY<INT>)"
    flags = [f"contains(_low, {sql_text(n)}) AS {c}" for n, c in known.items()]
    found = (
        lines.selectExpr("*", *flags)
        .selectExpr(*carried, "line_no", "line", *tested)
        .selectExpr(
            *carried, "line_no", "line", f"explode(CASE WHEN {any_hit} THEN {array} END) AS rule_pos"
        )
        .where("rule_pos IS NOT NULL")
    )
    if not context:
        return found
    # only lines with findings are hashed; a file without a path has no place to be known by
    near = F.when(F.col("path").isNotNull(), neighbours_hash(*[F.col(c) for c in NEIGHBOURS.values()]))
    return found.withColumn("context", near).drop(*NEIGHBOURS.values())


def rule_column(catalog: Catalog, attribute: str) -> Column:
    """An attribute of the rule at ``rule_pos``, from a literal array."""
    values = [getattr(r, attribute) for r in catalog.rules]
    items = [str(v) if isinstance(v, int) else sql_text(v) for v in values]
    return F.expr(f"get(array({', '.join(items)}), rule_pos)") if items else F.lit(None)


def snippet(rules: Iterable[Rule] = ()) -> Column:
    """Trimmed line with all credentials masked, whichever engine reports it.

    The built-in credential rules are always applied, also where no secrets engine runs, as
    snippets are stored and put into prompts. ``rules`` are further ones. A line without
    any sign of a credential only pays for substring tests, on the folded line in ``_low``.
    """
    masking = [*secret_rules.RULES.rules, *[r for r in rules if r.engine == SECRETS and r not in secret_rules.RULES.rules]]
    plain = trimmed_line(F.col("line"))
    hidden = redact_fn.redact(plain, masking, entropy=any(r.random_value for r in masking))
    tests = [needle_test(r.needles, "_low") for r in masking]
    if any(t is None for t in tests):
        return hidden
    return F.when(F.expr(" OR ".join(f"({t})" for t in tests)), hidden).otherwise(plain)


def match(
    files: DataFrame,
    catalog: Catalog,
    min_level: str = "info",
    keep: tuple[str, ...] = (),
    context: bool = False,
) -> DataFrame:
    """Raw findings of the line engines: rule, snippet and place, and with ``context`` the hash of the lines around."""
    attributes = ("engine", "rule_id", "cwe_id", "severity", "sev_rank", "title", "description")
    hits = rule_hits(files, catalog, min_level, keep, context)
    return hits.withColumn("_low", folded(F.col("line"))).select(
        *keep,
        *(["context"] if context else []),
        *[rule_column(catalog, a).alias(a) for a in attributes],
        snippet(catalog.rules).alias("vulnerable_code"),
        F.col("line_no").alias("line_start"),
        F.col("line_no").alias("line_end"),
        F.col("path").alias("file_path"),
        F.col("language").alias("_language"),
    )


def without_tests(files: DataFrame) -> DataFrame:
    """Files whose path does not look like a test, fixture or example."""
    return files.where(~F.coalesce("path", F.lit("")).rlike(TEST_PATH))


def with_entropy(catalog: Catalog) -> Catalog:
    """Catalog with the high-entropy detector as the last secrets rule."""
    return catalog.plus([secret_rules.ENTROPY])
