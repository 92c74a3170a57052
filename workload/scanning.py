"""Queries of the line engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lynceus.functions.severity import at_least, rank_order
from lynceus.functions.text import to_lines, trimmed
from lynceus.operators.entropy import random_literals
from lynceus.operators.findings import compare_scans, fixed_findings, new_findings
from lynceus.operators.matching import match, without_tests
from lynceus.operators.rule_tables import match_table
from lynceus.plans.scan import scan
from lynceus.rules.catalog import DEFAULT
from lynceus.rules.model import Rule, parse_engines, without_engines
from workload.base import NOW, corpus, corpus_sql, lines_sql, query, trim_sql
from workload.rules_sql import (
    AI_CODE,
    RANK_SQL,
    SAST,
    SECRETS,
    SNIPPET,
    every_match,
    findings_cte,
    first_match,
)

LINE_ENGINES = ("sast", "secrets", "ai_code")


def line_scan(spark, sf, name="code", level="info", **options):
    return scan(corpus(spark, sf, name), LINE_ENGINES, level, detected_at=NOW, **options)


for _name in ("documents", "conversations", "code"):

    @query(f"lines_{_name}", f"SELECT path, line_no, line FROM ({lines_sql(_name)})")
    def lines(spark, sf, name=_name):
        return to_lines(corpus(spark, sf, name).select("path", "code"))


@query("snippets_conversations", f"SELECT path, line_no, {trim_sql('line')} AS snippet FROM ({lines_sql('conversations')})")
def snippets(spark, sf):
    rows = to_lines(corpus(spark, sf, "conversations").select("path", "code"))
    return rows.select("path", "line_no", trimmed(F.col("line")).alias("snippet"))


PLACE = "path AS file_path, line_no AS line_start, rule_id, severity"

for _name in ("code", "documents", "pages", "conversations"):

    @query(
        f"sast_{_name}",
        f"WITH lines AS ({lines_sql(_name)}) SELECT {PLACE}, {SNIPPET} AS vulnerable_code FROM ({every_match(SAST)})",
    )
    def sast(spark, sf, name=_name):
        found = match(corpus(spark, sf, name), DEFAULT.of("sast"))
        return found.select("file_path", "line_start", "rule_id", "severity", "vulnerable_code")


@query(
    "ai_code_code",
    f"WITH lines AS ({lines_sql()}) SELECT {PLACE}, {SNIPPET} AS vulnerable_code FROM ({first_match(AI_CODE)})",
)
def ai_code(spark, sf):
    found = match(corpus(spark, sf), DEFAULT.of("ai_code"))
    return found.select("file_path", "line_start", "rule_id", "severity", "vulnerable_code")


@query(
    "secrets_code",
    f"WITH lines AS ({lines_sql()}) SELECT {PLACE}, {SNIPPET} AS vulnerable_code FROM ({first_match(SECRETS)})",
)
def secret(spark, sf):
    found = match(corpus(spark, sf), DEFAULT.of("secrets"))
    return found.select("file_path", "line_start", "rule_id", "severity", "vulnerable_code")


PROSE = ("documents", "pages", "conversations")


@query(
    "prose_findings",
    " UNION ALL ".join(
        f"SELECT '{n}' AS source, engine, rule_id, n FROM (WITH {findings_cte(n)} SELECT engine, rule_id, count(*) AS n FROM found GROUP BY ALL)"
        for n in PROSE
    ),
)
def prose_findings(spark, sf):
    """All line engines over the three text tables, in one plan."""
    files = None
    for n in PROSE:
        part = corpus(spark, sf, n).withColumn("source", F.lit(n))
        files = part if files is None else files.unionByName(part)
    found = match(files, DEFAULT, keep=("source",))
    return found.groupBy("source", "engine", "rule_id").agg(F.count("*").alias("n"))


@query(
    "secret_redaction",
    """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey,
       concat('password = "', left(pw, least(4, length(pw) // 4)), repeat('*', length(pw) - least(4, length(pw) // 4)), '"; token = "ghp_', repeat('*', 36), '"') AS vulnerable_code
       FROM (SELECT o_orderkey, concat('order-', CAST(o_orderkey AS STRING), '-', CAST(o_custkey AS STRING)) AS pw FROM orders)""",
)
def secret_redaction(spark, sf):
    """Both credentials of a line are masked, though one rule reports it."""
    from workload.base import table

    files = table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS path",
        "'unknown' AS language",
        "concat('  password = \"order-', o_orderkey, '-', o_custkey, '\"; token = \"ghp_', lpad(o_orderkey, 36, 'aB3'), '\"') AS code",
    )
    found = match(files, DEFAULT.of("secrets"))
    return found.select(F.col("file_path").cast("bigint").alias("o_orderkey"), "vulnerable_code")


@query(
    "route_handlers",
    f"WITH lines AS ({lines_sql()}) SELECT path AS file_path, line_no AS line_start FROM lines WHERE {AI_CODE['G07'][1]}",
)
def route_handlers(spark, sf):
    """The whole-file rule alone."""
    from lynceus.rules.model import Catalog

    only = Catalog(tuple(r for r in DEFAULT.rules if r.rule_id == "G07"))
    return match(corpus(spark, sf), only).select("file_path", "line_start")


@query(
    "scan_findings",
    f"""WITH {findings_cte()} SELECT engine, path AS file_path, line_no AS line_start, rule_id, severity,
        {RANK_SQL} AS sev_rank FROM found""",
)
def scan_findings(spark, sf):
    """All line engines in one pass."""
    return line_scan(spark, sf).select("engine", "file_path", "line_start", "rule_id", "severity", "sev_rank")


@query(
    "scan_counts",
    f"WITH {findings_cte()} SELECT engine, rule_id, severity, count(*) AS n FROM found GROUP BY ALL",
)
def scan_counts(spark, sf):
    """Findings per rule: the flagship query."""
    return line_scan(spark, sf).groupBy("engine", "rule_id", "severity").agg(F.count("*").alias("n"))


@query(
    "scan_ranked",
    f"""WITH {findings_cte('conversations')} SELECT engine, path AS file_path, line_no AS line_start, rule_id FROM found
        WHERE {RANK_SQL} >= 1""",
)
def scan_ranked(spark, sf):
    """Default level, most severe first."""
    found = line_scan(spark, sf, "conversations", "low")
    return rank_order(found).select("engine", "file_path", "line_start", "rule_id")


@query(
    "scan_high",
    f"WITH {findings_cte()} SELECT engine, rule_id, severity, count(*) AS n FROM found WHERE {RANK_SQL} >= 3 GROUP BY ALL",
)
def scan_high(spark, sf):
    """A level threshold drops rules while the plan is built."""
    return line_scan(spark, sf, level="high").groupBy("engine", "rule_id", "severity").agg(F.count("*").alias("n"))


@query(
    "severity_filter",
    f"WITH {findings_cte('documents')} SELECT engine, severity, count(*) AS n FROM found WHERE {RANK_SQL} >= 2 GROUP BY ALL",
)
def severity_filter(spark, sf):
    found = at_least(line_scan(spark, sf, "documents"), "no such level", default="medium")
    return found.groupBy("engine", "severity").agg(F.count("*").alias("n"))


@query(
    "scan_without_tests",
    f"""WITH {findings_cte()} SELECT rule_id, count(*) AS n FROM found
        WHERE NOT regexp_matches(path, '\\.env\\.example|test_|_test\\.|fixture') GROUP BY rule_id""",
)
def scan_without_tests(spark, sf):
    found = scan(without_tests(corpus(spark, sf)), LINE_ENGINES, "info", detected_at=NOW)
    return found.groupBy("rule_id").agg(F.count("*").alias("n"))


USER_RULE = "(?i)item|price"


@query(
    "user_rules",
    f"""WITH lines AS ({lines_sql()}) SELECT 'U01' AS rule_id, path AS file_path, line_no AS line_start FROM lines
        WHERE regexp_matches(line, '{USER_RULE}') AND regexp_matches(path, '\\.(py|JSX|js)$')
        UNION ALL SELECT 'U02', path, line_no FROM lines WHERE regexp_matches(line, '^\\s*$|order')""",
)
def user_rules(spark, sf):
    """A user's own rules next to the built-in catalog; one is limited to two languages."""
    own = [
        Rule("U01", "sast", "Price handling", "item|price", "low", languages=("python", "javascript")),
        Rule("U02", "sast", "Blank line or order", r"^\s*$|order", "info", ignore_case=False),
    ]
    found = match(corpus(spark, sf), DEFAULT.of("sast").plus(own))
    return found.where("rule_id LIKE 'U%'").select("rule_id", "file_path", "line_start")


RULE_PATTERN = "concat('expr_', CAST(n_nationkey AS STRING), '[0-9]+[)]|order = ', CAST(n_nationkey AS STRING), '[0-9]*$')"


NATION_LINES = " UNION ALL ".join(
    f"SELECT {k} AS k, count(*) AS n FROM lines WHERE regexp_matches(line, 'expr_{k}[0-9]+[)]|order = {k}[0-9]*$')"
    for k in range(25)
)


@query(
    "rule_table",
    f"""WITH lines AS ({lines_sql()}) SELECT concat('N', CAST(n_nationkey AS STRING)) AS rule_id, n_name AS title,
        CASE n_regionkey WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS severity, n
        FROM nation JOIN ({NATION_LINES}) ON k = n_nationkey WHERE n > 0""",
)
def rule_table(spark, sf):
    """Rules kept as a table, whose patterns are two alternatives."""
    from workload.base import table

    rows = table(spark, sf, "nation").selectExpr(
        "concat('N', CAST(n_nationkey AS STRING)) AS rule_id", "'sast' AS engine", "n_nationkey AS ord", "n_name AS title",
        f"{RULE_PATTERN} AS pattern", "CASE n_regionkey WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS severity",
        "0 AS sev_rank", "'CWE-0' AS cwe_id", "'' AS description", "CAST(NULL AS STRING) AS scope",
    )
    found = match_table(corpus(spark, sf), rows)
    return found.groupBy("rule_id", "title", "severity").agg(F.count("*").alias("n"))


# A rule for each order: texts, alternatives, a class in front, and one engine that reports the first match. Rules of
# regions require no text.
ORDER_RULES = """
    SELECT concat('O', CAST(o_orderkey AS STRING)) AS rule_id, CASE o_orderkey % 5 WHEN 4 THEN 'ai_code' ELSE 'sast' END AS engine,
      CAST(o_orderkey AS INT) AS ord, 'An order' AS title,
      CASE o_orderkey % 5 WHEN 0 THEN concat('user_id = ', CAST(o_orderkey AS STRING), '$')
        WHEN 1 THEN concat('expr_', CAST(o_orderkey AS STRING), '[)]')
        WHEN 2 THEN concat('order = ', CAST(o_orderkey AS STRING), '$|; size = ', CAST(o_orderkey AS STRING), '$')
        WHEN 3 THEN concat('[gh]ost = .127[.]0[.]0[.]1:', CAST(o_orderkey AS STRING), '.$')
        ELSE concat('list[(]', CAST(o_orderkey AS STRING), '|; (?:n|build) = ', CAST(o_orderkey AS STRING), '$') END AS pattern,
      CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS severity, 0 AS sev_rank,
      'CWE-0' AS cwe_id, '' AS description, CASE o_orderkey % 2 WHEN 0 THEN 'python,go,java' END AS scope FROM orders
    UNION ALL
    SELECT concat('R', CAST(r_regionkey AS STRING)), 'ai_code', -1 - CAST(r_regionkey AS INT), r_name, concat('^[ ]{', CAST(r_regionkey + 1 AS STRING), '}[a-z]+'), 'info', 0, 'CWE-1', '', NULL
    FROM region
"""
NUMBERED = " UNION ALL ".join(
    f"SELECT path, line_no, line, {kind} AS kind, regexp_extract(line, '{pattern}', 1) AS n FROM lines"
    for kind, pattern in (
        (0, r"user_id = (\d+)$"), (1, r"expr_(\d+)[)]"), (2, r"order = (\d+)$"), (2, r"; size = (\d+)$"),
        (3, r"[gh]ost = .127[.]0[.]0[.]1:(\d+).$"), (4, r"; (?:n|build) = (\d+)$"),
    )
)


@query(
    "rule_index",
    f"""WITH lines AS ({lines_sql()}), numbered AS ({NUMBERED}),
        -- an open end matches every order whose number begins the one found
        listed AS (SELECT path, line_no, line, unnest([left(n, i) FOR i IN range(1, length(n) + 1)]) AS n, 4 AS kind
                   FROM (SELECT *, regexp_extract(line, 'list[(]([0-9]+)', 1) AS n FROM lines)),
        found AS (
          SELECT DISTINCT path, line_no, concat('O', n) AS rule_id, kind, CAST(n AS BIGINT) AS ord FROM (SELECT path, line_no, line, n, kind FROM numbered UNION ALL SELECT path, line_no, line, n, kind FROM listed)
          JOIN orders ON CAST(o_orderkey AS STRING) = n AND o_orderkey % 5 = kind
          WHERE o_orderkey % 2 = 1 OR regexp_matches(path, '[.](py|go|java)$')
          UNION ALL SELECT path, line_no, concat('R', CAST(r_regionkey AS STRING)), 4, -1 - r_regionkey
          FROM lines, region WHERE regexp_matches(line, concat('^[ ]{{', CAST(r_regionkey + 1 AS STRING), '}}[a-z]+'))
        )
        SELECT path AS file_path, line_no AS line_start, rule_id FROM found WHERE kind < 4
        UNION ALL SELECT path, line_no, first(rule_id ORDER BY ord, rule_id) FROM found WHERE kind = 4 GROUP BY path, line_no""",
)
def rule_index(spark, sf):
    """A rule for every order, matched to lines by an index; no rule comes to the driver."""
    for name in ("orders", "region"):
        spark.read.parquet(f"{sf}/{name}.parquet").createOrReplaceTempView(f"rule_{name}")
    rows = spark.sql(ORDER_RULES.replace("FROM orders", "FROM rule_orders").replace("FROM region", "FROM rule_region"))
    return match_table(corpus(spark, sf), rows).select("file_path", "line_start", "rule_id")


@query(
    "engine_selection",
    f"WITH {findings_cte()} SELECT engine, count(*) AS n FROM found WHERE engine <> 'sast' GROUP BY engine",
)
def engine_selection(spark, sf):
    """Default engines minus a disabled list; unknown names are dropped."""
    engines = parse_engines([*without_engines(" SAST, sca"), "fuzzing"])
    found = scan(corpus(spark, sf), engines, "info", detected_at=NOW)
    return found.groupBy("engine").agg(F.count("*").alias("n"))


LITERALS = """SELECT path, line_no, unnest(regexp_extract_all(line, '[=:]\\s*[''"]([^''"\\s]{20,})[''"]', 1)) AS literal FROM lines"""


def entropy_sql(name: str) -> str:
    return f"""WITH lines AS ({lines_sql(name)}), literals AS ({LITERALS}),
    chars AS (SELECT literal, unnest(string_split(literal, '')) AS c, length(literal) AS n
              FROM (SELECT DISTINCT literal FROM literals)),
    shares AS (SELECT literal, c, count(*) / max(n) AS p FROM chars GROUP BY literal, c),
    bits AS (SELECT literal, round(-sum(p * log2(p)), 6) AS bits FROM shares GROUP BY literal)
    SELECT path AS file_path, line_no AS line_start, literal, bits FROM literals JOIN bits USING (literal)"""


for _name in ("documents", "code"):

    @query(f"entropy_{_name}", entropy_sql(_name))
    def entropy(spark, sf, name=_name):
        found = random_literals(corpus(spark, sf, name), threshold=-1.0)
        return found.select("file_path", "line_start", "literal", F.round("bits", 6).alias("bits"))


@query(
    "entropy_findings",
    entropy_sql("code").replace("SELECT path AS file_path, line_no AS line_start, literal, bits", "SELECT DISTINCT path AS file_path, line_no AS line_start")
    + f" WHERE bits > 4.5 AND (path, line_no) NOT IN (SELECT path, line_no FROM ({first_match(SECRETS)}))",
)
def entropy_findings(spark, sf):
    """The entropy detector takes the lines that no secrets rule has claimed."""
    found = scan(corpus(spark, sf), ["secrets"], entropy=True, detected_at=NOW)
    return found.where("rule_id = 'K11'").select("file_path", "line_start")


ID_SQL = f"sha256(concat(path, '|', rule_id, '|', CAST(line_no AS STRING), '|', {SNIPPET}))"


@query(
    "finding_ids",
    f"WITH lines AS ({lines_sql()}) SELECT {ID_SQL} AS finding_id, rule_id FROM ({every_match(SAST)})",
)
def finding_ids(spark, sf):
    return scan(corpus(spark, sf), ["sast"], "info", detected_at=NOW).select("finding_id", "rule_id")


def changed_sql(which: str) -> str:
    """Findings of the later or earlier state of the code: order comments differ, lines move."""
    return f"""WITH lines AS ({lines_sql()}), old AS ({every_match(SAST)}),
      now_ AS (SELECT path, line_no + 1 AS line_no, line, rule_id FROM old WHERE line_no > 2
               UNION ALL SELECT path, line_no, line, rule_id FROM old WHERE line_no <= 2)
      SELECT path AS file_path, line_no AS line_start, rule_id FROM {which}"""


def two_scans(spark, sf):
    files = corpus(spark, sf)
    later = files.withColumn(
        "code",
        F.expr("concat(substring_index(code, chr(10), 2), chr(10), chr(10), substring(code, length(substring_index(code, chr(10), 2)) + 2))"),
    )
    rest = dict(engines=["sast"], min_severity="info", detected_at=NOW)
    return scan(files, **rest), scan(later, **rest)


@query("new_findings", changed_sql("(SELECT DISTINCT path, line_no, line, rule_id FROM now_) n WHERE (path, line_no, rule_id, line) NOT IN (SELECT path, line_no, rule_id, line FROM old)"))
def new(spark, sf):
    before, after = two_scans(spark, sf)
    return new_findings(after, before).select("file_path", "line_start", "rule_id")


@query("fixed_findings", changed_sql("(SELECT DISTINCT path, line_no, line, rule_id FROM old) n WHERE (path, line_no, rule_id, line) NOT IN (SELECT path, line_no, rule_id, line FROM now_)"))
def fixed(spark, sf):
    before, after = two_scans(spark, sf)
    return fixed_findings(after, before).select("file_path", "line_start", "rule_id")


INSERTED = "ready = eval(given_by_caller)"


@query(
    "compared_scans",
    f"""WITH old AS ({lines_sql()}),
      lines AS (SELECT path, line_no, line FROM old UNION ALL SELECT path, 0, '{INSERTED}' FROM ({corpus_sql()}) WHERE code <> '')
      SELECT path AS file_path, line_no + 1 AS line_start, rule_id, line_no = 0 AS is_new FROM ({every_match(SAST)})""",
)
def compared(spark, sf):
    """A line put in front moves all others; only the finding on it is new."""
    files = corpus(spark, sf).where("code <> ''")
    later = files.withColumn("code", F.concat(F.lit(INSERTED + "\n"), "code"))
    rest = dict(engines=["sast"], min_severity="info", detected_at=NOW)
    before, after = (scan(f, context=True, **rest) for f in (files, later))
    return compare_scans(after, before).select("file_path", "line_start", "rule_id", "is_new")
