"""The rule catalogs once more, as RE2 patterns for the checking SQL.

Written apart from the library's Java patterns. ``<b>`` and ``<e>`` stand for a
Unicode word start and end, which RE2 lacks.
"""

from __future__ import annotations

from workload.base import lines_sql, quoted, trim_sql

START = r"(?:^|[^\p{L}\p{N}_])"
END = r"(?:$|[^\p{L}\p{N}_])"


def _m(pattern: str, column: str = "line", flags: str = "(?i)") -> str:
    text = flags + pattern.replace("<b>", START).replace("<e>", END)
    return f"regexp_matches({column}, {quoted(text)})"


# The accepted forms of the rules below follow from the blueprint.
SAST = {
    "S01": ("medium", _m(r"""<b>md5\(|hashlib\.md5\(|crypto\.createhash\(['"]md5['"]\)""")),
    "S02": ("low", _m(r"""<b>sha1\(|hashlib\.sha1\(|crypto\.createhash\(['"]sha1['"]\)""")),
    "S03": ("high", _m(r"""(select|insert|update|delete|from).*('|"|\+|=|\.format\(|\$\{)""")),
    "S04": ("high", _m(r"""<b>os\.(system|popen)\(|subprocess\.(run|call|popen)\((|.*[^\p{L}\p{N}_])shell\s*=\s*true<e>|child_process\.exec\(""")),
    "S05": ("high", _m(r"""<b>eval\(|new function\(|settimeout\(.*['"].*['"]\)""")),
    "S06": ("medium", _m(r"""\.innerhtml\s*=|dangerouslysetinnerhtml|\{@html<e>""")),
    "S07": ("high", _m(r"""fs\.(readfile|writefile|open)\(.*\+|req\.(query|body)\..*\.\./""")),
    "S08": ("medium", _m(r"""object\.assign\(.*\.\.\.|json\.parse\(.*req\.(body|query)""")),
    "S09": ("low", _m(r"""math\.random\(|rand\.(int|float|random)""")),
    "S10": ("medium", _m(r"""<b>(des|rc4|blowfish)<e>""")),
    "S11": ("info", _m(r"""127\.0\.0\.1|localhost""", flags="")),
}

AI_CODE = {
    "G01": ("medium", _m(r"""(user_id|userid|account_id|accountid|object_id|objectid)\s*[=:]\s*[0-9]+<e>""")),
    "G02": ("high", _m(r"""(username|user)\s*[=:]\s*['"]admin['"]""")),
    "G03": ("medium", _m(r"""<b>(debug\s*=\s*true|debug:\s*true|node_env\s*=\s*['"]development['"])""")),
    "G04": ("high", _m(r"""verify\s*=\s*false|rejectunauthorized\s*:\s*false|insecureskipverify\s*:\s*true""")),
    "G05": ("medium", _m(r"""access-control-allow-origin:\s*\*|cors\(\)|allow_origins=\["\*"\]|allowedorigins.*"\*\"""")),
    "G06": ("low", _m(r"""\.(findall|find_all|list|fetchall|fetch_all|getall|get_all)\s*\([^)]*\)""")),
    "G07": (
        "medium",
        _m(r"""@(app|router)\.(delete|put|patch)\s*\([^)]+\)\s*$""")
        + " AND " + _m(r"""^async\s+def\s+[a-z_]+\(""", "nxt")
        + " AND NOT " + _m(r"""^async\s+def\s+[a-z_]+\((|.*[^\p{L}\p{N}_])(auth|depends|token|user)<e>""", "nxt"),
    ),
    "G08": ("high", _m(r"""<b>(exec|compile)\s*\((|.*[^\p{L}\p{N}_])input<e>|<b>(exec|compile)\s*\(.*request\.""")),
    "G09": ("medium", _m(r"""(console\.(log|info|debug)|print|logger\.(info|debug|warn))\s*\((|.*[^\p{L}\p{N}_])(password|token|secret|api_key|apikey|auth)<e>""")),
    "G10": (
        "medium",
        "((" + _m(r"""url\s*=\s*['"]http://""") + " AND NOT " + _m(r"""url\s*=\s*['"]http://(localhost|127\.0\.0\.1)""")
        + ") OR (" + _m(r"""fetch\s*\(\s*['"]http://""") + " AND NOT " + _m(r"""fetch\s*\(\s*['"]http://localhost""") + "))",
    ),
    "G11": ("info", _m(r"""(//|#)\s*(todo|fixme|hack|notsecure|unsafe).*(auth|secur|password|token|permission|access|vulnerab|sanitiz|valid)""")),
    "G12": ("info", _m(r"""port\s*[=:]\s*(3000|8080|8000|5000|4200|3001)<e>|['"]:(3000|8080|8000|5000|4200|3001)['"]""")),
}

SECRETS = {
    "K01": ("critical", _m(r"""AKIA[0-9A-Z]{16}""", flags="")),
    "K02": ("critical", _m(r"""aws[\p{L}\p{N}_]*secret[\p{L}\p{N}_]*['"]?\s*[=:]\s*['"][a-z0-9/+=]{40}['"]""")),
    "K03": ("critical", _m(r"""-----BEGIN (RSA|EC|OPENSSH) PRIVATE KEY-----""", flags="")),
    "K04": ("high", _m(r"""ghp_[a-zA-Z0-9]{36}""", flags="")),
    "K05": ("high", _m(r"""(postgres|mysql|mongodb)://[^:]+:[^@]+@""")),
    "K06": ("high", _m(r"""sk-ant-[a-zA-Z0-9-]{95}""", flags="")),
    "K07": ("high", _m(r"""eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+""", flags="")),
    "K08": ("medium", _m(r"""api[_-]?key\s*=\s*['"][a-z0-9]{20,}['"]""")),
    "K09": ("medium", _m(r"""(password|passwd|pwd)['"]?\s*[=:]\s*['"][^'"]{4,}['"]""")),
    "K10": ("medium", _m(r"""[\p{L}\p{N}_]*_key\s*=\s*['"][a-z0-9_]{20,}['"]""")),
}


# The value that each credential pattern captures.
VALUES = (
    r"(AKIA[0-9A-Z]{16})",
    r"""(?i)aws[\p{L}\p{N}_]*secret[\p{L}\p{N}_]*['"]?\s*[=:]\s*['"]([a-z0-9/+=]{40})['"]""",
    r"-----BEGIN (?:RSA|EC|OPENSSH) PRIVATE KEY-----([a-zA-Z0-9+/=\\]*)",
    r"(ghp_[a-zA-Z0-9]{36})",
    r"(?i)(?:postgres|mysql|mongodb)://[^:]+:([^@]+)@",
    r"(sk-ant-[a-zA-Z0-9-]{95})",
    r"(eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+)",
    r"""(?i)api[_-]?key\s*=\s*['"]([a-z0-9]{20,})['"]""",
    r"""(?i)(?:password|passwd|pwd)['"]?\s*[=:]\s*['"]([^'"]{4,})['"]""",
    r"""(?i)_key\s*=\s*['"]([a-z0-9_]{20,})['"]""",
)


def masked_sql(text: str) -> str:
    """A text whose captured values, the longest first, keep four characters at most, a quarter of them."""
    found = "flatten([" + ", ".join(f"regexp_extract_all({text}, {quoted(v)}, 1)" for v in VALUES) + "])"
    values = f"list_filter(list_distinct({found}), lambda v: v <> '')"
    longest = f"list_transform(list_sort(list_transform({values}, lambda v: {{'n': -length(v), 'v': v}})), lambda x: x.v)"
    seen = "least(4, length(v) // 4)"
    return f"list_reduce(list_prepend({text}, {longest}), lambda t, v: replace(t, v, left(v, {seen}) || repeat('*', length(v) - {seen})))"



def level_sql(rules: dict, column: str = "rule_id") -> str:
    whens = " ".join(f"WHEN '{r}' THEN '{level}'" for r, (level, _) in rules.items())
    return f"CASE {column} {whens} END"


def every_match(rules: dict, lines: str = "lines") -> str:
    """One row per line and rule that matches it."""
    return " UNION ALL ".join(
        f"SELECT path, line_no, line, '{r}' AS rule_id, '{level}' AS severity FROM {lines} WHERE {test}"
        for r, (level, test) in rules.items()
    )


def first_match(rules: dict, lines: str = "lines") -> str:
    """One row per line that any rule matches, under the first of them."""
    cases = " ".join(f"WHEN {test} THEN '{r}'" for r, (_, test) in rules.items())
    return (
        f"SELECT path, line_no, line, rule_id, {level_sql(rules)} AS severity"
        f" FROM (SELECT *, CASE {cases} END AS rule_id FROM {lines}) m WHERE rule_id IS NOT NULL"
    )


def findings_cte(name: str = "code") -> str:
    """All findings of the three line engines over a corpus, as a WITH clause."""
    return f"""lines AS MATERIALIZED ({lines_sql(name)}),
    found AS MATERIALIZED (
      SELECT *, 'sast' AS engine FROM ({every_match(SAST)})
      UNION ALL SELECT *, 'secrets' AS engine FROM ({first_match(SECRETS)})
      UNION ALL SELECT *, 'ai_code' AS engine FROM ({first_match(AI_CODE)})
    )"""


RANK_SQL = "CAST(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END AS BIGINT)"
SNIPPET = masked_sql(trim_sql("line"))
