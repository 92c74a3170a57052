"""Rules for mistakes typical of generated code. The first match of a line wins."""

from __future__ import annotations

from lynceus.rules.model import AI_CODE, ASSIGN, CALL, QUOTE, Catalog, Rule, then


def _rule(rule_id, title, severity, cwe, pattern, needles, description, **more) -> Rule:
    return Rule(
        rule_id, AI_CODE, title, pattern, severity, f"CWE-{cwe}", description, needles, **more
    )


# Titles, levels, weakness ids and accepted forms. Order decides
# which rule a line is reported under.
RULES = Catalog(
    (
        _rule(
            "G01", "Hardcoded Numeric User/Object ID", "medium", 798,
            r"""(?:user|account|object)_?id\s*[=:]\s*[0-9]+\b""",
            (ASSIGN, ("user_id", "userid", "account_id", "accountid", "object_id", "objectid")),
            "A fixed id stands where the caller's own id belongs, which skips access checks.",
        ),
        _rule(
            "G02", "Hardcoded Admin Credentials", "high", 798,
            r"""(?:username|user)\s*[=:]\s*['"]admin['"]""",
            (ASSIGN, QUOTE, ("admin",), ("user",)),
            "Default administrator names are the first thing an attacker tries.",
        ),
        _rule(
            "G03", "Debug Mode Enabled", "medium", 489,
            r"""\b(?:debug\s*=\s*true|debug:\s*true|node_env\s*=\s*['"]development['"])""",
            (ASSIGN, ("debug", "node_env")),
            "Debug output shows stack traces and settings to every visitor.",
        ),
        _rule(
            "G04", "TLS/SSL Verification Disabled", "high", 295,
            r"""verify\s*=\s*false|rejectunauthorized\s*:\s*false|insecureskipverify\s*:\s*true""",
            (ASSIGN, ("verify", "rejectunauthorized")),
            "Without certificate checks anyone on the path can read and change the traffic.",
        ),
        _rule(
            "G05", "Overly Permissive CORS Policy", "medium", 942,
            r"""access-control-allow-origin:\s*\*|cors\(\)|allow_origins=\["\*"\]|"""
            + then("allowedorigins", r"""["]\*["]"""),
            (("access-control-allow-origin", "cors()", "allow_origins", "allowedorigins"),),
            "Every site may call this service from a visitor's browser. List the trusted origins.",
        ),
        _rule(
            "G06", "Missing Pagination Limit (Potential DoS / Data Exposure)", "low", 400,
            r"""\.(?:findall|find_all|list|fetchall|fetch_all|getall|get_all)\s*\([^)]*\)""",
            (CALL, (".find", ".list", ".fetch", ".get")),
            "The call loads every record. Add a limit and a cursor.",
        ),
        _rule(
            "G07", "Unauthenticated Route Handler", "medium", 306,
            r"""@(?:app|router)\.(?:delete|put|patch)\s*\([^)]+\)\s*\nasync\s+def\s+[a-z_]+\((?!.*\b(?:auth|depends|token|user)\b)""",
            (("@",), ("@app.", "@router."), ("async",)),
            "A route that changes data takes no caller identity. Require one.",
            multiline=True,
        ),
        _rule(
            "G08", "Dynamic Code Execution (exec/compile)", "high", 95,
            then(r"\b(?:exec|compile)\s*\(", r"\binput\b|request\."),
            (CALL, ("exec", "compile"), ("input", "request.")),
            "User input is compiled and run. Parse it as data instead.",
        ),
        _rule(
            "G09", "Logging Sensitive Data", "medium", 532,
            then(
                r"(?:console\.(?:log|info|debug)|print|logger\.(?:info|debug|warn))\s*\(",
                r"\b(?:password|token|secret|api_key|apikey|auth)\b",
            ),
            (
                CALL,
                ("console.", "print", "logger."),
                ("password", "token", "secret", "api_key", "apikey", "auth"),
            ),
            "Credentials end up in the log, where many more people can read them.",
        ),
        _rule(
            "G10", "Plain HTTP Endpoint (No TLS)", "medium", 319,
            r"""url\s*=\s*['"]http://(?!localhost|127\.0\.0\.1)|fetch\s*\(\s*['"]http://(?!localhost)""",
            (QUOTE, ("http://",)),
            "The request travels in clear text. Use https for every remote host.",
        ),
        _rule(
            "G11", "Security TODO / FIXME Left by AI", "info", 546,
            then(
                r"(?://|#)\s*(?:todo|fixme|hack|notsecure|unsafe)",
                "auth|secur|password|token|permission|access|vulnerab|sanitiz|valid",
            ),
            (("//", "#"), ("todo", "fixme", "hack", "notsecure", "unsafe")),
            "A comment says that a security control is still missing.",
        ),
        _rule(
            "G12", "Hardcoded Development Port", "info", 1188,
            r"""port\s*[=:]\s*(?:3000|8080|8000|5000|4200|3001)\b|['"]:(?:3000|8080|8000|5000|4200|3001)['"]""",
            (ASSIGN, ("3000", "8080", "8000", "5000", "4200", "3001")),
            "The port of a development server is fixed in code. Read it from the environment.",
        ),
    )
)
