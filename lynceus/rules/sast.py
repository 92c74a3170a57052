"""Insecure-code rules. Every matching rule of a line is reported."""

from __future__ import annotations

from lynceus.rules.model import CALL, SAST, Catalog, Rule, then


def _rule(rule_id, title, severity, cwe, pattern, needles, description, **more) -> Rule:
    return Rule(
        rule_id, SAST, title, pattern, severity, f"CWE-{cwe}", description, needles, **more
    )


# Titles, levels, weakness ids and accepted forms, in report order.
RULES = Catalog(
    (
        _rule(
            "S01", "Insecure Hashing Algorithm (MD5)", "medium", 327,
            r"""\bmd5\b\(|hashlib\.md5\(|crypto\.createHash\(['"]md5['"]\)""",
            (CALL, ("md5",)),
            "MD5 collisions are cheap to produce. Hash with SHA-256, and passwords with Argon2.",
        ),
        _rule(
            "S02", "Insecure Hashing Algorithm (SHA1)", "low", 327,
            r"""\bsha1\b\(|hashlib\.sha1\(|crypto\.createHash\(['"]sha1['"]\)""",
            (CALL, ("sha1",)),
            "SHA-1 collisions have been demonstrated in practice. Move to SHA-256 or stronger.",
        ),
        _rule(
            "S03", "Potential SQL Injection (String Concatenation)", "high", 89,
            then("select|insert|update|delete|from", r"""['"+=]|\.format\(|\$\{"""),
            (
                ("select", "insert", "update", "delete", "from"),
                ("'", '"', "+", "=", ".format(", "${"),
            ),
            "SQL text is built from pieces. Bind values as parameters or use a query builder.",
        ),
        _rule(
            "S04", "Potential OS Command Injection", "high", 78,
            r"""\bos\.(?:system|popen)\(|child_process\.exec\(|"""
            + then(r"subprocess\.(?:run|call|popen)\(", r"\bshell\s*=\s*true\b"),
            (CALL, ("os.system(", "os.popen(", "subprocess.", "child_process.exec(")),
            "A shell interprets this command. Pass an argument list and avoid the shell.",
        ),
        _rule(
            "S05", "Dangerous Use of eval()", "high", 95,
            r"""\beval\(|new function\(|""" + then(r"settimeout\(", """['"]""", r"""['"]\)"""),
            (CALL, ("eval(", "new function(", "settimeout(")),
            "Text is run as code here. Anyone who controls the text controls the program.",
        ),
        _rule(
            "S06", "Insecure HTML Rendering (XSS Sink)", "medium", 79,
            r"""\.innerhtml\s*=|dangerouslysetinnerhtml|\{@html\b""",
            (("html",), ("innerhtml", "{@html")),
            "Markup is inserted unescaped. Render text nodes or sanitize the markup first.",
        ),
        _rule(
            "S07", "Potential Path Traversal", "high", 22,
            then(r"fs\.(?:readfile|writefile|open)\(", r"\+")
            + "|" + then(r"req\.(?:query|body)\.", r"\.\./"),
            (("fs.", "req."), ("fs.readfile(", "fs.writefile(", "fs.open(", "req.query.", "req.body.")),
            "A path is assembled from request data. Resolve it and check that it stays inside the root.",
        ),
        _rule(
            "S08", "Prototype Pollution Potential", "medium", 1321,
            then(r"object\.assign\(", r"\.\.\.") + "|" + then(r"json\.parse\(", r"req\.(?:body|query)"),
            (CALL, ("object.assign(", "json.parse(")),
            "Untrusted keys are merged into an object and may reach its prototype.",
        ),
        _rule(
            "S09", "Insecure Random Number Generation", "low", 338,
            r"""math\.random\(|rand\.(?:int|float|random)""",
            (("rand",), ("math.random(", "rand.")),
            "This generator is predictable. Take security-relevant values from the system's secure one.",
        ),
        _rule(
            "S10", "Weak Hashing Algorithm (Legacy)", "medium", 327,
            r"""\b(?:des|rc4|blowfish)\b""",
            (("des", "rc4", "blowfish"),),
            "DES, RC4 and Blowfish no longer resist attack. Use AES-GCM or ChaCha20-Poly1305.",
        ),
        _rule(
            "S11", "Hardcoded Localhost Reference", "info", 1188,
            r"""127\.0\.0\.1|localhost""",
            (("127.0.0.1", "localhost"),),
            "The address only works on one machine. Read it from configuration.",
            ignore_case=False,
        ),
    )
)
