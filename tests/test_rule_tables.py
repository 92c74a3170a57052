"""Rule tables against every rule on every line, and required texts of patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lynceus.operators import rule_tables
from lynceus.operators.rule_tables import match_table, prepared, table_hits
from lynceus.plans.scan import as_files, scan
from lynceus.rules.anchors import anchors

COLUMNS = "rule_id string, engine string, ord int, title string, pattern string, severity string, sev_rank int, cwe_id string, description string, scope string"

PATTERNS = [
    "abc", "ab[c]d", "a(?:b|c)de", "foo|ba[rz]", "x+yz{2}w", "(?i)HELLO w", "q?uvw", "[0-9]{3}", "^def$", "a.c.e", "hel*o", "(wor)?ld!",
    "\\bcat\\b", "\\d+kg", "no(?!t)thing", "fo{0,1}obar", "(?:abc|abd)ef", "ſtop", "K9k", "aaaa", "", "z|abcde", "long line end", "\\Qa.c\\E+",
]


def table(spark, rows):
    return spark.createDataFrame([(i, e, o, f"t{o}", p, s, 0, None, "d", scope) for i, e, o, p, s, scope in rows], COLUMNS)


def files_of(spark, *codes):
    return as_files(spark.createDataFrame([(f"f{i}.{'py' if i % 2 else 'js'}", c) for i, c in enumerate(codes)], "path string, code string"))


def brute(spark, files, rules):
    """Every rule on every line."""
    lines = rule_tables._line_rows(files.withColumn("_file", F.col("path")), ("_file",))
    plain = prepared(rules).select("rule_id", "regex", F.col("languages").alias("only"))
    both = lines.join(plain, F.rlike("line", "regex") & (F.col("only").isNull() | F.array_contains("only", F.col("language"))))
    return sorted(map(tuple, both.select("path", "line_no", "rule_id").collect()))


@pytest.mark.parametrize("max_bytes, long_line", [(64 << 20, 1000), (0, 12)])
def test_every_rule_on_every_line(spark, monkeypatch, max_bytes, long_line):
    """Broadcast and joined; lines looked up whole and by number; scoped rules; rules without a required text in blocks."""
    monkeypatch.setattr(rule_tables, "LONG_LINE", long_line)
    monkeypatch.setattr(rule_tables, "BLOCK", 2)
    rng = random.Random(5)
    words = "abc abcde ab[c] abcd acde foo bar baz xxyzzw HELLO hello World uvw quvw 123 def aXcYe heo helllo world! ld! cat concat 5kg nothing fobar foobar abcef abdef stop Stop \u017ftop K9K \u212a9k aaaaaa z a.ccc".split()
    codes = ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(12)) for _ in range(25)]
    codes += ["", None, "abc " * 5000 + "long line end", "def\n\n def"]
    files = files_of(spark, *codes)
    rows = [(f"U{k}", "sast", k, p, "low", ["py,python", None, "javascript"][k % 3] if k % 2 else None) for k, p in enumerate(PATTERNS)]
    rules = table(spark, rows)
    got = table_hits(files, prepared(rules), max_bytes=max_bytes).select("path", "line_no", "rule_id")
    assert sorted(map(tuple, got.collect())) == brute(spark, files, rules) != []


def test_first_match_and_levels(spark):
    rules = table(spark, [
        ("B", "ai_code", 2, "token", "high", None), ("A", "ai_code", 1, "token = 1", "info", None), ("C", "secrets", 1, "token", "low", None),
        ("D", "sast", 9, "token", "medium", None), ("E", "sast", 1, None, "high", None), (None, "sast", 1, "token", "high", None), ("F", "sast", 3, "other", "no such", None),
    ])
    files = files_of(spark, "token = 1\ntoken = 2", "other")
    place = lambda df: sorted(map(tuple, df.select("file_path", "line_start", "rule_id").collect()))
    assert place(match_table(files, rules)) == [("f0.js", 1, "A"), ("f0.js", 1, "C"), ("f0.js", 1, "D"), ("f0.js", 2, "B"), ("f0.js", 2, "C"), ("f0.js", 2, "D"), ("f1.py", 1, "F")]
    # the info rule still claims its line
    assert place(match_table(files, rules, "medium")) == [("f0.js", 1, "D"), ("f0.js", 2, "B"), ("f0.js", 2, "D")]
    assert place(match_table(files, rules.limit(0))) == []
    assert place(match_table(files.limit(0), rules)) == []
    found = scan(files, ["sast", "ai_code"], "info", rules=rules).where("rule_id IN ('A', 'B', 'C', 'D')")
    assert sorted(r.rule_id for r in found.collect()) == ["A", "B", "D", "D"]


def test_files_of_one_path_and_masking(spark):
    rules = table(spark, [("A", "ai_code", 1, "eval", "low", None)])
    files = as_files(spark.createDataFrame([("a.py", 'password = "hunter2secret"; eval(x)')] * 2, "path string, code string"))
    got = match_table(files, rules).collect()
    assert [r.vulnerable_code for r in got] == ['password = "hun**********"; eval(x)'] * 2


@pytest.mark.parametrize("pattern", PATTERNS)
def test_a_matching_line_holds_a_required_text(pattern):
    found = anchors(pattern, 3)
    assert all(len(a) >= 3 and a == a.lower() for a in found)
    rng = random.Random(pattern)
    made = re.compile(pattern.replace("\\Qa.c\\E", "a[.]c"))
    for _ in range(3000):
        text = "".join(rng.choices(pattern.replace("\\", "") + "abcdefz 9", k=rng.randint(0, 12)))
        if found and made.search(text):
            assert any(a in text.lower().replace("\u017f", "s").replace("\u212a", "k") for a in found)


def test_required_texts():
    assert anchors("[gh]ost = .127[.]0:5.$", 3) == ["127.0:5"]
    assert anchors("list[(]123|; (?:n|build) = 12$", 3) == ["list(123", " = 12"]
    assert anchors("(abc(def(ghij)+))k", 3) == ["ghij"]
    assert anchors("abc|", 3) == anchors("(?x) a b c", 3) == anchors("\\x41bcd", 3) == anchors("(abc", 3) == anchors(None, 3) == []
