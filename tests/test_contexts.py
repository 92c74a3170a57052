"""Contexts of a scan, and comparison of scans in one shuffle."""

import io
from contextlib import redirect_stdout

from lynceus.operators.findings import compare_scans, with_context
from lynceus.plans.scan import as_files, scan

CODE = "x = eval(a)\n\n  y = eval(b)\r\nx = eval(a)\nplain\nx = eval(a)"


def files_of(spark, *codes):
    return as_files(spark.createDataFrame([(f"f{i}.py", c) for i, c in enumerate(codes)], "path string, code string"))


def test_a_scan_gives_the_context_that_a_join_gives(spark):
    files = files_of(spark, CODE, "eval(c)", "", None)
    place = lambda df: sorted(map(tuple, df.select("file_path", "line_start", "rule_id", "context").collect()))
    got = scan(files, ["sast"], "info", context=True)
    assert place(got) == place(with_context(scan(files, ["sast"], "info"), files)) != []
    assert got.where("context IS NULL").isEmpty()
    nameless = scan(files.selectExpr("CAST(NULL AS STRING) AS path", "code", "language", "ext"), ["sast"], "info", context=True)
    assert nameless.where("context IS NOT NULL").isEmpty() and not nameless.isEmpty()


def test_compared_scans_travel_once(spark):
    """Keys of both scans went through several joins and windows, each with a shuffle of its own."""
    scans = [scan(files_of(spark, c), ["sast"], "info", context=True) for c in ("eval(new)\n" + CODE + "\nx = eval(a)", CODE)]
    compared = compare_scans(*scans)
    assert sorted((r["line_start"], r["rule_id"]) for r in compared.where("is_new").collect()) == [(1, "S05"), (8, "S05")]
    out = io.StringIO()
    with redirect_stdout(out):
        compared.explain()
    assert out.getvalue().count("Exchange hashpartitioning") == 1


def test_repeated_findings_are_one(spark):
    now, before = (scan(files_of(spark, c), ["sast"], "info", context=True) for c in (CODE, "x = eval(a)\nx = eval(a)"))
    twice = compare_scans(now.unionAll(now), before)
    once = compare_scans(now, before.unionAll(before))
    rows = lambda df: sorted((r["line_start"], r["is_new"]) for r in df.collect())
    assert rows(twice) == sorted(rows(once) * 2) and sum(new for _, new in rows(once)) == 2


def test_new_findings_keep_no_table_of_ids(spark):
    """An anti join needs no distinct ids, for which each task once kept all of its ids in a hash table."""
    from lynceus.operators.findings import fixed_findings, new_findings

    now, before = (scan(files_of(spark, c), ["sast"], "info") for c in (CODE, "x = eval(a)"))
    twice = before.unionAll(before)
    lines = lambda df: sorted(r["line_start"] for r in df.collect())
    assert lines(new_findings(now, twice)) == [3, 4, 6] and lines(fixed_findings(now, twice)) == []
    out = io.StringIO()
    with redirect_stdout(out):
        new_findings(now, twice).explain()
    assert "HashAggregate" not in out.getvalue()


def test_only_lines_with_findings_are_hashed(spark):
    """Contexts were hashed for every line of a file, by lambdas that are not compiled."""
    out = io.StringIO()
    with redirect_stdout(out):
        scan(files_of(spark, CODE), ["sast"], "info", context=True).select("context").explain()
    assert "xxhash64" in out.getvalue() and "lambdafunction" not in out.getvalue()


def test_findings_alike_but_for_white_space(spark):
    """Snippets, files and rules are told apart wherever one ends; white space and an absent snippet are not lost or mixed up."""
    columns = "file_path string, rule_id string, line_start int, vulnerable_code string, context bigint"
    table = lambda *rows: spark.createDataFrame(rows, columns)
    before = table(("a", "bc", 1, "x\t= \r\n 1 ", 1), ("ab", "c", 2, "y", 1), ("f", "r", 3, None, 1), ("g", "r", 3, "=", 1), (None, "r", None, " z ", None))
    now = table(
        ("a", "bc", 9, "x = 1", 2), ("a", "bc", 9, "x = 1", 2), ("a", "bcy", 2, "", 1), ("ab", "c", 2, "y ", 1), ("f", "r", 3, "", 1),
        ("f", "r", 4, None, 1), ("g", "r", 3, "==", 1), ("", "r", None, "z", 5), ("a", "bc", 10, "x= 1", 2),
    )
    got = compare_scans(now, before)
    assert got.schema["line_start"].dataType == now.schema["line_start"].dataType and got.columns == [*now.columns, "is_new"]
    new = sorted((r.file_path, r.rule_id, r.line_start) for r in got.collect() if r.is_new)
    assert new == [("a", "bc", 10), ("a", "bcy", 2), ("f", "r", 3), ("g", "r", 3)] and got.count() == 9


def test_lines_are_trimmed_alike(spark):
    from pyspark.sql import functions as F

    from lynceus.functions.text import WHITE_SPACE, trimmed, trimmed_line

    ends = [*WHITE_SPACE, "", "a", "~", "!", "\x7f", "\x1f", "\u20ac", "\u017f", "\x00"]
    rows = [(a + m + b,) for a in ends for b in ends for m in ("", "x", "x y\t", " ")] + [(None,)]
    lines = spark.createDataFrame(rows, "line string")
    got = lines.select(trimmed(F.col("line")).alias("a"), trimmed_line(F.col("line")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and len(got) == len(rows)
