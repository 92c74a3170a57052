"""Columns whose names the operators use themselves, nulls, repeated rows and empty tables, for the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lynceus.llm import lines, secrets, substrings
from lynceus.scale import spare

NAMES = "_row _quality _runs _lines _kept _key _bitmap_id _bitmap_row _live _scan_id _scan_row _found _span_id _span_row _id component_id member stays keep_runs dedup"
STAGES = dict(corpus_pipeline.STAGES)
LINE = "a line of text that many hold"
WORDS = " ".join(f"w{i % 37}x{i}" for i in range(80))


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit(""))).alias(c) for c in NAMES.split()])


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, f"{WORDS}\n{LINE}", "en", "a", 1), (2, f"{WORDS} more\n{LINE}", "en", "a", 2), (3, f"{WORDS}\n{LINE}", None, None, None),
        (3, f"{WORDS}\n{LINE}", None, None, None), (None, f"{LINE}\n{WORDS}", "en", "b", 4), (4, None, "en", "a", 0), (5, "", "en", "a", 0),
        (6, f'{WORDS[::-1]} password = "abcdefghijkl"', "en", "c", 9),
    ]
    return documents(spark, rows)


def carried(df):
    """How many rows there are of each further column's value."""
    return {c: sorted(r[0] for r in df.select(c).collect()) for c in NAMES.split()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, odd, name):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    expected = sorted(map(tuple, STAGES[name](spark, plain, "").collect()), key=repr)
    got = STAGES[name](spark, odd, "")
    assert got.columns == odd.columns
    assert sorted(map(tuple, got.select(*plain.columns).collect()), key=repr) == expected
    for values in carried(got).values():
        assert len(values) == len(expected) and all(":" in v for v in values)
    empty = STAGES[name](spark, odd.limit(0), "")
    assert empty.columns == odd.columns and empty.collect() == []


def test_stages_on_odd_rows(spark, odd):
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    assert ids(STAGES["quality rules"](spark, odd, "")) == [1, 2, 3, 3, 6, None]
    cut = {(r.doc_id, r.text) for r in STAGES["line dedup"](spark, odd, "").select("doc_id", "text").collect()}
    assert cut >= {(1, ""), (2, f"{WORDS} more"), (3, f"{WORDS}\n{LINE}"), (None, ""), (4, None), (5, "")}
    assert ids(STAGES["near duplicates"](spark, odd, "")) == [1, 4, 5, 6, None]
    masked = {r.doc_id: r.text for r in STAGES["secret scans"](spark, odd, "").collect()}
    assert secrets.MASK in masked[6] and masked[4] is None and masked[5] == ""
    pieces = STAGES["packing"](spark, odd, "").groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, 5, 6, None}
    assert STAGES["packing"](spark, odd.limit(0), "").collect() == []


def test_operators_keep_columns_of_any_name(spark, odd):
    cut = substrings.remove_spans(odd, substrings.duplicate_spans(odd), out_col="_span_id")
    assert sorted(cut.columns) == sorted(odd.columns) and cut.select("_found").first()[0].startswith("_found:")
    marked = lines.with_bitmaps(odd, lines.keep_bitmaps(odd), "_bitmap_row")
    assert marked.count() == odd.count() and marked.select("_bitmap_id").first()[0].startswith("_bitmap_id:")
    assert spare(odd, "_ROW") == "_ROW_" and spare(odd, "new") == "new"


def test_frequent_lines_meet_in_salts(spark, monkeypatch):
    """A line of all documents goes from all but the last, with any number of salts."""
    rows = [(i, f"{LINE}\nown {i}\n{LINE.upper()}", "en", "a", 1) for i in range(300)]
    docs = documents(spark, rows)
    for salts in (1, 64):
        monkeypatch.setattr(lines, "SALTS", salts)
        found = {r.bitmap_id: (r.n_lines, r.n_dropped, r.keep_runs) for r in lines.keep_bitmaps(docs).collect()}
        assert found == {i: (3, 2, [0, 1, 1, 1, 0]) for i in range(299)}
