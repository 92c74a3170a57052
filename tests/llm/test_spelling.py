"""Spelling variants against all edits of every word."""

import itertools
import random

import brute
import pytest
from pyspark.sql import functions as F

from lynceus.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, words):
    names = "size back task at rest a b near form root"
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    return df.select("*", *[F.lit("x").alias(c) for c in names.split()])


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = brute.spelling_words(map(tuple, docs.collect()))
    got = rows_of(queries.op13_spelling(spark, SF))
    assert got == sorted(brute.spelling(words), key=repr)
    assert sum(r[1] is not None for r in got) > 5


def test_words_of_odd_texts(spark):
    """Nulls, empty texts, letters beyond A-Z, repeated rows, a very long run, and clashing names."""
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "Straßen straßen STRASSEN"), (4, "École école ÉCOLE×÷ \U0001f600école字écoles" * 3)]
    rows += [(i, "Wonder wonders wondered x-wonder_wonderful2wonderful " * 40) for i in range(60)] * 2 + [(9, "a" * 30_000)] * 5
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("x").alias("word"), F.lit("x").alias("n"), F.lit(1).alias("id"))
    words = brute.spelling_words(rows)
    assert dict(rows_of(spelling.vocabulary(df))) == words and max(map(len, words)) > 20_000
    assert rows_of(spelling.variant_groups(spelling.vocabulary(df))) == sorted(brute.spelling({w: n for w, n in words.items() if len(w) < 99}) + [(w, None, w, n, 0, None) for w, n in words.items() if len(w) >= 99], key=repr)
    assert rows_of(spelling.variant_groups(spelling.vocabulary(df.limit(0)))) == []


@pytest.mark.parametrize("group", [4096, 3])
def test_random_words(spark, monkeypatch, group):
    """Few letters, so that states are crowded; a small bound sends them another way."""
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (spelling.MIN_CHARS, group))
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))): rng.choice([1, 2, 3, 10, 50, 250]) for _ in range(900)}
    words |= {"".join(w): 7 for w in itertools.product("ab", repeat=6)} | {"a" * i: 10**i for i in range(6, 15)}
    assert rows_of(spelling.variant_groups(frame(spark, words))) == sorted(brute.spelling(words), key=repr)


def test_chain_of_forms_and_ties(spark):
    """A form's form is followed to the last; of near words alike in n the smallest counts."""
    words = {"aaaaaa" + "b" * i: 5**i for i in range(12)} | {"cccccc": 1, "cccccd": 9, "cccccb": 9}
    got = {r[0]: r for r in rows_of(spelling.variant_groups(frame(spark, words)))}
    assert got["aaaaaa"][2] == "aaaaaa" + "b" * 11 and got["aaaaaa"][1] == "aaaaaab"
    assert got["cccccc"] == ("cccccc", "cccccb", "cccccb", 1, 2, 9)


def test_acceptor_is_minimal():
    """No two states accept the same strings, and the words are those given."""
    words = sorted({"".join(w) for n in (4, 5) for w in itertools.product("ab", repeat=n) if n == 4 or w.count("a") % 3})
    made = spelling.Acceptor(words)

    def language(q):
        return ({""} if made.final[q] else set()) | {s + x for s, to in made.arcs[q].items() for x in language(to)}

    languages = [frozenset(language(q)) for q in range(len(made.arcs))]
    assert languages[made.start] == set(words) and len(set(languages)) == len(languages)
