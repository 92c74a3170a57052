"""The suffix tree against one made of dictionaries."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lynceus.llm import queries, suffix_tree

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    names = "row n key state word base gain times n_tokens of r"
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in names.split()])


def same(got, expected):
    by = lambda rows: sorted(rows, key=repr)
    got, expected = by(map(tuple, got)), by(expected)
    assert [r[:-2] for r in got] == [r[:-2] for r in expected]
    assert np.allclose([r[-2:] for r in got], [r[-2:] for r in expected], rtol=1e-9, atol=1e-7)


def test_table(spark):
    docs = list(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tree = brute.SuffixTree([brute.lm_tokens(t) for i, t in docs if not held[i]])
    assert {len(s) for s in tree.states} == {1, 2}
    got = queries.op12_suffix_tree(spark, SF).collect()
    same(got, [(i, held[i], *tree.score(brute.lm_tokens(t))) for i, t in docs])
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("depth, held, share", [(1, 10**6, 0), (2, 40, 0.01), (3, 0, 1), (3, 10**6, 0)])
def test_random_texts(spark, monkeypatch, depth, held, share):
    """All depths; values that tasks hold, hold in part and only join; texts across chunks; odd rows."""
    monkeypatch.setattr(suffix_tree, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(suffix_tree, "SCORED_TOKENS", 200)
    rng = random.Random(4)
    def text(n):
        words, out = "a b c d A É é \U0001f600 x%d" % rng.randrange(9), []
        for _ in range(n):
            out.append(rng.choice(words.split()) if len(out) < 2 or rng.random() < 0.5 else f"{out[-2]}".lower()[:1] + "q")
        return rng.choice(" \n\t").join(out)
    rows = [(i, text(rng.choice([0, 1, 2, 30, 90]))) for i in range(120)] + [(None, "a b"), (None, None), (3, "a b"), (3, "a b"), (4, " \n"), (5, "a b c " * 3000)]
    train = [t for i, t in rows if i is None or i % 3]
    tree = brute.SuffixTree(map(brute.lm_tokens, train), depth, 2, 4, 0.3)
    assert {len(s) for s in tree.states} == set(range(1, depth + 1))
    docs = frame(spark, rows)
    made = suffix_tree.train(docs.where("doc_id IS NULL OR doc_id % 3 != 0"), depth=depth, min_count=2, min_state=4, cost=0.3)
    got = suffix_tree.score(docs, made, held_share=share, held_values=held).collect()
    same(got, [(i, *tree.score(brute.lm_tokens(t))) for i, t in rows])
    for s in list(tree.states)[:20]:
        assert abs(sum(tree.predicts(s, w) for w in [*tree.words, "unseen"]) - 1) < 1e-9


def test_empty_tables(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    nothing = suffix_tree.train(docs.limit(0))
    assert sorted(map(tuple, suffix_tree.score(docs, nothing).collect())) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert suffix_tree.score(docs.limit(0), suffix_tree.train(docs)).collect() == []


def test_keys_are_found():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 5000, np.uint64))
    table = suffix_tree.KeyTable(keys)
    assert (table.find(keys[::-1]) == np.arange(len(keys))[::-1]).all()
    assert (table.find(rng.integers(0, 2**64, 5000, np.uint64)) == -1).all()
    edges = np.array([0, 2**64 - 1], np.uint64)
    assert list(suffix_tree.KeyTable(edges).find(edges)) == [0, 1]
