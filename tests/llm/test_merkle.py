"""Merkle proofs against a plain version, on the smallest table and on odd rows."""

import brute
import pytest
from pyspark.sql import functions as F

from lynceus.llm import merkle, queries

SF = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def proved(spark, tmp_path, rows):
    """The registered query over given rows, which also have columns that the operator uses itself."""
    names = "tree level pos k digest load id leaf steps n_tree height c0 tampered subroot"
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in names.split()])
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, queries.op11_merkle(spark, str(tmp_path)).collect()), key=repr)


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*FIELDS)
    got = sorted(map(tuple, queries.op11_merkle(spark, SF).collect()), key=repr)
    assert got == sorted(brute.merkle(map(tuple, docs.collect())), key=repr)
    assert 0 < sum(r[-1] for r in got) < len(got)


@pytest.mark.parametrize("plain_joins", [False, True])
def test_odd_rows(spark, tmp_path, monkeypatch, plain_joins):
    """Nulls in every column, repeated and equal rows, lone groups, sources that sort by bytes, long texts."""
    if plain_joins:
        monkeypatch.setattr(merkle, "SALT_FROM", 2)
        monkeypatch.setattr(merkle, "fits_broadcast", lambda df: False)
    rows = [(None, None, None, None, None), (1, None, "en", 3, ""), (1, None, "en", 3, "a\nb"), (1, "", "é", None, "é\n"), (2, "é", None, 0, None)]
    rows += [(3, "z", "en", 1, "x\n" * 50_000)] * 3 + [(4, "Z", "en", 1, "same\n")] + [(None, "é", "en", 5, "t\n")] * 2
    rows += [(i, "hot", "de", i, f"text\n{i}") for i in range(-5, 800)] + [(9, f"s{i}", "en", i, "\n") for i in range(30)]
    assert proved(spark, tmp_path, rows) == sorted(brute.merkle(rows), key=repr)


@pytest.mark.parametrize("n", [1, 3, 28, 244])
def test_one_group(spark, tmp_path, n):
    """One source, so that its root is the root; a lone row is its own root and has no steps."""
    rows = [(i, "s", "en", i, f"a\n{i}") for i in range(n)]
    assert proved(spark, tmp_path, rows) == sorted(brute.merkle(rows), key=repr)


def test_lone_groups_and_empty(spark, tmp_path):
    rows = [(i, f"s{i}", "en", i, f"a\n{i}") for i in range(20)]
    assert proved(spark, tmp_path / "a", rows) == sorted(brute.merkle(rows), key=repr)
    assert proved(spark, tmp_path / "b", []) == []


def test_proofs_are_the_siblings(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"t{i}") for i in range(12)], "i int, g string, t string")
    tree = merkle.build(docs, merkle.record_digest(F.col("i"), F.col("t")), "i", "g", {"t": F.col("t")})
    got = merkle.proofs(tree).withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps"))).collect()
    assert {r["folded"] for r in got} == {tree.root}
    leaf = {r["id"]: r["leaf"] for r in got}
    steps = {r["id"]: r["steps"] for r in got}
    assert steps[2][0]["before"] == leaf[0]
    assert steps[2][0]["after"] == leaf[4] and steps[11][0]["before"] == leaf[7] + leaf[9]
    assert {r["id"]: r["t"] for r in got} == {i: f"t{i}" for i in range(12)}
