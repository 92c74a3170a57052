"""The queries of this subpackage: each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lynceus.llm import bpe, crf, embeddings, lines, merkle, minhash, packing, quality, secrets, spelling, substrings, suffix_tree, warc
from lynceus.llm.oracles import SQL  # noqa: F401
from lynceus.scale import bound_batches, work_dir

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _crc(column: str):
    """The unsigned crc32 of a value as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.quality_rules(docs)
    return judged.select("doc_id", *[f"quality.{c}" for c in (*quality.MEASURES, "base_failed", "kept")])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, _tokenizer("byte_bpe_50k.json")).select("doc_id", "bpe.*")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner; its texts of one language are a repository."""
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, repo_col=F.concat_ws("/", "source", "lang"), owner_col="source")
    return found.select(
        F.col("scan_id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example"
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).drop("url")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_links(_table(spark, sf_dir, "embeddings"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.document_groups(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1
    labels = _table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    scored = crf.classify(docs, crf.train(docs, labels))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substrings.remove_spans(docs, substrings.duplicate_spans(docs))
    return cut.select("doc_id", "dedup.n_words", "dedup.n_removed", "dedup.kept_sha256")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    with_runs = lines.with_bitmaps(docs, lines.keep_bitmaps(docs), "keep_runs")
    split = with_runs.select("doc_id", lines.text_lines(F.col("text")).alias("lines"), "keep_runs")
    kept = split.select(
        "doc_id", F.size("lines").cast("bigint").alias("n_lines"), lines.kept_lines(F.col("lines"), F.col("keep_runs")).alias("kept")
    )
    return kept.select(
        "doc_id",
        "n_lines",
        (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of the untampered rows, then checked against rows of which some lost their line feeds."""
    docs = _table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars")
    row = lambda text: merkle.record_digest(*[F.col(c) for c in fields], text)
    tampered = F.when(_crc("doc_id") % 2 == 0, row(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    manifest = merkle.build(docs, row(F.col("text")), "doc_id", "source", {"tampered": tampered})
    proved = merkle.proofs(manifest).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
        merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"),
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows that are not held out; rows of null id are learned from."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda c: F.coalesce(_crc(c) % 7 == 2, F.lit(False))
    scored = suffix_tree.score(docs, suffix_tree.train(docs.where(~held_out("doc_id"))))
    return scored.withColumnRenamed("id", "doc_id").select(
        "doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.vocabulary(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_bpe, op3_secrets, op4_warc, op5_embedding_dedup, op6_minhash, op7_packing,
        op8_quality_crf, op9_substring_dedup, op10_line_dedup, op11_merkle,
        op12_suffix_tree, op13_spelling,
    )
} | {"pipeline": corpus_pipeline.run}
