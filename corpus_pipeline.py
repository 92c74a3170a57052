"""A training corpus from raw documents: five stages over one table.

Each stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.llm import lines, minhash, packing, quality, secrets
from lynceus.scale import bound_batches, cut_lineage, fits_broadcast, spare

TOKENIZER = "word_bpe_49k.json"
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts are rejected; rows are judged one by one, also repeated
    ones; columns of any name stay; an empty table gives an empty one."""
    bound_batches(spark)
    out = spare(docs, "_quality")
    return quality.quality_rules(docs, out_col=out).where(F.col(out)["kept"]).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later documents repeat; n_chars follows the text.

    Null texts stay null. Rows of one id are one document, each cut by its own text. Columns of any name stay;
    an empty table gives an empty one.
    """
    runs, split = (spare(docs, c) for c in ("_runs", "_lines"))
    marked = lines.with_bitmaps(docs, lines.keep_bitmaps(docs), runs).withColumn(split, lines.text_lines(F.col("text")))
    kept = F.array_join(lines.kept_lines(F.col(split), F.col(runs)), "\n")
    return _with_text(marked, F.when(F.col(runs).isNull(), F.col("text")).otherwise(kept), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id.

    Rows are told apart by a number of their own; of rows alike in id and text one stays.
    Texts without words are in no group, and rows of null id neither: they all stay. Columns of any name stay;
    an empty table gives an empty one.
    """
    bound_batches(spark)
    row = spare(docs, "_row")
    # written once, so that a row keeps its number
    keyed = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    grouped = F.when(F.col("doc_id").isNotNull(), F.col(row))
    groups = minhash.document_groups(keyed.select(grouped.alias("doc_id"), "text")).where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = cut_lineage(groups.select(F.col("doc_id").alias("member"), "component_id"), "near-groups")
    ids = keyed.select(F.col(row).alias("numbered"), F.col("doc_id").alias("id"))
    first = groups.join(ids, F.col("member") == F.col("numbered")).groupBy("component_id").agg(F.min(F.struct("id", "member")).alias("first"))
    stays = first.select(F.col("first.member").alias("stays"))
    out = spare(docs, "_gone")
    gone = groups.join(stays, F.col("member") == F.col("stays"), "left_anti").select(F.col("member").alias(out))
    gone = cut_lineage(gone, "near-gone")
    # rows that go are numbers alone: where they measure small, no text is shuffled
    gone = F.broadcast(gone) if fits_broadcast(gone) else gone
    return keyed.join(gone, F.col(row) == F.col(out), "left_anti").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their live-looking secrets masked; n_chars follows the text.

    Null and empty texts stay as they are; repeated rows are masked alike; a null source is one unnamed owner. Columns of any
    name stay; an empty table gives an empty one.
    """
    found = secrets.scan_secrets(docs, repo_col=F.concat_ws("/", "source", "lang"), owner_col="source")
    masked = secrets.mask_live(docs, found)
    return _with_text(masked, F.col("text"), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences.

    Null and empty texts are the end id alone; repeated rows and null ids are packed one by one; an empty table gives no pieces.
    """
    import public_tokenizers

    bound_batches(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


def _with_text(rows: DataFrame, text, docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    new = {"text": text, "n_chars": size}
    return rows.select(*[new[c].alias(c) if new.get(c) is not None else F.col(c) for c in docs.columns])


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the pieces of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
