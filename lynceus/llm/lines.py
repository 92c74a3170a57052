"""Line dedup over the whole corpus that returns keep bitmaps, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.scale import cut_lineage, spare

SPACES = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
SALTS = 64


def text_lines(text: Column) -> Column:
    """Lines between line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACES))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # lower() is fast, but folds other letters too, so it serves ASCII lines only
    return F.when(F.octet_length(line) == F.length(line), F.lower(bare)).otherwise(
        F.translate(bare, capitals, capitals.lower())
    )


def row_key(text: Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """Sorted dropped positions as a run-length bitmap: lines kept, dropped, kept, ... in turn."""
    beside = F.arrays_zip(
        dropped.alias("p"),
        F.concat(F.array(F.lit(-2)), dropped).alias("before"),
        F.slice(dropped, F.lit(2), F.size(dropped)).alias("after"),
    )
    first = F.filter(beside, lambda z: z["p"].isNotNull() & (z["before"] != z["p"] - 1))
    last = F.filter(beside, lambda z: z["p"].isNotNull() & ~F.equal_null(z["after"], z["p"] + 1))
    ends = F.arrays_zip(
        F.transform(first, lambda z: z["p"]).alias("a"), F.transform(last, lambda z: z["p"] + 1).alias("b")
    )
    edges = F.flatten(F.transform(ends, lambda z: F.array(z["a"], z["b"])))
    steps = F.arrays_zip(
        F.concat(edges, F.array(n_lines)).alias("to"), F.concat(F.array(F.lit(0)), edges).alias("from")
    )
    return F.transform(steps, lambda z: z["to"] - z["from"])


def kept_lines(lines: Column, runs: Column) -> Column:
    """The lines that the bitmap keeps; a null bitmap keeps all."""
    flags = F.flatten(F.transform(runs, lambda r, i: F.array_repeat(i % 2 == 0, r)))
    kept = F.filter(F.arrays_zip(lines.alias("line"), flags.alias("keep")), lambda z: z["keep"])
    return F.when(runs.isNull(), lines).otherwise(F.transform(kept, lambda z: z["line"]))


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """(id, row key, lines, dropped lines, keep bitmap) of each document that loses lines.

    A line's key loses all its lines except in the largest id that holds it, if it has
    ``min_chars`` code points and is found in ``min_docs`` documents. Lines travel
    as 128-bit hashes, a document and a position. They are range-partitioned by
    hash and sorted by document and position, so that the first line of each
    document in a hash is read off the stream. A salt taken from the document
    splits a frequent line over tasks; its slices meet as counts and maxima.

    Null and empty texts are one empty line, which is too short to go. Rows of
    null id count as one document, smaller than all others. Rows of one id count
    once; those with different texts have bitmaps of their own, told apart by
    :func:`row_key`. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("doc"), row_key(F.col(text_col)).alias("row"), text_lines(F.col(text_col)).alias("lines")
    )
    keyed = (
        rows.select("doc", "row", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("doc", "row", "n_lines", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc", "row", "n_lines", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
        .withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
    )
    keyed = cut_lineage(keyed, "line-hashes")
    ranged = keyed.select("h1", "h2", "salt", "doc", "pos").repartitionByRange("h1", "h2", "salt")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc").desc_nulls_last(), "pos")
    firsts = ranged.select(
        "h1", "h2", "doc", F.row_number().over(stream).alias("n"), F.lag("doc").over(stream).alias("above")
    ).where((F.col("n") == 1) | ~F.equal_null("above", "doc"))
    frequent = (
        firsts.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "keeper")
    )
    # a frequent line meets its copies once for each salt, so no task gets all of them
    salted = frequent.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f_salt"))
    same = (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")) & (F.col("salt") == F.col("f_salt"))
    gone = keyed.join(salted, same & ~F.equal_null("doc", "keeper"))
    found = gone.groupBy("doc", "row").agg(
        F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("dropped")
    )
    return found.select(
        F.col("doc").alias("bitmap_id"),
        F.col("row").alias("bitmap_row"),
        "n_lines",
        F.size("dropped").alias("n_dropped"),
        keep_runs(F.col("dropped"), F.col("n_lines")).alias("keep_runs"),
    )


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, out_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` and, as column ``out_col``, each row's bitmap or null.

    A column of that name is replaced; all others stay, whatever their names. Rows without a bitmap, also those of null id or
    text, get null; rows that repeat an id get the bitmap of their own text. An empty table gives an empty result.
    """
    taken = docs.withColumn(out_col, F.lit(None))
    of, row = spare(taken, "_bitmap_id"), spare(taken, "_bitmap_row")
    docs = docs.drop(out_col)
    names = bitmaps.select(F.col("bitmap_id").alias(of), F.col("bitmap_row").alias(row), F.col("keep_runs").alias(out_col))
    same = F.equal_null(F.col(id_col), F.col(of)) & (row_key(F.col(text_col)) == F.col(row))
    return docs.join(names, same, "left").drop(of, row)
