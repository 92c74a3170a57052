"""Substring dedup by hash joins of content-defined blocks and of windows, in place of a relative Lempel-Ziv parse."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.lines import row_key
from lynceus.llm.words import begin_task, mixed, split_words, window_hashes, word_hashes
from lynceus.scale import cut_lineage, spare

WINDOW = 50
GRAM = 8
OUT_ROWS = 50_000


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def block_bounds(hashes: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and first windows of a text's blocks.

    A window's anchor is the least hash of its grams, so equal windows have equal
    anchors wherever they are. A block is a run of windows with one anchor.
    """
    least = _least(window_hashes(hashes, gram), window - gram + 1)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[starts], starts


def _blocks(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            parts, held = [], 0
            for i, text in enumerate(batch.column(2).to_pylist()):
                h = word_hashes(split_words(text))
                if len(h) < window:
                    continue
                anchors, starts = block_bounds(h, window)
                whole = window_hashes(h, window)
                ends = np.append(starts[1:], len(whole))
                place = (np.arange(len(whole)) - np.repeat(starts, ends - starts)).astype(np.uint64)
                content = np.add.reduceat(mixed(whole + place), starts)
                parts.append((np.full(len(starts), i), anchors.view(np.int64), content.view(np.int64), starts, ends - starts))
                held += len(starts)
                if held > OUT_ROWS:
                    yield _block_batch(batch, parts)
                    parts, held = [], 0
            if parts:
                yield _block_batch(batch, parts)

    return run


def _block_batch(batch: pa.RecordBatch, parts: list) -> pa.RecordBatch:
    of, anchors, contents, starts, sizes = (np.concatenate(c) for c in zip(*parts))
    at = pa.array(of)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(at), batch.column(1).take(at), pa.array(anchors), pa.array(contents), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())],
        ["doc", "row", "anchor", "content", "start", "size"],
    )


def run_arrays(runs: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First windows and sizes of each row's runs, as views of the batch; a batch may hold a million runs, too many for Python objects."""
    starts, sizes = (runs.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "size"))
    bounds = runs.offsets.to_numpy()
    for there, a, b in zip(runs.is_valid().to_numpy(zero_copy_only=False).tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        yield (starts[a:b], sizes[a:b]) if there else (starts[:0], sizes[:0])


def _windows(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            parts, held = [], 0

            def out() -> pa.RecordBatch:
                of, hashes, at = (np.concatenate(c) for c in zip(*parts))
                rows = pa.array(of)
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hashes.view(np.int64)), pa.array(at, pa.int32())],
                    ["doc", "row", "hash", "start"],
                )

            spans = run_arrays(batch.column(3))
            for i, (text, (starts, sizes)) in enumerate(zip(batch.column(2).to_pylist(), spans)):
                whole = window_hashes(word_hashes(split_words(text)), window)
                at = np.concatenate([np.arange(a, a + n) for a, n in zip(starts.tolist(), sizes.tolist())])
                parts.append((np.full(len(at), i), whole[at], at))
                held += len(at)
                if held > OUT_ROWS:
                    yield out()
                    parts, held = [], 0
            if parts:
                yield out()

    return run


def factors(starts: np.ndarray, sizes: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Duplicate spans of words from runs of found windows.

    The joins have decided which windows are found; here runs of them are merged. A factor
    goes on as long as the next window is found too, whichever reference block holds it, and has
    no reference position. Factors that touch become one span. A found window alone has the least length.
    """
    spans: list[list[int]] = []
    order = np.argsort(starts, kind="stable")
    for a, n in zip(starts[order].tolist(), sizes[order].tolist()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], a + n - 1 + window)
        else:
            spans.append([a, a + n - 1 + window])
    return [(a, b) for a, b in spans]


def removed_words(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    gone = np.zeros(n, bool)
    for a, b in spans:
        gone[a:b] = True
    return gone


KEPT = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])


def cut_texts(window: int):
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for text, (starts, sizes) in zip(texts, run_arrays(runs)):
            words = split_words(text.as_py())
            kept = words
            if len(starts):
                gone = removed_words(len(words), factors(starts, sizes, window))
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            joined = b" ".join(kept)
            out.append((len(words), len(words) - len(kept), joined.decode(), hashlib.sha256(joined).hexdigest()))
        return pa.array([dict(zip(KEPT.names, row)) for row in out], KEPT)

    return cut


def duplicate_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """(span_id, span_row, found): runs of windows, as first window and number, that start in an earlier document.

    Every document is cut into blocks of windows with a common anchor, about one for 22
    words, and all blocks are references for the documents of larger ids. Blocks
    travel as hashes. Anchors of one document only are left at once. A block whose whole
    content is in an earlier document is found as a whole. For the others, one of
    each content, the windows themselves are looked up: a window's first document
    comes from a partial minimum, so passages that a third of the corpus shares never meet
    in one task. Every window of every document is decided, none by a cut-off.

    Documents under ``window`` words and null texts have no windows. Rows of null id are no
    references and lose nothing. Rows of one id never are references of each
    other. Spans are kept per id and text (``span_row``, see :func:`row_key`).
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc"), row_key(F.col(text_col)).alias("row"), F.col(text_col).cast("string").alias("text")
    )
    kind = texts.schema["doc"].dataType.simpleString()
    blocks = cut_lineage(
        texts.mapInArrow(_blocks(window), f"doc {kind}, row bigint, anchor bigint, content bigint, start int, size int"), "blocks"
    )
    shared = blocks.groupBy(F.col("anchor").alias("of")).agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.min("content").alias("low"), F.max("content").alias("high")
    ).where(F.col("first") != F.col("last"))
    held = blocks.join(shared, F.col("anchor") == F.col("of")).select(
        "doc", "row", "anchor", "content", "start", "size", F.when(F.col("low") == F.col("high"), F.col("first")).alias("first")
    )
    held = cut_lineage(held, "shared-blocks")
    alike = held.where("first < doc").select("doc", "row", "start", "size")
    mixed_blocks = held.where("first IS NULL").drop("first")
    firsts = mixed_blocks.groupBy(F.col("anchor").alias("a"), F.col("content").alias("c")).agg(F.min("doc").alias("first"))
    told = mixed_blocks.join(firsts, (F.col("anchor") == F.col("a")) & (F.col("content") == F.col("c")))
    told = cut_lineage(told.select("doc", "row", "start", "size", "first"), "block-contents")
    whole = told.where("first < doc").select("doc", "row", "start", "size")
    own = told.where("first = doc").groupBy(F.col("doc").alias("d"), F.col("row").alias("r")).agg(
        F.collect_list(F.struct("start", "size")).alias("spans")
    )
    query = texts.join(own, (F.col("doc") == F.col("d")) & (F.col("row") == F.col("r"))).select("doc", "row", "text", "spans")
    windows = cut_lineage(query.mapInArrow(_windows(window), f"doc {kind}, row bigint, hash bigint, start int"), "windows")
    first = windows.groupBy(F.col("hash").alias("h")).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    single = windows.join(first, F.col("hash") == F.col("h")).where("first < doc").select("doc", "row", "start", F.lit(1).alias("size"))
    runs = alike.unionAll(whole).unionAll(single)
    return runs.groupBy(F.col("doc").alias("span_id"), F.col("row").alias("span_row")).agg(
        F.collect_set(F.struct("start", "size")).alias("found")
    )


def remove_spans(
    docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, out_col: str = "dedup"
) -> DataFrame:
    """``docs`` with a struct: n_words, n_removed, kept (the words that stay, joined by one space), kept_sha256.

    All rows and columns stay, whatever their names; a column named ``out_col`` is replaced. Null and empty texts have no words and lose
    none. Rows that repeat an id are cut by the spans of their own text; an empty table gives an empty result.
    """
    taken = docs.withColumn(out_col, F.lit(None))
    of, row, runs_of = (spare(taken, c) for c in ("_span_id", "_span_row", "_found"))
    docs = docs.drop(out_col)
    found = spans.select(F.col("span_id").alias(of), F.col("span_row").alias(row), F.col("found").alias(runs_of))
    same = F.equal_null(F.col(id_col), F.col(of)) & (row_key(F.col(text_col)) == F.col(row))
    ddl = "struct<n_words:bigint,n_removed:bigint,kept:string,kept_sha256:string>"
    made = F.arrow_udf(cut_texts(window), ddl).asNondeterministic()(F.col(text_col).cast("string"), F.col(runs_of))
    return docs.join(found, same, "left").withColumn(out_col, made).drop(of, row, runs_of)
