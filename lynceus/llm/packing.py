"""Packing of tokenized documents into windows by online sum-of-squares placement."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.memo import Memo, keep_only

WINDOW = 2048
END_ID = 1
OUT_ROWS = 20_000
CACHED_CHUNKS = 300_000
LEARNED = 500
TOGETHER = 64
TASK_SEQUENCES = 1 << 38


#: Latin letters that stay one letter in lower case, then ASCII marks other than the apostrophe. The
#: tokenizer ends a word where letters end, so it treats both parts apart.
PARTS = re.compile("([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@[-`{-~]*)")
#: How byte-level tokenizers write bytes as characters: printable ones as themselves, others from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class ChunkIds(Memo):
    """Packed ids of what stands between spaces; the tokenizer never joins over ASCII white space."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        super().__init__(self._one, CACHED_CHUNKS)
        self._tokenizer = Tokenizer.from_str(source)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model

    def _one(self, chunk: bytes) -> bytes:
        return np.asarray(self._tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: bytes) -> bytes:
        """One word of lower-case letters, which needs no more than the merges."""
        text = word.decode() if word.isascii() else word.decode("latin-1").translate(BYTE_CHARS)
        ids = [t.id for t in self._model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def of(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Ids of all the chunks. Of new ones a word and its marks are encoded apart, all others together."""
        found = dict(zip(chunks, map(self.get, chunks)))
        rest = []
        for chunk in [c for c, ids in found.items() if ids is None]:
            if (ids := self._old.get(chunk)) is None:
                if not (parts := PARTS.fullmatch(text := chunk.decode())):
                    rest.append(text)
                    continue
                word, marks = parts[1].lower().encode(), parts[2].encode()
                ids = self.get(word) or self._old.get(word) or self.put(word, self._letters(word))
                if marks:
                    ids += self[marks]
            found[chunk] = self.put(chunk, ids)
        for chunk, ids in self._joined(rest):
            found[chunk] = self.put(chunk, ids)
        return found

    def _joined(self, new: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Encodes many chunks at once; the places of the tokens tell which chunk they are of."""
        for i in range(0, len(new), LEARNED):
            part = new[i : i + LEARNED]
            found = self._tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            cuts = [0, *(4 * np.searchsorted(starts, ends)).tolist()]
            ids = np.asarray(found.ids, "<u4").tobytes()
            for chunk, a, b in zip(part, cuts, cuts[1:]):
                yield chunk.encode(), ids[a:b]


@lru_cache(maxsize=2)
def chunk_ids(source: str) -> ChunkIds:
    return ChunkIds(source)


def text_chunks(text: str | None) -> list[bytes]:
    """The tokenizer ignores case. For letters that can't combine with marks it may be dropped before."""
    text = text or ""
    return (text.lower() if text.isascii() and "<|" not in text else text).encode().split()


def document_ids(texts: list[str | None], chunks: ChunkIds, end_id: int = END_ID) -> Iterator[bytes]:
    """Each whole text's ids and the end id, as little-endian 32-bit integers."""
    end = end_id.to_bytes(4, "little")
    for i in range(0, len(texts), TOGETHER):
        split = [text_chunks(t) for t in texts[i : i + TOGETHER]]
        ids = chunks.of(set().union(*split))
        for words in split:
            yield b"".join(map(ids.__getitem__, words)) + end


#: A piece of a document in a window: document, its tokens, first token, packed ids.
Piece = tuple[object, int, int, bytes]


def _cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, total, start, ids = piece
    return (doc, total, start, ids[: 4 * n]), (doc, total, start + n, ids[4 * n :])


class LevelArray:
    """Open windows by fill level; ``counts[h]`` of them hold h tokens.

    A piece of s tokens goes to the level h (0 opens a window) where moving one
    window from h to h + s leaves the smallest sum of squared counts of partly
    filled windows. Equal choices take the fullest window.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.leave = np.full(window + 1, np.iinfo(np.int64).max // 4)
        self.leave[0] = 0
        self.enter = np.ones(window + 1, np.int64)
        self.enter[window] = 0
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def _changed(self, h: int) -> None:
        n = len(self.open[h])
        self.counts[h] = n
        self.leave[h] = 1 - 2 * n if n else np.iinfo(np.int64).max // 4
        self.enter[h] = 2 * n + 1

    def level_for(self, size: int) -> int:
        change = self.leave[: self.window - size + 1] + self.enter[size:]
        return self.window - size - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts the piece into a window; returns the window if it is full now."""
        size = len(piece[3]) // 4
        h = self.level_for(size)
        held = self.open[h].pop() if h else []
        if h:
            self._changed(h)
        held.append(piece)
        if h + size == self.window:
            return held
        self.open[h + size].append(held)
        self._changed(h + size)
        return None

    def close(self) -> Iterator[list[Piece]]:
        """What is still open when the task has no more documents.

        The fullest windows are filled with cuts from the emptiest. At most one
        window stays partly filled; it is cut at powers of two, which need no
        padding.
        """
        left = [w for h in range(self.window, 0, -1) for w in self.open[h]]
        fills = [sum(len(p[3]) // 4 for p in w) for w in left]
        i, j = 0, len(left) - 1
        while i < j:
            taken = left[j].pop()
            room, size = self.window - fills[i], len(taken[3]) // 4
            part, rest = _cut(taken, min(room, size))
            left[i].append(part)
            fills[i] += min(room, size)
            fills[j] -= min(room, size)
            if rest[3]:
                left[j].append(rest)
            if fills[i] == self.window:
                yield left[i]
                i += 1
            if not fills[j]:
                j -= 1
        if i == j and fills[i]:
            pieces, bit = left[i], self.window
            while bit:
                if fills[i] & bit:
                    need, out = bit, []
                    while need:
                        part, rest = _cut(pieces.pop(0), need)
                        need -= len(part[3]) // 4
                        out.append(part)
                        if rest[3]:
                            pieces.insert(0, rest)
                    yield out
                bit //= 2


def windows(docs: Iterable[tuple[object, bytes]], window: int = WINDOW) -> Iterator[list[Piece]]:
    """Windows of one task's documents: long ones fill whole windows, and what is left is placed."""
    levels = LevelArray(window)
    for doc, ids in docs:
        total = len(ids) // 4
        whole = total - total % window
        for at in range(0, whole, window):
            yield [(doc, total, at, ids[4 * at : 4 * (at + window)])]
        if whole < total and (full := levels.place((doc, total, whole, ids[4 * whole :]))):
            yield full
    yield from levels.close()


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of tokenized documents and where each lies: one row per piece.

    Every task packs the documents of its own partition, so nothing is shuffled
    and nothing but the open windows is held; a rerun of a task gives the same
    pieces. ``sequence_id`` holds the partition in its upper bits. Null and
    empty texts are the end id alone. Rows are packed one by one, also repeated
    ones and those with a null id. Other columns are not read. An empty table
    gives no pieces. ``window`` must be a power of two.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    source = docs.sparkSession.sparkContext.broadcast(Path(path).read_text())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    columns = "start length ids_crc32 doc_tokens sequence_id offset".split()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_ids(source.value)
        keep_only(chunks)
        kinds: list[pa.DataType] = []

        def read() -> Iterator[tuple[object, bytes]]:
            for batch in batches:
                kinds[:] = [batch.schema.field(0).type]
                yield from zip(batch.column(0).to_pylist(), document_ids(batch.column(1).to_pylist(), chunks, end_id))

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            ids, *rest = zip(*out)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kinds[0]), *(pa.array(c, pa.int64()) for c in rest)], ["doc_id", *columns]
            )

        sequence, out = TaskContext.get().partitionId() * TASK_SEQUENCES, []
        for full in windows(read(), window):
            offset = 0
            for doc, total, start, ids in full:
                length = len(ids) // 4
                out.append((doc, start, length, zlib.crc32(ids), total, sequence, offset))
                offset += length
            sequence += 1
            if len(out) >= OUT_ROWS:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{c} bigint" for c in columns))
