"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.llm.memo import Memo, keep_only

BLOCK_CHARS = 1 << 16
BLOCK_BYTES = 1 << 13
# Characters beyond a pretoken's end that its pattern can read: those of the longest contraction.
PATTERN_REACH = 3
SHORT_BYTES = 24
NO_RANK = 1 << 60
CACHED_CHUNKS = 300_000

# The characters with Unicode's White_Space property.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The pattern that splits text before merges, in the tokenizer's format.
_pretokens = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
# White space stays with what follows it. No merge and no pattern match crosses the start of
# a run of white space, so each chunk is encoded by itself.
_chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_last_cut = regex.compile(f"(?r)(?<=[^{WHITE}])[{WHITE}]")
# How an open pretoken goes on, by the kind of its last character.
_white = regex.compile(f"[{WHITE}]*")
_runs = (_white, regex.compile(r"\p{L}*"), regex.compile(r"\p{N}*"), regex.compile(rf"[^{WHITE}\p{{L}}\p{{N}}]*"))


def byte_letters() -> dict[str, int]:
    """The format's letter for each byte: printable ones stand for themselves, the rest follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes that must follow a token's end before no further input can change the token.

    Append text to an input and compare the two runs of the merges. A boundary
    before the end can differ only if a merge (u, v) takes it away in one run
    while the token v behind it differs between the runs. So differences move
    left through a chain of merges of rising rank, by the length of each u, and
    the v of a merge begins with the u of the merge before it in the chain. The
    result is the longest such chain: best[u] is the longest that ends in a
    merge with left part u.
    """
    best: dict[bytes, int] = {}
    longest = 0
    for u, v in merges:
        reach = len(u) + max((best.get(v[:i], 0) for i in range(1, len(v) + 1)), default=0)
        best[u] = max(best.get(u, 0), reach)
        longest = max(longest, reach)
    return longest


class Transducer:
    """Encoder of one merge list. Merges must be in the order in which training made them."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        made = {bytes([b]): -1 for b in range(256)}
        for rank, (u, v) in enumerate(merges):
            if max(made.get(u, rank), made.get(v, rank)) >= rank or u + v in made:
                raise ValueError(f"merge {rank} is out of order")
            made[u + v] = rank
        self.rank_of = {(ids[u], ids[v]): rank for rank, (u, v) in enumerate(merges)}.get
        self.results = [ids[u + v] for u, v in merges]
        self.bytes_ids = [ids[bytes([b])] for b in range(256)]
        self.pieces = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in special.items()}
        self.special = special
        self.lookahead = sufficient_lookahead(merges)
        self._split = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._packed = {i: i.to_bytes(4, "little") for i in self.pieces}
        self._spans = Memo(self._span, CACHED_CHUNKS)

    def merged(self, data: bytes) -> list[int]:
        """Tokens of a whole input: the lowest rank first, and the leftmost of equal rank."""
        ids = list(map(self.bytes_ids.__getitem__, data))
        return self._merged_long(ids) if len(ids) > SHORT_BYTES else self._merged_short(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        rank_of = self.rank_of
        ranks = [rank_of(pair, NO_RANK) for pair in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != NO_RANK:
            at = ranks.index(least)
            ids[at] = new = self.results[least]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], new), NO_RANK)
            if at < len(ranks):
                ranks[at] = rank_of((new, ids[at + 1]), NO_RANK)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        rank_of, n = self.rank_of, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, pair in enumerate(zip(ids, ids[1:])) if (r := rank_of(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = self.results[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank_of((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [i for i in ids if i >= 0]

    def _stable(self, held: bytes, data: bytes) -> tuple[list[int], bytes]:
        """Tokens of an open pretoken that no further byte can change, and the bytes behind them.

        ``held`` are the bytes of tokens that were not stable before ``data``: always
        less than the lookahead and the longest token together.
        """
        out: list[int] = []
        for i in range(0, len(data), BLOCK_BYTES):
            held += data[i : i + BLOCK_BYTES]
            end = 0
            for token in self.merged(held) if len(held) > self.lookahead else ():
                if end + len(self.pieces[token]) > len(held) - self.lookahead:
                    break
                end += len(self.pieces[token])
                out.append(token)
            held = held[end:]
        return out, held

    def _closed(self, held: bytes, data: bytes) -> list[int]:
        """Tokens of a pretoken, or of its rest, that ends with ``data``."""
        if len(data) <= BLOCK_BYTES:
            return self.merged(held + data)
        out, held = self._stable(held, data)
        return out + self.merged(held)

    def _pack(self, ids: list[int]) -> bytes:
        return b"".join(map(self._packed.__getitem__, ids))

    def _span(self, chunk: str) -> bytes:
        """What leaves the transducer for white space and all that follows it."""
        return b"".join(self._pack(self._closed(b"", word.encode())) for word in _pretokens.findall(chunk))

    def stream(self, blocks: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of a text that arrives in blocks, each emitted once it is stable.

        State between blocks: the text behind the last sure end of a pretoken, or, of a
        pretoken longer than a block's share, its kind and the bytes without stable tokens.
        Both are bounded, whatever the length of the text or of a pretoken. Ids of short
        spans that were emitted before are looked up.
        """
        rest, run, held = "", None, b""
        for block in blocks:
            rest += block
            if run:
                stop = run.match(rest).end()
                going = stop == len(rest)
                stop -= run is _white  # the last white space may belong to what follows
                data, rest = rest[:stop].encode(), rest[stop:]
                if going:
                    ids, held = self._stable(held, data)
                    yield self._pack(ids)
                    continue
                yield self._pack(self._closed(held, data))
                run, held = None, b""
            if cut := _last_cut.search(rest):
                yield b"".join(map(self._spans.__getitem__, _chunks.findall(rest, 0, cut.start())))
                rest = rest[cut.start() :]
            if len(rest) <= BLOCK_BYTES:
                continue
            sure = len(rest) - PATTERN_REACH
            for word in _pretokens.finditer(rest):
                if word.end() > sure:
                    break
                yield self._pack(self._closed(b"", word[0].encode()))
            if word.end() - word.start() > BLOCK_BYTES:
                run = next(r for r in _runs if r.match(rest, word.end() - 1).end() >= word.end())
                stop = word.end() - (run is _white)
                ids, held = self._stable(b"", rest[word.start() : stop].encode())
                yield self._pack(ids)
                rest = rest[stop:]
            else:
                rest = rest[word.start() :]
        if run:
            stop = run.match(rest).end()
            stop -= run is _white and stop < len(rest)
            yield self._pack(self._closed(held, rest[:stop].encode()))
            rest = rest[stop:]
        yield b"".join(map(self._spans.__getitem__, _chunks.findall(rest)))

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian 32-bit integers, a block of the text at a time."""
        at = 0
        for m in self._split.finditer(text) if self._split else ():
            yield from self.stream(text_blocks(text, at, m.start()))
            yield self._packed[self.special[m[0]]]
            at = m.end()
        yield from self.stream(text_blocks(text, at, len(text)))


def text_blocks(text: str, start: int, end: int) -> Iterator[str]:
    """A part of a text in blocks of bounded length."""
    return (text[i : min(i + BLOCK_CHARS, end)] for i in range(start, end, BLOCK_CHARS))


class Decoder:
    """Ids to text as they come; a character whose bytes are not all there waits for the rest."""

    def __init__(self, pieces: dict[int, bytes]):
        self._pieces = pieces
        self._utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self._utf8.decode(b"".join(map(self._pieces.__getitem__, ids)), last)


@lru_cache(maxsize=2)
def transducer(source: str) -> Transducer:
    """From the text of a byte-level tokenizer file."""
    file = json.loads(source)
    letters = byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ids = {raw(t): i for t, i in file["model"]["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
    return Transducer(ids, [(raw(u), raw(v)) for u, v in pairs], special)


def _shared(spark: SparkSession, path: str):
    """The tokenizer file for all tasks: a few megabytes whatever the corpus."""
    return spark.sparkContext.broadcast(Path(path).read_text())


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text.

    Null and empty texts have none; repeated rows give repeated ids. Other columns
    stay, one named ``out_col`` is replaced; an empty table gives an empty one.
    """
    source = _shared(docs.sparkSession, path)

    def ids(texts: pa.Array) -> pa.Array:
        t = transducer(source.value)
        keep_only(t._spans)
        rows = [np.frombuffer(b"".join(t.encode(x or "")), "<u4").astype(np.int32) for x in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))

    return docs.withColumn(out_col, F.arrow_udf(ids, "array<int>").asNondeterministic()(F.col(text_col).cast("string")))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``rows`` with the text of their ids.

    Bytes that are no UTF-8 become U+FFFD; null and empty ids give an empty text.
    Other columns stay, one named ``out_col`` is replaced; an empty table gives an empty one.
    """
    source = _shared(rows.sparkSession, path)

    def texts(ids: pa.Array) -> pa.Array:
        pieces = transducer(source.value).pieces
        return pa.array([Decoder(pieces).feed(x or [], last=True) for x in ids.to_pylist()], pa.string())

    return rows.withColumn(out_col, F.arrow_udf(texts, "string").asNondeterministic()(F.col(ids_col)))


def digests(text: str | None, t: Transducer) -> tuple[int, str, str]:
    """Number of ids, and digests of the ids and of the text decoded from them, in constant memory."""
    n, ids_sha, text_sha, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(t.pieces)
    for packed in t.encode(text or ""):
        n += len(packed) // 4
        ids_sha.update(packed)
        text_sha.update(decoder.feed(np.frombuffer(packed, "<u4").tolist()).encode())
    text_sha.update(decoder.feed([], last=True).encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def round_trip(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "bpe") -> DataFrame:
    """``docs`` with a struct: n_tokens, ids_sha256, decoded_sha256 of each whole text.

    Null texts count as empty: no tokens. Rows are independent; repeated rows
    give repeated results, and a column named ``out_col`` is replaced. No shuffle.
    """
    source = _shared(docs.sparkSession, path)
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(texts: pa.Array) -> pa.Array:
        t = transducer(source.value)
        keep_only(t._spans)
        return pa.array([dict(zip(kind.names, digests(x, t))) for x in texts.to_pylist()], kind)

    made: Callable[..., Column] = F.arrow_udf(run, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    return docs.withColumn(out_col, made.asNondeterministic()(F.col(text_col).cast("string")))
