"""Language model scores from a probabilistic suffix tree over words."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm.groups import sorted_groups
from lynceus.llm.memo import keep_only
from lynceus.llm.words import MULTIPLIER, mixed
from lynceus.scale import cut_lineage, planned_bytes

DEPTH = 2
# A next word needs so many occurrences after a state to have a probability of its own there.
MIN_COUNT = 16
# A context needs so many to be considered.
MIN_STATE = 64
# What a next word must save the training text, in nats, on average over the words of a state.
COST = 4.0
PRIOR = 1.0

CHUNK_TOKENS = 700_000
SCORED_TOKENS = 350_000
# Input bytes for each bucket of counts, so that a bucket fits a task at every size.
BUCKET_BYTES = 4 * 1024 * 1024
OUT_ROWS = 100_000
# Every task holds the values of words that are this share of all tokens or more, so 1 / share at most, and those of the most
# frequent states and next words, so many at most; 24 bytes each. All others are joined.
HELD_SHARE = 5e-7
HELD_VALUES = 1_500_000
MAX_FILTER_BITS = 28
# Texts are hashed about so many bytes at a time; longer words are hashed alone.
PIECE_BYTES = 1 << 20
LONGEST = 64
# The end of a text, a byte that UTF-8 never has.
END = b"\xff"
_STATE = np.uint64(0xD6E8FEB86659FD93)
LN10 = math.log(10)


def extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of contexts with one more word; the empty context has key 0."""
    return mixed(context * np.uint64(MULTIPLIER) + word)


def state_key(context: np.ndarray) -> np.ndarray:
    """A key for what a context itself holds, beside those of words that end it."""
    return mixed(context ^ _STATE)


class KeyTable:
    """Positions of 64-bit keys in a sorted array, found many at a time by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(int(len(keys)).bit_length(), 1)
        self.shift = np.uint64(64 - bits)
        buckets = keys >> self.shift
        self.starts = np.searchsorted(buckets, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        found = np.full(len(wanted), -1, np.int32)
        bucket = wanted >> self.shift
        at, end = self.starts[bucket], self.starts[bucket + np.uint64(1)]
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.keys[here] == wanted[left]
            found[left[hit]] = here[hit]
            at[left] += 1
            left = left[~hit]
            left = left[at[left] < end[left]]
        return found


@dataclass
class KeyFilter:
    """Tells keys that are surely not in a set; its size has a bound, and beyond it only more others pass."""

    bits: int
    words: np.ndarray

    def passes(self, keys: np.ndarray) -> np.ndarray:
        high = keys >> np.uint64(64 - self.bits)
        low = keys & np.uint64((1 << self.bits) - 1)
        return self._has(high) & self._has(low)

    def _has(self, at: np.ndarray) -> np.ndarray:
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def key_filter(keys: DataFrame, column: str) -> KeyFilter:
    """The filter of a column of keys, put together in partial aggregates: 32 MB at most come to the driver."""
    bits = min(max((16 * keys.count()).bit_length(), 10), MAX_FILTER_BITS)
    key = F.col(column)
    at = F.explode(F.array(F.shiftrightunsigned(key, 64 - bits), key.bitwiseAND((1 << bits) - 1))).alias("at")
    parts = keys.select(at).select(F.shiftright("at", 6).alias("i"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    found = parts.groupBy("i").agg(F.bit_or("bit").alias("word")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["i"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return KeyFilter(bits, words)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for every byte, the same for A-Z and a-z and 0 for space; which bytes are not space; powers of an odd number."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    inside = np.ones(256, bool)
    inside[list(b" \t\n\x0b\x0c\r")] = False
    values[~inside] = 0
    powers = np.full(LONGEST + 1, MULTIPLIER, np.uint64)
    powers[0] = 1
    return values, inside, np.cumprod(powers, dtype=np.uint64)


_VALUES, _INSIDE, _POWERS = _tables()


def token_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of all words, lower-cased in A-Z, of many at a time: a sum of byte values by place, then mixed."""
    data = np.frombuffer(b" " + data + b" ", np.uint8)
    inside = _INSIDE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    data = data[starts[0] :]
    place = np.arange(len(data), dtype=np.int32) - np.repeat((starts - starts[0]).astype(np.int32), np.diff(starts, append=starts[0] + len(data)))
    np.minimum(place, LONGEST, out=place)
    values = _VALUES[data]
    values *= _POWERS[place]
    hashes = np.add.reduceat(values, starts - starts[0])
    lengths = ends - starts
    for i in np.flatnonzero(lengths > LONGEST).tolist():
        word = data[starts[i] - starts[0] : ends[i] - starts[0]].tobytes().lower()
        hashes[i] = xxhash.xxh64_intdigest(word)
    return mixed(hashes + lengths.astype(np.uint64))


_END = token_hashes(END)[0]


class _Chunk:
    """Tokens of many texts behind each other: hashes, texts, places in their text, and distinct words."""

    def __init__(self, hashes: list[np.ndarray]):
        self.hashes = np.concatenate(hashes)
        ends = np.flatnonzero(self.hashes == _END)
        lengths = np.diff(ends, prepend=-1)
        self.of = np.repeat(np.arange(len(ends), dtype=np.int32), lengths)
        self.place = np.arange(len(self.hashes), dtype=np.int32) - np.repeat((ends - lengths + 1).astype(np.int32), lengths)
        self.lengths = lengths
        codes, distinct = pd.factorize(self.hashes)
        self.codes, self.distinct = codes, distinct
        self.word_keys = extended(np.zeros(len(distinct), np.uint64), distinct)

    def contexts(self, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For every length from 1: positions that have a context of that length, and its keys at all positions."""
        keys = np.zeros(len(self.hashes), np.uint64)
        for n in range(1, depth + 1):
            before = extended(keys, self.hashes) if n > 1 else self.word_keys[self.codes]
            keys = np.concatenate([np.zeros(1, np.uint64), before[:-1]])
            yield n, np.flatnonzero(self.place >= n), keys


def _chunks(batches: Iterable[pa.RecordBatch], tokens: int) -> Iterator[tuple[pa.Table, _Chunk]]:
    """Rows without their last column, the text, and its tokens, about so many at a time."""
    keep_only()
    rows: list[pa.RecordBatch] = []
    hashes: list[np.ndarray] = []
    held = 0
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        sizes = np.fromiter((len(t.as_buffer()) if t.is_valid else 0 for t in texts), np.int64, len(texts))
        pieces = np.cumsum(sizes) // PIECE_BYTES
        cuts = [*(np.flatnonzero(np.diff(pieces, prepend=-1))).tolist(), len(texts)] if len(texts) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts[a:b]]
            hashes.append(token_hashes(b" \xff ".join([*part, b""])))
            rows.append(batch.slice(a, b - a).drop_columns(batch.schema.names[-1:]))
            held += len(hashes[-1])
            if held >= tokens:
                yield pa.Table.from_batches(rows), _Chunk(hashes)
                rows, hashes, held = [], [], 0
    if rows:
        yield pa.Table.from_batches(rows), _Chunk(hashes)


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(keys).view(np.int64))


def _counting(length: int, wanted, bits: int):
    """Words of each chunk after their contexts of one length, with their counts, packed by bucket of their key.

    ``wanted`` filters contexts, and words after the context that is one shorter: what is rare there is not frequent here.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk in _chunks(batches, CHUNK_TOKENS):
            if length:
                states, words, counts = _pairs(chunk, length, *wanted.value)
            else:
                states, words, counts = np.zeros(len(chunk.distinct), np.uint64), chunk.distinct, np.bincount(chunk.codes)
            buckets = (extended(states, words) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(buckets, kind="stable")
            states, words, counts = states[order], words[order], counts[order].astype(np.int64)
            found, starts = np.unique(buckets[order], return_index=True)
            ends = [*starts[1:].tolist(), len(order)]
            packed = [[c[i:j].tobytes() for i, j in zip(starts.tolist(), ends)] for c in (states, words, counts.astype(np.uint32))]
            if len(counts) and counts.max() >= 1 << 32:
                raise OverflowError("a chunk has more words than its counts can hold")
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int32)), *[pa.array(c, pa.binary()) for c in packed]], ["bucket", "states", "words", "counts"]
            )

    return run


def _pairs(chunk: _Chunk, length: int, contexts: KeyFilter, events: KeyFilter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shorter = np.zeros(len(chunk.hashes), np.uint64)
    for n, at, keys in chunk.contexts(length):
        if n == length:
            at = at[contexts.passes(keys[at])]
            at = at[events.passes(extended(shorter[at], chunk.hashes[at]))]
            codes, states = pd.factorize(keys[at])
            pairs, counts = np.unique(codes * len(chunk.distinct) + chunk.codes[at], return_counts=True)
            return states[pairs // len(chunk.distinct)], chunk.distinct[pairs % len(chunk.distinct)], counts
        shorter = keys
    raise ValueError(length)


def _summed(least: int):
    """(state, word, n, key) of each bucket, summed over chunks, from ``least`` on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "bucket"):
            states, words, counts = (
                np.frombuffer(b"".join(group[c].to_pylist()), kind) for c, kind in (("states", np.uint64), ("words", np.uint64), ("counts", np.uint32))
            )
            keys = extended(states, words)
            order = np.argsort(keys)
            first = np.flatnonzero(np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]]))
            sums = np.add.reduceat(counts[order].astype(np.int64), first)
            at, sums = order[first[sums >= least]], sums[sums >= least]
            for i in range(0, len(at), OUT_ROWS):
                part = slice(i, i + OUT_ROWS)
                made = [_signed(states[at[part]]), _signed(words[at[part]]), pa.array(sums[part]), _signed(keys[at[part]])]
                yield pa.RecordBatch.from_arrays(made, ["state", "word", "n", "key"])

    return run


def _counts(texts: DataFrame, length: int, wanted, least: int) -> DataFrame:
    """(state, word, n, key) of all words after contexts of ``length`` words, from ``least`` occurrences on.

    A context's words are dealt out by the key of both, so a frequent context is in all buckets.
    """
    bits = min(max((planned_bytes(texts) // BUCKET_BYTES).bit_length(), 6), 24)
    packed = texts.mapInArrow(_counting(length, wanted, bits), "bucket int, states binary, words binary, counts binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_summed(least), f"{_ROWS}, key bigint")


def _with_events(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the keys of their word after each suffix of the state in ``chain``."""
    for batch in batches:
        word = batch.column("word").to_numpy().view(np.uint64)
        suffixes = batch.column("chain").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        depth = len(suffixes) // max(len(word), 1)
        events = extended(suffixes.reshape(len(word), depth), word[:, None])
        ends = pa.array(np.arange(len(word) + 1, dtype=np.int32) * depth, pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, _signed(events.reshape(-1)))], [*batch.schema.names, "events"])


_ROWS = "state bigint, word bigint, n bigint"


@dataclass
class SuffixTree:
    """``values``: key, base (log10 of a word's count and one, else 0), gain (log10), weight (occurrences in
    training); ``tokens`` and ``types`` of the training texts."""

    values: DataFrame
    tokens: int
    types: int
    depth: int


def train(
    docs: DataFrame, text_col: str = "text", depth: int = DEPTH, min_count: int = MIN_COUNT,
    min_state: int = MIN_STATE, cost: float = COST,
) -> SuffixTree:
    """The suffix tree of all words of all rows: states are contexts of up to ``depth`` words.

    Words are lower-cased in A-Z; each text ends with one more token. The root predicts a word seen c
    times with (c + 1) / (N + V + 1). A context is a state if it was followed ``min_state`` times and its next
    words diverge from what its longest shorter state predicts: the training text must gain ``cost`` nats
    for each next word seen ``min_count`` times after it. At a state such a word has (c + r p) / (n + 1), any other
    r p / (n + 1), where n is the state's count, p the prediction of the shorter state and r, what is left: n + 1 less all such c.

    Every count covers all rows and grows with them. Tasks count before the shuffle; counts are then dealt out by
    context and word together, so that no task gets all of a frequent context. A pass counts contexts of one length, where the
    counts before allow a state and a next word, told by filters of bounded size. Null texts are empty: one token. An empty table gives a tree without words.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    words = cut_lineage(_counts(texts, 0, None, 1).select("word", "n", "key"), "tree-words")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, types = int(totals[0]), int(totals[1])
    root = tokens + types + 1
    end = int(_END.view(np.int64))
    first = words.select("word", F.log((F.col("n") + 1) / F.lit(float(root))).alias("p0"))
    values = [words.select("key", F.log10(F.col("n") + 1.0).alias("base"), F.lit(0.0).alias("gain"), F.col("n").alias("weight"))]

    # contexts that may be states: key, n, chain (keys of their suffixes, from none on)
    none = F.array(F.lit(0).cast("bigint"))
    able = words.where((F.col("word") != end) & (F.col("n") >= min_state)).select("key", "n", none.alias("chain"))
    frequent = words.where(F.col("n") >= min_count)
    known: list[tuple[DataFrame, DataFrame]] = []
    for size in range(1, depth + 1):
        able = cut_lineage(able, "tree-contexts")
        if able.isEmpty():
            break
        wanted = spark.sparkContext.broadcast((key_filter(able, "key"), key_filter(frequent, "key")))
        contexts = able.select(F.col("key").alias("context"), F.col("n").alias("total"), F.col("chain"))
        rows = _counts(texts, size, wanted, min_count).join(contexts, F.col("state") == F.col("context")).drop("context")
        rows = cut_lineage(rows.mapInArrow(_with_events, f"{_ROWS}, key bigint, total bigint, chain array<bigint>, events array<bigint>"), "tree-pairs")
        frequent = rows

        # what the longest shorter state predicts
        expected = rows.join(first.withColumnRenamed("word", "first_word"), F.col("word") == F.col("first_word"))
        p = F.col("p0")
        for j, (states, entries) in enumerate(known, 1):
            backs = states.select(F.col("key").alias("context"), F.col("back").alias(f"b{j}"))
            probabilities = entries.select(F.col("key").alias("event"), F.col("p").alias(f"p{j}"))
            expected = expected.join(backs, F.col("chain")[j] == F.col("context"), "left").drop("context")
            expected = expected.join(probabilities, F.col("events")[j] == F.col("event"), "left").drop("event")
            p = F.when(F.col(f"b{j}").isNull(), p).otherwise(F.coalesce(f"p{j}", F.col(f"b{j}") + p))
        expected = cut_lineage(expected.select("state", "key", "n", "total", p.alias("p")), "tree-expected")

        # what the state itself predicts, and what the training text gains by that
        sums = expected.groupBy(F.col("state").alias("s")).agg(F.sum("n").alias("seen"), F.first("total").alias("t"))
        rest = sums.withColumn("rest", F.col("t") + PRIOR - F.col("seen"))
        rest = rest.withColumn("back", F.log(F.col("rest") / (F.col("t") + PRIOR)))
        own = F.log((F.col("n") + F.col("rest") * F.exp("p")) / (F.col("total") + PRIOR))
        judged = expected.join(rest.select("s", "rest", "back"), F.col("state") == F.col("s"))
        judged = cut_lineage(judged.select("state", "key", "n", "total", "back", "p", own.alias("own")), "tree-judged")
        gains = judged.groupBy(F.col("state").alias("key")).agg(
            F.sum(F.col("n") * (F.col("own") - F.col("p"))).alias("more"), F.sum("n").alias("seen"),
            F.count("*").alias("entries"), F.first("total").alias("total"), F.first("back").alias("back"),
        )
        gain = F.col("more") + (F.col("total") - F.col("seen")) * F.col("back")
        states = cut_lineage(gains.where(gain > cost * F.col("entries")).select("key", "back", "total"), "tree-states")
        entries = judged.join(states.select(F.col("key").alias("kept")), F.col("state") == F.col("kept"), "left_semi")
        entries = cut_lineage(entries.select("key", "n", F.col("own").alias("p"), (F.col("own") - F.col("back") - F.col("p")).alias("more")), "tree-entries")
        known.append((states, entries))
        state_rows = states.select("key", "back", "total").mapInArrow(_state_keys, "key bigint, back double, total bigint")
        values.append(state_rows.select("key", F.lit(0.0).alias("base"), (F.col("back") / LN10).alias("gain"), F.col("total").alias("weight")))
        values.append(entries.select("key", F.lit(0.0).alias("base"), (F.col("more") / LN10).alias("gain"), F.col("n").alias("weight")))
        # a pair seen often enough is a longer context
        longer = rows.where((F.col("word") != end) & (F.col("n") >= min_state))
        able = longer.select("key", "n", F.concat(none, F.col("events")).alias("chain"))

    whole = values[0]
    for more in values[1:]:
        whole = whole.unionAll(more)
    return SuffixTree(cut_lineage(whole, "tree-values"), tokens, types, depth)


def _state_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _signed(state_key(batch.column("key").to_numpy().view(np.uint64)))
        yield pa.RecordBatch.from_arrays([keys, batch.column("back"), batch.column("total")], ["key", "back", "total"])


@dataclass
class _Held:
    """What every task knows of a tree: the values of most weight, and which other keys may have one."""

    keys: np.ndarray
    base: np.ndarray
    gain: np.ndarray
    others: KeyFilter


def _split_values(tree: SuffixTree, share: float, most: int) -> tuple[_Held, DataFrame]:
    """The values of words of at least this share of all tokens and of the ``most`` most frequent states and next
    words, to be held by tasks, and the table of all others."""
    level, word = F.floor(4 * F.log2(F.col("weight"))).cast("int"), F.col("base") > 0
    steps = tree.values.where(~word).groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()
    held, least = 0, 10**6
    for step in sorted(steps, key=lambda step: -step["level"]):
        held += step["n"]
        if held > most:
            break
        least = step["level"]
    heavy = F.when(word, F.col("weight") >= share * tree.tokens).otherwise(level >= least)
    table = tree.values.where(heavy).select("key", "base", "gain").toArrow()
    keys = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    others = tree.values.where(~heavy).select("key", "base", "gain")
    return _Held(keys[order], table["base"].to_numpy()[order], table["gain"].to_numpy()[order], key_filter(others, "key")), others


def _scoring(depth: int, held):
    """Per text its sums over held values (``key`` null), and the keys whose values are elsewhere."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Held = held.value
        table = KeyTable(known.keys)
        for rows, chunk in _chunks(batches, SCORED_TOKENS):
            texts = rows.num_rows
            base, gain, seen = np.zeros(texts), np.zeros(texts), np.zeros(texts)
            others: list[tuple[np.ndarray, np.ndarray]] = []

            def add(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
                """Adds what is held, notes what may be elsewhere; which keys may have a value."""
                at = table.find(keys)
                here = at >= 0
                value = known.gain[at[here]]
                np.add(gain, np.bincount(of[here], value, texts), out=gain)
                away = np.flatnonzero(~here)
                away = away[known.others.passes(keys[away])]
                others.append((of[away], keys[away]))
                here[away] = True
                return here

            # words: looked up once each
            at = table.find(chunk.word_keys)
            value = np.where(at >= 0, known.base[at], 0.0) if len(known.base) else np.zeros(len(at))
            base += np.bincount(chunk.of, value[chunk.codes], texts)
            seen += np.bincount(chunk.of, (at >= 0)[chunk.codes], texts)
            maybe = (at < 0) & known.others.passes(chunk.word_keys)
            away = np.flatnonzero(maybe[chunk.codes])
            others.append((chunk.of[away], chunk.word_keys[chunk.codes[away]]))
            for _, at, contexts in chunk.contexts(depth):
                at = at[add(state_key(contexts[at]), chunk.of[at])]
                add(extended(contexts[at], chunk.hashes[at]), chunk.of[at])

            ids = [rows.column(c).combine_chunks() for c in range(2)]
            yield _scored(ids, np.arange(texts), chunk.lengths, seen, base, gain, None, None)
            of, keys = (np.concatenate(c) for c in zip(*others))
            codes, distinct = pd.factorize(keys)
            pairs, times = np.unique(of * max(len(distinct), 1) + codes, return_counts=True)
            of, keys = pairs // max(len(distinct), 1), distinct[pairs % max(len(distinct), 1)]
            for i in range(0, len(of), OUT_ROWS):
                part = slice(i, i + OUT_ROWS)
                yield _scored([ids[0], None], of[part], None, None, None, None, keys[part], times[part])

    return run


_SCORED = "n_tokens bigint, n_known bigint, base double, gain double, key bigint, times bigint"


def _scored(ids, of, n_tokens, known, base, gain, keys, times) -> pa.RecordBatch:
    n = len(of)
    made = lambda x, kind: pa.nulls(n, kind) if x is None else pa.array(np.asarray(x), kind)
    at = pa.array(of)
    return pa.RecordBatch.from_arrays(
        [
            ids[0].take(at), pa.nulls(n, pa.int64()) if ids[1] is None else ids[1].take(at), made(n_tokens, pa.int64()),
            made(known if known is None else known.astype(np.int64), pa.int64()), made(base, pa.float64()), made(gain, pa.float64()),
            pa.nulls(n, pa.int64()) if keys is None else _signed(keys), made(times, pa.int64()),
        ],
        ["row", "id", "n_tokens", "n_known", "base", "gain", "key", "times"],
    )


def score(
    docs: DataFrame, tree: SuffixTree, id_col: str = "doc_id", text_col: str = "text",
    held_share: float = HELD_SHARE, held_values: int = HELD_VALUES,
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row, in log10.

    Each token is predicted by its longest suffix that is a state. That is a sum: the word's own term, a term for
    each suffix that is a state, and one for each that knows the next word. So a text's score is a sum of values by key.
    Tasks hold the values of words with at least ``held_share`` of all tokens and of the ``held_values`` most frequent states
    and next words; the other keys of a text are joined to their values. A filter of bounded size leaves keys without value out of the join.

    ``base_score`` takes the root alone. Null texts are empty: one token. Every row is scored by
    itself, also where ids or texts repeat; ids of null too. An empty table gives an empty result.
    """
    known, others = _split_values(tree, held_share, held_values)
    held = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = cut_lineage(rows.mapInArrow(_scoring(tree.depth, held), f"row bigint, id bigint, {_SCORED}"), "tree-scores")
    tail = parts.where("key IS NOT NULL").select("row", "key", "times").join(others.withColumnRenamed("key", "of"), F.col("key") == F.col("of"))
    tail = tail.groupBy(F.col("row").alias("r")).agg(
        F.sum(F.when(F.col("base") > 0, F.col("times")).otherwise(0)).alias("t_known"),
        F.sum(F.col("base") * F.col("times")).alias("t_base"), F.sum(F.col("gain") * F.col("times")).alias("t_gain"),
    )
    whole = parts.where("key IS NULL").join(tail, F.col("row") == F.col("r"), "left")
    total = lambda c: F.col(c) + F.coalesce(f"t_{c}", F.lit(0))
    base: Column = total("base") - F.col("n_tokens") * math.log10(tree.tokens + tree.types + 1)
    return whole.select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("t_known", F.lit(0))).alias("n_known"),
        F.lit(tree.tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), (base + total("gain")).alias("score"),
    )

