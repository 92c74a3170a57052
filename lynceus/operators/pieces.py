"""Pieces of texts as hashes, made and looked up in blocks inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A filter has 16 bits for a key, within these bounds, and a key sets so many of them.
LEAST_BITS, MOST_BITS, PROBES = 16, 28, 3
# Counters of the pieces of a sample.
SLOTS = 1 << 20
# A hash ends in the length of its piece, modulo this.
KINDS = 32
# Pieces of so many bytes, all of even lengths, are first known by their halves.
HALVED = 6

_FACTOR = 0x9E3779B97F4A7C15
# Tells second halves from first ones.
_SECOND = np.uint64(0xA5A5A5A5A5A5A5A0)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_FACTOR, n, 1 << 64))


def _hashes(sums: np.ndarray, size: int) -> np.ndarray:
    return (_mixed(sums) & np.uint64(-KINDS % (1 << 64))) | np.uint64(size % KINDS)


def _sums(data: np.ndarray, size: int) -> np.ndarray:
    """The polynomial of every ``size`` consecutive bytes, from windows of doubling size."""
    out, done, part, width = None, 0, data.astype(np.uint64) + np.uint64(1), 1
    while True:
        if size & width:
            n = len(data) - done - width + 1
            out = part if out is None else out[:n] * _power(width) + part[done : done + n]
            done += width
        if done == size:
            return out
        part = part[:-width] * _power(width) + part[width:]
        width *= 2


def _windows(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive bytes."""
    return _hashes(_sums(data, size), size)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 of all texts, each byte's row, and where texts begin and end. A null text has none."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    return data, np.repeat(np.arange(len(texts)), np.diff(bounds)), bounds


def pieces(texts: pa.Array, sizes: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the rows and hashes of all pieces of so many bytes of UTF-8, overlapping. A null text has none."""
    data, rows, bounds = _bytes(texts)
    left = bounds[1:][rows] - np.arange(len(data))
    for size in sizes:
        if len(data) < size:
            yield np.empty(0, np.int64), np.empty(0, np.uint64)
            continue
        inside = left[: len(data) - size + 1] >= size
        yield rows[: len(inside)][inside], _windows(data, size)[inside]


class PieceFilter:
    """Tells keys that are surely none of a table's; of bounded size, so with very many keys it lets more through."""

    def __init__(self, words: np.ndarray, bits: int):
        self._words, self._bits = words, bits

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys that may be in the table."""
        at = np.arange(len(keys))
        for i in range(PROBES):
            place = probe(keys[at], i, self._bits)
            at = at[(self._words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
        return at


def probe(keys: np.ndarray, i: int, bits: int) -> np.ndarray:
    return (keys * np.uint64(2 * i + 1) + (keys >> np.uint64(32)) * np.uint64(i)) >> np.uint64(64 - bits)


def piece_filter(keys: DataFrame, column: str, n: int) -> PieceFilter:
    """The filter of a column of about ``n`` keys, put together in partial aggregates: 32 MB at most are told apart on the driver."""
    bits = min(max(int(n * 16).bit_length(), LEAST_BITS), MOST_BITS)

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate([probe(held, i, bits) for i in range(PROBES)])
            word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bit.view(np.int64))], ["word", "bit"])

    set_bits = keys.select(column).mapInArrow(places, "word int, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[set_bits.column("word").to_numpy()] = set_bits.column("bits").to_numpy().view(np.uint64)
    return PieceFilter(words, bits)


def held_keys(texts: pa.Array, sizes: Sequence[int], known: dict[int, PieceFilter], halves: PieceFilter | None = None) -> pa.Array:
    """Each text's distinct pieces that may be among the known keys of their length. Where ``halves`` are given, only pieces of
    which both may be halves of keys are put together and looked up."""
    data, of, bounds = _bytes(texts)
    left = bounds[1:][of] - np.arange(len(data))
    rows, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for size in sizes:
        if len(data) < size:
            continue
        at = np.flatnonzero(left[: len(data) - size + 1] >= size)
        if halves is not None and size >= HALVED:
            half = size // 2
            sums = _sums(data, half)
            hashes = _hashes(sums, half)
            at = at[halves.may_hold(hashes[at])]
            at = at[halves.may_hold(hashes[at + half] ^ _SECOND)]
            found = _hashes(sums[at] * _power(half) + sums[at + half], size)
        else:
            found = _windows(data, size)[at]
        kept = known[size].may_hold(found)
        rows.append(of[at[kept]])
        keys.append(found[kept])
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    if len(rows):
        new = np.append(True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1]))
        rows, keys = rows[new], keys[new]
    bounds = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.view(np.int64)))


def half_keys(texts: pa.Array, sizes: pa.Array, places: pa.Array) -> pa.Array:
    """The distinct halves of pieces, each given by its text, size and place."""
    data, _, bounds = _bytes(texts)
    sizes, starts, out = sizes.to_numpy(), bounds[:-1] + places.to_numpy(), [np.empty(0, np.uint64)]
    for size in np.unique(sizes).tolist():
        hashes, at = _windows(data, size // 2), starts[sizes == size]
        out += [hashes[at], hashes[at + size // 2] ^ _SECOND]
    return pa.array(np.unique(np.concatenate(out)).view(np.int64))


def piece_counts(texts: DataFrame, column: str, sizes: Sequence[int]) -> np.ndarray:
    """How often pieces occur, in ``SLOTS`` counters that several share."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, hashes in pieces(batch.column(0), sizes):
                total += np.bincount(((hashes >> np.uint64(8)) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slots = np.flatnonzero(total)
        for a in range(0, len(slots), 100_000):
            part = slots[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part])], ["slot", "n"])

    counted = texts.select(column).mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    return out


def rarest(texts: pa.Array, sizes: pa.Array, counts: np.ndarray) -> pa.Array:
    """The key and place of each text's rarest piece of its size, the first where several are as rare."""
    sizes, out, place = sizes.to_numpy(), np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int32)
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        for rows, hashes in pieces(texts.take(pa.array(mine)), [size]):
            if not len(rows):
                continue
            order = np.lexsort((np.arange(len(rows)), counts[((hashes >> np.uint64(8)) % np.uint64(SLOTS)).astype(np.int64)], rows))
            first = order[np.append(True, rows[order][1:] != rows[order][:-1])]
            out[mine[rows[first]]] = hashes[first]
            place[mine[rows[first]]] = first - np.searchsorted(rows, rows[first])
    return pa.StructArray.from_arrays([pa.array(out.view(np.int64)), pa.array(place)], ["key", "at"])
