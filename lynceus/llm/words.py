"""Words, their hashes and the hashes of word windows, inside tasks.

A word is a run of bytes other than the six ASCII space characters, which is
what ``bytes.split()`` returns. Hashes have 64 bits; two different sequences
are taken for equal with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import xxhash

from lynceus.llm.memo import Memo, keep_only

SPACES = " \t\n\x0b\x0c\r"
MULTIPLIER = 0x9E3779B97F4A7C15


_HASHES = Memo(xxhash.xxh64_intdigest, limit=100_000)


def begin_task() -> None:
    """Empties the memories of other operators."""
    keep_only(_HASHES)


def split_words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values, so that their order says nothing."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(MULTIPLIER, n, 1 << 64))


def window_hashes(w: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive values, built from windows of doubling width."""
    if width < 1 or len(w) < width:
        return np.empty(0, np.uint64)
    out, done, part, size = None, 0, w, 1
    while True:
        if width & size:
            if out is None:
                out = part
            else:
                n = len(w) - done - size + 1
                out = out[:n] * _power(size) + part[done : done + n]
            done += size
        if done == width:
            return mixed(out)
        part = part[:-size] * _power(size) + part[size:]
        size *= 2


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a window that begins at one of the distinct starts."""
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    np.subtract.at(edge, starts + width, 1)
    return np.cumsum(edge[:n]) > 0
