"""Per-key request throttle.

A window opens at a key's first request. A request at least one window length
after the opening opens a new window; otherwise it is allowed while the window
has admitted fewer than the limit. A rejected request changes nothing.

Where windows open depends on request times only, and one window on the next
only through its opening time. A key's times are cut into blocks of a bounded
number, and a block is a function from the window open before it to the window
open after it, so the blocks of one hot key are worked on in parallel:

1. the distinct request times are numbered in one order; a block is so many in a row;
2. every block gives its transfer function, a few steps;
3. neighbouring functions are composed, a bounded number at a time, in rounds until one a key is left;
   back down the rounds, each group hands its members the window open before them;
4. every block lists the windows that open in it;
5. the first requests of every window are admitted, a top-k that combines
   before the shuffle.

No step holds the requests of a key, and no task all blocks of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.functions.times import micros, time_bucket
from lynceus.scale import BROADCAST_BYTES, cut_lineage, join_lookup, numbered

# Requests admitted per window, and the window length.
LIMIT = 10
WINDOW_MICROS = 60_000_000

# Distinct times per block, and functions composed at a time.
BLOCK_TIMES = 4096
FAN_IN = 16

NEVER = np.iinfo(np.int64).min // 2
NO_KEY = "unknown"


def transfer(times: np.ndarray, block_start: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window open after a block for each window open before it, as steps.

    Returns ``(until, start)``: a window that expires at or before ``until[i]``
    (and after ``until[i-1]``) leaves the block in a window opened at
    ``start[i]``. A window that expires after the last request stays open.
    """
    n = len(times)
    after = np.searchsorted(times, times + window, side="left")
    last = np.where(after < n, after, np.arange(n))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    # Windows opened before the block expire within its first window length,
    # so only these requests can open the block's first window.
    reach = min(n, int(np.searchsorted(times, block_start + window, side="left")) + 1)
    ends = last[:reach]
    keep = np.append(ends[1:] != ends[:-1], True)
    return times[:reach][keep], times[ends[keep]]


def composed(first: tuple, then: tuple, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps of two blocks behind each other.

    What the first leaves goes through the second; a window that the first leaves open, as it expires later,
    meets the steps of the second that lie further.
    """
    until, start = first
    i = np.searchsorted(then[0], start + window, side="left")
    found = i < len(then[0])
    left = start.copy()
    left[found] = then[1][i[found]]
    further = then[0] > until[-1] if len(until) else np.ones(len(then[0]), bool)
    until, left = np.concatenate([until, then[0][further]]), np.concatenate([left, then[1][further]])
    keep = np.append(left[1:] != left[:-1], True)[: len(left)]
    return until[keep], left[keep]


def after(steps: tuple, start: int, window: int) -> int:
    """The window open behind a block, given the one open before it."""
    i = int(np.searchsorted(steps[0], start + window, side="left"))
    return int(steps[1][i]) if i < len(steps[0]) else start


def openings(times: np.ndarray, start: int, window: int) -> list[int]:
    """Opening times of the windows that open in a block, given the one open before it."""
    out = []
    i = int(np.searchsorted(times, start + window, side="left"))
    while i < len(times):
        out.append(int(times[i]))
        i = int(np.searchsorted(times, times[i] + window, side="left"))
    return out


def decide(times: np.ndarray, start: int, used: int, window: int, limit: int) -> np.ndarray:
    """Flags of one block's requests, given the window open before it."""
    flags = np.zeros(len(times), dtype=bool)
    i = 0
    end = int(np.searchsorted(times, start + window, side="left"))
    flags[: min(end, max(limit - used, 0))] = True
    i = end
    while i < len(times):
        end = int(np.searchsorted(times, times[i] + window, side="left"))
        flags[i : min(end, i + limit)] = True
        i = end
    return flags


def state_after(times: np.ndarray, start: int, used: int, window: int, limit: int):
    """Window and admitted count after a block, without flags."""
    i = int(np.searchsorted(times, start + window, side="left"))
    used = min(limit, used + i)
    while i < len(times):
        start = int(times[i])
        end = int(np.searchsorted(times, start + window, side="left"))
        used, i = min(limit, end - i), end
    return start, used


_STEPS = "key string, block bigint, until array<bigint>, start array<bigint>"


def _gathered(functions: DataFrame, fan_in: int) -> DataFrame:
    """Functions of up to ``fan_in`` neighbouring blocks of a key in one row."""
    above = F.floor(F.col("block") / fan_in).alias("above")
    return functions.groupBy("key", above).agg(F.sort_array(F.collect_list(F.struct("block", "until", "start"))).alias("parts"))


def _parts(row: list) -> list[tuple[int, tuple]]:
    return [(p["block"], (np.asarray(p["until"], np.int64), np.asarray(p["start"], np.int64))) for p in row]


def _entries(functions: DataFrame, window: int, fan_in: int) -> DataFrame:
    """(key, block, entry): the window open before each block, by composing functions in rounds and handing entries back."""

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for parts in pdf["parts"]:
                steps = _parts(parts)
                whole = steps[0][1]
                for _, one in steps[1:]:
                    whole = composed(whole, one, window)
                rows.append(whole)
            yield pd.DataFrame({"key": pdf["key"], "block": pdf["above"], "until": [r[0] for r in rows], "start": [r[1] for r in rows]})

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, parts, entry in zip(pdf["key"], pdf["parts"], pdf["entry"]):
                for block, steps in _parts(parts):
                    out.append((key, block, entry))
                    entry = after(steps, entry, window)
            yield pd.DataFrame(out, columns=["key", "block", "entry"])

    levels = []
    while True:
        # keys with one block left are done: nothing is open before it
        several = functions.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k")
        functions = functions.join(several, F.col("key") == F.col("k"), "left_semi")
        gathered = cut_lineage(_gathered(functions, fan_in), "throttle-groups")
        if gathered.isEmpty():
            break
        levels.append(gathered)
        functions = cut_lineage(gathered.mapInPandas(up, _STEPS), "throttle-functions")
    entries = None
    for gathered in reversed(levels):
        rows = gathered.withColumn("entry", F.lit(int(NEVER)))
        if entries is not None:
            known = entries.select(F.col("key").alias("k"), F.col("block").alias("b"), F.col("entry").alias("given"))
            rows = gathered.join(known, (F.col("key") == F.col("k")) & (F.col("above") == F.col("b")), "left")
            rows = rows.select("key", "above", "parts", F.coalesce("given", F.lit(int(NEVER))).alias("entry"))
        entries = cut_lineage(rows.mapInPandas(down, "key string, block bigint, entry bigint"), "throttle-entries")
    if entries is None:
        return functions.where("false").select("key", "block", F.lit(0).cast("bigint").alias("entry"))
    return entries


def window_openings(requests: DataFrame, window_micros: int, block_times: int = BLOCK_TIMES, fan_in: int = FAN_IN) -> DataFrame:
    """(key, opened): the windows that the requests (key, t) open."""
    order = numbered(requests.distinct(), ["key", "t"], "pos", "throttle-times")
    block = F.floor(F.col("pos") / block_times).alias("block")
    times = cut_lineage(order.groupBy("key", block).agg(F.sort_array(F.collect_list("t")).alias("t")), "throttle-blocks")

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [transfer(np.asarray(t), int(t[0]), window_micros) for t in pdf["t"]]
            yield pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "until": [r[0] for r in rows], "start": [r[1] for r in rows]})

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, s) for k, t, entry in zip(pdf["key"], pdf["t"], pdf["entry"]) for s in openings(np.asarray(t), entry, window_micros)]
            yield pd.DataFrame(out, columns=["key", "opened"])

    functions = cut_lineage(times.mapInPandas(steps, _STEPS), "throttle-functions")
    entries = _entries(functions, window_micros, fan_in)
    known = entries.select(F.col("key").alias("k"), F.col("block").alias("b"), "entry")
    both = times.join(known, (F.col("key") == F.col("k")) & (F.col("block") == F.col("b")), "left")
    return both.select("key", "t", F.coalesce("entry", F.lit(int(NEVER))).alias("entry")).mapInPandas(opened, "key string, opened bigint")


def throttle(
    requests: DataFrame,
    key: str,
    ts: str,
    request_id: str,
    limit: int = LIMIT,
    window_micros: int = WINDOW_MICROS,
    block_times: int = BLOCK_TIMES,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The requests with ``allowed``. Ties in time go by id; no key counts as one key."""
    timed = requests.select(
        "*",
        F.coalesce(F.col(key).cast("string"), F.lit(NO_KEY)).alias("_key"),
        micros(F.col(ts)).alias("_t"),
    ).withColumn("_bucket", time_bucket(F.col("_t"), window_micros))
    windows = window_openings(
        timed.select(F.col("_key").alias("key"), F.col("_t").alias("t")).where("t IS NOT NULL"), window_micros, block_times
    )
    # a window lies in two buckets of its length at most, and a bucket meets two windows of a key
    ends = [time_bucket(F.col("opened") + late, window_micros) for late in (0, window_micros - 1)]
    buckets = windows.select(F.col("key").alias("_key"), F.col("opened").alias("_window"), F.explode(F.array_distinct(F.array(*ends))).alias("_bucket"))
    inside = (F.col("_t") >= F.col("_window")) & (F.col("_t") < F.col("_window") + window_micros)
    placed = join_lookup(timed, cut_lineage(buckets, "windows"), ["_key", "_bucket"], condition=inside, max_bytes=max_bytes)

    place = F.row_number().over(
        Window.partitionBy("_key", "_window").orderBy("_t", request_id)
    )
    last_admitted = (
        placed.select("_key", "_window", "_t", request_id)
        .withColumn("_place", place)
        .where(F.col("_place") <= limit)
        .groupBy("_key", "_window")
        .agg(F.max(F.struct("_t", F.col(request_id).alias("id"))).alias("_last"))
    )
    decided = join_lookup(
        placed,
        cut_lineage(last_admitted, "admitted"),
        ["_key", "_window"],
        max_bytes=max_bytes
    )
    mine = F.struct(F.col("_t"), F.col(request_id).alias("id"))
    return decided.select(
        *[F.col(c) for c in requests.columns], (mine <= F.col("_last")).alias("allowed")
    )
