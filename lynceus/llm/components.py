"""Connected components of a link table, by star contraction."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.scale import cut_lineage

TASK_LINKS = 250_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    below = list(forest.up)
    for i in range(0, len(below), 50_000):
        part = below[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array([forest.find(x) for x in part], pa.int64())], ["u", "v"]
        )


def _towards(pairs: DataFrame) -> DataFrame:
    """Links as (larger, smaller), each once."""
    return (
        pairs.where("u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(links: DataFrame, a: str, b: str, purpose: str = "components") -> DataFrame:
    """(id, component) for every linked id that is not the smallest of its component.

    Each task reduces its own links to a forest, which keeps connectivity. Forests
    of up to ``TASK_LINKS`` links a task are then merged; where that is one task, it is
    done. Otherwise large-star and small-star rounds follow until nothing changes or
    what is left fits a task. Each step is written to the shared folder, so a lost
    executor costs one step. A hub's links meet only in partial minima and in joins
    that Spark can split. Links with a null end are ignored; an empty table gives an empty result.
    """
    pairs = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
    pairs = pairs.where("u IS NOT NULL AND v IS NOT NULL AND u != v")
    now = cut_lineage(pairs.mapInArrow(_contract, "u bigint, v bigint"), purpose)
    state: tuple | None = None
    while True:
        tasks = -(-now.count() // TASK_LINKS)
        now = cut_lineage(now.coalesce(max(tasks, 1)).mapInArrow(_contract, "u bigint, v bigint"), purpose)
        if tasks <= 1:
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(_towards(large), purpose)
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select(F.col("w").alias("u"), F.col("m").alias("v"))
        )
        now = cut_lineage(_towards(small), purpose)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
