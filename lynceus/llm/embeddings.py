"""Near-duplicate vectors by pairs of compact chunks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm.components import Forest, connected_components
from lynceus.llm.groups import list_rows
from lynceus.scale import bound_batches, cut_lineage

MIN_COSINE = 0.95
GRID_DIMS = 4
# Rotated dimensions in which pairs are tried, and boxes of chunks are held.
HEAD_DIMS = 128
CHUNK = 4096
# Numbers that a chunk of long vectors holds.
CHUNK_VALUES = 1 << 20
TILE = 1024
ROTATION_SEED = 5
# Squared distances in single precision are off by less, in up to HEAD_DIMS dimensions.
MARGIN = 1e-4
# Vectors that a task knows to have sent already.
MEMO = 100_000
# Numbers that candidates are gathered into at once.
GATHERED = 1 << 22


@lru_cache(maxsize=8)
def directions(dims: int) -> np.ndarray:
    """Fixed directions of signs, whose products with a vector are the same on every machine."""
    return np.random.default_rng(ROTATION_SEED).integers(0, 2, size=(dims, min(GRID_DIMS, dims))) * 2.0 - 1.0


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation, whose first axes are along the directions; distances stay, and all other axes get a like share of them."""
    axes = np.random.default_rng(ROTATION_SEED + 1).normal(size=(dims, dims))
    axes[:, : min(GRID_DIMS, dims)] = directions(dims)
    return np.linalg.qr(axes)[0]


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cells(rows: np.ndarray, min_cosine: float) -> np.ndarray:
    """A number for each vector's grid cell along the directions; neighbours in order are near each other there.

    It is taken column by column, so that a vector has the same one in whatever batch it comes.
    """
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    along, square = np.zeros((len(rows), min(GRID_DIMS, rows.shape[1]))), np.zeros(len(rows))
    for j, signs in enumerate(directions(rows.shape[1])):
        along += rows[:, j, None] * signs
        square += rows[:, j] * rows[:, j]
    steps = np.floor(along / np.sqrt(square * rows.shape[1] * (2 - 2 * min_cosine) / 4)[:, None])
    out = np.zeros(len(rows), np.int64)
    for step in np.clip(steps, -(1 << 14), (1 << 14) - 1).astype(np.int64).T:
        out = (out << 15) + step
    return out


def _placed(min_cosine: float, sent: bool):
    """The length and cell of each vector; with ``sent`` also the vector, which a task sends once, without its id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if sent:
                keys = batch.column("vec_key").to_pylist()
                new = []
                for i, key in enumerate(keys):
                    if key not in seen:
                        new.append(i)
                        seen.add(key)
                seen = seen if len(seen) <= MEMO else set()
                batch = batch.take(pa.array(new, pa.int64()))
            vectors = list_rows(pa.chunked_array([batch.column("vector")]), np.float64)
            by_dims: dict[int, list[int]] = {}
            for i, (v, known) in enumerate(zip(vectors, batch.column("vec_key").is_valid().to_pylist())):
                if known:
                    by_dims.setdefault(len(v), []).append(i)
            dims, cell = np.zeros(len(vectors), np.int32), np.zeros(len(vectors), np.int64)
            for n, at in by_dims.items():
                dims[at] = n
                cell[at] = cells(np.array([vectors[i] for i in at]), min_cosine)
            kept = ["vec_key", "vector"] if sent else ["vec_id", "vec_key"]
            yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(cell), *[batch.column(c) for c in kept]], ["dims", "cell", *kept])

    return run


def _box(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turned = unit @ rotation(unit.shape[1])[:, :HEAD_DIMS]
    return turned.min(axis=0), turned.max(axis=0)


_CHUNK = "chunk bigint, dims int, low array<double>, high array<double>, keys binary, names binary, copies binary, vectors binary"


def _chunks(kind: type):
    """Rows sorted by length, cell and class as chunks of at most ``CHUNK`` classes of one length, with the box that holds them.

    Of each class the rows with its vector come first, then the one with its count.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, length = TaskContext.get().partitionId(), 0, 0
        keys: list[int] = []
        names: list[int] = []
        copies: list[int] = []
        vectors: list[np.ndarray] = []

        def chunk() -> pa.RecordBatch:
            nonlocal made, keys, names, copies, vectors
            held = np.array(vectors).astype(kind)
            low, high = _box(_unit(held))
            packed = [np.array(x, np.int64).tobytes() for x in (keys, names, copies)]
            row = [(part << 33) + made, length, low.tolist(), high.tolist(), *packed, held.tobytes()]
            made, keys, names, copies, vectors = made + 1, [], [], [], []
            types = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], [c.split()[0] for c in _CHUNK.split(", ")])

        last, vector = None, None
        for batch in batches:
            rows = list_rows(pa.chunked_array([batch.column("vector")]), np.float64)
            for v, n, key, name, count in zip(rows, *[batch.column(c).to_pylist() for c in ("dims", "vec_key", "class_id", "copies")]):
                if name is None:
                    # of a vector that several tasks sent one is taken
                    if key != last:
                        last, vector = key, v
                    continue
                if keys and (n != length or len(keys) >= max(1, min(CHUNK, CHUNK_VALUES // length))):
                    yield chunk()
                length = n
                keys.append(key)
                names.append(name)
                copies.append(count)
                vectors.append(vector)
        if keys:
            yield chunk()

    return run


class _Held:
    """The vectors of a chunk: unit vectors, and rows whose products are minus half the squared distances in the head."""

    def __init__(self, rows: np.ndarray):
        self.unit = _unit(rows)
        self.whole = rows.shape[1] <= HEAD_DIMS
        turned = self.unit @ rotation(rows.shape[1])[:, :HEAD_DIMS]
        half, one = (turned**2).sum(axis=1, keepdims=True) / -2, np.ones((len(rows), 1))
        self.left, self.right = (np.hstack([turned, *more]).astype(np.float32) for more in ((half, one), (one, half)))
        cut = range(0, len(rows), TILE)
        self.low, self.high = (np.array([f(turned[i : i + TILE], axis=0) for i in cut]) for f in (np.min, np.max))


def near_pairs(a: _Held, b: _Held | None, min_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with the least cosine; ``b`` None compares ``a`` with itself.

    Tiles whose boxes are too far apart are left out. Distances in the head are taken in single precision;
    what is within the margin of the limit, or longer than the head, is checked in double.
    """
    itself = b is None
    b = a if b is None else b
    limit = 2 - 2 * min_cosine
    for i in range(0, len(a.unit), TILE):
        gaps = np.maximum(0, np.maximum(a.low[i // TILE] - b.high, b.low - a.high[i // TILE]))
        near = (gaps**2).sum(axis=1) <= limit + MARGIN
        for j in range(i if itself else 0, len(b.unit), TILE):
            if not near[j // TILE]:
                continue
            found = a.left[i : i + TILE] @ b.right[j : j + TILE].T
            within = found >= np.float32(-(limit + MARGIN) / 2)
            if not within.any():
                continue
            p, q = np.nonzero(within)
            sure = found[p, q] >= np.float32(-(limit - MARGIN) / 2) if a.whole else np.zeros(len(p), bool)
            p, q = p + i, q + j
            if itself:
                once = p < q
                p, q, sure = p[once], q[once], sure[once]
            tried = np.flatnonzero(~sure)
            step = max(1, GATHERED // a.unit.shape[1])
            for k in range(0, len(tried), step):
                at = tried[k : k + step]
                sure[at] = np.einsum("ij,ij->i", a.unit[p[at]], b.unit[q[at]]) >= min_cosine
            if sure.any():
                yield p[sure], q[sure]


def _linked(forest: Forest, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Joins the names of pairs; a pair of one tree is not looked at again, so dense groups cost a few rounds."""
    root = lambda names, at: (lambda u, back: np.array([forest.find(x) for x in names[u].tolist()], np.int64)[back])(*np.unique(at, return_inverse=True))
    while len(p):
        apart = root(a, p) != root(b, q)
        p, q = p[apart], q[apart]
        first = np.unique(p, return_index=True)[1]
        for x, y in zip(a[p[first]].tolist(), b[q[first]].tolist()):
            forest.join(x, y)


def _joined(kind: type, min_cosine: float):
    """Pairs of chunks; links are summed, and trees grown, over all pairs of a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sums, last = Forest(), {}, (None, None)
        for batch in batches:
            for row in range(batch.num_rows):
                side = lambda s: [batch.column(f"{c}{s}")[row].as_py() for c in ("chunk", "dims", "keys", "names", "copies", "vectors")]  # noqa: B023, E731
                (left, dims, *mine), (right, _, *other) = side(""), side("_b")
                of = lambda packed: _Held(np.frombuffer(packed[3], kind).reshape(-1, dims))  # noqa: B023, E731
                ints = lambda packed: [np.frombuffer(x, np.int64) for x in packed[:3]]
                if last[0] != left:
                    last = left, of(mine)
                (ka, na, ca), (kb, nb, cb) = ints(mine), ints(other)
                sum_a = sums.setdefault(left, (ka, np.zeros(len(ka), np.int64)))[1]
                sum_b = sums.setdefault(right, (kb, np.zeros(len(kb), np.int64)))[1]
                for p, q in near_pairs(last[1], None if left == right else of(other), min_cosine):
                    np.add.at(sum_a, p, cb[q])
                    np.add.at(sum_b, q, ca[p])
                    _linked(forest, na, nb, p, q)
        names = ["vec_key", "links", "a", "b"]
        for key, links in sums.values():
            some = np.flatnonzero(links)
            if len(some):
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(links[some]), none, none], names)
        below = list(forest.up)
        for i in range(0, len(below), 50_000):
            part = below[i : i + 50_000]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(part, pa.int64()), pa.array([forest.find(x) for x in part], pa.int64())], names)

    return run


def _gap() -> Column:
    """The squared distance of the boxes of two chunks."""
    off = lambda i: F.greatest(F.get("low", i) - F.get("high_b", i), F.get("low_b", i) - F.get("high", i), F.lit(0.0))
    return F.aggregate(F.sequence(F.lit(0), F.size("low") - 1), F.lit(0.0), lambda sum_, i: sum_ + off(i) * off(i))


def embedding_links(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors are one class with a count. Unit vectors are sorted by the cells of a grid, whose neighbours are near each other,
    and cut into chunks. Pairs of chunks are tasks that read both from the one table of chunks, so no vector travels more than
    once however many others it is compared with, and a task holds a bounded number of chunks. Chunks and tiles whose boxes
    are further apart than the least cosine allows are left out. A pair is compared once, in single precision, and in
    double where that could decide; links are sums by vector, so counts need no list of pairs, and leave a task as a spanning forest.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows of
    null id, link with nothing: no links, a component of their own, kept. Vectors
    of different lengths don't link. Rows that repeat an id and vector count once and
    each get that vector's result. Other columns are not read. An empty table gives an
    empty result.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.col("vec_id").isNotNull() & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vec_key", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("vector")))
    bound_batches(vectors.sparkSession)
    kind = np.float32 if _is_float(vectors, vector_col) else np.float64
    places = rows.mapInArrow(_placed(min_cosine, False), "dims int, cell bigint, vec_id bigint, vec_key bigint")
    places = cut_lineage(places, "vector-places")
    classes = places.where("vec_key IS NOT NULL").groupBy("vec_key", "vec_id").agg(F.min("dims").alias("dims"), F.min("cell").alias("cell"))
    classes = classes.groupBy("vec_key").agg(
        F.min("dims").alias("dims"), F.min("cell").alias("cell"), F.min("vec_id").alias("class_id"), F.count("*").alias("copies")
    )
    classes = cut_lineage(classes, "vector-classes")
    stored = f"array<{'float' if kind is np.float32 else 'double'}>"
    usable = rows.where("vec_key IS NOT NULL").select("vec_key", F.col("vector").cast(stored).alias("vector"))
    sent = usable.mapInArrow(_placed(min_cosine, True), f"dims int, cell bigint, vec_key bigint, vector {stored}")
    counted = classes.select("dims", "cell", "vec_key", F.lit(None).cast(stored).alias("vector"), "class_id", "copies")
    none = [F.lit(None).cast("bigint").alias(c) for c in ("class_id", "copies")]
    place = ["dims", "cell", "vec_key"]
    chunks = sent.select("*", *none).unionAll(counted).repartitionByRange(-(-classes.count() // CHUNK) or 1, *place)
    chunks = cut_lineage(chunks.sortWithinPartitions(*place, F.col("class_id").asc_nulls_first()).mapInArrow(_chunks(kind), _CHUNK), "vector-chunks")
    # each pair of chunks once, in the task of either side
    turn = F.pmod(F.xxhash64(F.least("chunk", "chunk_b"), F.greatest("chunk", "chunk_b")), F.lit(2)) == 0
    once = (F.col("chunk") == F.col("chunk_b")) | ((F.col("chunk") < F.col("chunk_b")) == turn) & (F.col("chunk") != F.col("chunk_b"))
    alike = F.abs(F.col("dims") - F.col("dims_b")) < 1
    other = chunks.select(*[F.col(c).alias(f"{c}_b") for c in chunks.columns]).hint("shuffle_replicate_nl")
    pairs = chunks.join(other, once & alike & (_gap() <= 2 - 2 * min_cosine + MARGIN)).drop("low", "high", "low_b", "high_b")
    found = pairs.mapInArrow(_joined(kind, min_cosine), "vec_key bigint, links bigint, a bigint, b bigint")
    found = cut_lineage(found, "vector-links")
    links = found.where("links IS NOT NULL").groupBy(F.col("vec_key").alias("k")).agg(F.sum("links").alias("links"))
    components = connected_components(found.where("a IS NOT NULL"), "a", "b", "vector-components")
    results = (
        classes.select("vec_key", "class_id", "copies")
        .join(links, F.col("vec_key") == F.col("k"), "left")
        .join(components, F.col("class_id") == F.col("id"), "left")
        .select(
            F.col("vec_key").alias("of_key"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "class_id").alias("component"),
        )
    )
    return places.select("vec_id", "vec_key").join(results, F.col("vec_key") == F.col("of_key"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def _is_float(vectors: DataFrame, vector_col: str) -> bool:
    return vectors.schema[vector_col].dataType.simpleString() == "array<float>"
