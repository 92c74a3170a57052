"""Near-duplicate documents by a chosen-path set similarity join on word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm.components import connected_components
from lynceus.llm.groups import list_rows, sorted_groups
from lynceus.llm.lines import row_key
from lynceus.llm.memo import keep_only
from lynceus.llm.words import begin_task, mixed, window_hashes, word_hashes
from lynceus.scale import cut_lineage, fits_broadcast

SHINGLE = 5
PERCENT = 75
TREES = 6
ROOT_PICKS = 2
LEAF = 4096
DEPTH = 8
POSITIONS = 64
HALF = 2 * POSITIONS
#: Share of equal signature positions from which a pair is checked: over four deviations below the threshold.
ESTIMATE = 0.5
MARGIN = 0.1
GROUP = 4096
HUB_ROUNDS = 6
_ROWS = 2048
_CHECKED = 256
_rng = np.random.default_rng(3)
_FLIP = _rng.integers(0, 1 << 63, POSITIONS, np.uint64)
_SPREAD = _rng.integers(0, 1 << 63, POSITIONS, np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    h = word_hashes(words)
    if not words:
        return h
    if len(words) < SHINGLE:
        return mixed(window_hashes(h, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(h, SHINGLE))


def signature(sets: np.ndarray) -> bytes:
    """The least scrambled hash of the set at each position, in 32 bits: all upper halves, then all lower ones.

    The upper halves alone serve to estimate similarity; unequal tokens share one with a chance of 2**-16.
    """
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sets), _ROWS):
        least = np.minimum(least, ((sets[i : i + _ROWS, None] ^ _FLIP) * _SPREAD).min(axis=0))
    return (least >> np.uint64(48)).astype("<u2").tobytes() + (least >> np.uint64(32)).astype("<u2").tobytes()


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin_task()
    for batch in batches:
        sizes, first, second, signs = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            sizes.append(len(s))
            first.append(digest[0])
            second.append(digest[1])
            signs.append(signature(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(signs, pa.binary())],
            ["doc", "row", "n", "f1", "f2", "sig"],
        )


def _set_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin_task()
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            rows = [shingles(t) for t in part.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            values = np.concatenate([np.empty(0, np.uint64), *rows]).view(np.int64)
            signs = pa.array([signature(r)[:HALF] for r in rows], pa.binary())
            hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([part.column(0), hashes, signs], ["of", "hashes", "set_sig"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 75 * union, on whole sets."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The upper halves of signatures, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, POSITIONS)


def _leaf_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small nodes, exhaustively: a forest over the members whose signatures make a check worth while."""
    keep_only()
    a, b = [], []
    for group in sorted_groups(batches, "node"):
        ids, sig = group["class_id"].to_pylist(), _matrix(group["sig"])
        label = np.arange(len(ids))
        for i in range(1, len(ids)):
            close = label[:i][(sig[:i] == sig[i]).mean(axis=1) >= ESTIMATE]
            for j in np.unique(close).tolist():
                label[label == j] = i
                a.append(ids[i])
                b.append(ids[j])
        if len(a) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group on full sets.

    Members are taken in blocks. In a block pairs are taken from the highest estimate down, a level at a time, so only a
    block's estimates are held. A pair that other links connect already needs no check, so a group of alike documents
    costs about one check a member. Members with role 0 are compared with those of role 1; without role 1, with each other.
    """
    keep_only()
    for group in sorted_groups(batches, "task"):
        ids, sets, sig = group["member"].to_pylist(), list_rows(group["hashes"], np.int64), _matrix(group["set_sig"])
        role = group["role"].to_numpy()
        others = np.flatnonzero(role == 1)
        name = {x: k for k, x in enumerate(dict.fromkeys(ids))}
        label = np.array([name[x] for x in ids], np.int64)
        a, b = [], []
        mine = np.flatnonzero(role == 0)
        for start in range(0, len(mine), _CHECKED):
            block = mine[start : start + _CHECKED]
            equal = np.zeros((len(block), len(ids)), np.uint8)
            for k, i in enumerate(block.tolist()):
                against = others if len(others) else np.arange(i)
                equal[k, against] = (sig[against] == sig[i]).sum(axis=1, dtype=np.uint8)
            for level in range(POSITIONS, int(np.ceil(ESTIMATE * POSITIONS)) - 1, -1):
                for k, j in np.argwhere(equal == level).tolist():
                    i = int(block[k])
                    if label[i] != label[j] and alike(sets[i], sets[j]):
                        label[label == label[i]] = label[j]
                        a.append(ids[i])
                        b.append(ids[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _estimate(a: Column, b: Column) -> Column:
    def share(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array((_matrix(x) == _matrix(y)).mean(axis=1) if len(x) else [], pa.float64())

    return F.arrow_udf(share, "double")(a, b)


def _key(node: Column, position: Column) -> Column:
    """The child node that a document of ``node`` goes to by its token at a position."""
    at = 2 * position + 1
    return F.xxhash64(node, position, F.substring("sig", at, F.lit(2)), F.substring("sig", HALF + at, F.lit(2)))


def _upper() -> Column:
    return F.substring("sig", 1, HALF)


def _roots() -> Column:
    """First-level nodes: in each tree one for each of its own positions."""
    return F.array(*[_key(F.lit(-1 - t), F.lit(ROOT_PICKS * t + k)) for t in range(TREES) for k in range(ROOT_PICKS)])


def _children() -> Column:
    """Child nodes by two different positions of the node's choice and, in every third node, by a third.

    A pair at the threshold shares 1.75 of them on average, so its paths grow in number with the depth and
    all of them end with a chance of under 1 in 10,000 at any depth.
    """
    draw = lambda k, n: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(n)).cast("int")
    first, third = draw(0, POSITIONS), draw(3, POSITIONS)
    second = F.pmod(first + 1 + draw(1, POSITIONS - 1), F.lit(POSITIONS)).cast("int")
    two = [_key(F.col("node"), p) for p in (first, second)]
    return F.when(draw(2, 3) == 0, F.array(*two, _key(F.col("node"), third))).otherwise(F.array(*two))


def _summary(rows: DataFrame) -> DataFrame:
    """Size, hub and a digest of the members of each node."""
    return rows.groupBy("node").agg(
        F.count("*").alias("size"),
        F.min("class_id").alias("hub"),
        F.bit_xor(F.xxhash64("class_id")).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit(1), "class_id")).alias("x2"),
    ).where("size > 1")


def _of(rows: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    return rows.join(nodes.select(F.col("node").alias("in_node"), *more), F.col("node") == F.col("in_node")).drop("in_node")


def _small(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the small nodes; of nodes with the same members, one."""
    once = nodes.where(F.col("size") <= LEAF).groupBy("size", "x1", "x2").agg(F.min("node").alias("node"))
    return _of(rows, once)


def _leaves(rows: DataFrame, signs: DataFrame) -> DataFrame:
    with_sig = rows.join(signs.withColumn("sig", _upper()), F.col("class_id") == F.col("signed")).select("node", "class_id", "sig")
    found = with_sig.repartition("node").sortWithinPartitions("node").mapInArrow(_leaf_links, "a bigint, b bigint")
    return cut_lineage(found, "candidates")


def _chunk_pairs(rows: DataFrame) -> DataFrame:
    """Crowded nodes that paths no longer split, as pairs of chunks: every two members meet in a small node."""
    sizes = rows.groupBy(F.col("node").alias("in_node")).agg(F.ceil(F.count("*") * 3 / LEAF).cast("int").alias("chunks"))
    cut = rows.join(sizes, F.col("node") == F.col("in_node")).withColumn(
        "chunk", F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int")
    )
    others = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda j: F.xxhash64("node", F.least("chunk", j), F.greatest("chunk", j)),
    )
    return cut.select(F.explode(others).alias("node"), "class_id")


def _hub_step(big: DataFrame, signs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compares all members of each crowded node with its hub: candidates, and the rows of the next level.

    A member near the hub leaves its node if nothing that is not near the hub can be within the
    threshold of it. Jaccard distance is a metric, so that holds where its
    estimate exceeds the largest estimate of a member not near the hub by the
    threshold and a margin at both. The hub itself always leaves.
    """
    upper = signs.withColumn("sig", _upper())
    hubs = upper.select(F.col("signed").alias("hub_id"), F.col("sig").alias("hub_sig"))
    near = big.join(upper, F.col("class_id") == F.col("signed")).join(hubs, F.col("hub") == F.col("hub_id"))
    near = cut_lineage(near.select("node", "class_id", "hub", _estimate(F.col("sig"), F.col("hub_sig")).alias("estimate")), "hub-estimates")
    far = near.where(F.col("estimate") < ESTIMATE).groupBy(F.col("node").alias("in_node")).agg(F.max("estimate").alias("most"))
    bound = F.coalesce("most", F.lit(-1.0)) + (1 - PERCENT / 100) + 2 * MARGIN
    stay = near.join(far, F.col("node") == F.col("in_node"), "left").where(
        (F.col("class_id") != F.col("hub")) & ((F.col("estimate") < ESTIMATE) | (F.col("estimate") <= bound))
    )
    candidates = near.where((F.col("estimate") >= ESTIMATE) & (F.col("class_id") != F.col("hub"))).select(
        F.col("class_id").alias("a"), F.col("hub").alias("b")
    )
    rows = stay.select("node", "class_id").join(signs, F.col("class_id") == F.col("signed"))
    return candidates, cut_lineage(rows.select(F.explode(_children()).alias("node"), "class_id").distinct(), "paths")


def _candidates(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) worth a check that connect all pairs which share a small node of some tree."""
    signs = classes.select(F.col("class_id").alias("signed"), "sig")
    rows = classes.select(F.explode(_roots()).alias("node"), "class_id")
    found: DataFrame | None = None
    for level in range(DEPTH + 1):
        nodes = cut_lineage(_summary(rows), "nodes")
        leaves = _leaves(_small(rows, nodes), signs)
        found = leaves if found is None else found.unionAll(leaves)
        crowded = nodes.where(F.col("size") > LEAF)
        if crowded.isEmpty():
            return found
        big = cut_lineage(_of(rows, crowded, "hub"), "crowded")
        if level == DEPTH:
            return found.unionAll(_leaves(_chunk_pairs(big.select("node", "class_id")), signs))
        near, rows = _hub_step(big, signs)
        found = found.unionAll(near)
    return found


def _small_side(numbers: DataFrame, purpose: str) -> DataFrame:
    """Rows of a few numbers, written once, so that their size is known: broadcast where it measures small, else joined."""
    numbers = cut_lineage(numbers, purpose)
    return F.broadcast(numbers) if fits_broadcast(numbers) else numbers


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are links on full sets."""
    mine, theirs = (sets.select(F.col("of").alias(f"of_{c}"), F.col("hashes").alias(f"hashes_{c}")) for c in "ab")
    both = pairs.join(mine, F.col("a") == F.col("of_a")).join(theirs, F.col("b") == F.col("of_b"))
    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    sized = both.select("a", "b", common.alias("common"), (F.size("hashes_a") + F.size("hashes_b")).alias("sum"))
    return sized.where(100 * F.col("common") >= PERCENT * (F.col("sum") - F.col("common"))).select("a", "b")


def _checked(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within the tasks (task, member, role), members of which are compared in one Python task each."""
    tasks = _small_side(tasks, "tasks")
    rows = tasks.join(sets, F.col("member") == F.col("of")).select("task", "member", "role", "hashes", "set_sig")
    return cut_lineage(rows.repartition("task").sortWithinPartitions("task").mapInArrow(_verified, "a bigint, b bigint"), "links")


def _crowded_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of groups too large for one task.

    In each round one hub a group is checked against all members outside its component; only components
    matter, so members that links connect already are not compared. From the second round on the hub
    comes from outside the group's largest component. What is outside it after the last
    round is checked against the whole group, in blocks.
    """
    links = members.sparkSession.createDataFrame([], "a bigint, b bigint")
    for turn in range(HUB_ROUNDS + 1):
        labels = connected_components(links, "a", "b", "labels") if turn else links.select(F.col("a").alias("id"), F.col("b").alias("component"))
        named = members.join(labels, F.col("member") == F.col("id"), "left").select(
            "comp", "member", F.coalesce("component", "member").alias("label")
        )
        named = cut_lineage(named, "labels")
        counts = named.groupBy(F.col("comp").alias("g"), "label").agg(F.count("*").alias("n"))
        main = counts.groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
        if main.isEmpty():
            return links
        open_rows = cut_lineage(named.join(main, F.col("comp") == F.col("g")).select("comp", "member", "label", "main"), "open")
        if turn == HUB_ROUNDS:
            break
        pick = open_rows.where("label != main") if turn else open_rows
        hubs = pick.groupBy(F.col("comp").alias("g")).agg(F.min(F.struct("member", "label")).alias("hub"))
        pairs = open_rows.join(hubs, F.col("comp") == F.col("g")).where("label != hub.label").select(
            F.col("member").alias("a"), F.col("hub.member").alias("b")
        )
        links = links.unionAll(cut_lineage(_exact(pairs, sets), "links"))
    half = GROUP // 2
    sizes = open_rows.groupBy(F.col("comp").alias("g")).agg(
        F.ceil(F.count("*") / half).cast("int").alias("all_chunks"),
        F.ceil(F.sum((F.col("label") != F.col("main")).cast("int")) / half).cast("int").alias("out_chunks"),
    )
    cut = open_rows.join(sizes, F.col("comp") == F.col("g"))
    at = lambda n: F.pmod(F.xxhash64("member"), F.col(n)).cast("int")
    spread = lambda n, key, role: F.transform(
        F.sequence(F.lit(0), F.col(n) - 1), lambda j: F.struct(key(j).alias("task"), F.lit(role).alias("role"))
    )
    queries = spread("all_chunks", lambda j: F.xxhash64("comp", at("out_chunks"), j), 0)
    whole = spread("out_chunks", lambda j: F.xxhash64("comp", j, at("all_chunks")), 1)
    tasks = cut.select("member", F.explode(F.when(F.col("label") != F.col("main"), F.concat(queries, whole)).otherwise(whole)).alias("to"))
    return links.unionAll(_checked(tasks.select("to.task", "member", "to.role"), sets))


def document_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept.

    Documents with equal shingle sets are one class, with a signature of 64
    minwise tokens. In each of six independent trees a class goes down two paths
    from the root, one for its token at each of two positions, and 7/3 on average
    from every later node. A node of up to 4096 classes is compared exhaustively by
    signature. In a larger one all members are compared with its hub, what that
    settles leaves, and the rest branches on; what is still crowded after eight levels
    is compared in pairs of chunks. Connected candidates are a group, and a group is verified
    on full sets: in one task up to 4096 classes, beyond that with hubs and in blocks.
    A pair at the threshold shares a first-level node with a chance of 1 - 0.25**12. Where all nodes of its
    shared tokens are crowded, all its paths end within eight levels with a chance of 1.5e-5 by calculation.
    A link is only what full sets confirm; groups give spanning links, not all pairs.

    Null texts and texts without words have no shingles and link with nothing. Rows of null id
    link with nothing: component null, kept. Rows that repeat an id are one
    document of the group; each is returned. Other columns are not read. An empty table
    gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("text_row", row_key(F.col("text")))
    sketches = cut_lineage(
        texts.select("doc", "text", "text_row").mapInArrow(_sketched, "doc bigint, row bigint, n bigint, f1 bigint, f2 bigint, sig binary"),
        "sketches",
    )
    classes = cut_lineage(
        sketches.where("n > 0 AND doc IS NOT NULL").groupBy("n", "f1", "f2").agg(
            F.min("doc").alias("class_id"), F.min_by("row", "doc").alias("row"), F.first("sig").alias("sig")
        ),
        "classes",
    )
    groups = connected_components(_candidates(classes), "a", "b", "candidate-groups")
    members = groups.select(F.col("id").alias("member"), F.col("component").alias("comp"))
    members = members.unionAll(groups.select(F.col("component").alias("member"), F.col("component").alias("comp")).distinct())
    sizes = members.groupBy(F.col("comp").alias("g")).agg(F.count("*").alias("size"))
    members = cut_lineage(members.join(sizes, F.col("comp") == F.col("g")).select("comp", "member", "size"), "groups")

    wanted = classes.select("class_id", "row").join(members.select("member"), F.col("class_id") == F.col("member"))
    same = (F.col("doc") == F.col("class_id")) & (F.col("text_row") == F.col("row"))
    # the representatives of candidate groups are few rows of two numbers: where they measure small, no text is shuffled
    wanted = _small_side(wanted, "wanted-sets")
    sets = texts.join(wanted, same).select("doc", "text").mapInArrow(_set_rows, "of bigint, hashes array<bigint>, set_sig binary")
    sets = cut_lineage(sets, "shingle-sets")
    links = _checked(members.where(F.col("size") <= GROUP).select(F.col("comp").alias("task"), "member", F.lit(0).alias("role")), sets)
    large = members.where(F.col("size") > GROUP)
    if not large.isEmpty():
        links = links.unionAll(_crowded_links(large.select("comp", "member"), sets))
    components = connected_components(links, "a", "b")
    named = classes.select(F.col("n").alias("c_n"), F.col("f1").alias("c_1"), F.col("f2").alias("c_2"), "class_id").join(
        components, F.col("class_id") == F.col("id"), "left"
    )
    same = (F.col("n") == F.col("c_n")) & (F.col("f1") == F.col("c_1")) & (F.col("f2") == F.col("c_2")) & F.col("doc").isNotNull()
    component = F.coalesce("component", "class_id", "doc")
    return sketches.join(named, same, "left").select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )
