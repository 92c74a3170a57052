"""Merkle manifest of a dataset: a tree for each group, a tree over the groups, a proof for every row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.scale import cut_lineage, fits_broadcast, join_lookup, salted_join

FAN_OUT = 3
BLOCK_LEVELS = 5
# From this distance on a pointer may be shared by so many nodes that a plain join is uneven.
SALT_FROM = 16
TOP = "2"
NODE = ("tree", "level", "pos")


def digest(text: Column) -> Column:
    """H: lower-case hex SHA-256."""
    return F.sha2(text.cast("binary"), 256)


def record_digest(*values: Column) -> Column:
    """H of all values in a row, each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return digest(F.concat(*parts))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda at, s: digest(F.concat(s["before"], at, s["after"])))


def proof_digest(steps: Column) -> Column:
    """H of all siblings, level by level and left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""))


def _beside(level: Column, i: Column) -> tuple[Column, Column]:
    """Siblings of node ``i`` in its run, joined: those before and those after it."""
    place = i % FAN_OUT
    before = F.array_join(F.slice(level, i - place + 1, place), "")
    return before, F.array_join(F.slice(level, i + 2, FAN_OUT - 1 - place), "")


def _with_steps(level: Column) -> Column:
    """The nodes of a level with their number and the step that each adds to a proof."""

    def node(value: Column, i: Column) -> Column:
        before, after = _beside(level, i)
        steps = F.array(F.struct(before.alias("before"), after.alias("after")))
        return F.struct(i.alias("i"), value.alias("digest"), steps.alias("steps"))

    return F.transform(level, node)


def _raised(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN_OUT).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(level, i * FAN_OUT + 1, FAN_OUT), "")))


def _placed(items: DataFrame) -> DataFrame:
    """``items`` (tree, k, digest, load) with their position in the tree and the tree's size.

    Rows are range-partitioned by tree and key, so a tree of any size spreads
    over tasks; a row's position is its place in the partition and the counts of the
    partitions before. Equal keys are ordered by digest, wholly equal rows by a running number.
    """
    by = ["tree", "k", "digest", "again"]
    items = cut_lineage(items.withColumn("again", F.monotonically_increasing_id()), "merkle-leaves")
    order = [F.col(c).asc_nulls_first() for c in by]
    rows = items.repartitionByRange(*order).sortWithinPartitions(*order)
    # a partition's number in the high bits, a row's in the low 33
    rows = cut_lineage(rows.select("tree", "digest", "load", F.monotonically_increasing_id().alias("place")), "merkle-order")
    rows = rows.select(
        "tree", "digest", "load", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("row")
    )
    counts = rows.groupBy("tree", "part").agg(F.min("row").alias("from"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part")
    counts = counts.select(
        "tree", "part", (F.sum("n").over(before) - F.col("n") - F.col("from")).alias("shift"),
        F.sum("n").over(Window.partitionBy("tree")).alias("size"),
    )
    placed = join_lookup(rows, cut_lineage(counts, "merkle-counts"), ["tree", "part"])
    return placed.select("tree", (F.col("row") + F.col("shift")).alias("pos"), "size", "digest", "load")


def _climbed(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves, inner nodes and roots of all trees of placed rows.

    A block of 3**5 neighbours is raised five levels inside one row; what comes out
    is the next pass's input. So a pass shuffles once, and no row grows with a tree.
    Leaves: tree, pos, digest, load, steps (their first, none for a lone leaf). Nodes: tree, level,
    pos, steps, without the roots. Roots: tree, height, digest.
    """
    nodes, roots, leaves, base = [], [], None, 0
    while True:
        at = rows.select("tree", "pos", "size", F.struct("pos", "digest", "load").alias("x"))
        block = F.floor(F.col("pos") / FAN_OUT**BLOCK_LEVELS).alias("block")
        blocks = at.groupBy("tree", block).agg(F.first("size").alias("n0"), F.sort_array(F.collect_list("x")).alias("x"))
        blocks = blocks.withColumn("l0", F.transform("x", lambda x: x["digest"]))
        for j in range(BLOCK_LEVELS):
            blocks = blocks.withColumn(f"n{j + 1}", F.ceil(F.col(f"n{j}") / FAN_OUT)).withColumn(f"l{j + 1}", _raised(F.col(f"l{j}")))
        blocks = cut_lineage(blocks, "merkle-blocks")
        for j in range(BLOCK_LEVELS):
            level, n = F.col(f"l{j}"), F.col(f"n{j}")
            exists = F.lit(True) if j == 0 else F.col(f"n{j - 1}") > 1
            made = _with_steps(level)
            if leaves is None:
                both = F.arrays_zip(made.alias("m"), F.col("x"))
                whole = F.transform(both, lambda z: F.struct(*[z["m"][c].alias(c) for c in ("i", "digest", "steps")], z["x"]["load"].alias("load")))
                first = blocks.select("tree", "block", "n0", F.inline(whole))
                pos = F.col("block") * FAN_OUT**BLOCK_LEVELS + F.col("i")
                steps = F.when(F.col("n0") > 1, F.col("steps")).otherwise(F.slice("steps", 1, 0))
                leaves = first.select("tree", pos.alias("pos"), F.col("n0").alias("size"), "digest", "load", steps.alias("steps"))
            else:
                inner = blocks.where(exists & (n > 1)).select("tree", "block", F.inline(made))
                pos = F.col("block") * FAN_OUT ** (BLOCK_LEVELS - j) + F.col("i")
                nodes.append(inner.select("tree", F.lit(base + j).alias("level"), pos.alias("pos"), "steps"))
            roots.append(blocks.where(exists & (n == 1)).select("tree", F.lit(base + j).alias("height"), level[0].alias("digest")))
        above = blocks.where(F.col(f"n{BLOCK_LEVELS - 1}") > 1)
        if above.isEmpty():
            break
        base += BLOCK_LEVELS
        rows = above.select(
            "tree", F.col("block").alias("pos"), F.col(f"n{BLOCK_LEVELS}").alias("size"),
            F.col(f"l{BLOCK_LEVELS}")[0].alias("digest"), F.lit(None).cast("int").alias("load"),
        )
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionAll(frames[1]), *frames[2:]])
    return leaves, union(nodes), cut_lineage(union(roots), "merkle-roots")


@dataclass
class Manifest:
    """``leaves``: tree, id, leaf, carried columns, steps and the node above; ``nodes``: all inner nodes with
    their pointer; ``subroots``: tree, height, digest; ``root``: null for an empty table; ``depth``: levels at most."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None
    depth: int
    carried: tuple[str, ...]


def build(
    rows: DataFrame, leaf: Column, id_col: str, group_col: str, carry: Mapping[str, Column] | None = None
) -> Manifest:
    """The trees over ``rows``; ``carry`` are further columns that leaves keep.

    A group's leaves ascend by id (null first). While several nodes remain, every three consecutive ones
    become their H; the last run may have fewer. Group roots, ordered by group (null first, bytewise), likewise give the root.

    Null and empty values are leaves like others. Rows of one id are leaves of their own,
    ordered by digest; equal rows have equal leaves, whose order changes nothing. An empty
    table has no leaf and a null root. Other columns are not read, so their names don't matter.
    """
    carry = dict(carry or {})
    group = F.col(group_col).cast("string")
    # sorts as its group does and is never null
    tree = F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group))
    load = F.struct(F.col(id_col).alias("id"), *[c.alias(f"c{i}") for i, c in enumerate(carry.values())])
    items = rows.select(tree.alias("tree"), F.col(id_col).alias("k"), leaf.alias("digest"), load.alias("load"))
    leaves, inner, subroots = _climbed(_placed(items))

    tops = subroots.select(
        F.lit(TOP).alias("tree"), F.col("tree").alias("k"), "digest", F.struct(F.col("tree").alias("of"), "height").alias("load")
    )
    heads, top_inner, top_roots = _climbed(_placed(tops))
    found = top_roots.first()
    high = subroots.agg(F.max("height")).first()[0] or 0
    depth = high + (found["height"] if found else 0)

    # a pointer leads to the parent; the children of the root have none, as nothing is to add there
    def up(level: Column) -> list[Column]:
        parent = F.floor(F.col("pos") / FAN_OUT)
        last = level + 1 >= (found["height"] if found else 0)
        return [
            F.when(~last, F.lit(TOP)).alias("n_tree"),
            F.when(~last, level + 1).alias("n_level"), F.when(~last, parent).alias("n_pos"),
        ]

    parent = [F.col("tree").alias("n_tree"), (F.col("level") + 1).alias("n_level"), F.floor(F.col("pos") / FAN_OUT).alias("n_pos")]
    nodes = inner.select(*NODE, F.col("level").alias("height"), "steps", *parent)
    ends = heads.select(
        F.col("load.of").alias("tree"), F.col("load.height").alias("level"), F.lit(0).cast("bigint").alias("pos"),
        F.col("load.height").alias("height"), "steps", *up(F.lit(0)),
    )
    above = top_inner.select(*NODE, (F.col("level") + high).alias("height"), "steps", *up(F.col("level")))
    alone = F.col("size") == 1
    first = leaves.select(
        "tree", F.col("load.id").alias("id"), F.col("digest").alias("leaf"), *[F.col(f"load.c{i}").alias(f"c{i}") for i in range(len(carry))],
        "steps", F.col("tree").alias("n_tree"), F.when(alone, 0).otherwise(1).alias("n_level"),
        F.when(alone, F.lit(0).cast("bigint")).otherwise(F.floor(F.col("pos") / FAN_OUT)).alias("n_pos"),
    )
    return Manifest(first, nodes.unionAll(ends).unionAll(above), subroots, found["digest"] if found else None, depth, tuple(carry))


def _reached(left: DataFrame, right: DataFrame, keys: Sequence[str], distance: int, salt_by: Sequence[str]) -> DataFrame:
    if distance >= SALT_FROM and not fits_broadcast(right):
        return salted_join(left, right, keys, salt_by=salt_by)
    return join_lookup(left, right, keys)


def _ahead(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        *[F.col(c).alias(f"n_{c}") for c in NODE], F.col("steps").alias("a_steps"), *[F.col(f"n_{c}").alias(f"a_{c}") for c in NODE]
    )


def _jumped(manifest: Manifest) -> DataFrame:
    """Every node that a leaf points to, with its steps up to the root.

    Each node holds the steps towards the node that it points to. A round joins the
    nodes with themselves: steps are concatenated, and the pointer's distance doubles. The
    side pointed to is what lies at least that distance above others, 3**distance times fewer, so it soon
    fits a measured broadcast; beyond that size distant pointers are salted.
    """
    nodes, distance = cut_lineage(manifest.nodes, "merkle-nodes"), 1
    entry = (F.col("tree") != TOP) & (F.col("level") <= 1)
    while distance < manifest.depth:
        ahead = _ahead(nodes.where(F.col("height") >= distance))
        going = _reached(nodes.where("n_tree IS NOT NULL"), ahead, ["n_tree", "n_level", "n_pos"], distance, NODE)
        going = going.select(*NODE, "height", F.concat("steps", "a_steps").alias("steps"), *[F.col(f"a_{c}").alias(f"n_{c}") for c in NODE])
        there = nodes.where("n_tree IS NULL").select(*going.columns)
        distance *= 2
        nodes = cut_lineage(going.unionAll(there).where(entry | (F.col("height") >= distance)), "merkle-pointers")
    return nodes.where(entry)


def proofs(manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, steps, carried columns) for every row.

    ``steps`` are the siblings before and after, joined, from the leaf's level to the
    root's children. A row alone in everything has no steps and is its own root. Every row comes back
    once, repeated ones too; an empty manifest gives an empty table.
    """
    above = _ahead(_jumped(manifest)).select("n_tree", "n_level", "n_pos", "a_steps")
    same = [F.col(f"n_{c}") == F.col(f"m_{c}") for c in NODE]
    renamed = above.select(*[F.col(f"n_{c}").alias(f"m_{c}") for c in NODE], "a_steps")
    whole = manifest.leaves.join(renamed, same[0] & same[1] & same[2])
    roots = manifest.subroots.select("tree", F.col("digest").alias("subroot"))
    whole = _reached(whole.select("tree", "id", "leaf", *[f"c{i}" for i in range(len(manifest.carried))], F.concat("steps", "a_steps").alias("steps")), roots, ["tree"], SALT_FROM, ["id"])
    return whole.select(
        "id", "leaf", "subroot", F.lit(manifest.root).cast("string").alias("root"), "steps",
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(manifest.carried)],
    )
