"""Rules kept as a table of any size, matched to lines by an index of required texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.functions.severity import RANK, rank_of
from lynceus.functions.text import line_array
from lynceus.operators.matching import snippet
from lynceus.operators.pieces import HALVED, PieceFilter, half_keys, held_keys, piece_counts, piece_filter, rarest
from lynceus.rules.anchors import anchors
from lynceus.rules.model import FIRST_MATCH
from lynceus.scale import BROADCAST_BYTES, cut_lineage, fits_broadcast, join_lookup, planned_bytes

# Lengths of the index keys in bytes: a rule takes the longest that its texts allow.
GRAMS = (16, 12, 8, 6, 3)
# Index rows of short pieces, up to which they are joined apart from a large index.
FEW = 100_000
# Lines beyond this length are looked up by number, so that their text is not repeated for each key.
LONG_LINE = 1000
# Rules without a required text are tested in blocks of so many.
BLOCK = 50
# Bytes of files, and of rules, in which the frequency of index keys is counted.
SAMPLE_BYTES = 8 * 1024 * 1024

# Characters that match an ASCII letter without case but are none, and the letter.
_LIKE_ASCII = ("ſıİK", "siik")


def folded(text: Column) -> Column:
    """Lower case, with every character that case-blind patterns take for an ASCII letter as that letter."""
    return F.lower(F.translate(text, *_LIKE_ASCII))


def _anchored(texts: pa.Array) -> pa.Array:
    return pa.array([anchors(t, GRAMS[-1]) for t in texts.to_pylist()], pa.list_(pa.string()))


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with their Java pattern, rank, languages and required texts. Rules without id, engine or pattern match nothing."""
    required = F.arrow_udf(_anchored, "array<string>")(F.col("pattern"))
    return rules.where("rule_id IS NOT NULL AND engine IS NOT NULL AND pattern IS NOT NULL").select(
        "rule_id", "engine", "ord", "title", F.concat(F.lit("(?dU)"), "pattern").alias("regex"), "severity",
        rank_of(F.col("severity"), 0).alias("sev_rank"), "cwe_id", "description", F.split("scope", ",").alias("languages"),
        required.alias("anchors"),
    ).withColumn("rule_no", F.monotonically_increasing_id())


def _line_rows(files: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    rows = files.select(*keep, "path", "language", F.posexplode(line_array(F.col("code"))).alias("_pos", "line"))
    return rows.select(*keep, "path", "language", (F.col("_pos") + 1).alias("line_no"), "line", folded(F.col("line")).alias("_low"))


def _sampled(rows: DataFrame) -> DataFrame:
    share = min(1.0, SAMPLE_BYTES / max(planned_bytes(rows), 1))
    return rows if share == 1.0 else rows.sample(share, seed=1)


def _frequencies(files: DataFrame, texts: DataFrame, sizes: Sequence[int]) -> np.ndarray:
    """How often sampled lines and rules hold each piece; only the choice of index keys depends on it, never a result."""
    lines = _line_rows(_sampled(files), ()).where(F.length("line") <= LONG_LINE)
    return piece_counts(lines, "_low", sizes) + piece_counts(_sampled(texts), "anchor", sizes)


def rule_index(rules: DataFrame, files: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """A table (key, rule_no, k, anchor, size, at): the rarest piece of a rule's ``k``-th required text, as a hash, and its place; and the number
    of rows by the length of their pieces, which is the longest that all texts of the rule allow."""
    shortest = F.array_min(F.transform("anchors", F.octet_length))
    size = F.greatest(*[F.when(shortest >= n, F.lit(n)) for n in GRAMS])
    texts = rules.where("size(anchors) > 0").select("rule_no", size.alias("size"), F.posexplode("anchors").alias("k", "anchor"))
    used = sorted(r["size"] for r in texts.select("size").distinct().collect())
    counts = rules.sparkSession.sparkContext.broadcast(_frequencies(files, texts, used))
    key = F.arrow_udf(lambda anchor, size: rarest(anchor, size, counts.value), "struct<key: bigint, at: int>")(F.col("anchor"), F.col("size"))
    index = texts.select("*", key.alias("piece")).select("piece.key", "rule_no", "k", "anchor", "size", "piece.at")
    index = cut_lineage(index, "rule-index")
    rows = {r["size"]: r["count"] for r in index.groupBy("size").count().collect()}
    return index, rows


def _halves(index: DataFrame) -> PieceFilter | None:
    """The filter of both halves of all keys. Many keys share them, as where texts differ in a number, so a small filter tells most pieces
    of lines from keys also where the keys are too many for one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([half_keys(*batch.columns)], ["half"])

    halves = index.where(F.col("size") >= HALVED).select("anchor", "size", "at").mapInArrow(run, "half bigint").distinct()
    halves = cut_lineage(halves, "rule-halves")
    n = halves.count()
    return piece_filter(halves, "half", n) if n else None


def _met(texts: DataFrame, rules: DataFrame, max_bytes: int) -> DataFrame:
    """Lines with a rule whose ``k``-th required text they hold, where the pattern matches. A line that holds several texts
    of a rule is taken under the first, so it meets a rule once."""
    # one of a rule's only text is not asked which came before
    rule = rules.withColumnRenamed("rule_no", "_rule").withColumn("anchors", F.when(F.size("anchors") > 1, F.col("anchors")))
    named = texts.withColumnRenamed("rule_no", "_rule")
    both = join_lookup(named, rule, ["_rule"], max_bytes=max_bytes).withColumnRenamed("_rule", "rule_no")
    before = F.exists(F.slice("anchors", F.lit(1), F.col("k")), lambda a: F.contains(folded(F.col("line")), a))
    return both.where(~F.coalesce(before, F.lit(False)) & _applies(F.col("line")))


def _applies(line: Column) -> Column:
    scope = F.col("languages").isNull() | F.coalesce(F.array_contains("languages", F.col("language")), F.lit(False))
    return scope & F.rlike(line, F.col("regex"))


RULE_COLUMNS = ("rule_no", "rule_id", "engine", "ord", "title", "severity", "sev_rank", "cwe_id", "description")


def table_hits(files: DataFrame, rules: DataFrame, keep: tuple[str, ...] = (), max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every (line, rule) of a prepared rule table whose pattern matches.

    A rule is found through the rarest piece of a text that its pattern requires: pieces of lines meet the
    index in an equi join, the required text is looked for, and only then the rule is fetched and its pattern tried. Filters of bounded
    size, which tasks hold, leave out pieces that no rule has before anything is joined: one of the halves of pieces, then one for each length. An index
    that measures small is broadcast, and lines are not shuffled; a larger one is joined by piece, where Spark splits frequent ones, and
    only lines with a piece of it travel. No rule comes to the driver. Rules that require no text are tried on every line, in blocks.
    """
    files = files.select("*", F.monotonically_increasing_id().alias("_file"))
    lines = _line_rows(files, (*keep, "_file"))
    columns = [*keep, "_file", "path", "language", "line_no", "line", *RULE_COLUMNS]
    short = lines.where((F.length("line") <= LONG_LINE) & (F.length("line") > 0))
    held = F.contains(folded(F.col("line")), F.col("anchor"))
    parts = []
    index, sizes = rule_index(rules, files)
    if sizes:
        # one for each length, so that few short pieces are told apart as well as if there were no others
        filters = {n: piece_filter(index.where(F.col("size") == n), "key", rows) for n, rows in sizes.items()}
        known = files.sparkSession.sparkContext.broadcast((filters, _halves(index)))
        keys = lambda of: F.arrow_udf(lambda texts: held_keys(texts, sorted(of), *known.value), "array<bigint>").asNondeterministic()
        # short pieces are frequent in lines: where they are few, their lines do not travel with those of a large index
        few = [n for n in sorted(sizes) if sum(sizes[m] for m in sizes if m <= n) <= FEW]
        apart = few and len(few) < len(sizes) and not fits_broadcast(index, max_bytes)
        for of in (few, [n for n in sizes if n not in few]) if apart else (list(sizes),):
            part = index.where(F.col("size").isin(of)).drop("size", "at")
            mine = short.withColumn("_keys", keys(of)("_low")).drop("_low").select("*", F.explode("_keys").alias("key")).drop("_keys")
            found = join_lookup(mine, part, ["key"], max_bytes=max_bytes).where(held).drop("key", "anchor")
            # the rules of few pieces are few, so the many lines that hold them meet those without a shuffle
            mine = join_lookup(rules, part.select("rule_no").distinct(), ["rule_no"], "left_semi", max_bytes=max_bytes) if apart and of is few else rules
            parts.append(_met(found, mine, max_bytes).select(*columns))
        index = index.drop("size", "at")
        whole = _line_rows(files.where(F.length("code") > LONG_LINE), (*keep, "_file")).drop("_low")
        long = cut_lineage(whole.where(F.length("line") > LONG_LINE).withColumn("_line", F.monotonically_increasing_id()), "long-lines")
        if not long.isEmpty():
            numbers = long.select(F.col("_line").alias("_of"), keys(sizes)(folded(F.col("line"))).alias("_keys"))
            numbers = numbers.select("_of", F.explode("_keys").alias("key"))
            candidates = join_lookup(numbers, index, ["key"], max_bytes=max_bytes).drop("key")
            texts = candidates.join(long, F.col("_of") == F.col("_line")).where(held).drop("_of", "_line", "anchor")
            parts.append(_met(texts, rules, max_bytes).select(*columns))
    rest = rules.where("size(anchors) = 0")
    blocks = -(-rest.count() // BLOCK)
    if blocks:
        each = F.struct(*[F.col(c) for c in (*RULE_COLUMNS, "regex", "languages")]).alias("rule")
        packed = rest.select(F.pmod(F.xxhash64("rule_no"), F.lit(blocks)).alias("part"), each).groupBy("part").agg(F.collect_list("rule").alias("rules"))
        every = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"))
        met = join_lookup(every, packed, ["part"], max_bytes=max_bytes)
        matching = F.filter(
            "rules",
            lambda r: (r["languages"].isNull() | F.coalesce(F.array_contains(r["languages"], F.col("language")), F.lit(False)))
            & F.rlike(F.col("line"), r["regex"]),
        )
        hit = met.select(*keep, "_file", "path", "language", "line_no", "line", F.explode(matching).alias("rule"))
        parts.append(hit.select(*columns[: -len(RULE_COLUMNS)], *[f"rule.{c}" for c in RULE_COLUMNS]))
    if not parts:
        absent = [F.lit(None).cast(rules.schema[c].dataType).alias(c) for c in RULE_COLUMNS]
        return lines.where("false").select(*columns[: -len(RULE_COLUMNS)], *absent)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def match_table(
    files: DataFrame, rules: DataFrame, min_level: str = "info", keep: tuple[str, ...] = (), max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Raw findings of a rule table in the ``RULES`` schema, of any number of rows.

    An engine that reports the first match takes the table's rule of least ``ord`` (then id) on a line; a level below
    the threshold still claims its line there. Files may repeat a path; each is a file of its own.
    """
    ready = cut_lineage(prepared(rules), "rules")
    hits = table_hits(files, ready, keep, max_bytes)
    first = F.col("engine").isin(*FIRST_MATCH)
    if not ready.where(first).isEmpty():
        # read twice
        hits = cut_lineage(hits, "rule-hits")
        place = Window.partitionBy("_file", "line_no", "engine").orderBy(F.col("ord").asc_nulls_first(), "rule_id", "rule_no")
        claimed = hits.where(first).withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")
        hits = hits.where(~first).unionByName(claimed)
    found = hits.where(F.col("sev_rank") >= RANK[min_level])
    return found.withColumn("_low", folded(F.col("line"))).select(
        *keep, "engine", "rule_id", "cwe_id", "severity", "sev_rank", "title", "description",
        snippet().alias("vulnerable_code"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"),
        F.col("path").alias("file_path"), F.col("language").alias("_language"),
    )
