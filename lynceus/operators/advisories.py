"""Advisory lookup for dependencies and the findings it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.functions.severity import rank_of
from lynceus.functions.versions import OPEN_END, in_range, version_key
from lynceus.rules.model import SCA
from lynceus.scale import BROADCAST_BYTES, cut_lineage, join_lookup, numbered

COORDINATES = ["ecosystem", "name", "version"]
# Beyond so many advisories a package's versions are not compared with each of them.
CROWDED = 256
# Versions that one key of the sweep's join holds at the least level; a level holds eight times as many as the one before it.
SWEEP_BLOCK = 64
# For each level of blocks: so many keys share the ranges of a block.
SWEEP_LEVELS = (1, 1, 8)
# Rows of the sweep's order whose versions are counted together.
STRETCH = 1 << 16


def cve_alias(advisory_id: Column, aliases: Column, strict: bool = True) -> Column:
    """First CVE among the aliases; else the id, when ``strict`` only if it is a CVE."""
    is_cve = lambda text: F.startswith(text, F.lit("CVE-"))
    first = F.get(F.filter(aliases, is_cve), F.lit(0))
    own = F.when(is_cve(advisory_id), advisory_id) if strict else advisory_id
    return F.coalesce(first, own)


def _with_ends(advisories: DataFrame) -> DataFrame:
    """Advisory rows with their ends as keys; a row whose end is no version has ``usable`` false.

    ``introduced`` 0 and a missing end are open. ``fixed`` is outside the range and
    ``last_affected`` inside. Where both ends are one version, it is also matched as text,
    so versions that don't compare are found by name.
    """
    for name in ("last_affected",):
        if name not in advisories.columns:
            advisories = advisories.withColumn(name, F.lit(None).cast("string"))
    eco = F.col("ecosystem")
    low = F.when(F.col("introduced") != "0", F.col("introduced"))
    end = F.coalesce("fixed", "last_affected")
    exact = F.when(F.col("fixed").isNull() & (F.col("introduced") == F.col("last_affected")), F.col("introduced"))
    return advisories.withColumns(
        {
            "lo": F.when(low.isNull(), F.lit("")).otherwise(version_key(low, eco)),
            "hi": F.when(end.isNull(), F.lit(OPEN_END)).otherwise(version_key(end, eco)),
            "closed": F.col("fixed").isNull() & F.col("last_affected").isNotNull(),
            "exact": exact,
        }
    ).withColumn("usable", (F.col("lo").isNotNull() & F.col("hi").isNotNull()) | F.col("exact").isNotNull())


def _ranges(advisories: DataFrame) -> DataFrame:
    """One row per package and advisory, with its version ranges as comparable keys.

    The ranges of an advisory come from one feed record, so the set is bounded by that
    record, and copies of it collapse before the shuffle. With one row per advisory a
    version cannot match it twice. :func:`unusable_ranges` counts what is left out.
    """
    return (
        _with_ends(advisories).where("usable")
        .groupBy("ecosystem", F.col("package_name").alias("name"), "advisory_id")
        .agg(
            F.collect_set(F.struct("lo", "hi", "closed", "exact")).alias("ranges"),
            F.min("cve_id").alias("cve_id"),
            F.max_by("severity", rank_of(F.col("severity"))).alias("severity"),
            F.min("summary").alias("summary"),
        )
    )


def unusable_ranges(advisories: DataFrame) -> DataFrame:
    """Per ecosystem: ranges with an end that cannot be compared."""
    return _with_ends(advisories).where("NOT usable").groupBy("ecosystem").agg(F.count("*").alias("ranges"))


def _in_any_range() -> Column:
    key, version = F.col("key"), F.col("version")
    return F.exists(
        "ranges",
        lambda r: F.coalesce(in_range(key, r["lo"], r["hi"], r["closed"]), F.lit(False))
        | F.coalesce(r["exact"] == version, F.lit(False)),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the key of their version, made once for each distinct version of an ecosystem."""
    versions = rows.select("ecosystem", "version").where("ecosystem IS NOT NULL AND version IS NOT NULL").distinct()
    keys = versions.withColumn("key", version_key(F.col("version"), F.col("ecosystem")))
    return join_lookup(rows, cut_lineage(keys, "version-keys"), ["ecosystem", "version"], "left")


def swept(versions: DataFrame, ranges: DataFrame, block: int = SWEEP_BLOCK) -> DataFrame:
    """``versions`` with each advisory that has them in any of its ranges, by a sorted sweep; repeated rows and further columns are kept.

    Versions and range ends of all packages are put in one order, and the versions are numbered in it. A low end comes
    before equal versions, a high end before or, where it belongs to the range, after them. So a range is the
    versions between two numbers, and no key is compared with a range. What earlier ranges of an advisory hold is
    cut off the later ones, so a pair is found once. A range meets its versions in an equi join on blocks of
    numbers, whatever their package, so a package with any number of versions and advisories spreads over tasks. Blocks come in
    ``SWEEP_LEVELS`` sizes, and a range takes the largest that is no longer than itself: it meets few of them, so what travels grows with the
    versions and the ranges, not with the pairs. The columns of both travel to the join, and the pairs are never
    shuffled. Versions without a key are matched by name; one with a key that stands by name in a range lies in it.
    """
    package = ["ecosystem", "name"]
    ranges = ranges.where("advisory_id IS NOT NULL")
    numbered_ranges = cut_lineage(ranges.withColumn("_advisory", F.monotonically_increasing_id()), "ranges")
    named = [c for c in ranges.columns if c not in (*package, "ranges")]
    owned = numbered_ranges.select(F.col("_advisory").alias("_of"), F.struct(*named).alias("_owner")).hint("merge")
    each = numbered_ranges.select(*package, "_advisory", F.posexplode("ranges").alias("range_no", "r")).select(*package, "_advisory", "range_no", "r.*")
    usable = each.where("lo IS NOT NULL AND hi IS NOT NULL")
    own = [c for c in versions.columns if c != "key"]
    whole = versions.select(*package, "version", "key", F.struct(*own).alias("_point"))
    none = lambda kind: F.lit(None).cast(kind)
    range_id = ["_advisory", "range_no"]
    no_point = [none("bigint").alias("_row"), none(whole.schema["_point"].dataType).alias("_point")]
    lows = usable.select(*package, F.col("lo").alias("key"), F.lit(0).alias("kind"), *range_id, F.lit(True).alias("low"), *no_point)
    closing = F.when(F.col("closed"), 2).otherwise(0)
    highs = usable.select(*package, F.col("hi").alias("key"), closing.alias("kind"), *range_id, F.lit(False).alias("low"), *no_point)
    points = whole.where("key IS NOT NULL").select(
        *package, "key", F.lit(1).alias("kind"), none("bigint").alias("_advisory"), none("int").alias("range_no"), none("boolean").alias("low"),
        F.monotonically_increasing_id().alias("_row"), "_point",
    )
    # a row's own number tells equal versions apart, so that one that stands often is spread too
    by = [*package, "key", "kind", *range_id, "_row"]
    order = numbered(points.unionAll(lows).unionAll(highs), by, "pos", "sweep", unkept=(*package, "key", "kind", "_row"))
    order = _points_before(order, F.col("_advisory").isNull())
    ends = order.where("_advisory IS NOT NULL").select(*range_id, "low", "at").repartition("_advisory")
    spans = ends.groupBy(*range_id).agg(F.max(F.when(F.col("low"), F.col("at"))).alias("a"), F.max(F.when(~F.col("low"), F.col("at"))).alias("b"))
    # a window holds the ranges of one advisory
    earlier = Window.partitionBy("_advisory").orderBy("a", "b", "range_no").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_advisory", F.greatest("a", F.max("b").over(earlier)).alias("a"), "b").where("a < b")
    # number of a block, its size and its share of the ranges make the key
    sizes = [(block * 8**i, shares) for i, shares in enumerate(SWEEP_LEVELS)]
    size, shares = F.lit(block), F.lit(SWEEP_LEVELS[0])
    for n, k in sizes[1:]:
        size = F.when(F.col("b") - F.col("a") >= n, n).otherwise(size)
        shares = F.when(F.col("b") - F.col("a") >= n, k).otherwise(shares)
    spans = spans.select("*", size.alias("size"), F.pmod(F.xxhash64("_advisory", "a"), shares).cast("int").alias("share"))
    spans = spans.join(owned, F.col("_advisory") == F.col("_of")).drop("_of", "_advisory")
    number = lambda c: F.floor(c / F.col("size"))
    spread = spans.select("*", F.explode(F.sequence(number(F.col("a")), number(F.col("b") - 1))).alias("block"))
    kept = F.array(*[F.struct(F.lit(n).alias("_size"), F.lit(i).alias("_share")) for n, k in sizes for i in range(k)])
    placed = order.where("_advisory IS NULL").select("_point", "at", F.inline(kept)).select("*", F.floor(F.col("at") / F.col("_size")).alias("_block"))
    met = (F.col("_block") == F.col("block")) & (F.col("_size") == F.col("size")) & (F.col("_share") == F.col("share"))
    inside = met & (F.col("at") >= F.col("a")) & (F.col("at") < F.col("b"))
    found = spread.join(placed.hint("merge"), inside).select("_point.*", "_owner.*")
    by_name = each.where("exact IS NOT NULL").select(F.col("ecosystem").alias("_e"), F.col("name").alias("_n"), "exact", "_advisory")
    unkeyed = whole.where("key IS NULL")
    same = (F.col("ecosystem") == F.col("_e")) & (F.col("name") == F.col("_n")) & (F.col("version") == F.col("exact"))
    met = unkeyed.join(by_name.hint("merge"), same).select("_point", "_advisory")
    met = met.join(owned, F.col("_advisory") == F.col("_of")).select("_point.*", "_owner.*")
    return found.unionAll(met)


def _points_before(order: DataFrame, point: Column) -> DataFrame:
    """``order`` with ``at`` in place of ``pos``, its running number: how many points stand before a row.

    Points are counted within stretches of the order, and the stretches' counts are added up.
    """
    stretch = F.floor(F.col("pos") / STRETCH)
    counts = order.groupBy(stretch.alias("_stretch")).agg(F.count_if(point).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_stretch")) - F.col("_n")
    starts = F.broadcast(counts.select("_stretch", before.alias("_before")))
    running = Window.partitionBy("_in").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.count_if(point).over(running), F.lit(0))
    own = order.withColumn("_in", stretch).withColumn("_inner", inner)
    return own.join(starts, F.col("_in") == F.col("_stretch")).withColumn("at", F.col("_before") + F.col("_inner")).drop("pos", "_in", "_inner", "_stretch", "_before")


def _matched(rows: DataFrame, advisories: DataFrame, max_bytes: int) -> DataFrame:
    """``rows`` with each advisory that affects their version."""
    ranges = cut_lineage(_ranges(advisories), "advisory-ranges")
    package = ["ecosystem", "name"]
    keyed = _keyed(rows)
    crowded = ranges.groupBy(*package).agg(F.count("*").alias("advisories")).where(F.col("advisories") > CROWDED).select(*package)
    crowded = cut_lineage(crowded, "crowded-packages")
    if crowded.isEmpty():
        return join_lookup(keyed, ranges, package, condition=_in_any_range(), max_bytes=max_bytes).drop("key", "ranges")
    light = join_lookup(keyed, crowded, package, "left_anti")
    few = join_lookup(ranges, crowded, package, "left_anti")
    hits = join_lookup(light, few, package, condition=_in_any_range(), max_bytes=max_bytes).drop("key", "ranges")
    heavy = cut_lineage(join_lookup(keyed, crowded, package, "left_semi"), "crowded-dependencies")
    return hits.unionByName(swept(heavy, join_lookup(ranges, crowded, package, "left_semi")))


def affected_versions(
    dependencies: DataFrame, advisories: DataFrame, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Distinct (ecosystem, name, version) with each advisory that affects it.

    The distinct coordinates are taken first, with partial aggregation, so a
    package named by a third of all manifests is matched once per version.
    """
    return _matched(dependencies.select(*COORDINATES).distinct(), advisories, max_bytes)


def affected(
    dependencies: DataFrame, advisories: DataFrame, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Dependencies with each advisory that affects their version.

    An equi join on ecosystem and package with the version range as its
    residual condition. The advisories are broadcast when they measure small,
    so the dependencies are not shuffled; otherwise Spark splits hot packages. Packages with more than
    ``CROWDED`` advisories are matched by a sorted sweep (:func:`swept`), in which the dependencies travel themselves.
    """
    return _matched(dependencies, advisories, max_bytes)


def sca_findings(hits: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw findings, one per dependency and advisory. Lines are 0, there is no weakness id."""
    coordinate = F.concat_ws("@", "name", "version")
    fallback = F.concat(F.lit("advisory for "), coordinate)
    return hits.select(
        *keep,
        F.lit(SCA).alias("engine"),
        F.col("advisory_id").alias("rule_id"),
        "cve_id",
        F.lit(None).cast("string").alias("cwe_id"),
        "severity",
        rank_of(F.col("severity"), 2).alias("sev_rank"),
        F.format_string(
            "Dependency %s %s: %s",
            "name",
            "version",
            F.coalesce("summary", fallback),
        ).alias("title"),
        F.format_string("%s (%s)", coordinate, "ecosystem").alias("vulnerable_code"),
        F.format_string(
            "%s (ID: %s)", F.coalesce("summary", F.lit("")), "advisory_id"
        ).alias("description"),
        F.lit(0).alias("line_start"),
        F.lit(0).alias("line_end"),
        "file_path",
    )


def coverage(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Per ecosystem: dependencies, distinct versions, vulnerable and uncheckable ones.

    Dependencies without an advisory count as clean. A version that cannot be
    compared is counted apart. The dependencies are read once; only their distinct
    versions are matched.
    """
    per_version = dependencies.groupBy(*COORDINATES).agg(F.count("*").alias("uses"))
    per_version = cut_lineage(_keyed(per_version), "versions")
    hits = _matched(per_version.select(*COORDINATES), advisories, BROADCAST_BYTES).groupBy(*COORDINATES).agg(
        F.count("*").alias("advisories")
    )
    joined = per_version.join(hits, COORDINATES, "left")
    return joined.groupBy("ecosystem").agg(
        F.sum("uses").alias("dependencies"),
        F.count("*").alias("versions"),
        F.count("advisories").alias("vulnerable_versions"),
        F.coalesce(F.sum(F.when(F.col("advisories").isNotNull(), F.col("uses"))), F.lit(0)).alias(
            "vulnerable_dependencies"
        ),
        F.count_if(F.col("key").isNull()).alias("uncheckable_versions"),
    )
