"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm.lines import row_key
from lynceus.scale import cut_lineage, spare

SHARED_OWNERS = 3
OWN_REPOSITORIES = 1
MASK = "[secret]"

# Kind, pattern, group that is the credential, least length of what counts, in the order of report.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Long words of letters and digits in both cases: no secrets by their form alone.
OPAQUE = ("opaque", r"[A-Za-z0-9_-]{20,}", 0, 20)

SPAN = "array<struct<start:int,kind:int,end:int,credential:string>>"


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Every match as start, kind, end and digest of its credential, leftmost first.

    The texts between the matches give the positions: they and the matches
    alternate, and their lengths add up. Lengths are code points.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(whole, F.length).alias("size"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole).alias("value"),
    )
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("out"))

    def add(acc: Column, z: Column) -> Column:
        start = acc["at"] + z["gap"]
        end = start + F.coalesce(z["size"], F.lit(0))
        row = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), z["value"].alias("value"))
        taken = z["value"].isNotNull() & (F.length(z["value"]) >= least)
        return F.struct(end.alias("at"), F.when(taken, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, none, add, lambda acc: acc["out"])
    hashed = F.transform(
        found,
        lambda z: F.struct(z["start"].alias("start"), z["kind"].alias("kind"), z["end"].alias("end"), F.sha2(z["value"], 256).alias("credential")),
    )
    return F.when(text.rlike(pattern), hashed).otherwise(F.array().cast(SPAN))


def _opaque(text: Column) -> Column:
    """Opaque words with capitals, small letters and three digits."""
    name, pattern, group, least = OPAQUE
    mixed = r"(?=[A-Z0-9_-]*[a-z])(?=[a-z0-9_-]*[A-Z])(?=(?:[A-Za-z_-]*[0-9]){3})" + pattern
    return _spans(text, len(KINDS), r"(?<![A-Za-z0-9_-])" + mixed, group, least)


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in (*KINDS, OPAQUE)])
    return F.array_join(
        F.transform(spans, lambda z: F.concat_ws(":", F.get(names, z["kind"]), z["start"].cast("string"), z["end"].cast("string"))), ","
    )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str | Column = "source",
    owner_col: str | Column = "source",
    shared_owners: int = SHARED_OWNERS,
) -> DataFrame:
    """One row per document row: its secrets, and which of them look live.

    Every candidate is hashed, and the hashes are counted over the corpus by distinct
    repositories and owners. A credential that ``shared_owners`` owners hold is a
    copied example; others look live. Opaque words are candidates too, and become
    spans only where one owner alone holds them, in one repository.

    Result: scan_id, scan_row (:func:`row_key`), n_assign, n_access, n_hex, base_sha256, spans,
    n_live, n_example, live (spans to mask). Null texts count as empty and have no spans. Null
    owners and repositories count as one unnamed. Repeated rows give repeated results and
    count once. An empty table gives an empty result. Other columns are not read.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("scan_id"),
        row_key(F.col(text_col)).alias("scan_row"),
        F.coalesce(as_col(repo_col).cast("string"), F.lit("")).alias("repo"),
        F.coalesce(as_col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.col(text_col).cast("string").alias("text"),
    )
    found = rows.select(
        "scan_id", "scan_row", "repo", "owner",
        *[_spans(text, i, p, g, n).alias(name) for i, (name, p, g, n) in enumerate(KINDS)],
        _opaque(text).alias("opaque"),
    )
    found = cut_lineage(found, "secret-spans")
    each = found.select(
        "scan_id", "scan_row", "repo", "owner", F.explode(F.concat(*[k[0] for k in KINDS], "opaque")).alias("span")
    ).select("scan_id", "scan_row", "repo", "owner", "span.*")
    holders = each.groupBy("credential", "repo", "owner").agg(F.count("*").alias("n"))
    owned = holders.groupBy(F.col("credential").alias("held")).agg(
        F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos")
    )
    judged = each.join(owned, F.col("credential") == F.col("held")).where(
        (F.col("kind") < len(KINDS)) | ((F.col("owners") == 1) & (F.col("repos") <= OWN_REPOSITORIES))
    )
    span = F.struct("start", "kind", "end", (F.col("owners") < shared_owners).alias("live"))
    by_row = judged.groupBy(F.col("scan_id").alias("_id"), F.col("scan_row").alias("_row")).agg(
        F.sort_array(F.collect_set(span)).alias("all")
    )
    base = F.array_sort(F.concat(*[k[0] for k in KINDS]))
    whole = found.join(by_row, F.equal_null("scan_id", "_id") & (F.col("scan_row") == F.col("_row")), "left")
    spans = F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>"))
    return whole.select(
        "scan_id",
        "scan_row",
        *[F.size(k[0]).cast("bigint").alias(f"n_{k[0]}") for k in KINDS],
        F.sha2(_text_of(base), 256).alias("base_sha256"),
        _text_of(spans).alias("spans"),
        F.size(F.filter(spans, lambda z: z["live"])).cast("bigint").alias("n_live"),
        F.size(F.filter(spans, lambda z: ~z["live"])).cast("bigint").alias("n_example"),
        F.filter(spans, lambda z: z["live"]).alias("live"),
    )


def mask_live(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every live-looking secret replaced by ``MASK``; copied examples and all else stay.

    All rows and columns stay, whatever their names. Null and empty texts have no secrets. Rows that repeat an id are masked by
    the spans of their own text; an empty table gives an empty result.
    """
    of, row, spans = (spare(docs, c) for c in ("_scan_id", "_scan_row", "_live"))
    live = scanned.where(F.size("live") > 0).select(
        F.col("scan_id").alias(of), F.col("scan_row").alias(row), F.col("live").alias(spans)
    ).dropDuplicates([of, row])
    same = F.equal_null(F.col(id_col), F.col(of)) & (row_key(F.col(text_col)) == F.col(row))
    joined = docs.join(live, same, "left")
    text = F.col(text_col)
    none = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

    def add(acc: Column, z: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, z["start"] - acc["at"])
        out = F.when(z["start"] >= acc["at"], F.concat(acc["out"], F.array(before, F.lit(MASK)))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], z["end"]).alias("at"))

    masked = F.aggregate(
        F.col(spans), none, add,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return joined.withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(masked)).drop(of, row, spans)
