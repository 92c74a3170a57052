"""Fuzzy search of vulnerability titles by shared trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.scale import cut_lineage, join_lookup

MIN_SCORE = 0.3


def trigrams(text: Column) -> Column:
    """Set of trigrams of the words, each word padded by two spaces and one."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(padded, i, F.lit(3))
        )

    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of the two sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def similar_titles(titles: DataFrame, queries: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Distinct (query, title) pairs with a score of at least ``min_score``.

    A pair at that score shares at least ``min_score * |query|`` trigrams, so
    all but that many of the query's trigrams suffice to find it. The rarest
    ones are used: a trigram that every title contains is not looked up. Equal
    titles and queries are compared once.
    """
    docs = (
        titles.select("title").where("title IS NOT NULL").distinct()
        .withColumn("grams", trigrams(F.col("title")))
    )
    wanted = (
        queries.select("query").where("query IS NOT NULL").distinct()
        .withColumn("wanted", trigrams(F.col("query")))
    )
    postings = docs.select("title", "grams", F.explode("grams").alias("gram"))
    frequency = postings.groupBy("gram").agg(F.count("*").alias("titles"))
    asked = wanted.select("query", "wanted", F.explode("wanted").alias("gram"))
    rare = (
        asked.join(frequency, "gram")
        .groupBy("query", "wanted")
        # One short list per query: its own trigrams, rarest first.
        .agg(F.array_sort(F.collect_list(F.struct("titles", "gram"))).alias("by_rarity"))
        .withColumn(
            "needed",
            F.size("wanted") - F.ceil(F.size("wanted") * F.lit(min_score) - 1e-9).cast("int") + 1,
        )
        # Trigrams that no title has are the rarest of all and take up their share.
        .withColumn("take", F.col("needed") - (F.size("wanted") - F.size("by_rarity")))
        .where("take > 0")
        .withColumn("lookup", F.expr("transform(slice(by_rarity, 1, take), g -> g.gram)"))
        .select("query", "wanted", "lookup", F.posexplode("lookup").alias("rank", "gram"))
    )
    candidates = join_lookup(postings, cut_lineage(rare, "trigrams"), ["gram"])
    # A pair that several trigrams find is kept at the rarest of them only.
    found_before = F.arrays_overlap(F.expr("slice(lookup, 1, rank)"), "grams")
    score = similarity(F.col("grams"), F.col("wanted"))
    return (
        candidates.where(~found_before)
        .select("query", "title", score.alias("score"))
        .where(F.col("score") >= min_score)
    )


def title_search(
    vulnerabilities: DataFrame, queries: DataFrame, min_score: float = MIN_SCORE
) -> DataFrame:
    """Vulnerabilities whose title resembles a query, with the score."""
    pairs = cut_lineage(similar_titles(vulnerabilities, queries, min_score), "title-pairs")
    return join_lookup(vulnerabilities, pairs, ["title"])
