"""Ranked and fuzzy product search, suggestions, grouped search. Relevance is our own formula: the share of the query's words in the title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_query, pattern_of


def trigrams(x: Column) -> Column:
    """Distinct three-character pieces of a text, lower-cased, two blanks before and one behind."""
    padded = F.concat(F.lit("  "), F.lower(x), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def similarity(x: Column, q: str) -> Column:
    a, b = trigrams(x), trigrams(F.lit(q))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def trigram_search(products: DataFrame, q: str, least: float = 0.3, n: int = 40) -> DataFrame:
    found = products.withColumn("similarity", F.round(similarity(F.col("title"), q), 9)).where(F.col("similarity") >= least)
    return found.orderBy(F.desc("similarity"), "product_id").limit(n).select("product_id", "title", "similarity")


def ilike_search(products: DataFrame, q: str, n: int = 40) -> DataFrame:
    q = clean_query(q)
    if not q:
        return products.select("product_id", "title").limit(0)
    hit = F.col("title").ilike(pattern_of(q)) | F.col("category").ilike(pattern_of(q))
    return products.where((F.col("status") == "live") & hit).orderBy("product_id").limit(n).select("product_id", "title")


def ranked(products: DataFrame, records: DataFrame, variants: DataFrame, q: str, n: int = 40, least: float = 0.3) -> DataFrame:
    """Live products where all query words, trigrams or the pattern match; rank = 2 relevance + similarity + 0.5 (verified record) + 0.15 (stock).

    A record that expires soon earns nothing. In the pattern, % and _ of the query are wildcards.
    """
    q = clean_query(q)
    words = sorted(set(q.lower().split()))
    own = F.split(F.lower("title"), r"\s+")
    share = F.size(F.array_intersect(own, F.array(*map(F.lit, words)))) / F.lit(max(1, len(words)))
    verified = records.where(F.col("status") == "verified").select("product_id").distinct().withColumn("coa", F.lit(1))
    stocked = variants.where(F.col("stock") > 0).select("product_id").distinct().withColumn("held", F.lit(1))
    p = products.where(F.col("status") == "live").withColumn("share", share).withColumn("similar", similarity(F.col("title"), q))
    p = p.where((F.col("share") == 1) | (F.col("similar") >= least) | F.col("title").ilike(f"%{q}%") | F.col("batch_number").ilike(f"%{q}%"))
    p = p.join(verified, "product_id", "left").join(stocked, "product_id", "left")
    rank = 2 * F.col("share") + F.col("similar") + 0.5 * F.coalesce("coa", F.lit(0)) + 0.15 * F.coalesce("held", F.lit(0))
    return p.withColumn("rank", F.round(rank, 9)).orderBy(F.desc("rank"), "product_id").limit(n).select("product_id", "vendor_id", "rank")


def hydrate(top: DataFrame, vendors: DataFrame) -> DataFrame:
    """The limit came first: rows of inactive vendors go afterwards."""
    return top.join(vendors.where(F.col("status") == "active").select("vendor_id"), "vendor_id", "left_semi")


def suggest(products: DataFrame, vendors: DataFrame, q: str) -> DataFrame:
    """Five products and three stores; nothing for less than two characters."""
    q = clean_query(q, 80)
    a = products.where((F.col("status") == "live") & F.col("title").ilike(pattern_of(q))).orderBy("title", "product_id").limit(5)
    b = vendors.where((F.col("status") == "active") & F.col("brand_name").ilike(pattern_of(q))).orderBy("brand_name", "vendor_id").limit(3)
    out = a.select(F.lit("product").alias("kind"), F.col("product_id").alias("id"), F.col("title").alias("label")).unionByName(b.select(F.lit("store").alias("kind"), F.col("vendor_id").alias("id"), F.col("brand_name").alias("label")))
    return out if len(q) >= 2 else out.limit(0)


def grouped(groups: dict[str, tuple[DataFrame, int]], q: str) -> DataFrame:
    """label, id, title, position: of each group's (id, title) the first matches; groups without any are absent, and all are for less than two characters."""
    out, q = None, clean_query(q)
    for label, (df, n) in groups.items():
        hit = df.where(F.lit(len(q) >= 2) & F.col("title").ilike(pattern_of(q))).select(F.lit(label).alias("label"), "id", "title")
        hit = hit.withColumn("position", F.row_number().over(Window.partitionBy("label").orderBy("title", "id"))).where(F.col("position") <= n)
        out = hit if out is None else out.unionByName(hit)
    return out
