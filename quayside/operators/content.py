"""Content clusters, link selection, link maps, sitemaps, structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A text belongs to each cluster of which it holds a needle, else to the last one.
CLUSTERS = {
    "thca": ["thca"],
    "cbd": ["cbd"],
    "cbg": ["cbg"],
    "cbn": ["cbn", "sleep"],
    "drinks": ["drink", "delta-9", "seltzer", "beverage"],
    "wholesale": ["wholesale", "bulk", "private-label", "white-label"],
    "law": ["law", "legal", "jurisdiction"],
    "coa": ["coa", "lab-tested", "lab tested", "certificate"],
    "pre-rolls": ["pre-roll", "pre roll"],
    "flower": ["flower", "hemp"],
}


def clusters(text: Column, needles: dict[str, list[str]] | None = None) -> Column:
    """The names of the clusters of a text in their order."""
    needles = needles or CLUSTERS
    low = F.lower(F.coalesce(text, F.lit("")))

    def holds(some: list[str]) -> Column:
        out = F.lit(False)
        for n in some:
            out = out | F.contains(low, F.lit(n))
        return out

    found = F.array_compact(F.array(*[F.when(holds(some), name) for name, some in needles.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit(list(needles)[-1]))).otherwise(found)


def related_links(pages: DataFrame, links: DataFrame, per_section: int = 6) -> DataFrame:
    """page_id, section, url, position. A link fits where its clusters meet the page's, or it has none; of a url the first section counts.

    The join is on single clusters, and links without any are joined by a key of their own, so no page meets every link.
    """
    p = pages.select("page_id", F.explode(F.array_union("clusters", F.array(F.lit("")))).alias("cluster")).distinct()
    keys = F.when(F.size("clusters") == 0, F.array(F.lit(""))).otherwise(F.col("clusters"))
    x = p.join(links.select("section", "url", F.explode(keys).alias("cluster")), "cluster").select("page_id", "section", "url").distinct()
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("page_id", "url").orderBy("section"))).where("r = 1").drop("r")
    x = x.withColumn("position", F.row_number().over(Window.partitionBy("page_id", "section").orderBy("url")))
    return x.where(F.col("position") <= per_section)


def cross_urls(a: DataFrame, b: DataFrame) -> DataFrame:
    """A url for each state and cluster; both are short fixed lists."""
    return a.crossJoin(F.broadcast(b)).select("state", "cluster", F.concat(F.lit("/"), "state", F.lit("/"), "cluster", F.lit("/")).alias("url"))


def cascade(row: Column, *maps: Column, default: str) -> Column:
    """The first map's value at row that isn't null, else default."""
    return F.coalesce(*[m[row] for m in maps], F.lit(default))


def sitemap_page(rows: DataFrame, page: int, size: int = 2000) -> DataFrame:
    """A page by name; rows that aren't indexable go after the page is cut."""
    cut = rows.orderBy("name", "id").offset((page - 1) * size).limit(size)
    return cut.where("indexable").select("id", F.concat(F.lit("/"), "slug", F.lit("/")).alias("loc"))


def sitemap_xml(rows: DataFrame) -> DataFrame:
    """One <url> line for each (loc, lastmod); head and tail are the writer's."""
    return rows.select(F.concat(F.lit("<url><loc>"), "loc", F.lit("</loc>"), F.when(F.col("lastmod").isNotNull(), F.concat(F.lit("<lastmod>"), "lastmod", F.lit("</lastmod>"))).otherwise(""), F.lit("</url>")).alias("line"))


def offers_json(prices: DataFrame) -> DataFrame:
    """AggregateOffer objects, prices in whole units with two places."""
    money = lambda c: F.format_string("%d.%02d", F.expr(f"{c} div 100"), F.expr(f"{c} % 100"))
    offer = F.struct(F.lit("AggregateOffer").alias("@type"), money("low_cents").alias("lowPrice"), money("high_cents").alias("highPrice"), F.col("offers").alias("offerCount"), F.when(F.col("in_stock"), "InStock").otherwise("OutOfStock").alias("availability"))
    return prices.select("product_id", F.to_json(offer).alias("json"))


def pivot_meta(meta: DataFrame, keys: list[str]) -> DataFrame:
    """(entity_id, key, value) to a column for each of keys; empty values are null."""
    return meta.groupBy("entity_id").pivot("key", keys).agg(F.max(F.when(F.col("value") != "", F.col("value"))))


def first_or(primary: DataFrame, fallback: DataFrame, n: int) -> DataFrame:
    """The first n of primary by rank, or of fallback if primary is empty."""
    some = primary.limit(1).withColumn("_some", F.lit(True)).select("_some")
    rest = fallback.join(F.broadcast(some), how="left_anti")
    return primary.unionByName(rest).orderBy("rank", "id").limit(n)


def schedule(topics: DataFrame, start: str, n: int = 120) -> DataFrame:
    """The first n topics, one a day from the day after start at nine."""
    due = topics.orderBy("topic_id").limit(n).withColumn("at", F.row_number().over(Window.orderBy("topic_id")))
    return due.select("topic_id", (F.to_timestamp_ntz(F.lit(start)) + F.make_interval(days=F.col("at"), hours=F.lit(9))).alias("due_at"))
