"""Catalogue read model: stats, lab records, badges, prices, nested products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

USABLE = ["verified", "expiring_soon"]


def review_stats(reviews: DataFrame, key: str) -> DataFrame:
    """Mean (six places) and count of published reviews."""
    own = reviews.where(F.col("status") == "published").groupBy(key)
    return own.agg(F.round(F.avg("rating"), 6).alias("rating_avg"), F.count("*").alias("rating_count"))


def with_stats(rows: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    return rows.join(stats, key, "left").fillna({"rating_avg": 0.0, "rating_count": 0})


def live_counts(vendors: DataFrame, products: DataFrame) -> DataFrame:
    n = products.where(F.col("status") == "live").groupBy("vendor_id").agg(F.count("*").alias("live_products"))
    return vendors.select("vendor_id").join(n, "vendor_id", "left").fillna({"live_products": 0})


def latest_record(records: DataFrame) -> DataFrame:
    """Of each product's usable lab records the newest; ties to the smaller id."""
    w = Window.partitionBy("product_id").orderBy(F.desc_nulls_last("issue_date"), "record_id")
    return records.where(F.col("status").isin(USABLE)).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def product_badges(products: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """product_id, badges (in a fixed order): usable record, same batch, tested under 183 days ago, tracking, wholesale."""
    c = latest_record(records).select("product_id", F.col("status").alias("coa"), F.col("batch_number").alias("coa_batch"), "issue_date")
    has = F.col("coa").isNotNull()
    badge = lambda cond, name: F.when(cond, name)
    recent = F.datediff(F.lit(as_of).cast("date"), "issue_date") < 183
    badges = F.array_compact(F.array(badge(has, "verified_coa"), badge(has & (F.col("coa_batch") == F.col("batch_number")), "batch_linked"), badge(has & recent, "recently_tested"), F.lit("tracking"), badge(F.col("wholesale"), "wholesale")))
    return products.join(c, "product_id", "left").select("product_id", badges.alias("badges"))


def vendor_badges(vendors: DataFrame) -> DataFrame:
    """Stored badges, then derived ones, each once in first order."""
    stored = F.when(F.col("identity_verified"), F.array(F.lit("identity"), F.lit("verified"))).otherwise(F.array().cast("array<string>"))
    derived = F.array_compact(F.array(F.when(F.col("identity_verified"), "identity"), F.when(F.col("business_verified"), "business"), F.when(F.col("wallet_verified"), "wallet"), F.when(F.col("wholesale_enabled"), "wholesale")))
    return vendors.select("vendor_id", F.array_distinct(F.concat(stored, derived)).alias("badges"))


def badge_overflow(badges: DataFrame, most: int = 3) -> DataFrame:
    return badges.select("vendor_id", F.slice("badges", 1, most).alias("shown"), F.greatest(F.lit(0), F.size("badges") - most).alias("more"))


def prices(variants: DataFrame) -> DataFrame:
    """Prices are those of retail variants; stock and the count are over all. from_cents: the least retail price, else the least of all."""
    retail = F.when(~F.col("wholesale_only"), F.col("price_cents"))
    return variants.groupBy("product_id").agg(F.min(retail).alias("low_cents"), F.max(retail).alias("high_cents"), F.bool_or(F.col("stock") > 0).alias("in_stock"), F.count("*").alias("offers"), F.coalesce(F.min(retail), F.min("price_cents")).alias("from_cents"))


def read_model(products: DataFrame, vendors: DataFrame, variants: DataFrame, records: DataFrame, stats: DataFrame) -> DataFrame:
    """Products with nested vendor, variants[] and records[], stats and defaults; lists are empty, not null, where nothing matches."""
    v = variants.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("k", "price_cents", "stock", "wholesale_only"))).alias("variants"))
    c = records.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("record_id", "issue_date", "status", "batch_number"))).alias("compliance"))
    own = vendors.select("vendor_id", F.struct("brand_name", "country", F.col("status").alias("vendor_status")).alias("vendor"))
    out = products.join(own, "vendor_id", "left").join(v, "product_id", "left").join(c, "product_id", "left")
    out = out.withColumn("variants", F.coalesce("variants", F.array().cast(v.schema["variants"].dataType))).withColumn("compliance", F.coalesce("compliance", F.array().cast(c.schema["compliance"].dataType)))
    return with_stats(out, stats, "product_id")


def public(products: DataFrame, vendors: DataFrame) -> DataFrame:
    """Live products of active vendors."""
    return products.where(F.col("status") == "live").join(vendors.where(F.col("status") == "active").select("vendor_id", "brand_name", "country"), "vendor_id")


def flat_records(products: DataFrame, records: DataFrame) -> DataFrame:
    """Records under their products, with the title; products without records vanish."""
    return products.select("product_id", "title").join(records, "product_id")


def batch_warnings(products: DataFrame, records: DataFrame) -> DataFrame:
    """Products whose newest usable record is of another batch, and cannabinoid products without one."""
    c = latest_record(records).select("product_id", F.col("batch_number").alias("coa_batch"), F.lit(True).alias("has"))
    x = products.join(c, "product_id", "left")
    warning = F.when(F.col("has").isNull() & (F.col("cannabinoid_type") != "none"), "missing_coa").when(F.col("has") & ~F.col("coa_batch").eqNullSafe(F.col("batch_number")), "batch_mismatch")
    return x.withColumn("warning", warning).where(F.col("warning").isNotNull()).select("product_id", "warning")


def related(products: DataFrame, n: int = 4, key: str = "category") -> DataFrame:
    """Per live product, the first n other live products of its category (or another key) by id. A sequence number stands for the list, so no category is joined with itself in full."""
    live = products.where(F.col("status") == "live").select("product_id", key)
    w = Window.partitionBy(key).orderBy("product_id")
    first = live.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n + 1).select(key, F.col("product_id").alias("related_id"))
    heads = first.groupBy(key).agg(F.sort_array(F.collect_list("related_id")).alias("ids"))
    own = live.join(heads, key)
    picked = F.slice(F.filter("ids", lambda i: i != F.col("product_id")), 1, n)
    return own.select("product_id", F.posexplode(picked).alias("pos", "related_id")).select("product_id", (F.col("pos") + 1).alias("position"), "related_id")
