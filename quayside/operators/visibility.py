"""Row-level visibility. A principal is (uid, role, vendor_id); policies of a table are joined by OR, none means nothing is seen."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Principal(NamedTuple):
    uid: int | None = None
    role: str = "anon"
    vendor_id: int | None = None

    @property
    def admin(self) -> bool:
        return self.role == "admin"


def _is(col: str, value) -> Column:
    return F.coalesce(F.col(col) == value, F.lit(False)) if value is not None else F.lit(False)


def products(df: DataFrame, who: Principal) -> DataFrame:
    return df.where((F.col("status") == "live") | _is("vendor_id", who.vendor_id) | F.lit(who.admin))


def orders(df: DataFrame, who: Principal) -> DataFrame:
    return df.where(_is("buyer_id", who.uid) | _is("vendor_id", who.vendor_id) | F.lit(who.admin))


def children(df: DataFrame, visible_parents: DataFrame, key: str, extra: Column | None = None) -> DataFrame:
    """Rows whose parent is visible, and those that extra admits."""
    if extra is None:
        return df.join(visible_parents.select(key).distinct(), key, "left_semi")
    marked = visible_parents.select(key).distinct().withColumn("_seen", F.lit(True))
    return df.join(marked, key, "left").where(F.coalesce("_seen", F.lit(False)) | extra).drop("_seen")


def records(df: DataFrame, products_: DataFrame, who: Principal) -> DataFrame:
    """Lab records: (usable and the product live) or own or admin."""
    p = products_.select("product_id", F.col("status").alias("_product"), F.col("vendor_id").alias("_vendor"))
    shown = F.col("status").isin("verified", "expiring_soon") & (F.col("_product") == "live")
    return df.join(p, "product_id").where(shown | _is("_vendor", who.vendor_id) | F.lit(who.admin)).drop("_product", "_vendor")


def wholesale_tiers(variants: DataFrame, products_: DataFrame, approved_access: DataFrame, approved_profiles: DataFrame, who: Principal) -> DataFrame:
    """Wholesale variants: admin, own vendor, or approved access to the vendor and an approved profile and a live product."""
    p = products_.select("product_id", "vendor_id", "status")
    may = approved_access.where(F.col("buyer_id") == who.uid).join(approved_profiles, "buyer_id", "left_semi").select("vendor_id").distinct().withColumn("_may", F.lit(True)) if who.uid is not None else None
    rows = variants.where("wholesale_only").join(p, "product_id")
    rows = rows.join(may, "vendor_id", "left") if may is not None else rows.withColumn("_may", F.lit(False))
    ok = F.lit(who.admin) | _is("vendor_id", who.vendor_id) | (F.coalesce("_may", F.lit(False)) & (F.col("status") == "live"))
    return rows.where(ok).drop("_may")


def admin_only(df: DataFrame, who: Principal) -> DataFrame:
    return df.where(F.lit(who.admin))


def editable_reviews(df: DataFrame, who: Principal, as_of: str, days: int = 30) -> DataFrame:
    """Own reviews of the days before as_of."""
    return df.where(_is("buyer_id", who.uid) & (F.col("created_at") > F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS")))
