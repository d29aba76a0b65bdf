"""Mutations as plans, checkout keys, provisioning, time-driven sweeps and checks. as_of is a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def update_where(df: DataFrame, where: Column, touched: Column | None = None, **new: Column) -> DataFrame:
    """df with new values in the rows of where; updated_at, if touched is given, too."""
    hit = F.coalesce(where, F.lit(False))
    values = dict(new) | ({"updated_at": touched} if touched is not None else {})
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, v in values.items()})


def delete_where(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def suspend(products: DataFrame, vendor_id: int) -> DataFrame:
    """The vendor's live products become suspended."""
    return update_where(products, (F.col("vendor_id") == vendor_id) & (F.col("status") == "live"), status=F.lit("suspended"))


def reinstate(products: DataFrame, vendor_id: int) -> DataFrame:
    """All of the vendor's suspended products become live, for whatever reason they were suspended."""
    return update_where(products, (F.col("vendor_id") == vendor_id) & (F.col("status") == "suspended"), status=F.lit("live"))


def first_by_key(orders: DataFrame, key: str, *order) -> DataFrame:
    """One order for each key; orders without a key all stay."""
    keyed = orders.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    return keyed.unionByName(orders.where(F.col(key).isNull()))


def event_log(events: DataFrame) -> DataFrame:
    """invoice_id, log: delivery:type of each event in order of arrival, comma-joined."""
    one = F.struct("arrival_seq", F.concat_ws(":", F.col("delivery_id").cast("string"), "type").alias("x"))
    return events.groupBy("invoice_id").agg(F.array_join(F.sort_array(F.collect_list(one))["x"], ",").alias("log"))


#: Seller labels and their types; reserve share, days held and tier by risk.
SELLERS = {"AUTOMOBILE": "cultivator", "BUILDING": "processor", "FURNITURE": "retailer", "HOUSEHOLD": "farm"}
RESERVES = {True: ("0.25", 45, 2), False: ("0.15", 30, 1)}


def provision(applications: DataFrame) -> DataFrame:
    """vendor_id, seller_type, reserve_pct, rolling_days, risk_tier of applications (vendor_id, label, high_risk)."""
    kinds = F.create_map(*[F.lit(x) for kv in SELLERS.items() for x in kv])
    by = lambda i, t: F.when(F.col("high_risk"), F.lit(RESERVES[True][i])).otherwise(F.lit(RESERVES[False][i])).cast(t)
    return applications.select("vendor_id", F.coalesce(kinds[F.col("label")], F.lit("cbd_brand")).alias("seller_type"), by(0, "double").alias("reserve_pct"), by(1, "int").alias("rolling_days"), by(2, "int").alias("risk_tier"))


def sweep_records(records: DataFrame, as_of: str, valid: int = 365, warn: int = 30) -> DataFrame:
    """Usable records past their retest date are expired, those within warn days of it expire soon."""
    left = F.datediff(F.date_add("issue_date", valid), F.lit(as_of).cast("date"))
    usable = F.col("status").isin("verified", "expiring_soon")
    return update_where(records, usable, status=F.when(left < 0, "expired").when(left <= warn, "expiring_soon").otherwise(F.col("status")))


def completed(orders: DataFrame, as_of: str, hours: int = 48) -> DataFrame:
    """order_id, status: paid orders whose dispute window since their delivery (delivered_at) has ended are completed."""
    over = F.col("delivered_at") + F.expr(f"INTERVAL {hours} HOURS") <= F.to_timestamp_ntz(F.lit(as_of))
    return update_where(orders, (F.col("status") == "paid") & over, status=F.lit("completed")).select("order_id", "status")


def payout_queue(accruals: DataFrame, held: DataFrame) -> DataFrame:
    """vendor_id, eligible: earnings less the reserve of vendors that aren't held, where that is positive."""
    out = accruals.join(held.select("vendor_id"), "vendor_id", "left_anti").withColumn("eligible", F.col("earnings") - F.col("reserve_shown"))
    return out.where("eligible > 0").select("vendor_id", "eligible")


def rolling_share(rows: DataFrame, key: str, at: str, flag: Column, days: int = 30) -> DataFrame:
    """key, day, rows and flagged of the days up to and with each day that has rows; days are aggregated before the window."""
    day = rows.groupBy(key, F.to_date(at).alias("day")).agg(F.count("*").alias("n"), F.count_if(flag).alias("f"))
    w = Window.partitionBy(key).orderBy(F.unix_date("day")).rangeBetween(1 - days, 0)
    return day.select(key, "day", F.sum("n").over(w).alias("rows"), F.sum("f").over(w).alias("flagged"))


def tier_price(lines: DataFrame, tiers: DataFrame) -> DataFrame:
    """id, price_cents of each line (id, product_id, quantity): of the product's tiers (min_quantity, price_cents) the largest that the quantity reaches."""
    own = tiers.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("min_quantity", "price_cents")), asc=False).alias("tiers"))
    fits = F.filter("tiers", lambda t: t["min_quantity"] <= F.col("quantity"))
    return lines.join(own, "product_id", "left").select("id", F.get(fits, 0)["price_cents"].alias("price_cents"))


def sender_role(admin: Column, sender_vendor: Column, thread_vendor: Column) -> Column:
    return F.when(admin, "admin").when(sender_vendor == thread_vendor, "vendor").otherwise("buyer")


def write_violations(old: DataFrame, new: DataFrame, key: str, fixed: list[str], allowed: list[str]) -> DataFrame:
    """Keys whose new row changes a fixed column or takes a status that isn't allowed."""
    a = old.select(key, F.struct(*fixed).alias("_was"))
    bad = ~F.col("_was").eqNullSafe(F.struct(*fixed)) | ~F.col("status").isin(allowed)
    return new.join(a, key).where(bad).select(key)


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """keys, rows of the keys that occur more than once; null keys equal none."""
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")
