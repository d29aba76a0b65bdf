"""Settlement ledger, commissions, accruals and money reports. Amounts are whole cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SETTLED = ["paid", "processing", "shipped", "delivered", "completed", "partially_refunded"]


def half_up(x: Column) -> Column:
    """The nearest integer; halves go up."""
    return F.floor(x + F.lit(0.5))


def commission_rates(rules: DataFrame, default: str = "0.12") -> DataFrame:
    """vendor_id, rate: of the vendor's open rules (scope vendor, no effective_to) the one that took effect last; ties to the higher rate."""
    own = rules.where((F.col("scope") == "vendor") & F.col("effective_to").isNull() & F.col("vendor_id").isNotNull())
    return own.groupBy("vendor_id").agg(F.max(F.struct("effective_from", "rate"))["rate"].alias("rate"))


def with_commission(orders: DataFrame, rates: DataFrame | None = None, default: str = "0.12") -> DataFrame:
    rate = F.lit(default).cast("decimal(6,4)")
    if rates is not None:
        orders, rate = orders.join(rates, "vendor_id", "left"), F.coalesce("rate", rate)
    return orders.withColumn("commission", half_up(F.col("total_cents") * rate).cast("long"))


def settle(orders: DataFrame, posted: DataFrame | None = None, default_reserve: str = "0.15") -> DataFrame:
    """Ledger rows of orders (order_id, vendor_id, total_cents, commission, reserve_pct, created_at), four for each not yet posted."""
    if posted is not None:
        done = posted.where(F.col("entry_type") == "buyer_payment").select("order_id")
        orders = orders.join(done, "order_id", "left_anti")
    net = F.col("total_cents") - F.col("commission")
    o = orders.withColumn("hold", F.round(net * F.coalesce("reserve_pct", F.lit(default_reserve).cast("decimal(6,4)"))).cast("long"))
    row = lambda kind, amount: F.struct(F.lit(kind).alias("entry_type"), amount.cast("long").alias("amount_cents"))
    rows = F.array(row("buyer_payment", F.col("total_cents")), row("platform_commission", -F.col("commission")), row("vendor_earnings", net - F.col("hold")), row("reserve_hold", F.col("hold")))
    return o.select("order_id", "vendor_id", "created_at", F.explode(rows).alias("x")).select("order_id", "vendor_id", "x.entry_type", "x.amount_cents", "created_at")


def total(kind: str, amount: Column | None = None) -> Column:
    """Sum of the amounts of one kind of entry; nought if there are none."""
    return F.coalesce(F.sum(F.when(F.col("entry_type") == kind, F.col("amount_cents") if amount is None else amount)), F.lit(0)).cast("long")


def vendor_accruals(ledger: DataFrame) -> DataFrame:
    """Earnings less payouts, reserve less releases (shown as nought at least); rows with no vendor are left out."""
    size = F.abs("amount_cents")
    out = ledger.where(F.col("vendor_id").isNotNull()).groupBy("vendor_id").agg((total("vendor_earnings") - total("payout", size)).alias("earnings"), (total("reserve_hold") - total("reserve_release", size)).alias("reserve"))
    return out.withColumn("reserve_shown", F.greatest("reserve", F.lit(0).cast("long")))


def payout_cards(ledger: DataFrame, newest: int = 100) -> DataFrame:
    """Per vendor over its newest rows only: earnings, hold less the size of the summed releases, size of the summed payouts."""
    w = Window.partitionBy("vendor_id").orderBy(F.desc("created_at"), "order_id", "entry_type")
    top = ledger.where(F.col("vendor_id").isNotNull()).withColumn("r", F.row_number().over(w)).where(F.col("r") <= newest)
    return top.groupBy("vendor_id").agg(total("vendor_earnings").alias("earned"), (total("reserve_hold") - F.abs(total("reserve_release"))).alias("reserved"), F.abs(total("payout")).alias("paid"))


def gross_value(orders: DataFrame) -> DataFrame:
    settled = F.col("status").isin(SETTLED)
    return orders.agg(F.coalesce(F.sum(F.when(settled, F.col("total_cents"))), F.lit(0)).cast("long").alias("gmv_cents"), F.count_if(settled).alias("settled_orders"), F.count("*").alias("orders"))


def commission_earned(ledger: DataFrame) -> DataFrame:
    return ledger.agg(total("platform_commission", F.abs("amount_cents")).alias("commission_cents"))


def sales_since(orders: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per vendor: settled sales of the days before as_of, and orders to ship (paid)."""
    since = F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS")
    recent = (F.col("created_at") >= since) & F.col("status").isin(SETTLED)
    return orders.where(F.col("vendor_id").isNotNull()).groupBy("vendor_id").agg(F.coalesce(F.sum(F.when(recent, F.col("total_cents"))), F.lit(0)).cast("long").alias("sales_cents"), F.count_if(F.col("status") == "paid").alias("to_ship"))
