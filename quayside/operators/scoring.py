"""Listing scores, tiers and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clamp
from .ledger import half_up

#: Weights of the health score's components (they sum to 110).
WEIGHTS = {
    "verification": 12, "coa_recency": 12, "coa_completeness": 8, "product_completeness": 8, "images": 4, "inventory": 6, "shipping": 10,
    "tracking": 6, "delivery": 8, "disputes": 10, "returns": 4, "reviews": 8, "responsiveness": 4, "conduct": 10,
}


def bayesian(avg: Column, n: Column, prior: float = 4.2, weight: int = 20) -> Column:
    none = avg.isNull() | n.isNull() | (n == 0)
    return F.when(none, F.lit(prior)).otherwise((prior * weight + avg * n) / (weight + n))


def components(x: dict[str, Column]) -> dict[str, Column]:
    """The health score's components, 0 to 1, from the columns of x."""
    age = x["coa_age_days"]
    faults = 0.25 * x["violations"] + 0.15 * x["warnings"] + 0.05 * x["complaints"] + 0.3 * x["delistings"]
    return {
        "verification": F.when(x["verified"], 1.0).otherwise(0.4),
        "coa_recency": F.when(age.isNull() | x["coa_expired"], 0.0).otherwise(clamp(1 - age / 365)),
        "coa_completeness": F.when(x["coa_complete"], 1.0).otherwise(0.5),
        "product_completeness": clamp(x["completeness"]),
        "images": clamp(x["images"] / 3),
        "inventory": clamp(x["inventory"]),
        "shipping": clamp(x["on_time"]),
        "tracking": clamp(x["tracking"]),
        "delivery": clamp(x["delivery"]),
        "disputes": clamp(1 - 10 * x["dispute_rate"]),
        "returns": clamp(1 - 5 * x["return_rate"]),
        "reviews": clamp((bayesian(x["rating_avg"], x["rating_count"]) - 3) / 2),
        "responsiveness": clamp(1 - x["response_hours"] / 48),
        "conduct": clamp(1 - faults),
    }


def health_score(x: dict[str, Column]) -> Column:
    parts = components(x)
    weighted = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return half_up(100 * weighted / sum(WEIGHTS.values())).cast("int")


def compliance_tier(status: Column, *panels: Column) -> Column:
    """3: verified and all panels pass; 2: verified; 0: none, expired or rejected; else 1."""
    passed = F.lit(True)
    for p in panels:
        passed = passed & p.eqNullSafe("pass")
    return F.when(status.isNull() | status.isin("expired", "rejected"), 0).when((status == "verified") & passed, 3).when(status == "verified", 2).otherwise(1)


def verification_tier(*flags: Column) -> Column:
    return sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0))


def sponsored_eligible(verified: Column, coa_expired: Column, open_disputes: Column, on_time: Column, violations: Column) -> Column:
    return F.coalesce(verified & ~coa_expired & (open_disputes == 0) & (on_time >= 0.9) & (violations == 0), F.lit(False))


def rank_score(tier: Column, health: Column, verification: Column, rating: Column, on_time: Column, destination: Column) -> Column:
    return 1e6 * tier + 1e3 * health + 200 * verification + 20 * rating + 40 * on_time + 30 * destination


def promote(ids: list, sponsored: list[bool], tiers: list[int], most: int = 2) -> list:
    """A list's order with sponsored items moved up two places, from the end, past an item of no higher tier; at most `most` moves, of which one item may take several."""
    page = list(zip(ids, sponsored, tiers, strict=True))
    left = most
    for at in reversed(range(1, len(page))):
        _, paid, tier = page[at]
        if left and paid and tier >= page[at - 1][2]:
            page.insert(max(0, at - 2), page.pop(at))
            left -= 1
    return [x for x, *_ in page]


def ranked_pages(rows: DataFrame, page: str, sensitive: bool = False) -> DataFrame:
    """Rows (page key, id, score, seq, sponsored, tier) with their position in the page's whole list, of any length.

    Promotion as promote() with two moves: what moves is found by windows, and the positions around it are shifted.
    """
    w = Window.partitionBy(page).orderBy(F.desc("score"), "seq")
    rows = rows.withColumn("at", F.row_number().over(w))
    if sensitive:
        return rows.select(page, "id", F.col("at").alias("position"))
    paid = F.coalesce(F.col("sponsored"), F.lit(False))
    rows = rows.select(page, "id", "at", "tier", paid.alias("paid"), *(F.lag("tier", i).over(w).alias(f"tier_{i}") for i in (1, 2, 3)), F.lag(paid, 2).over(w).alias("paid_2"))
    # The last that may move is the first move. What is three places and more before it stands as it was for the second.
    may = rows.where(F.col("paid") & (F.col("tier") >= F.col("tier_1")))
    last = may.groupBy(page).agg(F.max_by(F.struct("at", "tier", "tier_2", "tier_3", "paid_2"), "at").alias("x")).select(F.col(page).alias("of"), "x.*").withColumnRenamed("at", "first")
    same = F.col(page).eqNullSafe(F.col("of"))
    rest = may.select(page, "at").join(last.select("of", "first"), same).where("at <= first - 3").groupBy(F.col("of").alias("too")).agg(F.max("at").alias("rest"))
    # Behind the first move, the item that was two before it stands right behind it; it may pass it, or the moved item goes on.
    passes = F.when(F.col("paid_2") & (F.col("tier_2") >= F.col("tier")), F.col("first") - 1)
    again = F.when(F.col("tier") >= F.col("tier_3"), F.col("first") - 2)
    moves = last.join(rest, F.col("of").eqNullSafe(F.col("too")), "left").select("of", "first", F.coalesce(passes, again, "rest").alias("second"))

    def moved(at: Column, start: Column) -> Column:
        to = F.greatest(F.lit(1), start - 2)
        return F.when(at == start, to).when((at >= to) & (at < start), at + 1).otherwise(at)

    # At most one row of moves a page.
    out = rows.select(page, "id", "at").join(moves, same, "left")
    return out.withColumn("at", moved(F.col("at"), F.col("first"))).select(page, "id", moved(F.col("at"), F.col("second")).cast("int").alias("position"))
