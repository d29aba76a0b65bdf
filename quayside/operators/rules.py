"""Destination rules, checkout checks, moderation, state machines, data checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAUNCH = ["US", "CA"]


def eligibility(country: Column, region: Column, origin: Column, restricted: Column, cannabinoid: Column, age_restricted: Column) -> Column:
    """struct(eligible, effect): the first rule that applies. A restriction with no region holds for its whole country."""
    hit = F.exists(restricted, lambda r: (r["country"] == country) & (r["region"].isNull() | F.coalesce(r["region"] == region, F.lit(False))))
    out = lambda ok, effect: F.struct(F.lit(ok).alias("eligible"), F.lit(effect).alias("effect"))
    return (
        F.when(~F.coalesce(country.isin(LAUNCH), F.lit(False)), out(False, "deny_launch"))
        .when(hit, out(False, "deny_product"))
        .when((origin != country) & (cannabinoid != "none"), out(False, "deny_cross_border"))
        .when(age_restricted, out(True, "notice_only"))
        .otherwise(out(True, "allow"))
    )


def first_failures(lines: DataFrame) -> DataFrame:
    """Per order the first failing line's code (not_live, out_of_stock, not_eligible); orders without one are absent. lines: order_id, line, seq, live, stock, quantity, eligible."""
    code = F.when(~F.col("live"), "not_live").when(F.col("stock") < F.col("quantity"), "out_of_stock").when(~F.col("eligible"), "not_eligible")
    return lines.withColumn("code", code).where(F.col("code").isNotNull()).groupBy("order_id").agg(F.min(F.struct("line", "seq", "code"))["code"].alias("reject_code"))


#: Detectors of a message, the first match of each counts. Of external addresses the own site's is none.
DETECTORS = {
    "email_address": r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}",
    "phone_number": r"(\+?1[\s.-]?)?(\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}\b",
    "wallet_address": r"\b(bc1[a-z0-9]{20,}|[13][a-km-zA-HJ-NP-Z1-9]{25,34}|0x[a-fA-F0-9]{40}|lnbc[a-z0-9]{20,})\b",
    "telegram": r"(?i)\b(t\.me/|telegram|tg:\s*@)",
    "whatsapp": r"(?i)\b(whats\s?app|wa\.me/)",
    "discord": r"(?i)\b(discord(\.gg|app\.com)?)",
    "external_url": r"(?i)\bhttps?://(?!{own})[^\s]+",
    "offplatform_payment": r"(?i)\b(venmo|cashapp|cash app|zelle|paypal|pay\s+(me\s+)?(directly|off[\s-]?site|outside)|send\s+(btc|bitcoin|crypto)\s+to|wire\s+transfer|western union)\b",
}


def moderate(body: Column, own_site: str = "market.example") -> Column:
    """array<struct<kind,match>> of the detectors that match, matches cut to 80 characters."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.substring(F.regexp_extract(body, p.replace("{own}", own_site.replace(".", r"\.")), 0), 1, 80).alias("match")) for k, p in DETECTORS.items()])
    return F.filter(found, lambda x: x["match"] != "")


def flag_rows(messages: DataFrame) -> DataFrame:
    """A row for each flag."""
    return messages.select("id", F.explode(moderate(F.col("body"))).alias("x")).select("id", "x.kind", "x.match")


#: What follows each strike.
LADDER = ["automated_warning", "admin_review", "listing_suspension_review", "store_suspension_review"]


def enforcement(flags: DataFrame) -> DataFrame:
    """Each flag's strike number per sender and what follows."""
    n = F.row_number().over(Window.partitionBy("sender_id").orderBy("seq"))
    return flags.withColumn("strike", n).withColumn("action", F.element_at(F.array(*map(F.lit, LADDER)), F.least(F.col("strike"), F.lit(4))))


#: Allowed transitions.
TRANSITIONS = {
    "application": [(a, b) for a in ("submitted", "resubmitted", "under_review", "info_requested") for b in ("approved", "rejected", "info_requested")],
    "product": [("pending_review", "live"), ("pending_review", "delisted"), ("pending_review", "changes_requested")],
    "compliance": [("submitted", "verified"), ("submitted", "rejected")],
}


def transition_violations(changes: DataFrame, machine: str) -> DataFrame:
    """Changes (from_status, to_status) that the machine doesn't allow."""
    allowed = reduce(lambda a, b: a | b, [(F.col("from_status") == a) & (F.col("to_status") == b) for a, b in TRANSITIONS[machine]])
    return changes.where(~F.coalesce(allowed, F.lit(False)))


def change_feed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, op (insert, update, delete), before and after as JSON; unchanged rows are left out."""
    a = old.select(F.col(key), F.to_json(F.struct("*")).alias("before"))
    b = new.select(F.col(key), F.to_json(F.struct("*")).alias("after"))
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").when(F.col("before") != F.col("after"), "update")
    return a.join(b, key, "full").withColumn("op", op).where(F.col("op").isNotNull()).select(key, "op", "before", "after")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows put in by key; what new doesn't name stays."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_plan(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and whether it is created, updated or kept."""
    a, b = old.select(key, F.lit(True).alias("was")), new.select(key, F.lit(True).alias("is"))
    act = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "kept").otherwise("updated")
    return a.join(b, key, "full").select(key, act.alias("action"))


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and the rows of new whose key it lacks; of several such the least row."""
    w = Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key])
    fresh = new.join(old.select(key), key, "left_anti").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return old.unionByName(fresh)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("violations"))


def unique_slugs(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """slug for each row of wanted (id, base): base or base-2 to base-19, the first not taken, base-19 if all are."""
    tries = wanted.select("id", "base", F.explode(F.sequence(F.lit(1), F.lit(19))).alias("n"))
    tries = tries.withColumn("slug", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))))
    free = tries.join(taken.select("slug").distinct(), "slug", "left_anti").groupBy("id").agg(F.min(F.struct("n", "slug"))["slug"].alias("slug"))
    return wanted.join(free, "id", "left").select("id", F.coalesce("slug", F.concat("base", F.lit("-19"))).alias("slug"))
