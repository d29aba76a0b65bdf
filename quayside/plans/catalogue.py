"""The registered queries over the bound tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import catalog, content, ledger, rules, scoring, search, visibility
from ..sources import feeds
from ..streaming import payments
from . import bind
from .bind import with_tables

AS_OF, COA_AS_OF = "2001-08-02", "2024-02-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def charged(s: SparkSession, d: str) -> DataFrame:
    """Paid and completed orders with commission and the vendor's reserve."""
    o = ledger.with_commission(bind.orders(s, d).where(F.col("status").isin("paid", "completed")))
    return o.withColumn("reserve_pct", F.when(F.col("vendor_id") % 4 == 0, F.lit("0.25")).cast("decimal(6,4)"))


def full_ledger(s: SparkSession, d: str) -> DataFrame:
    """Settlement rows, and payouts and reserve releases of some orders."""
    rows = ledger.settle(charged(s, d))
    extra = rows.where((F.col("entry_type") == "buyer_payment") & (F.col("order_id") % 5 == 0)).withColumn("entry_type", F.lit("payout")).withColumn("amount_cents", -F.expr("amount_cents div 4"))
    back = rows.where((F.col("entry_type") == "reserve_hold") & (F.col("order_id") % 7 == 0)).withColumn("entry_type", F.lit("reserve_release")).withColumn("amount_cents", -F.expr("amount_cents div 2"))
    return rows.unionByName(extra).unionByName(back)


_SUM = "cast(coalesce(sum({1}) filter (where entry_type = '{0}'), 0) as bigint)"


def _sum(kind: str, what: str = "amount_cents") -> str:
    return _SUM.format(kind, what)


@query(with_tables("ledger", f"select vendor_id, earnings, reserve, greatest(reserve, 0) as reserve_shown from (select vendor_id, {_sum('vendor_earnings')} - {_sum('payout', 'abs(amount_cents)')} as earnings, {_sum('reserve_hold')} - {_sum('reserve_release', 'abs(amount_cents)')} as reserve from ledger where vendor_id is not null group by 1)"))
def ledger_vendor_accruals(s, d):
    return ledger.vendor_accruals(full_ledger(s, d))


@query(with_tables("ledger", f"select vendor_id, {_sum('vendor_earnings')} as earned, {_sum('reserve_hold')} - abs({_sum('reserve_release')}) as reserved, abs({_sum('payout')}) as paid from (select *, row_number() over (partition by vendor_id order by created_at desc, order_id, entry_type) as r from ledger where vendor_id is not null) where r <= 100 group by 1"))
def vendor_payout_cards(s, d):
    return ledger.payout_cards(full_ledger(s, d))


@query(with_tables("ledger", "select order_id, vendor_id, entry_type, amount_cents from ledger where entry_type not in ('payout', 'reserve_release')"))
def settlement_ledger_rows(s, d):
    return ledger.settle(charged(s, d)).drop("created_at")


@query(with_tables("split", "select order_id, cast(2 * (total_cents - commission) as bigint) as entry_sum, cast(4 as bigint) as entries from split where order_id % 2 = 1"))
def settlement_idempotent(s, d):
    o = charged(s, d)
    posted = ledger.settle(o.where(F.col("order_id") % 2 == 0))
    return ledger.settle(o, posted).groupBy("order_id").agg(F.sum("amount_cents").alias("entry_sum"), F.count("*").alias("entries"))


@query(with_tables("ord", "select cast(coalesce(sum(total_cents) filter (where status in ('paid', 'completed')), 0) as bigint) as gmv_cents, count(*) filter (where status in ('paid', 'completed')) as settled_orders, count(*) as orders from ord"))
def admin_gmv(s, d):
    return ledger.gross_value(bind.orders(s, d))


@query(with_tables("ledger", f"select {_sum('platform_commission', 'abs(amount_cents)')} as commission_cents from ledger"))
def commission_earned(s, d):
    return ledger.commission_earned(full_ledger(s, d))


@query(with_tables("ord", f"select vendor_id, cast(coalesce(sum(total_cents) filter (where created_at >= timestamp '{AS_OF}' - interval 30 day and status in ('paid', 'completed')), 0) as bigint) as sales_cents, count(*) filter (where status = 'paid') as to_ship from ord where vendor_id is not null group by 1"))
def vendor_sales_30d(s, d):
    return ledger.sales_since(bind.orders(s, d), AS_OF)


@query(with_tables("vendor product compliance", "select cast(a as bigint) as suspended_vendors, cast(b as bigint) as draft_products, cast(c as bigint) as submitted_records, cast(a + b + c as bigint) as queue_total from (select (select count(*) from vendor where status = 'suspended') as a, (select count(*) from product where status = 'draft') as b, (select count(*) from compliance where status = 'submitted') as c)"))
def admin_queue_counts(s, d):
    one = lambda df, v, name: df.agg(F.count_if(F.col("status") == v).alias(name))
    a = one(bind.vendors(s, d), "suspended", "suspended_vendors")
    b = one(bind.products(s, d), "draft", "draft_products")
    c = one(bind.compliance(s, d), "submitted", "submitted_records")
    return a.crossJoin(b).crossJoin(c).withColumn("queue_total", F.col("suspended_vendors") + F.col("draft_products") + F.col("submitted_records"))


@query("with rules as (select l_suppkey as vendor_id, l_shipdate as effective_from, cast(l_linenumber as decimal(6,4)) / 100 as rate from lineitem where l_returnflag = 'N') select s_suppkey as vendor_id, cast(coalesce(m.rate, 0.12) as double) as rate from supplier left join (select vendor_id, arg_max(rate, (effective_from, rate)) as rate from rules group by 1) m on m.vendor_id = s_suppkey")
def commission_resolve(s, d):
    li = bind.table(s, d, "lineitem").where(F.col("l_returnflag") == "N")
    own = li.select(F.lit("vendor").alias("scope"), F.col("l_suppkey").alias("vendor_id"), F.col("l_shipdate").alias("effective_from"), F.lit(None).cast("timestamp_ntz").alias("effective_to"), (F.col("l_linenumber").cast("decimal(6,4)") / 100).alias("rate"))
    v = bind.vendors(s, d).select("vendor_id")
    return v.join(ledger.commission_rates(own), "vendor_id", "left").select("vendor_id", F.coalesce(F.col("rate").cast("double"), F.lit(0.12)).alias("rate"))


@query(with_tables("review", "select product_id, round(avg(rating), 6) as rating_avg, count(*) as rating_count from review where status = 'published' group by 1"))
def product_review_stats(s, d):
    return catalog.review_stats(bind.reviews(s, d), "product_id")


@query(with_tables("vendor review", "select v.vendor_id, coalesce(round(avg(rating), 6), 0) as rating_avg, count(rating) as rating_count from vendor v left join review r on r.vendor_id = v.vendor_id and r.status = 'published' group by 1"))
def vendor_review_stats(s, d):
    return catalog.with_stats(bind.vendors(s, d).select("vendor_id"), catalog.review_stats(bind.reviews(s, d), "vendor_id"), "vendor_id")


@query(with_tables("vendor product", "select v.vendor_id, count(p.product_id) as live_products from vendor v left join product p on p.vendor_id = v.vendor_id and p.status = 'live' group by 1"))
def vendor_product_counts(s, d):
    return catalog.live_counts(bind.vendors(s, d), bind.products(s, d))


_MODEL = "product left join vendor v on v.vendor_id = product.vendor_id left join (select product_id, round(avg(rating), 6) as a, count(*) as n from review where status = 'published' group by 1) r on r.product_id = product.product_id"


@query(with_tables("product vendor review variant compliance", f"select product.product_id, title, v.brand_name, v.country, v.status as vendor_status, coalesce(r.a, 0) as rating_avg, coalesce(r.n, 0) as rating_count, (select count(*) from variant x where x.product_id = product.product_id) as n_variants, (select count(*) from compliance c where c.product_id = product.product_id) as n_records from {_MODEL}"))
def product_read_model(s, d):
    return _model(s, d).select("product_id", "title", "vendor.brand_name", "vendor.country", "vendor.vendor_status", "rating_avg", "rating_count", F.size("variants").cast("long").alias("n_variants"), F.size("compliance").cast("long").alias("n_records"))


def _model(s, d):
    return catalog.read_model(bind.products(s, d), bind.vendors(s, d), bind.variants(s, d), bind.compliance(s, d), catalog.review_stats(bind.reviews(s, d), "product_id"))


@query(with_tables("variant compliance", "select p.p_partkey as product_id, (select string_agg(k || ':' || price_cents || ':' || stock, ',' order by k) from variant v where v.product_id = p.p_partkey) as variants, (select string_agg(record_id || ':' || status, ',' order by record_id) from compliance c where c.product_id = p.p_partkey) as records from part p"))
def product_read_model_nested(s, d):
    one = lambda *xs: F.concat_ws(":", *[x.cast("string") for x in xs])
    m = _model(s, d)
    return m.select("product_id", F.array_join(F.transform("variants", lambda v: one(v["k"], v["price_cents"], v["stock"])), ",").alias("variants"), F.array_join(F.transform("compliance", lambda c: one(c["record_id"], c["status"])), ",").alias("records"))


_LATEST = "(select * from (select *, row_number() over (partition by product_id order by issue_date desc, record_id) as r from compliance where status in ('verified', 'expiring_soon')) where r = 1)"


@query(with_tables("compliance", f"select product_id, record_id, status from {_LATEST}"))
def latest_coa(s, d):
    return catalog.latest_record(bind.compliance(s, d)).select("product_id", "record_id", "status")


@query(with_tables("product compliance", f"select p.product_id, concat_ws(',', case when c.product_id is not null then 'verified_coa' end, case when c.batch_number = p.batch_number then 'batch_linked' end, case when date '{COA_AS_OF}' - c.issue_date < 183 then 'recently_tested' end, 'tracking', case when p.product_id % 4 = 0 then 'wholesale' end) as badges from product p left join {_LATEST} c on c.product_id = p.product_id"))
def product_badges(s, d):
    p = bind.products(s, d).withColumn("wholesale", F.col("product_id") % 4 == 0)
    return catalog.product_badges(p, bind.compliance(s, d), COA_AS_OF).select("product_id", F.array_join("badges", ",").alias("badges"))


@query(with_tables("vendor", "select vendor_id, concat_ws(',', case when identity_verified then 'identity' end, case when identity_verified then 'verified' end, case when business_verified then 'business' end, case when wallet_verified then 'wallet' end, case when wholesale_enabled then 'wholesale' end) as badges from vendor"))
def vendor_badges(s, d):
    return catalog.vendor_badges(bind.vendors(s, d)).select("vendor_id", F.array_join("badges", ",").alias("badges"))


@query(with_tables("vendor", "select vendor_id, greatest(0, 2 * cast(identity_verified as int) + cast(business_verified as int) + cast(wallet_verified as int) + cast(wholesale_enabled as int) - 3) as more from vendor"))
def badge_overflow(s, d):
    return catalog.badge_overflow(catalog.vendor_badges(bind.vendors(s, d))).select("vendor_id", "more")


@query(with_tables("variant", "select product_id, min(price_cents) filter (where not wholesale_only) as low_cents, max(price_cents) filter (where not wholesale_only) as high_cents, bool_or(stock > 0) as in_stock, count(*) as offers, coalesce(min(price_cents) filter (where not wholesale_only), min(price_cents)) as from_cents from variant group by 1"))
def price_range(s, d):
    return catalog.prices(bind.variants(s, d))


@query(with_tables("variant", "select product_id, min(price_cents) as from_cents from variant where wholesale_only group by 1"))
def from_price(s, d):
    return catalog.prices(bind.variants(s, d).where("wholesale_only")).select("product_id", "from_cents")


@query(with_tables("variant", "select l_orderkey as cart_id, cast(sum(coalesce(price_cents * cast(l_quantity as bigint), 0)) as bigint) as subtotal_cents from lineitem left join variant on product_id = l_partkey and k = 1 and l_linenumber <> 3 group by 1"))
def cart_subtotal(s, d):
    v = bind.variants(s, d).where("k = 1").select(F.col("product_id").alias("l_partkey"), "price_cents")
    li = bind.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    x = li.join(v, (li["l_partkey"] == v["l_partkey"]) & (F.col("l_linenumber") != 3), "left")
    return x.groupBy(F.col("l_orderkey").alias("cart_id")).agg(F.sum(F.coalesce(F.col("price_cents") * F.col("q"), F.lit(0))).alias("subtotal_cents"))


@query(with_tables("product compliance", "select p.product_id, p.title, c.record_id, c.status from product p join compliance c on c.product_id = p.product_id"))
def compliance_flat(s, d):
    return catalog.flat_records(bind.products(s, d), bind.compliance(s, d)).select("product_id", "title", "record_id", "status")


@query(with_tables("product compliance", f"select * from (select p.product_id, case when c.product_id is null and cannabinoid_type <> 'none' then 'missing_coa' when c.batch_number is distinct from p.batch_number and c.product_id is not null then 'batch_mismatch' end as warning from product p left join {_LATEST} c on c.product_id = p.product_id) where warning is not null"))
def batch_warnings(s, d):
    return catalog.batch_warnings(bind.products(s, d), bind.compliance(s, d))


@query(with_tables("product", "select a.product_id, row_number() over (partition by a.product_id order by b.id) as position, b.id as related_id from (select product_id, category from product where status = 'live') a join (select product_id as id, category, row_number() over (partition by category order by product_id) as r from product where status = 'live') b on a.category = b.category and b.r <= 5 and b.id <> a.product_id qualify position <= 4"))
def related_products(s, d):
    return catalog.related(bind.products(s, d))


@query(with_tables("variant", "select product_id, printf('{\"@type\":\"AggregateOffer\",\"lowPrice\":\"%d.%02d\",\"highPrice\":\"%d.%02d\",\"offerCount\":%d,\"availability\":\"%s\"}', l // 100, l % 100, h // 100, h % 100, n, case when i then 'InStock' else 'OutOfStock' end) as json from (select product_id, min(price_cents) filter (where not wholesale_only) as l, max(price_cents) filter (where not wholesale_only) as h, bool_or(stock > 0) as i, count(*) as n from variant group by 1)"))
def offers_jsonld(s, d):
    return content.offers_json(catalog.prices(bind.variants(s, d)))


# Scores


@query(with_tables("compliance", f"select record_id, product_id, case when status in ('expired', 'rejected') then 0 when status = 'verified' and pesticides = 'pass' and heavy_metals = 'pass' and microbials = 'pass' then 3 when status = 'verified' then 2 else 1 end as tier from compliance"))
def compliance_tier(s, d):
    return bind.compliance(s, d).select("record_id", "product_id", scoring.compliance_tier(F.col("status"), F.col("pesticides"), F.col("heavy_metals"), F.col("microbials")).alias("tier"))


@query(with_tables("review", "select p_partkey as product_id, round(case when n is null then 4.2 else (4.2 * 20 + a * n) / (20 + n) end, 6) as rating from part left join (select product_id, avg(rating) as a, count(*) as n from review where status = 'published' group by 1) on product_id = p_partkey"))
def bayesian_rating(s, d):
    r = bind.reviews(s, d).where("status = 'published'").groupBy("product_id").agg(F.avg("rating").alias("a"), F.count("*").alias("n"))
    return bind.products(s, d).select("product_id").join(r, "product_id", "left").select("product_id", F.round(scoring.bayesian(F.col("a"), F.col("n")), 6).alias("rating"))


def _health(x: str = "p_partkey") -> dict:
    k = F.col(x)
    share = lambda m, by=100: (k % m) / by
    return {
        "verified": k % 3 != 0, "coa_age_days": F.when(k % 10 != 9, (k % 400).cast("double")), "coa_expired": k % 17 == 0, "coa_complete": k % 4 != 0, "completeness": share(101), "images": (k % 5).cast("double"), "inventory": share(103), "on_time": share(107), "tracking": share(109),
        "delivery": share(113), "dispute_rate": share(13), "return_rate": share(23), "rating_avg": F.when(k % 6 != 0, 1 + k % 5 * 1.0), "rating_count": k % 50, "response_hours": (k % 60).cast("double"), "violations": (k % 3).cast("double"), "warnings": (k % 2).cast("double"), "complaints": (k % 7).cast("double"), "delistings": F.lit(0.0),
    }


_HEALTH_SQL = """select p_partkey as product_id, cast(floor(100 * (
  12 * case when k % 3 <> 0 then 1.0 else 0.4 end + 12 * case when k % 10 = 9 or k % 17 = 0 then 0.0 else c(1 - (k % 400) / 365.0) end + 8 * case when k % 4 <> 0 then 1.0 else 0.5 end + 8 * c((k % 101) / 100.0) + 4 * c((k % 5) / 3.0)
  + 6 * c((k % 103) / 100.0) + 10 * c((k % 107) / 100.0) + 6 * c((k % 109) / 100.0) + 8 * c((k % 113) / 100.0) + 10 * c(1 - 10 * (k % 13) / 100.0) + 4 * c(1 - 5 * (k % 23) / 100.0)
  + 8 * c((case when k % 6 = 0 or k % 50 = 0 then 4.2 else (84 + (1 + k % 5) * (k % 50)) / (20.0 + k % 50) end - 3) / 2) + 4 * c(1 - (k % 60) / 48.0) + 10 * c(1 - (0.25 * (k % 3) + 0.15 * (k % 2) + 0.05 * (k % 7)))
) / 110 + 0.5) as int) as health from (select p_partkey, cast(p_partkey as double) as k from part)"""


def _clamped(sql: str) -> str:
    """c(x) written out as least(1, greatest(0, x))."""
    out, i = "", 0
    while (j := sql.find(" c(", i)) >= 0:
        depth, e = 1, j + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[e], 0)
            e += 1
        out += sql[i:j] + " least(1.0, greatest(0.0, " + sql[j + 3 : e - 1] + "))"
        i = e
    return out + sql[i:]


@query(_clamped(_HEALTH_SQL))
def health_score(s, d):
    return bind.table(s, d, "part").select(F.col("p_partkey").alias("product_id"), scoring.health_score(_health()).alias("health"))


@query("select p_partkey as product_id, p_partkey % 3 <> 0 and p_partkey % 17 <> 0 and p_partkey % 4 = 0 and p_partkey % 107 >= 90 and p_partkey % 5 = 0 as eligible from part")
def sponsored_eligible(s, d):
    k, x = F.col("p_partkey"), _health()
    return bind.table(s, d, "part").select(k.alias("product_id"), scoring.sponsored_eligible(x["verified"], x["coa_expired"], k % 4, x["on_time"], k % 5).alias("eligible"))


_RANK_SQL = "select p_partkey as id, p_type as page, p_partkey % 4 as tier, round(1e6 * (p_partkey % 4) + 1e3 * (p_partkey % 101) + 200 * (p_partkey % 3) + 20 * (1 + p_partkey % 5) + 40 * ((p_partkey % 11) / 10.0) + 30 * (p_partkey % 2), 6) as score from part"


def _scored(s, d):
    k = F.col("p_partkey")
    score = scoring.rank_score(k % 4, k % 101, k % 3, 1 + k % 5, (k % 11) / 10, k % 2)
    return bind.table(s, d, "part").select(k.alias("id"), F.col("p_type").alias("page"), (k % 4).alias("tier"), F.round(score, 6).alias("score"))


@query(f"select page, id, row_number() over (partition by page order by score desc, id) as position from ({_RANK_SQL})")
def rank_products(s, d):
    w = Window.partitionBy("page").orderBy(F.desc("score"), "id")
    return _scored(s, d).withColumn("position", F.row_number().over(w)).select("page", "id", "position")


@query()
def rank_products_sponsored(s, d):
    rows = _scored(s, d).withColumn("seq", F.col("id"))
    return scoring.ranked_pages(rows.withColumn("sponsored", F.col("id") % 6 == 0), "page")


# Search


@query("select product_id, title, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) as similarity from (select p_partkey as product_id, p_name as title, list_distinct(list_transform(range(1, len(p_name) + 2), lambda i: substr('  ' || lower(p_name) || ' ', i, 3))) as a, (select list_distinct(list_transform(range(1, len(q) + 2), lambda i: substr('  ' || lower(q) || ' ', i, 3))) from (select min(p_name) as q from part)) as b from part) where round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) >= 0.3 order by similarity desc, product_id limit 40")
def trigram_search(s, d):
    return search.trigram_search(bind.products(s, d), _name(s, d))


def _name(s, d) -> str:
    """A title to search for: the first by name (a single value)."""
    return bind.table(s, d, "part").agg(F.min("p_name")).first()[0] or ""


@query(with_tables("product", "select product_id, title from product where status = 'live' and (title ilike '%re%' or category ilike '%re%') order by product_id limit 40"))
def ilike_search(s, d):
    return search.ilike_search(bind.products(s, d), " re ")


_RANKED = """select product_id, vendor_id, round(2 * share + sim + 0.5 * coa + 0.15 * held, 9) as rank from (
  select product_id, vendor_id, title, batch_number, q, len(list_intersect(string_split_regex(lower(title), '\\s+'), list_distinct(string_split(lower(q), ' ')))) / greatest(1, len(list_distinct(string_split(lower(q), ' ')))) as share,
    len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) as sim,
    cast(exists (select 1 from compliance c where c.product_id = x.product_id and c.status = 'verified') as int) as coa, cast(exists (select 1 from variant v where v.product_id = x.product_id and stock > 0) as int) as held
  from (select product.*, q, list_distinct(list_transform(range(1, len(title) + 2), lambda i: substr('  ' || lower(title) || ' ', i, 3))) as a, list_distinct(list_transform(range(1, len(q) + 2), lambda i: substr('  ' || lower(q) || ' ', i, 3))) as b from product, (select min(p_name) as q from part) where status = 'live') x)
where share = 1 or sim >= 0.3 or title ilike '%' || q || '%' or batch_number ilike '%' || q || '%' order by rank desc, product_id limit 40"""


@query(with_tables("product compliance variant", _RANKED))
def search_ranked(s, d):
    return search.ranked(bind.products(s, d), bind.compliance(s, d), bind.variants(s, d), _name(s, d))


@query(with_tables("product compliance variant vendor", f"select t.* from ({_RANKED}) t where vendor_id in (select vendor_id from vendor where status = 'active')"))
def search_top40_then_active(s, d):
    return search.hydrate(search_ranked(s, d), bind.vendors(s, d)).select("product_id", "vendor_id", "rank")


@query(with_tables("product vendor", "select * from (select 'product' as kind, product_id as id, title as label from product where status = 'live' and title ilike '%er%' order by title, product_id limit 5) union all select * from (select 'store', vendor_id, brand_name from vendor where status = 'active' and brand_name ilike '%er%' order by brand_name, vendor_id limit 3)"))
def suggest(s, d):
    return search.suggest(bind.products(s, d), bind.vendors(s, d), "er")


@query(with_tables("product vendor", "select label, id, title, position from (select *, row_number() over (partition by label order by title, id) as position from (select 'products' as label, product_id as id, title from product where status = 'live' union all select 'stores', vendor_id, brand_name from vendor) where title ilike '%er%') where position <= case label when 'products' then 4 else 5 end"))
def federated_search(s, d):
    a = bind.products(s, d).where("status = 'live'").select(F.col("product_id").alias("id"), "title")
    b = bind.vendors(s, d).select(F.col("vendor_id").alias("id"), F.col("brand_name").alias("title"))
    return search.grouped({"products": (a, 4), "stores": (b, 5)}, "er")


# Rules


@query(with_tables("product", "select product_id, c as country, r as region, case when c not in ('US', 'CA') then 'deny_launch' when (r7 = 0 and c = 'CA') or (r7 = 1 and c = 'US' and r in ('ID', 'OR')) then 'deny_product' when c <> 'US' and cannabinoid_type <> 'none' then 'deny_cross_border' when age_restricted then 'notice_only' else 'allow' end as effect from product, (values ('US', 'TX'), ('US', 'ID'), ('US', null), ('CA', 'ON'), ('GB', '')) t(c, r)"))
def checkout_eligibility(s, d):
    to = s.createDataFrame([("US", "TX"), ("US", "ID"), ("US", None), ("CA", "ON"), ("GB", "")], "country string, region string")
    x = bind.products(s, d).crossJoin(F.broadcast(to))  # five fixed destinations
    e = rules.eligibility(F.col("country"), F.col("region"), F.lit("US"), F.col("restricted"), F.col("cannabinoid_type"), F.col("age_restricted"))
    return x.select("product_id", "country", "region", e["effect"].alias("effect"))


_LINES = "select l_orderkey as order_id, l_linenumber as line, l_partkey, l_partkey % 11 <> 0 as live, l_partkey % 40 as stock, cast(l_quantity as bigint) as quantity, l_partkey % 7 <> 0 as eligible from lineitem"


@query(f"select order_id, arg_min(code, (line, l_partkey, code)) as reject_code from (select *, case when not live then 'not_live' when stock < quantity then 'out_of_stock' when not eligible then 'not_eligible' end as code from ({_LINES})) where code is not null group by 1")
def checkout_reject_codes(s, d):
    k = F.col("l_partkey")
    lines = bind.table(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), k.alias("seq"), (k % 11 != 0).alias("live"), (k % 40).alias("stock"), F.col("l_quantity").cast("long").alias("quantity"), (k % 7 != 0).alias("eligible"))
    return rules.first_failures(lines)


_MESSAGES = "(select doc_id as id, text as body from documents union all select * from (values (-1, 'mail me a.b@c.io or 555-123-4567, https://else.example/x'), (-2, 'ask on Telegram or whats app, pay me directly'), (-3, 'see https://market.example/p and discord.gg/x'), (-4, 'send btc to bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq')) t(id, body))"
_FLAGS = f"""(select id, 'email_address' as kind, regexp_extract(body, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}', 0) as match from {_MESSAGES}
 union all select id, 'phone_number', regexp_extract(body, '(\\+?1[\\s.-]?)?(\\(?\\d{{3}}\\)?[\\s.-]?)\\d{{3}}[\\s.-]?\\d{{4}}\\b', 0) from {_MESSAGES}
 union all select id, 'wallet_address', regexp_extract(body, '\\b(bc1[a-z0-9]{{20,}}|[13][a-km-zA-HJ-NP-Z1-9]{{25,34}}|0x[a-fA-F0-9]{{40}}|lnbc[a-z0-9]{{20,}})\\b', 0) from {_MESSAGES}
 union all select id, 'telegram', regexp_extract(body, '(?i)\\b(t\\.me/|telegram|tg:\\s*@)', 0) from {_MESSAGES}
 union all select id, 'whatsapp', regexp_extract(body, '(?i)\\b(whats\\s?app|wa\\.me/)', 0) from {_MESSAGES}
 union all select id, 'discord', regexp_extract(body, '(?i)\\b(discord(\\.gg|app\\.com)?)', 0) from {_MESSAGES}
 union all select id, 'external_url', coalesce(list_filter(regexp_extract_all(body, '(?i)\\bhttps?://[^\\s]+'), lambda u: not regexp_matches(u, '(?i)^https?://market\\.example'))[1], '') from {_MESSAGES}
 union all select id, 'offplatform_payment', regexp_extract(body, '(?i)\\b(venmo|cashapp|cash app|zelle|paypal|pay\\s+(me\\s+)?(directly|off[\\s-]?site|outside)|send\\s+(btc|bitcoin|crypto)\\s+to|wire\\s+transfer|western union)\\b', 0) from {_MESSAGES})"""


def _messages(s, d):
    own = [(-1, "mail me a.b@c.io or 555-123-4567, https://else.example/x"), (-2, "ask on Telegram or whats app, pay me directly"), (-3, "see https://market.example/p and discord.gg/x"), (-4, "send btc to bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq")]
    docs = bind.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return docs.unionByName(s.createDataFrame(own, "id long, body string"))


@query(f"select id, kind, substr(match, 1, 80) as match from {_FLAGS} where match <> ''")
def moderation_fanout(s, d):
    return rules.flag_rows(_messages(s, d))


@query(f"select id, count(*) filter (where match <> '') as n_flags, bool_or(match <> '') as flagged from {_FLAGS} group by 1")
def moderation_flags(s, d):
    return _messages(s, d).withColumn("f", rules.moderate(F.col("body"))).select("id", F.size("f").cast("long").alias("n_flags"), (F.size("f") > 0).alias("flagged"))


@query("select event_id, user_id as sender_id, n as strike, case least(n, 4) when 1 then 'automated_warning' when 2 then 'admin_review' when 3 then 'listing_suspension_review' else 'store_suspension_review' end as action from (select event_id, user_id, cast(row_number() over (partition by user_id order by event_id) as int) as n from events where event_type = 'error')")
def enforcement_ladder(s, d):
    e = bind.table(s, d, "events").where("event_type = 'error'").select("event_id", F.col("user_id").alias("sender_id"), F.col("event_id").alias("seq"))
    return rules.enforcement(e).drop("seq")


# Text


@query("select page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g'), '&amp;', '&'), '&nbsp;', ' '), '&#?\\w+;', ' ', 'g'), '[ \\t]+', ' ', 'g'), '^\\s+', '', 'g'), '\\s+$', '', 'g')) as text_md5 from pages")
def html_to_text(s, d):
    return bind.table(s, d, "pages").select("page_id", F.md5(T.html_to_text(F.col("html"))).alias("text_md5"))


@query("select page_id, array_to_string(string_split_regex(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '^\\s+', ''), '\\s+$', ''), '\\s+')[1:20], ' ') as excerpt from pages")
def trim_words_excerpt(s, d):
    return bind.table(s, d, "pages").select("page_id", T.trim_words(F.col("html"), 20).alias("excerpt"))


@query("select page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as escaped from pages")
def escape_html(s, d):
    return bind.table(s, d, "pages").select("page_id", T.escape_html(F.col("url")).alias("escaped"))


@query("select p_partkey as product_id, substr(regexp_replace(regexp_replace(lower(trim(p_name || ' ' || p_brand)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) as slug from part")
def slugify(s, d):
    return bind.table(s, d, "part").select(F.col("p_partkey").alias("product_id"), T.slugify(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("select p_partkey as product_id, cast(round(p_retailprice * 100) as bigint) as cents, p_size as n from part")
def to_cents(s, d):
    p = bind.table(s, d, "part")
    return p.select(F.col("p_partkey").alias("product_id"), T.to_cents(F.format_string("$%.2f", "p_retailprice")).alias("cents"), T.int_or(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" pcs"))).alias("n"))


@query("select c_custkey as id, coalesce(try_cast(regexp_extract(c_name, '^\\s*([+-]?\\d+)', 1) as int), 0) as n from customer")
def parse_int_default(s, d):
    return bind.table(s, d, "customer").select(F.col("c_custkey").alias("id"), T.int_or(F.col("c_name")).alias("n"))


@query(with_tables("ord", "select order_id, 'BH-' || strftime(created_at, '%y%m') || '-' || upper(substr(sha256(cast(order_id as varchar)), 1, 6)) as number from ord"))
def order_numbers(s, d):
    return bind.orders(s, d).select("order_id", T.order_number(F.col("order_id"), F.col("created_at")).alias("number"))


# Feeds


def _feed(s, d, kind: str) -> DataFrame:
    """CSV files written from the part table, one for each brand."""
    p, q = bind.table(s, d, "part"), lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    price = F.format_string("$%.2f", "p_retailprice")
    if kind == "shopify":
        head, line = "Handle,Title,Body (HTML),Type,Tags,Variant SKU,Variant Price,Variant Inventory Qty,Option1 Value", F.concat_ws(",", F.replace("p_name", F.lit(" "), F.lit("-")), q(F.col("p_name")), q(F.concat(F.lit("<p>a, "), "p_name", F.lit("</p>"))), "p_type", q(F.lit("x, y")), F.col("p_partkey").cast("string"), price, F.col("p_size").cast("string"), F.lit("Default Title"))
    else:
        head, line = "SKU,Name,Type,Categories,Regular price,Stock", F.concat_ws(",", F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(""), q(F.col("p_name")), F.when(F.col("p_size") % 9 == 0, "variation").otherwise("simple"), q(F.concat(F.lit("All > "), "p_type", F.lit(", other"))), price, F.col("p_size").cast("string"))
    lines = p.groupBy(F.col("p_brand").alias("feed")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("x"))
    return feeds.read_feeds(lines.select("feed", F.concat(F.lit(head + "\r\n"), F.array_join("x.line", "\r\n"), F.lit("\r\n,,\r\n")).alias("content")))


@query("select p_brand as feed, replace(p_name, ' ', '-') as handle, arg_min(p_name, p_partkey) as title, arg_min(p_type, p_partkey) as category, cast(min(p_partkey) as varchar) as sku, cast(round(arg_min(p_retailprice, p_partkey) * 100) as bigint) as price_cents, arg_min(p_size, p_partkey) as stock, count(*) - 1 as extra_variants from part group by 1, 2")
def csv_import_shopify(s, d):
    return feeds.import_shopify(_feed(s, d, "shopify")).select("feed", "handle", "title", "category", "sku", "price_cents", "stock", "extra_variants")


@query("select p_brand as feed, case when p_size % 2 = 0 then cast(p_partkey as varchar) else regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g')[1:40] end as sku, p_name as title, p_type as category, cast(round(p_retailprice * 100) as bigint) as price_cents, p_size as stock from part where p_size % 9 <> 0")
def csv_import_woo(s, d):
    return feeds.import_woocommerce(_feed(s, d, "woo")).select("feed", "sku", "title", "category", "price_cents", "stock")


@query("select distinct p_type as category from part where p_type > (select min(p_type) from part)")
def anti_unmapped(s, d):
    p = bind.table(s, d, "part").select(F.col("p_type").alias("category"))
    return feeds.unmapped(p, p.agg(F.min("category").alias("category")))


# Visibility


@query(with_tables("product", "select product_id from product where status = 'live' or vendor_id = 3"))
def rls_products_public(s, d):
    return visibility.products(bind.products(s, d), visibility.Principal(vendor_id=3, role="vendor")).select("product_id")


@query(with_tables("ord", "select order_id from ord where buyer_id = 7 or vendor_id = 3"))
def rls_orders_party(s, d):
    return visibility.orders(bind.orders(s, d), visibility.Principal(uid=7, vendor_id=3, role="vendor")).select("order_id")


@query(with_tables("ord", "select l_orderkey as order_id, count(*) as lines from lineitem where l_orderkey in (select order_id from ord where buyer_id = 7) group by 1"))
def rls_tracking_twohop(s, d):
    who = visibility.Principal(uid=7, role="buyer")
    li = bind.table(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_linenumber")
    shipments = visibility.children(li, visibility.orders(bind.orders(s, d), who), "order_id")
    return visibility.children(li, shipments, "order_id").groupBy("order_id").agg(F.count("*").alias("lines"))


@query(with_tables("compliance product", "select record_id from compliance c join product p using (product_id) where (c.status in ('verified', 'expiring_soon') and p.status = 'live') or p.vendor_id = 3"))
def rls_records(s, d):
    return visibility.records(bind.compliance(s, d), bind.products(s, d), visibility.Principal(vendor_id=3, role="vendor")).select("record_id")


@query(with_tables("variant product", "select v.product_id from variant v join product p using (product_id) where wholesale_only and (vendor_id = 3 or (vendor_id % 5 = 2 and status = 'live'))"))
def rls_tiers(s, d):
    v = bind.vendors(s, d).where(F.col("vendor_id") % 5 == 2).select(F.lit(7).cast("long").alias("buyer_id"), "vendor_id")
    profiles = s.createDataFrame([(7,)], "buyer_id long")
    return visibility.wholesale_tiers(bind.variants(s, d), bind.products(s, d), v, profiles, visibility.Principal(uid=7, vendor_id=3, role="vendor")).select("product_id")


@query(with_tables("vendor product", "select vendor_id from vendor where exists (select 1 from product p where p.vendor_id = vendor.vendor_id and p.status = 'live')"))
def semi_live_parents(s, d):
    return visibility.children(bind.vendors(s, d), bind.products(s, d).where("status = 'live'"), "vendor_id").select("vendor_id")


# Content


_NEEDLES = {"the": ["the"], "and": ["and", " und "], "que": ["que"], "der": ["der "], "other": ["zzz"]}


@query("select doc_id, case when s = '' then 'other' else s end as clusters from (select doc_id, concat_ws(',', case when contains(t, 'the') then 'the' end, case when contains(t, 'and') or contains(t, ' und ') then 'and' end, case when contains(t, 'que') then 'que' end, case when contains(t, 'der ') then 'der' end, case when contains(t, 'zzz') then 'other' end) as s from (select doc_id, lower(coalesce(text, '')) as t from documents))")
def cluster_detect(s, d):
    return bind.table(s, d, "documents").select("doc_id", F.array_join(content.clusters(F.col("text"), _NEEDLES), ",").alias("clusters"))


@query("select page_id, section, url, position from (select page_id, section, url, row_number() over (partition by page_id, section order by url) as position from (select page_id, url, min(section) as section from (select p.p_partkey as page_id, l.section, l.url from part p join (select 'a' as section, n_regionkey as c, 'u' || n_nationkey as url from nation union all select 'b', null, 'u' || n_nationkey from nation where n_nationkey < 3) l on l.c is null or l.c = p.p_partkey % 5) group by 1, 2)) where position <= 6")
def related_links(s, d):
    nation, empty = bind.table(s, d, "nation"), F.array().cast("array<string>")
    url = F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("url")
    links = nation.select(F.lit("a").alias("section"), url, F.array(F.col("n_regionkey").cast("string")).alias("clusters")).unionByName(nation.where("n_nationkey < 3").select(F.lit("b").alias("section"), url, empty.alias("clusters")))
    pages = bind.table(s, d, "part").select(F.col("p_partkey").alias("page_id"), F.array((F.col("p_partkey") % 5).cast("string")).alias("clusters"))
    return content.related_links(pages, links)


@query("select n_name as state, r_name as cluster, '/' || n_name || '/' || r_name || '/' as url from nation, region")
def state_cluster_urls(s, d):
    return content.cross_urls(bind.table(s, d, "nation").select(F.col("n_name").alias("state")), bind.table(s, d, "region").select(F.col("r_name").alias("cluster")))


@query("select id, '/' || slug || '/' as loc from (select p_partkey as id, replace(p_name, ' ', '-') as slug, p_size % 3 <> 0 as indexable from part order by p_name, p_partkey limit 500 offset 500) where indexable")
def sitemap_page(s, d):
    rows = bind.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), (F.col("p_size") % 3 != 0).alias("indexable"))
    return content.sitemap_page(rows, 2, 500)


@query("select c_custkey as entity_id, max(case when c_acctbal > 0 then 'yes' end) as lab, c_mktsegment as segment from customer group by c_custkey, c_mktsegment")
def eav_pivot(s, d):
    c = bind.table(s, d, "customer")
    meta = c.select(F.col("c_custkey").alias("entity_id"), F.lit("lab").alias("key"), F.when(F.col("c_acctbal") > 0, "yes").otherwise("").alias("value")).unionByName(c.select(F.col("c_custkey").alias("entity_id"), F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value")))
    return content.pivot_meta(meta, ["lab", "segment"])


@query("select n_nationkey as topic_id, timestamp '2024-01-01 09:00:00' + to_days(cast(r as int)) as due_at from (select n_nationkey, row_number() over (order by n_nationkey) as r from nation) where r <= 120")
def topic_schedule(s, d):
    return content.schedule(bind.table(s, d, "nation").select(F.col("n_nationkey").alias("topic_id")), "2024-01-01")


# Limits before filters


@query("select event_id from (select * from events order by ts desc, event_id limit 50) where event_type <> 'view'")
def flags_top50_then_open(s, d):
    return bind.table(s, d, "events").orderBy(F.desc("ts"), "event_id").limit(50).where("event_type <> 'view'").select("event_id")


@query(with_tables("review", "select order_id, line, product_id from (select * from review where status = 'published' order by created_at desc, order_id, line, product_id limit 50) where product_id % 2 = 0"))
def reviews_top50_then_filter(s, d):
    top = bind.reviews(s, d).where("status = 'published'").orderBy(F.desc("created_at"), "order_id", "line", "product_id").limit(50)
    return top.where("product_id % 2 = 0").select("order_id", "line", "product_id")


# Events


@query(with_tables("event", "select invoice_id, delivery_id, min(arrival_seq) as arrival_seq from event group by 1, 2"))
def event_dedup(s, d):
    return payments.deduplicated(bind.events(s, d)).select("invoice_id", "delivery_id", "arrival_seq")


_FIRST = "(select invoice_id, delivery_id, min(arrival_seq) as arrival_seq, any_value(type) as type from event group by 1, 2)"


@query(with_tables("event", f"select invoice_id, arg_max(type, arrival_seq) as payment_status, case arg_max(type, arrival_seq) when 'processing' then 'payment_processing' when 'settled' then 'paid' when 'settled_overpaid' then 'paid' when 'expired' then 'expired_payment' else 'pending_payment' end as order_status, bool_or(type like 'settled%') as has_settled_at, count(*) as n_events from {_FIRST} group by 1"))
def event_latest_status(s, d):
    return payments.latest_status(bind.events(s, d))


@query(with_tables("event", "select type, type as payment_status, case type when 'processing' then 'payment_processing' when 'settled' then 'paid' when 'settled_overpaid' then 'paid' when 'expired' then 'expired_payment' else 'pending_payment' end as order_status, count(*) as n from event group by 1, 2, 3"))
def event_status_map(s, d):
    return payments.with_status(bind.events(s, d)).groupBy("type", "payment_status", "order_status").agg(F.count("*").alias("n"))


@query(with_tables("event", "select distinct invoice_id from event where type in ('settled', 'settled_overpaid') and invoice_id % 2 = 1"))
def event_ledger_due(s, d):
    e = bind.events(s, d)
    return payments.to_post(e, e.where("invoice_id % 2 = 0").select("invoice_id").distinct())


# Workflow


@query("select o_orderkey as id, f as from_status, t as to_status from (select o_orderkey, case o_orderstatus when 'O' then 'pending_review' when 'F' then 'live' else 'draft' end as f, case o_orderkey % 3 when 0 then 'live' when 1 then 'delisted' else 'draft' end as t from orders) where not (f = 'pending_review' and t in ('live', 'delisted', 'changes_requested'))")
def transition_violations(s, d):
    o, k = bind.table(s, d, "orders"), F.col("o_orderkey") % 3
    a = F.when(F.col("o_orderstatus") == "O", "pending_review").when(F.col("o_orderstatus") == "F", "live").otherwise("draft")
    return rules.transition_violations(o.select(F.col("o_orderkey").alias("id"), a.alias("from_status"), F.when(k == 0, "live").when(k == 1, "delisted").otherwise("draft").alias("to_status")), "product")


def _old_new(s, d):
    c = bind.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    new = c.where("id % 5 <> 0").withColumn("segment", F.when(F.col("id") % 7 == 0, "MOVED").otherwise(F.col("segment")))
    return c.where("id % 3 <> 0"), new


_CHANGES = "(select coalesce(a.id, b.id) as id, a.s as was, b.s as now, a.id is not null as old, b.id is not null as new from (select c_custkey as id, c_mktsegment as s from customer where c_custkey % 3 <> 0) a full join (select c_custkey as id, case when c_custkey % 7 = 0 then 'MOVED' else c_mktsegment end as s from customer where c_custkey % 5 <> 0) b on a.id = b.id)"


@query(f"select id, case when not old then 'insert' when not new then 'delete' else 'update' end as op from {_CHANGES} where not old or not new or was <> now")
def audit_diff(s, d):
    return rules.change_feed(*_old_new(s, d), "id").select("id", "op")


@query(f"select id, case when not old then 'created' when not new then 'kept' else 'updated' end as action from {_CHANGES}")
def upsert_plan(s, d):
    return rules.upsert_plan(*_old_new(s, d), "id")


@query(f"select id, coalesce(now, was) as segment from {_CHANGES}")
def upsert_rows(s, d):
    return rules.upsert(*_old_new(s, d), "id")


@query(f"select id, case when old then was else now end as segment from {_CHANGES}")
def insert_on_conflict_nothing(s, d):
    return rules.insert_new(*_old_new(s, d), "id")


@query("select * from (select 'line_key_unique' as check_name, count(*) as violations from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1) union all select 'line_order_exists', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'discount_range', count(*) from lineitem where l_discount < 0 or l_discount > 0.5 union all select 'order_status_known', count(*) from orders where o_orderstatus not in ('O', 'F'))")
def constraint_report(s, d):
    li, o = bind.table(s, d, "lineitem"), bind.table(s, d, "orders")
    name = lambda df, n: df.select(F.lit(n).alias("check_name"), "violations")
    parts = [
        name(rules.duplicate_keys(li, "l_orderkey", "l_linenumber"), "line_key_unique"),
        name(li.select("l_orderkey").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").agg(F.count("*").alias("violations")), "line_order_exists"),
        name(li.where((F.col("l_discount") < 0) | (F.col("l_discount") > 0.5)).agg(F.count("*").alias("violations")), "discount_range"),
        name(o.where(~F.col("o_orderstatus").isin("O", "F")).agg(F.count("*").alias("violations")), "order_status_known"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("with w as (select c_custkey as id, c_mktsegment as base from customer), taken as (select c_mktsegment as slug from customer union select c_mktsegment || '-2' from customer where c_custkey % 2 = 0) select id, base || '-' || cast(n as varchar) as slug from (select id, base, min(n) as n from w, range(2, 20) t(n) where base || '-' || cast(n as varchar) not in (select slug from taken) group by 1, 2)")
def slug_uniquify(s, d):
    c = bind.table(s, d, "customer")
    taken = c.select(F.col("c_mktsegment").alias("slug")).unionByName(c.where("c_custkey % 2 = 0").select(F.concat("c_mktsegment", F.lit("-2")).alias("slug")))
    return rules.unique_slugs(c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("base")), taken)


from . import pages  # noqa: E402, F401  registers its queries here
