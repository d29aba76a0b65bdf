"""The marketplace's tables, derived from the supplied tables by fixed expressions.

Each function gives one table; as_of is always a parameter of what uses it, never the wall clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vendors(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    s = table(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.select(
        F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("brand_name"),
        F.when(F.col("n_regionkey") == 0, "US").when(F.col("n_regionkey") == 1, "CA").otherwise("XX").alias("country"),
        (F.col("s_acctbal") > 0).alias("identity_verified"), (F.col("s_suppkey") % 2 == 0).alias("business_verified"), (F.col("s_suppkey") % 3 == 0).alias("wallet_verified"),
        F.when(F.col("s_suppkey") % 10 == 9, "suspended").otherwise("active").alias("status"), (F.col("s_suppkey") % 4 == 0).alias("wholesale_enabled"),
    )


def products(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))  # one row
    p = table(spark, d, "part").crossJoin(F.broadcast(n))
    place = lambda c, r: F.struct(F.lit(c).alias("country"), F.lit(r).cast("string").alias("region"))
    return p.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), (F.col("p_partkey") % F.col("n")).alias("vendor_id"),
        F.when(F.col("p_size") % 5 == 0, "none").otherwise("cbd").alias("cannabinoid_type"), F.when(F.col("p_partkey") % 11 == 0, "draft").otherwise("live").alias("status"), F.col("p_brand").alias("batch_number"), F.col("p_size").alias("size"),
        F.when(F.col("p_partkey") % 7 == 0, F.array(place("CA", None))).when(F.col("p_partkey") % 7 == 1, F.array(place("US", "ID"), place("US", "OR"))).otherwise(F.array().cast("array<struct<country:string,region:string>>")).alias("restricted"),
        (F.col("p_size") % 5 != 0).alias("age_restricted"),
    )


def variants(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("p_retailprice").cast("decimal(15,2)") * 100).cast("long")
    p = table(spark, d, "part").select("p_partkey", cents.alias("cents"), F.explode(F.array(*map(F.lit, (1, 7, 28)))).alias("k"))
    return p.select(F.col("p_partkey").alias("product_id"), "k", (F.col("cents") * F.col("k")).alias("price_cents"), (F.col("p_partkey") * F.col("k") % 40).alias("stock"), (F.col("k") == 28).alias("wholesale_only"))


STATUSES = ["verified", "expiring_soon", "submitted", "rejected", "expired"]


def compliance(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.explode(F.array(*map(F.lit, range(3)))).alias("j"))
    key, j = F.col("p_partkey"), F.col("j")
    ok = lambda m: F.when((key + j) % m == 0, "fail").otherwise("pass")
    return p.select(
        (key * 10 + j).alias("record_id"), key.alias("product_id"), F.date_add(F.lit("2023-07-01").cast("date"), ((key * 17 + j * 90) % 400).cast("int")).alias("issue_date"),
        F.element_at(F.array(*map(F.lit, STATUSES)), ((key + j) % 5 + 1).cast("int")).alias("status"), F.when(j == 1, "B").otherwise(F.col("p_brand")).alias("batch_number"), ok(3).alias("pesticides"), ok(4).alias("heavy_metals"), ok(7).alias("microbials"),
    )


def orders(spark: SparkSession, d: str) -> DataFrame:
    """With the vendor of the lowest l_suppkey; null where an order has no lines."""
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("vendor_id"))
    o = table(spark, d, "orders").join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.when(F.col("o_orderstatus") == "O", "paid").when(F.col("o_orderstatus") == "P", "pending_payment").otherwise("completed")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("buyer_id"), "vendor_id", status.alias("status"), F.round(F.col("o_totalprice").cast("decimal(15,2)") * 100).cast("long").alias("total_cents"), F.col("o_orderdate").alias("created_at"))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R")
    return r.select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("vendor_id"), (1 + F.col("l_quantity").cast("int") % 5).alias("rating"), F.when(F.col("l_linestatus") == "F", "published").otherwise("pending").alias("status"), F.col("l_shipdate").alias("created_at"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """Payment events; each eighth delivery arrives twice."""
    kinds = {"view": "processing", "signup": "settled", "error": "expired", "click": "settled_underpaid", "purchase": "settled_overpaid"}
    e = table(spark, d, "events").select(F.col("event_id").alias("delivery_id"), F.col("user_id").alias("invoice_id"), F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")].alias("type"), F.col("event_id").alias("arrival_seq"))
    again = e.where(F.col("delivery_id") % 8 == 0).withColumn("arrival_seq", F.col("arrival_seq") + 1_000_000_000)
    return e.unionByName(again)


#: The same tables for the SQL side; a query takes those it names.
SQL = {
    "vendor": "select s_suppkey as vendor_id, s_name as brand_name, case n_regionkey when 0 then 'US' when 1 then 'CA' else 'XX' end as country, s_acctbal > 0 as identity_verified, s_suppkey % 2 = 0 as business_verified, s_suppkey % 3 = 0 as wallet_verified, case when s_suppkey % 10 = 9 then 'suspended' else 'active' end as status, s_suppkey % 4 = 0 as wholesale_enabled from supplier left join nation on s_nationkey = n_nationkey",
    "product": "select p_partkey as product_id, p_name as title, p_type as category, p_partkey % (select count(*) from supplier) as vendor_id, case when p_size % 5 = 0 then 'none' else 'cbd' end as cannabinoid_type, case when p_partkey % 11 = 0 then 'draft' else 'live' end as status, p_brand as batch_number, p_size as size, p_partkey % 7 as r7, p_size % 5 <> 0 as age_restricted from part",
    "variant": "select p_partkey as product_id, k, cast(round(cast(p_retailprice as decimal(15,2)) * 100) as bigint) * k as price_cents, (p_partkey * k) % 40 as stock, k = 28 as wholesale_only from part, (values (1), (7), (28)) t(k)",
    "compliance": "select p_partkey * 10 + j as record_id, p_partkey as product_id, date '2023-07-01' + cast((p_partkey * 17 + j * 90) % 400 as int) as issue_date, case (p_partkey + j) % 5 when 0 then 'verified' when 1 then 'expiring_soon' when 2 then 'submitted' when 3 then 'rejected' else 'expired' end as status, case when j = 1 then 'B' else p_brand end as batch_number, case when (p_partkey + j) % 3 = 0 then 'fail' else 'pass' end as pesticides, case when (p_partkey + j) % 4 = 0 then 'fail' else 'pass' end as heavy_metals, case when (p_partkey + j) % 7 = 0 then 'fail' else 'pass' end as microbials from part, (values (0), (1), (2)) t(j)",
    "ord": "select o_orderkey as order_id, o_custkey as buyer_id, vendor_id, case o_orderstatus when 'O' then 'paid' when 'P' then 'pending_payment' else 'completed' end as status, cast(round(cast(o_totalprice as decimal(15,2)) * 100) as bigint) as total_cents, o_orderdate as created_at from orders left join (select l_orderkey, min(l_suppkey) as vendor_id from lineitem group by 1) l on l_orderkey = o_orderkey",
    "review": "select l_partkey as product_id, l_suppkey as vendor_id, 1 + cast(l_quantity as int) % 5 as rating, case when l_linestatus = 'F' then 'published' else 'pending' end as status, l_shipdate as created_at, l_orderkey as order_id, l_linenumber as line from lineitem where l_returnflag = 'R'",
    "event": "select event_id as delivery_id, user_id as invoice_id, case event_type when 'view' then 'processing' when 'signup' then 'settled' when 'error' then 'expired' when 'click' then 'settled_underpaid' when 'purchase' then 'settled_overpaid' end as type, event_id as arrival_seq from events union all select event_id, user_id, case event_type when 'view' then 'processing' when 'signup' then 'settled' when 'error' then 'expired' when 'click' then 'settled_underpaid' when 'purchase' then 'settled_overpaid' end, event_id + 1000000000 from events where event_id % 8 = 0",
    "split": "select order_id, vendor_id, total_cents, commission, cast(round((total_cents - commission) * cast(case when vendor_id % 4 = 0 then 0.25 else 0.15 end as decimal(6,4))) as bigint) as hold, created_at, status from (select *, (total_cents * 12 + 50) // 100 as commission from ord where status in ('paid', 'completed'))",
    "ledger": "select order_id, vendor_id, 'buyer_payment' as entry_type, total_cents as amount_cents, created_at from split union all select order_id, vendor_id, 'platform_commission', -commission, created_at from split union all select order_id, vendor_id, 'vendor_earnings', total_cents - commission - hold, created_at from split union all select order_id, vendor_id, 'reserve_hold', hold, created_at from split union all select order_id, vendor_id, 'payout', -(total_cents // 4), created_at from split where order_id % 5 = 0 union all select order_id, vendor_id, 'reserve_release', -(hold // 2), created_at from split where order_id % 7 = 0",
}
_NEEDS = {"split": ["ord"], "ledger": ["ord", "split"]}


def with_tables(names: str, query: str) -> str:
    """query behind the CTEs of the named tables."""
    chosen: list[str] = []
    for n in names.split():
        chosen += [x for x in (*_NEEDS.get(n, []), n) if x not in chosen]
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in chosen) + " " + query
