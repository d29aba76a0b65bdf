"""More registered queries: page reads, visibility, mutations, sweeps and checks, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, content, ledger, pages, rules, visibility, workflow
from . import bind
from .bind import with_tables
from .catalogue import _LATEST, AS_OF, full_ledger, query

_PUBLIC = "(select product.* from product join vendor on vendor.vendor_id = product.vendor_id where product.status = 'live' and vendor.status = 'active')"


def _public(s, d):
    return catalog.public(bind.products(s, d), bind.vendors(s, d))


@query(with_tables("product vendor", f"select 'trending' as section, product_id as id, title as label from (select * from {_PUBLIC} order by product_id desc limit 8) union all select 'vendor', vendor_id, brand_name from vendor where status = 'active' union all select 'wholesale', vendor_id, brand_name from vendor where status = 'active' and wholesale_enabled"))
def home_page(s, d):
    return pages.home(_public(s, d), bind.vendors(s, d))


@query(with_tables("product vendor", f"select category, product_id, row_number() over (partition by category order by product_id) as position from {_PUBLIC}"))
def category_listing(s, d):
    return pages.numbered(_public(s, d).select("category", "product_id"), ["category"], "product_id")


@query("select a.p_type as category, b.p_type as sibling, row_number() over (partition by a.p_type order by b.p_type) as position from (select distinct p_type from part) a join (select distinct p_type from part) b on a.p_type <> b.p_type qualify position <= 6")
def category_siblings(s, d):
    return pages.siblings(bind.products(s, d))


@query(with_tables("product", "select a.product_id, row_number() over (partition by a.product_id order by b.id) as position, b.id as related_id from (select product_id, vendor_id from product where status = 'live') a join (select product_id as id, vendor_id, row_number() over (partition by vendor_id order by product_id) as r from product where status = 'live') b on a.vendor_id = b.vendor_id and b.r <= 5 and b.id <> a.product_id qualify position <= 4"))
def same_seller(s, d):
    return catalog.related(bind.products(s, d), key="vendor_id")


@query(with_tables("vendor product review", "select v.vendor_id, coalesce(n, 0) as products, coalesce(m, 0) as reviews, coalesce(c, '') as categories from vendor v left join (select vendor_id, count(*) as n, string_agg(distinct category, ',' order by category) as c from product where status = 'live' group by 1) p on p.vendor_id = v.vendor_id left join (select vendor_id, count(*) as m from review where status = 'published' group by 1) r on r.vendor_id = v.vendor_id"))
def store_pages(s, d):
    return pages.stores(bind.vendors(s, d), bind.products(s, d), bind.reviews(s, d))


@query(with_tables("variant product vendor", "select l_orderkey as cart_id, l_linenumber as line, x.product_id, p.title, p.category, x.price_cents, v.brand_name from lineitem left join variant x on x.product_id = l_partkey and x.k = 1 left join product p on p.product_id = x.product_id left join vendor v on v.vendor_id = p.vendor_id"))
def cart_page(s, d):
    li = bind.table(s, d, "lineitem").select(F.col("l_orderkey").alias("cart_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("product_id"))
    x = bind.variants(s, d).where("k = 1").select("product_id", "price_cents")
    p = bind.products(s, d).select("product_id", "title", "category", "vendor_id")
    v = bind.vendors(s, d).select("vendor_id", "brand_name")
    return li.join(x, "product_id", "left").join(p, "product_id", "left").join(v, "vendor_id", "left").drop("vendor_id")


@query(with_tables("ord vendor", "select buyer_id, order_id, brand_name, row_number() over (partition by buyer_id order by created_at desc, order_id) as position from ord left join vendor on vendor.vendor_id = ord.vendor_id"))
def buyer_orders(s, d):
    o = bind.orders(s, d).join(bind.vendors(s, d).select("vendor_id", "brand_name"), "vendor_id", "left")
    return pages.numbered(o, ["buyer_id"], F.desc("created_at"), "order_id").select("buyer_id", "order_id", "brand_name", "position")


@query(with_tables("ord vendor", "select order_id, brand_name, ord.status, total_cents, (select count(*) from lineitem where l_orderkey = order_id) as items from ord left join vendor on vendor.vendor_id = ord.vendor_id where buyer_id = 7"))
def order_detail(s, d):
    o = visibility.orders(bind.orders(s, d), visibility.Principal(uid=7, role="buyer"))
    n = bind.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count("*").alias("items"))
    o = o.join(bind.vendors(s, d).select("vendor_id", "brand_name"), "vendor_id", "left").join(n, "order_id", "left").fillna({"items": 0})
    return o.select("order_id", "brand_name", "status", "total_cents", "items")


_ITEMS = "(select l_orderkey as order_id, string_agg(cast(cast(l_quantity as bigint) as varchar) || 'x ' || p_name, ', ' order by l_linenumber, l_partkey, l_quantity) as items from lineitem join part on p_partkey = l_partkey group by 1)"


@query(with_tables("ord", f"select vendor_id, o.order_id, position, coalesce(items, '—') as items from (select *, row_number() over (partition by vendor_id order by created_at desc, order_id) as position from ord where vendor_id is not null) o left join {_ITEMS} i on i.order_id = o.order_id where position <= 100"))
def vendor_orders(s, d):
    top = pages.numbered(bind.orders(s, d).where("vendor_id is not null"), ["vendor_id"], F.desc("created_at"), "order_id", most=100)
    li = bind.table(s, d, "lineitem").join(bind.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    lines = li.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("seq"), F.col("l_quantity").cast("long").alias("quantity"), F.col("p_name").alias("title"))
    return top.select("vendor_id", "order_id", "position").join(pages.items_text(lines), "order_id", "left").fillna({"items": "—"})


@query(with_tables("product variant compliance", f"select p.vendor_id, p.product_id, row_number() over (partition by p.vendor_id order by p.product_id desc) as position, (select count(*) from variant v where v.product_id = p.product_id) as variants, c.status as coa from product p left join {_LATEST} c on c.product_id = p.product_id"))
def vendor_products(s, d):
    n = bind.variants(s, d).groupBy("product_id").agg(F.count("*").alias("variants"))
    c = catalog.latest_record(bind.compliance(s, d)).select("product_id", F.col("status").alias("coa"))
    p = bind.products(s, d).join(n, "product_id", "left").fillna({"variants": 0}).join(c, "product_id", "left")
    return pages.numbered(p, ["vendor_id"], F.desc("product_id")).select("vendor_id", "product_id", "position", "variants", "coa")


@query(with_tables("ord", "select status, order_id, row_number() over (partition by status order by vendor_id asc nulls last, order_id) as position from ord"))
def order_queue(s, d):
    return pages.numbered(bind.orders(s, d), ["status"], F.asc_nulls_last("vendor_id"), "order_id").select("status", "order_id", "position")


@query(with_tables("product vendor variant", "select p.product_id, p.title, v.brand_name, x.price_cents from product p left join vendor v on v.vendor_id = p.vendor_id left join (select product_id, arg_min(price_cents, k) as price_cents from variant group by 1) x on x.product_id = p.product_id where p.status = 'draft'"))
def admin_product_queue(s, d):
    first = pages.numbered(bind.variants(s, d), ["product_id"], "k", most=1).select("product_id", "price_cents")
    p = bind.products(s, d).where("status = 'draft'").join(bind.vendors(s, d).select("vendor_id", "brand_name"), "vendor_id", "left")
    return p.join(first, "product_id", "left").select("product_id", "title", "brand_name", "price_cents")


@query(with_tables("compliance product vendor", "select record_id, title, brand_name, row_number() over (order by issue_date asc nulls last, record_id) as position from compliance c join product p on p.product_id = c.product_id left join vendor v on v.vendor_id = p.vendor_id where c.status = 'submitted' qualify position <= 100"))
def admin_compliance_queue(s, d):
    c = bind.compliance(s, d).where("status = 'submitted'").orderBy(F.asc_nulls_last("issue_date"), "record_id").limit(100)
    p = bind.products(s, d).select("product_id", "title", "vendor_id").join(bind.vendors(s, d).select("vendor_id", "brand_name"), "vendor_id", "left")
    x = c.select("product_id", "record_id", "issue_date").join(p, "product_id").withColumn("one", F.lit(1))
    return pages.numbered(x, ["one"], F.asc_nulls_last("issue_date"), "record_id").select("record_id", "title", "brand_name", "position")


@query(with_tables("ord vendor", "select order_id, brand_name, c_name as buyer, total_cents from (select * from ord order by created_at desc, order_id limit 200) o left join vendor v on v.vendor_id = o.vendor_id left join customer on c_custkey = buyer_id"))
def admin_orders(s, d):
    top = bind.orders(s, d).orderBy(F.desc("created_at"), "order_id").limit(200)
    c = bind.table(s, d, "customer").select(F.col("c_custkey").alias("buyer_id"), F.col("c_name").alias("buyer"))
    return top.join(bind.vendors(s, d).select("vendor_id", "brand_name"), "vendor_id", "left").join(c, "buyer_id", "left").select("order_id", "brand_name", "buyer", "total_cents")


@query(with_tables("vendor", "select vendor_id, brand_name, status from vendor where vendor_id = 3"))
def own_vendor(s, d):
    return pages.single(bind.vendors(s, d).where("vendor_id = 3")).select("vendor_id", "brand_name", "status")


@query(with_tables("review vendor", "select product_id, position, rating, brand_name from (select *, row_number() over (partition by product_id order by created_at desc, order_id, line, rating) as position from review where status = 'published') r left join vendor v on v.vendor_id = r.vendor_id where position <= 5"))
def product_reviews(s, d):
    top = pages.numbered(bind.reviews(s, d).where("status = 'published'"), ["product_id"], F.desc("created_at"), "order_id", "line", "rating", most=5)
    return top.join(bind.vendors(s, d).select("vendor_id", "brand_name"), "vendor_id", "left").select("product_id", "position", "rating", "brand_name")


@query("select conv_id as thread_id, count(*) as messages, arg_max(role, (turn, role)) as last_role from conversations group by 1 having arg_min(role, (turn, role)) is distinct from 'system'")
def message_threads(s, d):
    return pages.threads(bind.table(s, d, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), "role"))


@query("select p_partkey as product_id from part where contains(lower(p_name), 're') or contains(lower(p_type), 're') or contains(lower(p_brand), 're')")
def substring_search(s, d):
    p = bind.products(s, d)
    hit = F.lit(False)
    for c in ("title", "category", "batch_number"):
        hit = hit | F.contains(F.lower(c), F.lit("re"))
    return p.where(hit).select("product_id")


@query("select p_partkey as product_id, case when contains(lower(p_name), 're') then 'red' when contains(lower(p_name), 'an') then 'ant' else 'other' end as target from part")
def first_needle(s, d):
    return bind.products(s, d).select("product_id", pages.first_match(F.col("title"), [("re", "red"), ("an", "ant")], "other").alias("target"))


@query("select 'old-' || lower(n_name) as alias, n_nationkey as target from nation where n_nationkey % 3 = 0")
def alias_redirects(s, d):
    n = bind.table(s, d, "nation")
    return pages.redirects(n.select(F.concat(F.lit("old-"), F.lower("n_name")).alias("alias"), F.lower("n_name").alias("slug")), n.where("n_nationkey % 3 = 0").select(F.lower("n_name").alias("slug"), F.col("n_nationkey").alias("id")))


@query("select p_partkey as product_id, coalesce(case when p_size % 3 = 0 then p_name end, case when p_size % 3 = 1 then p_type end, 'Buy ' || p_brand) as description from part")
def description_cascade(s, d):
    p, m = bind.table(s, d, "part"), F.col("p_size") % 3
    text = pages.description(F.when(m == 0, F.col("p_name")).otherwise(" "), F.when(m == 1, F.col("p_type")), template=F.concat(F.lit("Buy "), "p_brand"))
    return p.select(F.col("p_partkey").alias("product_id"), text.alias("description"))


@query(with_tables("product", "select category, product_id, row_number() over (partition by category order by title, product_id) as position from product where status = 'live' qualify position <= 12"))
def collection_items(s, d):
    p = bind.products(s, d).where("status = 'live'")
    return pages.numbered(p, ["category"], "title", "product_id", most=12).select("category", "product_id", "position")


@query("select p_partkey as id, p_name as title from part order by p_partkey limit 6")
def guides_with_fallback(s, d):
    p = bind.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("rank"))
    return content.first_or(p.where("title = ''"), p, 6).select("id", "title")


@query("select n_name as state, case when n_nationkey % 4 = 0 then '/map/' || n_name when n_nationkey % 4 = 1 then '/law/' || n_name else '/laws' end as url from nation")
def state_grid(s, d):
    n, k = bind.table(s, d, "nation"), F.col("n_nationkey") % 4
    one = lambda i, kind: F.when(k == i, F.create_map(F.col("n_name"), F.concat(F.lit(f"/{kind}/"), "n_name")))
    return n.select(F.col("n_name").alias("state"), content.cascade(F.col("n_name"), one(0, "map"), one(1, "law"), default="/laws").alias("url"))


@query(with_tables("product vendor", "select '/' as path, '1.0' as priority union all select '/search', '0.5' union all select distinct '/categories/' || category, '0.8' from product union all select '/product/' || product_id, '0.7' from product where status = 'live' union all select '/store/' || vendor_id, '0.6' from vendor where status = 'active'"))
def route_sitemap(s, d):
    return pages.sitemap(bind.products(s, d), bind.vendors(s, d))


@query("select '<url><loc>/' || p_partkey || '</loc>' || case when p_size % 2 = 0 then '<lastmod>' || p_brand || '</lastmod>' else '' end || '</url>' as line from part")
def sitemap_lines(s, d):
    p = bind.table(s, d, "part")
    return content.sitemap_xml(p.select(F.concat(F.lit("/"), F.col("p_partkey").cast("string")).alias("loc"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("lastmod")))


@query(with_tables("product", "select t.category as term, coalesce(n, 0) as members, case when coalesce(n, 0) >= 100 then 'full' when coalesce(n, 0) > 0 then 'some' else 'empty' end as mode from (select distinct category from product) t left join (select category, count(*) as n from product where status = 'live' group by 1) m on m.category = t.category"))
def archive_context(s, d):
    p = bind.products(s, d).select(F.col("category").alias("term"), (F.col("status") == "live").alias("published"))
    return pages.archive(p.select("term").distinct(), p)


@query("select p_type as type, count(*) filter (where p_partkey % 11 <> 0) as live, count(*) filter (where p_partkey % 11 = 0) as draft from part group by 1")
def counts_by_status(s, d):
    p = bind.products(s, d).groupBy(F.col("category").alias("type")).pivot("status", ["live", "draft"]).count()
    return p.fillna(0)


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_values(s, d):
    return bind.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select c_custkey as id, concat_ws(',', case when c_acctbal < 0 then 'bank' end, case when c_custkey % 4 = 0 or c_acctbal < 0 then 'store' end) as missing from customer")
def application_missing_steps(s, d):
    c = bind.table(s, d, "customer")
    bank, url = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).otherwise("  ")
    return c.select(F.col("c_custkey").alias("id"), pages.missing_steps({"person": [F.col("c_name")], "bank": [bank], "store": [url, bank]}).alias("missing"))


@query("select p_partkey as product_id, printf('$%s', format('{:,}', cast(floor(c / 100) as bigint)) || '.' || lpad(cast(c % 100 as varchar), 2, '0')) as price from (select p_partkey, cast(round(cast(p_retailprice as decimal(15,2)) * 100) as bigint) as c from part)")
def money_text(s, d):
    cents = F.round(F.col("p_retailprice").cast("decimal(15,2)") * 100).cast("long")
    return bind.table(s, d, "part").select(F.col("p_partkey").alias("product_id"), pages.money(cents).alias("price"))


# Visibility


@query(with_tables("ord", "select l_orderkey as order_id, count(*) as lines from lineitem where l_orderkey in (select order_id from ord where buyer_id = 7 or vendor_id = 3) or l_suppkey = 3 group by 1"))
def rls_participants(s, d):
    o = visibility.orders(bind.orders(s, d), visibility.Principal(uid=7, vendor_id=3, role="vendor"))
    li = bind.table(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_suppkey")
    return visibility.children(li, o, "order_id", extra=F.col("l_suppkey") == 3).groupBy("order_id").agg(F.count("*").alias("lines"))


@query("select c_custkey as id from customer where c_custkey % 7 = 0 or c_custkey % 5 = 0")
def rls_write_violations(s, d):
    c = bind.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.lit("draft").alias("status"))
    new = c.withColumn("segment", F.when(F.col("id") % 7 == 0, "MOVED").otherwise(F.col("segment"))).withColumn("status", F.when(F.col("id") % 5 == 0, "live").otherwise("submitted"))
    return workflow.write_violations(c, new, "id", ["segment"], ["draft", "submitted"])


@query(with_tables("ord", f"select order_id from ord where buyer_id = 7 and created_at > timestamp '{AS_OF}' - interval 3000 day"))
def rls_editable(s, d):
    return visibility.editable_reviews(bind.orders(s, d), visibility.Principal(uid=7, role="buyer"), AS_OF, 3000).select("order_id")


@query(with_tables("ord review", "select distinct order_id from review where order_id in (select order_id from ord where status = 'completed')"))
def rls_review_insert(s, d):
    done = bind.orders(s, d).where("status = 'completed'")
    return visibility.children(bind.reviews(s, d).select("order_id"), done, "order_id").distinct()


@query("select event_id from events where event_type = 'error'")
def rls_admin_only(s, d):
    e = bind.table(s, d, "events").where("event_type = 'error'").select("event_id")
    return visibility.admin_only(e, visibility.Principal(role="admin")).unionByName(visibility.admin_only(e, visibility.Principal(role="buyer")))


# Mutations


@query(with_tables("product", "select product_id, case when vendor_id = 3 and status = 'live' then 'suspended' else status end as status from product"))
def suspend_cascade(s, d):
    return workflow.suspend(bind.products(s, d), 3).select("product_id", "status")


@query(with_tables("product", "select product_id, status from product"))
def reinstate_cascade(s, d):
    return workflow.reinstate(workflow.suspend(bind.products(s, d), 3), 3).select("product_id", "status")


@query(with_tables("product", f"select product_id, case when size % 2 = 0 then category || '!' else category end as category, case when size % 2 = 0 then timestamp '{AS_OF} 00:00:00' end as updated_at from product where not size % 9 = 0"))
def update_and_delete(s, d):
    p = workflow.delete_where(bind.products(s, d), F.col("size") % 9 == 0)
    p = workflow.update_where(p, F.col("size") % 2 == 0, touched=F.to_timestamp_ntz(F.lit(f"{AS_OF} 00:00:00")), category=F.concat("category", F.lit("!")))
    return p.select("product_id", "category", "updated_at")


@query("select l_orderkey % 100 as key, min((l_orderkey, l_linenumber, l_partkey))[1] as order_id from (select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey % 3 <> 0) group by 1")
def checkout_idempotent(s, d):
    li = bind.table(s, d, "lineitem").where("l_orderkey % 3 <> 0").select((F.col("l_orderkey") % 100).alias("key"), F.col("l_orderkey").alias("order_id"), "l_linenumber", "l_partkey")
    return workflow.first_by_key(li, "key", "order_id", "l_linenumber", "l_partkey").select("key", "order_id")


@query(with_tables("event", "select invoice_id, string_agg(delivery_id || ':' || type, ',' order by arrival_seq) as log from event group by 1"))
def event_log(s, d):
    return workflow.event_log(bind.events(s, d))


@query(with_tables("event", "select distinct invoice_id from event where invoice_id not in (select o_orderkey from orders where o_orderkey % 2 = 0)"))
def unknown_invoices(s, d):
    known = bind.table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("invoice_id"))
    return bind.events(s, d).select("invoice_id").distinct().join(known, "invoice_id", "left_anti")


_STATES = "(select record_id as id, status as f, case record_id % 3 when 0 then 'verified' when 1 then 'rejected' else 'draft' end as t from compliance)"


@query(with_tables("compliance", f"select id from {_STATES} where not (f = 'submitted' and t in ('verified', 'rejected'))"))
def record_violations(s, d):
    k = F.col("record_id") % 3
    moved = bind.compliance(s, d).select(F.col("record_id").alias("id"), F.col("status").alias("from_status"), F.when(k == 0, "verified").when(k == 1, "rejected").otherwise("draft").alias("to_status"))
    return rules.transition_violations(moved, "compliance").select("id")


@query("select c_custkey as vendor_id, case c_mktsegment when 'AUTOMOBILE' then 'cultivator' when 'BUILDING' then 'processor' when 'FURNITURE' then 'retailer' when 'HOUSEHOLD' then 'farm' else 'cbd_brand' end as seller_type, case when c_acctbal < 0 then 0.25 else 0.15 end::double as reserve_pct, case when c_acctbal < 0 then 45 else 30 end as rolling_days, case when c_acctbal < 0 then 2 else 1 end as risk_tier from customer")
def vendor_provisioning(s, d):
    return workflow.provision(bind.table(s, d, "customer").select(F.col("c_custkey").alias("vendor_id"), F.col("c_mktsegment").alias("label"), (F.col("c_acctbal") < 0).alias("high_risk")))


@query("select c_custkey as id, case when c_custkey % 50 = 0 then 'admin' when c_custkey % 9 = c_custkey % 7 then 'vendor' else 'buyer' end as role from customer")
def sender_roles(s, d):
    k = F.col("c_custkey")
    return bind.table(s, d, "customer").select(k.alias("id"), workflow.sender_role(k % 50 == 0, k % 9, k % 7).alias("role"))


# Time


@query(with_tables("compliance", "select record_id, case when status not in ('verified', 'expiring_soon') then status when left_days < 0 then 'expired' when left_days <= 30 then 'expiring_soon' else status end as status from (select *, (issue_date + 365) - date '2024-07-15' as left_days from compliance)"))
def coa_sweep(s, d):
    return workflow.sweep_records(bind.compliance(s, d), "2024-07-15").select("record_id", "status")


@query(with_tables("ord", "select order_id, case when status = 'paid' and created_at + interval 5 day + interval 48 hour <= timestamp '1998-01-01' then 'completed' else status end as status from ord"))
def auto_complete(s, d):
    return workflow.completed(bind.orders(s, d).withColumn("delivered_at", F.col("created_at") + F.expr("INTERVAL 5 DAYS")), "1998-01-01")


@query(with_tables("ledger", "select vendor_id, earnings - greatest(reserve, 0) as eligible from (select vendor_id, cast(coalesce(sum(amount_cents) filter (where entry_type = 'vendor_earnings'), 0) - coalesce(sum(abs(amount_cents)) filter (where entry_type = 'payout'), 0) as bigint) as earnings, cast(coalesce(sum(amount_cents) filter (where entry_type = 'reserve_hold'), 0) - coalesce(sum(abs(amount_cents)) filter (where entry_type = 'reserve_release'), 0) as bigint) as reserve from ledger where vendor_id is not null group by 1) where earnings - greatest(reserve, 0) > 0 and vendor_id % 10 <> 9"))
def payout_queue(s, d):
    return workflow.payout_queue(ledger.vendor_accruals(full_ledger(s, d)), bind.vendors(s, d).where("status = 'suspended'"))


@query(with_tables("ord", "select vendor_id, day, cast(sum(n) over w as bigint) as rows, cast(sum(f) over w as bigint) as flagged from (select vendor_id, cast(created_at as date) as day, count(*) as n, count(*) filter (where status = 'pending_payment') as f from ord where vendor_id is not null group by 1, 2) window w as (partition by vendor_id order by day range between interval 29 day preceding and current row)"))
def rolling_disputes(s, d):
    return workflow.rolling_share(bind.orders(s, d).where("vendor_id is not null"), "vendor_id", "created_at", F.col("status") == "pending_payment")


@query("select p_partkey as id, case when q >= 28 then c * 20 when q >= 7 then c * 6 when q >= 1 then c end as price_cents from (select p_partkey, cast(p_size as bigint) as q, p_partkey % 1000 as c from part)")
def wholesale_tier_price(s, d):
    p, c = bind.table(s, d, "part"), F.col("p_partkey") % 1000
    tier = lambda n, by: F.struct(F.lit(n).alias("min_quantity"), (c * by).alias("price_cents"))
    tiers = p.select(F.col("p_partkey").alias("product_id"), F.explode(F.array(tier(1, 1), tier(7, 6), tier(28, 20))).alias("t")).select("product_id", "t.*")
    return workflow.tier_price(p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("product_id"), F.col("p_size").cast("long").alias("quantity")), tiers)


# Checks


@query("select l_orderkey as order_id, count(*) as rows from lineitem where l_returnflag = 'R' group by 1 having count(*) > 1")
def one_review_per_order(s, d):
    return workflow.repeated(bind.reviews(s, d), "order_id")


@query("select o_custkey as buyer_id, count(*) as rows from orders where o_orderstatus = 'P' group by 1 having count(*) > 1")
def one_open_draft(s, d):
    o = bind.orders(s, d).where("status = 'pending_payment'")
    return workflow.repeated(o, "buyer_id")


@query(with_tables("ord", "select vendor_id, created_at, count(*) as rows from ord where vendor_id is not null group by 1, 2 having count(*) > 1"))
def unique_with_nulls(s, d):
    return workflow.repeated(bind.orders(s, d), "vendor_id", "created_at")


@query("select c_custkey as id, length(c_name) between 1 and 120 and c_acctbal between -500 and 9000 and c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'MACHINERY') as valid from customer")
def request_validation(s, d):
    c = bind.table(s, d, "customer")
    ok = F.length("c_name").between(1, 120) & F.col("c_acctbal").between(-500, 9000) & F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "MACHINERY")
    return c.select(F.col("c_custkey").alias("id"), ok.alias("valid"))


@query("select n_nationkey as id, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as title from nation")
def slug_titles(s, d):
    return bind.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), T.title_of_slug(F.replace(F.lower("n_name"), F.lit(" "), F.lit("-"))).alias("title"))
