"""Operators against hand-computed values and properties."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.functions import text as T
from quayside.operators import catalog, ledger, rules, scoring, search, visibility
from quayside.sources import feeds
from quayside.streaming import payments


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_csv_quotes_and_blank_rows():
    assert feeds.parse_csv('a,"b ""q"", c"\r\n,,\r\nd,e') == [["a", 'b "q", c'], ["d", "e"]]
    assert feeds.parse_csv('x"y,z"w,1\n" ", ') == [["xy,zw", "1"]]
    assert feeds.parse_csv('""\r"a\nb"') == [["a\nb"]]
    assert feeds.parse_csv("") == []


@given(st.lists(st.lists(st.text('ab",\n\r '), min_size=1, max_size=4), max_size=5))
def test_csv_round_trip(rows):
    text = "\n".join(",".join('"' + c.replace('"', '""') + '"' for c in r) for r in rows)
    assert feeds.parse_csv(text) == [r for r in rows if any(c.strip() for c in r)]


def test_formats():
    assert feeds.detect(["Handle", "Variant SKU"]) == "shopify"
    assert feeds.detect(["sku", " Categories "]) == "woocommerce"
    assert feeds.detect(["handle"]) is None


def test_text_functions(spark):
    got = one(spark, a=T.to_cents(F.lit("$12.50")), b=T.to_cents(F.lit("1.2.3")), c=T.to_cents(F.lit("")), d=T.to_cents(F.lit("-5")), e=T.slugify(F.lit(" Blue Ridge Co. ")), f=T.int_or(F.lit("12x")), g=T.int_or(F.lit("x")))
    assert tuple(got) == (1250, 120, 0, 500, "blue-ridge-co", 12, 0)
    got = one(spark, a=T.html_to_text(F.lit("<p>a<br>b</p> &amp;  &copy; c")), b=T.trim_words(F.lit("<b>a</b> b  c d"), 3), c=T.escape_html(F.lit("<&'\">")))
    assert tuple(got) == ("a\nb\n\n & c", "a b c", "&lt;&amp;&#39;&quot;&gt;")


def test_half_up_differs_from_rounding_away(spark):
    assert tuple(one(spark, a=ledger.half_up(F.lit(-2.5)), b=ledger.half_up(F.lit(2.5)))) == (-2, 3)


@pytest.fixture
def order_rows(spark):
    return spark.createDataFrame([(1, 7, 10_000, 1_200, None), (2, None, 999, 120, "0.25")], "order_id long, vendor_id long, total_cents long, commission long, r string").selectExpr("*", "cast(r as decimal(6,4)) as reserve_pct", "timestamp_ntz'2024-01-01' as created_at")


def test_settlement(order_rows):
    rows = ledger.settle(order_rows)
    assert [r.amount_cents for r in rows.where("order_id = 1").collect()] == [10_000, -1_200, 7_480, 1_320]
    sums = {r.order_id: r.s for r in rows.groupBy("order_id").agg(F.sum("amount_cents").alias("s")).collect()}
    assert sums == {1: 2 * 8_800, 2: 2 * 879}
    assert ledger.settle(order_rows, rows).count() == 0
    assert [r.vendor_id for r in ledger.vendor_accruals(rows).collect()] == [7]


def test_payout_cards_use_the_size_of_sums_and_the_newest_rows(spark):
    rows = [(1, i, k, a, i) for i, (k, a) in enumerate([("payout", -50), ("payout", 20), ("reserve_hold", 100), ("reserve_release", -30), ("reserve_release", 10)])]
    df = spark.createDataFrame(rows, "vendor_id long, order_id long, entry_type string, amount_cents long, created_at long")
    card = ledger.payout_cards(df).first()
    assert (card.reserved, card.paid) == (80, 30)
    accrual = ledger.vendor_accruals(df).first()
    assert (accrual.earnings, accrual.reserve) == (-70, 60)
    assert ledger.payout_cards(df, newest=1).first().paid == 0


def test_scores(spark):
    got = one(spark, a=F.round(scoring.bayesian(F.lit(4.9), F.lit(84)), 6), b=scoring.bayesian(F.lit(None).cast("double"), F.lit(3)))
    assert tuple(got) == (4.765385, 4.2)
    yes, no = F.lit(1.0), F.lit(0.0)
    ideal = dict(verified=F.lit(True), coa_age_days=no, coa_expired=F.lit(False), coa_complete=F.lit(True), completeness=yes, images=F.lit(3.0), inventory=yes, on_time=yes, tracking=yes, delivery=yes, dispute_rate=no, return_rate=no, rating_avg=F.lit(None).cast("double"), rating_count=F.lit(0), response_hours=no, violations=no, warnings=no, complaints=no, delistings=no)
    assert one(spark, a=scoring.health_score(ideal)).a == 97
    assert sum(scoring.WEIGHTS.values()) == 110


def test_promotion():
    assert scoring.promote(list("ABCS"), [False, False, False, True], [1] * 4) == list("SABC")
    assert scoring.promote(list("AS"), [False, True], [2, 1]) == list("AS")
    assert scoring.promote([], [], []) == []


@given(st.lists(st.tuples(st.booleans(), st.integers(0, 3)), max_size=12))
def test_promotion_keeps_the_page(page):
    ids = list(range(len(page)))
    assert sorted(scoring.promote(ids, [s for s, _ in page], [t for _, t in page])) == ids


def test_eligibility(spark):
    rows = [("GB", "", "deny_launch"), ("CA", None, "deny_product"), ("US", "ID", "deny_product"), ("US", None, "notice_only")]
    df = spark.createDataFrame(rows, "c string, r string, want string").withColumn("x", F.expr("array(named_struct('country', 'CA', 'region', cast(null as string)), named_struct('country', 'US', 'region', 'ID'))"))
    e = rules.eligibility(F.col("c"), F.col("r"), F.lit("US"), F.col("x"), F.lit("cbd"), F.lit(True))
    assert all(r.want == r.got for r in df.withColumn("got", e["effect"]).collect())


def test_moderation(spark):
    body = "mail a.b@c.io or 555-123-4567 https://evil.example/x"
    got = [f.kind for f in one(spark, f=rules.moderate(F.lit(body))).f]
    assert got == ["email_address", "phone_number", "external_url"]
    assert one(spark, f=rules.moderate(F.lit("https://market.example/p"))).f == []


def test_catalog_quirks(spark):
    v = spark.createDataFrame([(1, 1, 500, 0, False), (1, 28, 240_000, 5, True), (2, 28, 240_000, 0, True)], "product_id long, k int, price_cents long, stock int, wholesale_only boolean")
    got = {r.product_id: r for r in catalog.prices(v).collect()}
    assert (got[1].low_cents, got[1].high_cents, got[1].in_stock, got[1].offers) == (500, 500, True, 2)
    assert (got[2].low_cents, got[2].from_cents, got[2].in_stock) == (None, 240_000, False)
    p = spark.createDataFrame([(1, "B", False), (2, "B", False)], "product_id long, batch_number string, wholesale boolean")
    c = spark.createDataFrame([(1, 1, "verified", "B", "2024-01-01"), (2, 2, "expiring_soon", "X", "2023-07-03")], "record_id long, product_id long, status string, batch_number string, d string").withColumn("issue_date", F.to_date("d"))
    got = {r.product_id: r.badges for r in catalog.product_badges(p, c, "2024-01-02").collect()}
    assert got == {1: ["verified_coa", "batch_linked", "recently_tested", "tracking"], 2: ["verified_coa", "tracking"]}  # any usable record counts; 183 days is too old


def test_search_wildcards_and_short_queries(spark):
    p = spark.createDataFrame([(1, "a_b", "x", "live", "B", 1), (2, "axb", "x", "live", "B", 1)], "product_id long, title string, category string, status string, batch_number string, vendor_id long")
    assert [r.product_id for r in search.ilike_search(p, "a_b").collect()] == [1, 2]
    assert search.ilike_search(p, "  ").count() == 0
    v = spark.createDataFrame([(1, "ab", "active")], "vendor_id long, brand_name string, status string")
    assert search.suggest(p, v, "a").count() == 0


def test_visibility(spark):
    o = spark.createDataFrame([(1, 7, 3), (2, 8, None)], "order_id long, buyer_id long, vendor_id long")
    assert visibility.orders(o, visibility.Principal()).count() == 0
    assert visibility.orders(o, visibility.Principal(role="admin")).count() == 2
    assert [r.order_id for r in visibility.orders(o, visibility.Principal(uid=8)).collect()] == [2]


def test_slug_runs_out(spark):
    taken = spark.createDataFrame([("a" if i == 1 else f"a-{i}",) for i in range(1, 20)], "slug string")
    assert rules.unique_slugs(spark.createDataFrame([(1, "a"), (2, "b")], "id long, base string"), taken).orderBy("id").collect()[0].slug == "a-19"


def test_events_by_arrival(spark):
    e = spark.createDataFrame([(1, 9, "settled", 1), (2, 9, "expired", 2), (1, 9, "settled", 3), (3, 8, "settled_underpaid", 4)], "delivery_id long, invoice_id long, type string, arrival_seq long")
    got = {r.invoice_id: (r.payment_status, r.order_status, r.has_settled_at, r.n_events) for r in payments.latest_status(e).collect()}
    assert got == {9: ("expired", "expired_payment", True, 2), 8: ("settled_underpaid", "pending_payment", True, 1)}
    assert [r.invoice_id for r in payments.to_post(e).collect()] == [9]


def test_stream_posts_once(spark, order_rows, tmp_path):
    schema = "delivery_id long, invoice_id long, type string, arrival_seq long"
    for i in range(2):
        spark.createDataFrame([(i, 1, "settled", i)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        payments.run_settlement(events, order_rows, str(tmp_path / "ledger"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 4
