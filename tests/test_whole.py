"""Registered queries return every row that they are to decide on."""

import random
from collections import defaultdict

from quayside.operators import scoring
from quayside.plans import bind, catalogue

SF = "/root/testdata/sf0.001"


def tier(r):
    if r.status in ("expired", "rejected"):
        return 0
    if r.status == "verified":
        return 3 if {r.pesticides, r.heavy_metals, r.microbials} == {"pass"} else 2
    return 1


def test_compliance_tier_scores_every_record(spark):
    records = bind.compliance(spark, SF).collect()
    assert len(records) == 3 * bind.table(spark, SF, "part").count()
    got = [(r.record_id, r.product_id, r.tier) for r in catalogue.QUERIES["compliance_tier"](spark, SF).collect()]
    assert sorted(got) == sorted((r.record_id, r.product_id, tier(r)) for r in records)


def order(rows):
    """Ids by page in the order of their positions, which are 1, 2, ..."""
    pages = defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r.page), r.position)):
        pages[r.page].append(r.id)
        assert r.position == len(pages[r.page])
    return dict(pages)


def promoted(rows):
    pages = defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r["page"]), -r["score"], r["seq"])):
        pages[r["page"]].append((r["id"], bool(r["sponsored"]), r["tier"]))
    return {p: scoring.promote(*map(list, zip(*x, strict=True))) for p, x in pages.items()}


def test_ranked_pages_promotes_over_lists_of_any_length(spark):
    r, rows = random.Random(7), []
    for p in range(1500):
        share, tiers = r.choice((0, 0.1, 0.5, 0.9)), r.choice((1, 2, 4))
        n = r.choice((1, 2, 3, 4, 5, 6, 8, 60)) if p else 40
        rows += [(p or None, len(rows) + i, float(r.randrange(9)), i, r.random() < share, r.randrange(tiers)) for i in range(n)]
    df = spark.createDataFrame(rows, "page int, id long, score double, seq int, sponsored boolean, tier int")
    assert order(scoring.ranked_pages(df, "page").collect()) == promoted([x.asDict() for x in df.collect()])


def test_rank_products_ranks_everything(spark):
    scored = [x.asDict() | {"seq": x.id, "sponsored": x.id % 6 == 0} for x in catalogue._scored(spark, SF).collect()]
    got = order(catalogue.QUERIES["rank_products"](spark, SF).collect())
    assert got == promoted([x | {"sponsored": False} for x in scored]) and max(map(len, got.values())) > 24
    assert order(catalogue.QUERIES["rank_products_sponsored"](spark, SF).collect()) == promoted(scored)


def test_commission_resolve_reads_every_rule(spark):
    newest = {}
    for r in bind.table(spark, SF, "lineitem").where("l_returnflag = 'N'").collect():
        newest[r.l_suppkey] = max(newest.get(r.l_suppkey, (r.l_shipdate, 0)), (r.l_shipdate, r.l_linenumber))
    got = {r.vendor_id: round(r.rate, 6) for r in catalogue.QUERIES["commission_resolve"](spark, SF).collect()}
    assert got == {r.s_suppkey: newest[r.s_suppkey][1] / 100 if r.s_suppkey in newest else 0.12 for r in bind.table(spark, SF, "supplier").collect()}
