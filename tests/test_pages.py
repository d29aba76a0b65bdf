"""Page reads, mutations and sweeps on literal rows."""

import pytest
from pyspark.sql import functions as F

from quayside.functions import text as T
from quayside.operators import pages, search, workflow


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_entities_of_word_characters_become_blanks(spark):
    df = spark.createDataFrame([("x&a_b;y &#; &##1; a&amp;b<br>&#39;c",)], "t string")
    assert df.select(T.html_to_text(F.col("t"))).first()[0] == "x y &#; &##1; a&b\n c"


def test_single_row_or_error(spark):
    df = spark.createDataFrame([(1,), (2,)], "a long")
    assert values(pages.single(df.where("a = 1"))) == [(1,)] and values(pages.single(df.where("a > 5"))) == []
    with pytest.raises(Exception, match="more than one row"):
        pages.single(df).collect()


def test_short_searches_find_nothing(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, title string")
    assert search.grouped({"x": (df, 4)}, " a ").count() == 0 and search.grouped({"x": (df, 4)}, "ab").count() == 1


def test_mutations(spark):
    p = spark.createDataFrame([(1, 3, "live"), (2, 3, "draft"), (3, 4, "live"), (4, None, "live"), (5, 3, "suspended")], "product_id long, vendor_id long, status string")
    down = workflow.suspend(p, 3)
    assert values(down.select("product_id", "status")) == [(1, "suspended"), (2, "draft"), (3, "live"), (4, "live"), (5, "suspended")]
    assert values(workflow.reinstate(down, 3).where("vendor_id = 3").select("product_id", "status")) == [(1, "live"), (2, "draft"), (5, "live")]
    assert [r[0] for r in values(workflow.delete_where(p, F.col("vendor_id") == 3))] == [3, 4]
    keyed = spark.createDataFrame([("k", 2), ("k", 1), (None, 3), (None, 4)], "key string, order_id long")
    assert values(workflow.first_by_key(keyed, "key", "order_id")) == [("k", 1), (None, 3), (None, 4)]


def test_threads_items_and_steps(spark):
    m = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (2, 0, "system"), (2, 1, "user"), (3, 0, None)], "thread_id long, seq long, role string")
    assert values(pages.threads(m)) == [(1, 2, "assistant"), (3, 1, None)]
    li = spark.createDataFrame([(1, 2, 0, 1, "B"), (1, 1, 0, 2, "A")], "order_id long, line int, seq long, quantity long, title string")
    assert values(pages.items_text(li)) == [(1, "2x A, 1x B")]
    c = spark.createDataFrame([("a", " ", None), (None, "b", "c")], "x string, y string, z string")
    assert [r[0] for r in c.select(pages.missing_steps({"one": [F.col("x")], "two": [F.col("y"), F.col("z")]})).collect()] == ["two", "one"]
    assert spark.range(1).select(pages.money(F.lit(123456789))).first()[0] == "$1,234,567.89"


def test_tier_prices_and_repeats(spark):
    tiers = spark.createDataFrame([(1, 1, 100), (1, 10, 80), (2, 5, 9)], "product_id long, min_quantity long, price_cents long")
    lines = spark.createDataFrame([(1, 1, 9), (2, 1, 10), (3, 2, 4), (4, 7, 1)], "id long, product_id long, quantity long")
    assert values(workflow.tier_price(lines, tiers)) == [(1, 100), (2, 80), (3, None), (4, None)]
    df = spark.createDataFrame([(1, None), (1, None), (1, 2), (1, 2)], "a long, b long")
    assert values(workflow.repeated(df, "a", "b")) == [(1, 2, 2)]
