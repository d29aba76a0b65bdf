"""Reads of pages and dashboards: listings, queues, details, link maps. Every limit has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, by: list[str], *order, most: int | None = None, name: str = "position") -> DataFrame:
    """df with each row's place in its group; of each group at most the first `most`."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if most is None else out.where(F.col(name) <= most)


def single(df: DataFrame) -> DataFrame:
    """df if it has one row at most; an error in the row's place otherwise."""
    n = df.select(F.count("*").over(Window.partitionBy(F.lit(1))).alias("_n"), *df.columns)
    return n.where(F.assert_true(F.col("_n") <= 1, F.lit("more than one row")).isNull()).drop("_n")


def home(public: DataFrame, vendors: DataFrame, n: int = 8) -> DataFrame:
    """section, id, label: the newest products, the active vendors, and those with wholesale."""
    row = lambda df, section, key, label: df.select(F.lit(section).alias("section"), F.col(key).alias("id"), F.col(label).alias("label"))
    active = vendors.where("status = 'active'")
    top = public.orderBy(F.desc("product_id")).limit(n)
    return row(top, "trending", "product_id", "title").unionByName(row(active, "vendor", "vendor_id", "brand_name")).unionByName(row(active.where("wholesale_enabled"), "wholesale", "vendor_id", "brand_name"))


def siblings(products: DataFrame, n: int = 6) -> DataFrame:
    """Per category the first n others by name. Categories are a short list."""
    names = products.select("category").distinct()
    others = F.broadcast(names.agg(F.sort_array(F.collect_list("category")).alias("names")))  # one row
    picked = F.slice(F.filter("names", lambda c: c != F.col("category")), 1, n)
    return names.crossJoin(others).select("category", F.posexplode(picked).alias("p", "sibling")).select("category", "sibling", (F.col("p") + 1).alias("position"))


def stores(vendors: DataFrame, products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per vendor: live products, published reviews, the categories it sells (sorted, comma-joined)."""
    p = products.where("status = 'live'").groupBy("vendor_id").agg(F.count("*").alias("products"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))
    r = reviews.where("status = 'published'").groupBy("vendor_id").agg(F.count("*").alias("reviews"))
    out = vendors.select("vendor_id").join(p, "vendor_id", "left").join(r, "vendor_id", "left")
    return out.fillna({"products": 0, "reviews": 0, "categories": ""})


def items_text(lines: DataFrame) -> DataFrame:
    """order_id, items: "2x A, 1x B" in the order of lines (order_id, line, seq, quantity, title)."""
    one = F.struct("line", "seq", "quantity", "title")
    text = F.transform(F.sort_array(F.collect_list(one)), lambda x: F.concat(x["quantity"].cast("string"), F.lit("x "), x["title"]))
    return lines.groupBy("order_id").agg(F.array_join(text, ", ").alias("items"))


def first_match(text: Column, needles: list[tuple[str, str]], default: str) -> Column:
    """The value of the first needle that the lower-cased text holds."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for needle, value in needles:
        hit = F.contains(low, F.lit(needle))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def redirects(aliases: DataFrame, terms: DataFrame) -> DataFrame:
    """alias, target: of aliases (alias, slug) those whose term exists."""
    return aliases.join(terms.select(F.col("slug"), F.col("id").alias("target")), "slug").select("alias", "target")


def description(*texts: Column, template: Column) -> Column:
    """The first text that isn't blank, else the template."""
    return F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in texts], template)


def sitemap(products: DataFrame, vendors: DataFrame) -> DataFrame:
    """path, priority: the fixed paths, categories, products and vendors."""
    spark = products.sparkSession
    fixed = spark.createDataFrame([("/", "1.0"), ("/search", "0.5")], "path string, priority string")
    path = lambda df, kind, col, priority: df.select(F.concat(F.lit(f"/{kind}/"), F.col(col).cast("string")).alias("path"), F.lit(priority).alias("priority"))
    out = fixed.unionByName(path(products.select("category").distinct(), "categories", "category", "0.8"))
    return out.unionByName(path(products.where("status = 'live'"), "product", "product_id", "0.7")).unionByName(path(vendors.where("status = 'active'"), "store", "vendor_id", "0.6"))


def threads(messages: DataFrame, hidden: str = "system") -> DataFrame:
    """thread_id, messages, last_role of threads (thread_id, seq, role) that don't begin with the hidden role."""
    t = messages.groupBy("thread_id").agg(F.count("*").alias("messages"), F.min(F.struct("seq", "role"))["role"].alias("first"), F.max(F.struct("seq", "role"))["role"].alias("last_role"))
    return t.where(~F.col("first").eqNullSafe(hidden)).drop("first")


def missing_steps(steps: dict[str, list[Column]]) -> Column:
    """The names of the steps of which a field is null or blank, comma-joined in their order."""
    blank = lambda c: c.isNull() | (F.trim(c.cast("string")) == "")
    out = []
    for name, fields in steps.items():
        bad = F.lit(False)
        for c in fields:
            bad = bad | blank(c)
        out.append(F.when(bad, name))
    return F.array_join(F.array_compact(F.array(*out)), ",")


def money(cents: Column) -> Column:
    """$1,234.56"""
    return F.concat(F.lit("$"), F.format_number((cents / 100).cast("decimal(20,2)"), 2))


def archive(terms: DataFrame, members: DataFrame) -> DataFrame:
    """term, members (published), mode: full from 100 on, some, or empty."""
    n = members.where("published").groupBy("term").agg(F.count("*").alias("members"))
    out = terms.join(n, "term", "left").fillna({"members": 0})
    return out.withColumn("mode", F.when(F.col("members") >= 100, "full").when(F.col("members") > 0, "some").otherwise("empty"))
