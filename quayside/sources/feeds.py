"""Product feeds: CSV parsing, format detection, importers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import html_to_text, int_or, to_cents

_token = re.compile(r'""|"|,|\r\n|\r|\n')


def parse_csv(text: str) -> list[list[str]]:
    """Rows of fields. A quote anywhere turns quoting on or off, a doubled one inside quotes is a quote; rows of blanks are dropped."""
    rows, row, field, quoted, at = [], [], [], False, 0

    def end_row():
        row.append("".join(field))
        if any(c.strip() for c in row):
            rows.append(row.copy())
        row.clear()
        field.clear()

    while m := _token.search(text, at):
        field.append(text[at : m.start()])
        t, at = m[0], m.end()
        if t == '""' and not quoted:
            t, at = '"', at - 1  # the first only opens
        if t == '""':
            field.append('"')
        elif t == '"':
            quoted = not quoted
        elif quoted:
            field.append(t)
        elif t == ",":
            row.append("".join(field))
            field.clear()
        else:
            end_row()
    field.append(text[at:])
    end_row()
    return rows


def detect(headers: list[str]) -> str | None:
    h = {x.strip().lower() for x in headers}
    if "handle" in h and any(x.startswith("variant sku") or x == "variant price" for x in h):
        return "shopify"
    return "woocommerce" if "regular price" in h or {"sku", "categories"} <= h else None


def read_feeds(files: DataFrame) -> DataFrame:
    """files (feed, content) to rows (feed, format, seq, cells: map of lower-cased header to trimmed value); a file is one feed, parsed whole."""

    def run(pdfs):
        for pdf in pdfs:
            out = []
            for feed, content in zip(pdf["feed"], pdf["content"], strict=True):
                rows = parse_csv(content or "")
                if rows and (kind := detect(rows[0])):
                    head = [x.strip().lower() for x in rows[0]]
                    out += [(feed, kind, i, dict(zip(head, [c.strip() for c in r], strict=False))) for i, r in enumerate(rows[1:])]
            yield pd.DataFrame(out, columns=["feed", "format", "seq", "cells"])

    return files.select("feed", "content").mapInPandas(run, "feed string, format string, seq long, cells map<string,string>")


def _get(name: str) -> Column:
    return F.coalesce(F.col("cells")[name], F.lit(""))


def _or(*cols: Column) -> Column:
    """The first that isn't empty; the last as it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def _list(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), F.trim), lambda t: t != "")


def import_shopify(rows: DataFrame) -> DataFrame:
    """One product for each feed and handle, from its first row; the others count as extra variants."""
    r = rows.where(F.col("format") == "shopify").withColumn("handle", _get("handle")).where("handle <> ''")
    own = r.groupBy("feed", "handle").agg(F.min_by("cells", "seq").alias("cells"), F.count("*").alias("n"))
    text, option = html_to_text(_get("body (html)")), _get("option1 value")
    return own.select(
        "feed", "handle", _or(_get("title"), F.col("handle")).alias("title"), text.alias("description"), F.substring(F.split(text, "\n")[0], 1, 160).alias("short_description"), _or(_get("type"), _get("product category"), F.lit("Uncategorized")).alias("category"),
        F.array_join(_list(_get("tags")), ",").alias("tags"), _or(_get("variant sku"), F.col("handle")).alias("sku"), F.when((option != "") & (F.lower(option) != "default title"), option).otherwise("Default").alias("variant_name"),
        to_cents(_get("variant price")).alias("price_cents"), int_or(_get("variant inventory qty")).alias("stock"), (F.col("n") - 1).alias("extra_variants"),
    )


def import_woocommerce(rows: DataFrame) -> DataFrame:
    """Simple and variable products with a name."""
    r = rows.where((F.col("format") == "woocommerce") & F.lower(_get("type")).isin("", "simple", "variable") & (_get("name") != ""))
    text, short = html_to_text(_get("description")), html_to_text(_get("short description"))
    category = F.trim(F.split(F.element_at(F.split(_get("categories"), ">"), -1), ",")[0])
    slug = F.substring(F.regexp_replace(F.lower(_get("name")), "[^a-z0-9]+", "-"), 1, 40)
    return r.select(
        "feed", _or(_get("sku"), _get("name")).alias("handle"), _get("name").alias("title"), text.alias("description"), F.substring(_or(short, F.split(text, "\n")[0]), 1, 160).alias("short_description"), _or(category, F.lit("Uncategorized")).alias("category"),
        F.array_join(_list(_get("tags")), ",").alias("tags"), _or(_get("sku"), slug).alias("sku"), F.lit("Default").alias("variant_name"), to_cents(_or(_get("regular price"), _get("sale price"))).alias("price_cents"), int_or(_get("stock")).alias("stock"), F.lit(0).cast("long").alias("extra_variants"),
    )


def unmapped(imported: DataFrame, mapping: DataFrame) -> DataFrame:
    """Categories that the mapping lacks."""
    return imported.select("category").distinct().join(mapping.select("category"), "category", "left_anti")


def first_by_url(links: DataFrame) -> DataFrame:
    return links.withColumn("r", F.row_number().over(Window.partitionBy("url").orderBy("seq"))).where("r = 1").drop("r")
