"""Column functions on text and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(x: Column, size: int = 60) -> Column:
    edge = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(edge, 1, size)


def to_cents(x: Column) -> Column:
    """Whole cents of a price in text: signs and all but digits and points are dropped, a second point ends the number; 0 if there is none."""
    number = F.regexp_extract(F.regexp_replace(x, "[^0-9.]", ""), r"^(\d*\.?\d*)", 1)
    return F.coalesce(F.floor(number.try_cast("double") * 100 + 0.5).cast("long"), F.lit(0).cast("long"))


def int_or(x: Column, default: int = 0) -> Column:
    return F.coalesce(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(default))


def html_to_text(x: Column) -> Column:
    """Line breaks for <br> and </p>, no tags, common entities, single blanks, no white space at the ends; in that order."""
    steps = [(r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"<[^>]+>", ""), ("&amp;", "&"), ("&nbsp;", " "), (r"&#?\w+;", " "), (r"[ \t]+", " "), (r"^\s+|\s+$", "")]
    for pattern, by in steps:
        x = F.regexp_replace(x, pattern, by)
    return x


def escape_html(x: Column) -> Column:
    for c, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(c), F.lit(by))
    return x


def trim_words(x: Column, n: int) -> Column:
    """The first n words of a text without tags."""
    plain = F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"^\s+|\s+$", "")
    return F.array_join(F.slice(F.split(plain, r"\s+"), 1, n), " ")


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def clean_query(q: str, size: int = 120) -> str:
    return q.strip()[:size]


def pattern_of(q: str) -> str:
    """%q% for ILIKE; %, comma and brackets in q are blanks, an underscore stays a wildcard."""
    return "%" + "".join(" " if c in "%,()" else c for c in q) + "%"


def title_of_slug(x: Column) -> Column:
    return F.initcap(F.replace(x, F.lit("-"), F.lit(" ")))


def order_number(order_id: Column, created_at: Column) -> Column:
    return F.concat(F.lit("BH-"), F.date_format(created_at, "yyMM"), F.lit("-"), F.upper(F.substring(F.sha2(order_id.cast("string"), 256), 1, 6)))
