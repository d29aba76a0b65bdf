"""Personal data by candidates and gradient boosting.

1. Generators with high recall propose spans, which may overlap, also within a kind: of e-mail addresses (plain or spelt
   out, with each number of labels), IP addresses (each four groups in a row), card numbers and telephone numbers (runs of
   groups of digits and parts of them).
2. Boosted trees judge each candidate by its format (digits, groups, separators, check digit, ranges) and its context
   (characters beside it, words before it).
3. For each kind, margins are calibrated on held-out cases, and the least threshold with PRECISION there selects.
   Base spans (regular expressions with checks) stay whatever the trees say; of the others, those that overlap no base
   span are kept, the likeliest first (then by kind, start and end), none overlapping another.

The trees are trained once, on the driver, on cases written by rules with a fixed seed (`cases`): formats of personal data,
and numbers, times, versions and the like that aren't. They learn nothing from the corpus.

Null counts as an empty text, which has no spans. Offsets are code points, ends exclusive. Repeated rows are judged
alike. An empty table gives no rows; other columns play no part. A text of any length is read whole, in time linear in it.
"""

from __future__ import annotations

import functools
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .boosting import Boosted, calibrate, threshold_for

KINDS = ["email", "ip", "card", "phone"]
PRECISION, CONTEXT = 0.995, 40


class Span(NamedTuple):
    kind: str
    start: int
    end: int


#: Base patterns. Possessive and with a look-behind where a match can only start at a run's first character: the same
#: matches as the plain patterns, in linear time.
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """By kind as in KINDS, then start."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            out.append(Span("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
            out.append(Span("ip", m.start(), m.end()))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 13:
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(Span("card", m.start(), m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(Span("phone", m.start(), m.end()))
    return out


#: What the generators look for. An address grows to both sides of its at sign, a number is a run of groups of digits.
_at = re.compile(r"\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:at|AT)\s(?=[\w-]++\s?[\[({<]?\s?(?:dot|DOT)\b)|\s?@\s?")
_label = re.compile(r"[\w-]++")
_dot = re.compile(r"(?:\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s|\.)(?=[\w-])")
_own = re.compile(r"[\w.%+-]")
_groups = re.compile(r"[0-9]++")
_ip_run = re.compile(r"(?<![0-9A-Za-z.])[0-9]++(?:\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]++){3,}+(?![0-9A-Za-z])")
_ip6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4}){1,4}(?![0-9A-Fa-f:])")
_card_run = re.compile(r"(?<![0-9A-Za-z.])[0-9]++(?:[ ./_ ‑–-]{1,3}[0-9]++)*+(?![0-9A-Za-z])")
_phone_run = re.compile(r"(?<![0-9A-Za-z.])(?:\+|00)?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ .()/ ‑-]{1,3}[0-9]{2,5}){2,}+(?![0-9A-Za-z]|\.[0-9])")
_digits = re.compile(r"[0-9]")
#: An address is proposed with each number of labels up to this, and with all.
LABELS = 8
CUES = {
    "email": re.compile(r"(?i)mail|contact|write|reach|address"),
    "ip": re.compile(r"(?i)\bip\b|host|server|client|login|address|from"),
    "card": re.compile(r"(?i)card|visa|master|amex|credit|debit|pay"),
    "phone": re.compile(r"(?i)phone|tel|call|mobile|cell|fax|dial|sms|whatsapp"),
}
#: Behind an address: another label.
_next = re.compile(r"\s?[\[({<]?\s?(?:dot|DOT)\b|\.[\w-]")
_against = re.compile(r"(?i)order|invoice|version|serial|isbn|sku|build|release|section|ref|tracking|timestamp|date|page|figure|id\b|no\.?\s*$|v\s*$")


def _emails(text: str) -> Iterator[Span]:
    end = 0  # of the last at sign: what is before it belongs to its address
    for m in _at.finditer(text):
        start = m.start()
        while start > end and _own.match(text, start - 1):
            start -= 1
        end = m.end()
        x = _label.match(text, end) if start < m.start() else None
        n = 0
        while x and (dot := _dot.match(text, x.end())):
            x, n = _label.match(text, dot.end()), n + 1
            if n <= LABELS or not _dot.match(text, x.end()):
                yield Span("email", start, x.end())


def _ips(text: str) -> Iterator[Span]:
    for m in _ip_run.finditer(text):
        g = [x.span() for x in _groups.finditer(text, m.start(), m.end())]
        for i in range(len(g) - 3):
            if max(b - a for a, b in g[i : i + 4]) <= 3:
                yield Span("ip", g[i][0], g[i + 3][1])
    if ":" in text:
        for m in _ip6.finditer(text):
            yield Span("ip", m.start(), m.end())


def _windows(text: str, m: re.Match, least: int, most: int) -> Iterator[tuple[int, int, str]]:
    """Start, end and digits of the rows of whole groups in a run that have least to most digits."""
    g = [x.span() for x in _groups.finditer(text, m.start(), m.end())]
    for i in range(len(g)):
        digits = ""
        for a, b in g[i : i + most]:
            if len(digits) + b - a > most:
                break
            digits += text[a:b]
            if len(digits) >= least:
                yield g[i][0], b, digits


def _cards(text: str) -> Iterator[Span]:
    """A whole run, and what passes the check digit in a longer one."""
    for m in _card_run.finditer(text):
        if m.end() - m.start() >= 13:
            for a, b, digits in _windows(text, m, 13, 19):
                if (a, b) == m.span() or luhn(digits):
                    yield Span("card", a, b)


def _phones(text: str) -> Iterator[Span]:
    """A whole run, and what starts as numbers do in a longer one."""
    for m in _phone_run.finditer(text):
        yield Span("phone", m.start(), m.end())
        for a, b, digits in _windows(text, m, 9, 15):
            while a > m.start() and text[a - 1] in "+(":
                a -= 1
            if (a, b) != m.span() and (a == m.start() or text[a] in "+(0") and (a == m.start() or text[a - 1] not in "0123456789"):
                yield Span("phone", a, b)


GENERATORS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def candidates(text: str) -> list[Span]:
    """By kind as in KINDS, once each."""
    out: dict[Span, None] = {}
    digits = _digits.search(text)
    for kind, propose in GENERATORS.items():
        if "@" in text or " at " in text or "at" in text.lower() if kind == "email" else digits:
            out.update(dict.fromkeys(propose(text)))
    return list(out)


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    x = text[span.start : span.end]
    before, after = text[max(0, span.start - CONTEXT) : span.start], text[span.end : span.end + CONTEXT]
    digits = "".join(re.findall(r"[0-9]", x))
    groups = re.findall(r"[0-9]+", x)
    seps = re.findall(r"[^0-9A-Za-z]+", x)
    octets = [int(g) for g in groups[:4]] if span.kind == "ip" else []
    last = re.split(r"[^A-Za-z]+", x)[-1]
    return [
        float(KINDS.index(span.kind)), float(len(x)), float(len(digits)), float(len(groups)), float(len(set(seps))), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(luhn(digits)) if digits else 0.0, float(digits[:1] in ("3", "4", "5", "6") and len(set(digits)) > 3), float(len(digits) in (15, 16)), float(len({len(g) for g in groups}) == 1),
        float(x[:1] == "+"), float("(" in x), float("[" in x or "{" in x), float(bool(re.search(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$", x))), float(bool(octets) and max(octets) <= 255), float(sum(o > 9 for o in octets)),
        float("@" in x), float(bool(re.search(r"\bat\b|\bAT\b", x))), float(bool(re.search(r"\bdot\b|\bDOT\b", x))), float(2 <= len(last) <= 6 and last.islower()), float(x.count(":")), float("." in x), float("/" in x),
        float(bool(CUES[span.kind].search(before))), float(bool(_against.search(before))), float(before[-1:].isalnum()), float(before[-1:] in ("$", "€", "£", "#", "=", "/", '"')), float(after[:1].isalnum()), float(after[:1] in ("%", "€", "/", "=")), float(sum(c.isdigit() for c in before + after)),
        float(13 <= len(digits) <= 19), float(bool(re.search(r"[0-9][ .()/-]{0,2}$", before))), float(bool(re.match(r"[ .()/-]{0,2}[0-9]", after))), float(bool(_next.match(after))), float(digits[:1] == "0"),
    ]


def cases(n: int, seed: int = 7) -> list[tuple[str, Span, int]]:
    """About n texts by rules, with the candidates in them and whether they are personal data."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["re", "th", "on", "ing", "ver", "la", "mi", "que", "sta", "der", "un", "ca"]) for _ in range(r.randint(1, 4)))
    some = lambda: " ".join(word() for _ in range(r.randint(2, 7)))
    tld = lambda: r.choice(["com", "org", "net", "io", "de", "fr", "es", "co.uk"])

    def check(d: str) -> str:
        return next(d + c for c in "0123456789" if luhn(d + c))

    def loose(d: str) -> str:
        """The number with another last digit, if it would pass for a card's."""
        return d[:-1] + str((int(d[-1]) + 1) % 10) if luhn(d) else d

    def card() -> str:
        if r.random() < 0.35:
            return check(num(r.choice([12, 13, 14, 15, 15, 15, 15, 16, 18])))
        d = check(r.choice(["4", "51", "53", "55", "6011", "37"]) + num(9 if r.random() < 0.1 else 11))
        d = check(d[:1] + num(14)) if len(d) != 16 else d
        s = r.choice(["", " ", "-", ".", " ", " - ", "/"])
        return s.join(d[i : i + 4] for i in range(0, 16, 4))

    def good() -> tuple[str, str]:
        kind = r.choice(KINDS)
        if kind == "email":
            at, dot = r.choice(["@", "@", " [at] ", "(at)", " at ", " @ ", "[@]", "{at}"]), r.choice([".", " [dot] ", "(dot)", " dot "])
            if at == " at ":
                dot = r.choice([" dot ", " [dot] "])
            return kind, word() + r.choice([".", "_", "", "1"]) + word() + at + word() + dot + tld().replace(".", dot)
        if kind == "ip":
            s = r.choice([".", ".", "[.]", "(.)"])
            return kind, s.join(str(r.randint(1, 254) if s == "." or r.random() < 0.6 else r.randint(0, 19)) for _ in range(4)) if r.random() < 0.8 else ":".join("%x" % r.randint(1, 65535) for _ in range(8))
        if kind == "card":
            return kind, card()
        a, b, c = num(3), num(3), num(4)
        return kind, r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{r.randint(30, 49)} {num(2)} {num(3)} {num(4)}", f"00{r.randint(30, 49)} {num(3)} {num(3)} {num(4)}", f"0{num(2)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(2)}/{num(3)} {num(4)}"])

    def bad() -> str:
        return r.choice([
            lambda: f"{word()} at {word()}. {word().title()} {word()}", lambda: f"{word()}@{num(2)}.{num(2)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}.{r.randint(0, 9)}",
            lambda: ".".join(str(r.randint(200, 999)) for _ in range(4)), lambda: loose(num(16)) if r.random() < 0.5 else (lambda d: " ".join(d[i : i + 4] for i in range(0, 16, 4)))(loose(num(16))), lambda: f"20{num(2)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}:{num(2)}",
            lambda: f"20{num(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: f"{num(3)} {num(3)} {num(3)}", lambda: " ".join(num(r.randint(2, 5)) for _ in range(r.randint(3, 6))),
            lambda: f"{r.randint(10, 23)}:{num(2)}:{num(2)}:{num(2)}", lambda: f"{num(2)}/{num(2)}/20{num(2)}", lambda: f"{num(4)}-{num(4)}-{num(4)}", lambda: f"00{num(2)} {num(2)} {num(2)}", lambda: loose(num(r.randint(13, 19))), lambda: " ".join(num(r.randint(1, 8)) for _ in range(r.randint(4, 12))), lambda: ".".join(num(r.randint(1, 3)) for _ in range(r.randint(5, 8))),
        ])()

    cue = {"email": ["mail", "contact", "write to"], "ip": ["ip", "host", "login from"], "card": ["card", "visa", "pay by"], "phone": ["phone", "call", "tel"]}
    against = ["order no.", "version", "serial", "invoice", "tracking", "section", "ref", "isbn", "build", "on"]
    out = []
    while len(out) < n:
        if r.random() < 0.5:
            kind, x = good()
            head = some() + " " + (r.choice(cue[kind]) + r.choice([": ", " "]) if r.random() < 0.5 else "")
            wanted = kind
        else:
            x, wanted = bad(), ""
            head = some() + " " + (r.choice(against) + " " if r.random() < 0.5 else "")
        good_at = {(wanted, len(head), len(head) + len(x))} if wanted else set()
        text = head + x
        if r.random() < 0.25:  # more numbers behind it
            text += r.choice([" ", " ", ", ", " / ", "\n"])
            kind, more = good() if r.random() < 0.7 else ("", bad())
            if kind:
                good_at.add((kind, len(text), len(text) + len(more)))
            text += more
        text += r.choice([" ", ". ", ", ", "\n"]) + some()
        out += [(text, s, int((s.kind, s.start, s.end) in good_at)) for s in candidates(text)]
    return out


@functools.cache
def model(n: int = 20_000) -> tuple[Boosted, dict[str, tuple[float, float, float]]]:
    """The trees, and for each kind a and b of its calibration and its threshold."""
    made = cases(n)
    x, y = np.array([describe(t, s) for t, s, _ in made]), np.array([v for *_, v in made], float)
    held = np.arange(len(y)) % 3 == 0
    trees = Boosted(trees=80, depth=4).fit(x[~held], y[~held])
    m, use = trees.margin(x[held]), {}
    for k, kind in enumerate(KINDS):
        own = x[held][:, 0] == k
        a, b = calibrate(m[own], y[held][own])
        use[kind] = (a, b, max(0.9, threshold_for(1 / (1 + np.exp(-(a * m[own] + b))), y[held][own], PRECISION)))
    return trees, use


def _free(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that overlap none of those taken."""
    if not taken or not spans:
        return spans
    merged: list[list[int]] = []
    for _, a, b in sorted(taken, key=lambda s: s.start):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    ends = [b for _, b in merged]
    at = lambda s: bisect_right(ends, s.start)
    return [s for s in spans if at(s) == len(merged) or merged[at(s)][0] >= s.end]


def select(ranked: list[Span]) -> list[Span]:
    """Of spans in their order those that overlap none before them."""
    out: list[Span] = []
    starts: list[int] = []  # of what is chosen, which doesn't overlap, with its ends
    ends: list[int] = []
    for s in ranked:
        i = bisect_right(starts, s.start)
        if (i == 0 or ends[i - 1] <= s.start) and (i == len(starts) or s.end <= starts[i]):
            starts.insert(i, s.start)
            ends.insert(i, s.end)
            out.append(s)
    return out


def find(texts: list[str], made: tuple | None = None) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all its spans, each by kind as in KINDS, then start. made: what model() gave."""
    trees, use = made or model()
    base = [base_spans(t) for t in texts]
    proposed = [(i, s) for i, t in enumerate(texts) for s in _free(candidates(t), base[i])]
    chosen: dict[int, list[tuple[float, int, int, int]]] = {}
    for a in range(0, len(proposed), 50_000):
        some = proposed[a : a + 50_000]
        m = trees.margin(np.array([describe(texts[i], s) for i, s in some]))
        for (i, s), v in zip(some, m.tolist(), strict=True):
            slope, shift, least = use[s.kind]
            p = 1 / (1 + math.exp(-min(35.0, max(-35.0, slope * v + shift))))
            if p >= least:
                chosen.setdefault(i, []).append((-p, KINDS.index(s.kind), s.start, s.end))
    out = []
    for i, own in enumerate(base):
        more = select([Span(KINDS[k], a, b) for _, k, a, b in sorted(chosen.get(i, []))])
        out.append((own, sorted(own + more, key=lambda s: (KINDS.index(s.kind), s.start))))
    return out


def told(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with [EMAIL], [IP], [CARD] or [PHONE] for each span; overlapping spans become one, named by the first."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def spans_of(spark: SparkSession, text: Column) -> Column:
    """struct: counts of base spans, base and spans (kind:start:end, comma-joined), found (all spans as structs)."""
    sent = spark.sparkContext.broadcast(model())

    @F.pandas_udf("struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base:string,spans:string,found:array<struct<kind:string,start:int,end:int>>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in texts:
            rows = [(*(sum(s.kind == k for s in base) for k in KINDS), told(base), told(every), [s._asdict() for s in every]) for base, every in find([t or "" for t in x], sent.value)]
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "found"])

    return run(text)


def redact(spark: SparkSession, text: Column) -> Column:
    """text with its personal data replaced; null stays null."""
    sent = spark.sparkContext.broadcast(model())

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common.hold("pii")
        for x in texts:
            yield pd.Series([None if t is None else redacted(t, every) for t, (_, every) in zip(x, find([t or "" for t in x], sent.value), strict=True)], dtype="object")

    return run(text)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), spans_of(spark, F.col("text")).alias("x"))
    return docs.select("doc_id", "x.n_email", "x.n_ip", "x.n_card", "x.n_phone", F.sha2("x.base", 256).alias("base_sha256"), "x.spans")
