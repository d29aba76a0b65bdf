"""Candidates, selection and redaction against plain forms, long texts, and cases that the trees haven't seen."""

import random
import time

import numpy as np
import pytest

from quayside.llm import pii
from quayside.llm.pii import Span


def meets(a, b):
    return a.start < b.end and b.start < a.end


def test_selection_is_that_of_all_comparisons():
    r = random.Random(6)
    for _ in range(500):
        spans = [Span("card", a, a + r.randint(1, 6)) for a in (r.randrange(30) for _ in range(r.randint(0, 12)))]
        taken = [Span("ip", a, a + r.randint(1, 6)) for a in (r.randrange(30) for _ in range(r.randint(0, 5)))]
        assert pii._free(spans, taken) == [s for s in spans if not any(meets(s, t) for t in taken)]
        out = []
        for s in spans:
            if not any(meets(s, t) for t in out):
                out.append(s)
        assert pii.select(spans) == out


def test_candidates_overlap_within_a_kind():
    two = "4465758382889437 4465758382889437"
    assert {Span("card", 0, 16), Span("card", 17, 33)} <= set(pii.candidates(two))
    assert [s for s in pii.candidates("x 1.2.3.4.5 y") if s.kind == "ip"] == [Span("ip", 2, 9), Span("ip", 4, 11)]
    mails = [s for s in pii.candidates("write bob [at] mail [dot] example dot org") if s.kind == "email"]
    assert [s.end for s in mails] == [33, 41] and {s.start for s in mails} == {6}
    assert pii.candidates("") == [] == pii.candidates("nothing to see")


def test_number_windows_are_all_rows_of_groups():
    text, got = "12 345-6789 012 34", []
    (m,) = pii._card_run.finditer(text)
    got = [(a, b) for a, b, _ in pii._windows(text, m, 5, 9)]
    g = [(0, 2), (3, 6), (7, 11), (12, 15), (16, 18)]
    want = [(g[i][0], g[j][1]) for i in range(5) for j in range(i, 5) if 5 <= sum(b - a for a, b in g[i : j + 1]) <= 9]
    assert got == want


def test_trees_add_spans_that_the_patterns_miss():
    texts = ["pay 4465758382889437 4465758382889437 now", "mail ann.lee (at) post (dot) co (dot) uk today", "tel (555) 123-4567 ok", "host 10[.]1[.]2[.]3 up", "version 1.2.3.4567 of 2024-10-11 12:30", "order 1234 5678 1234 5678 page 12 of 30"]
    got = [pii.told(e) for _, e in pii.find(texts)]
    assert got == ["card:4:20,card:21:37", "email:5:40", "phone:4:18", "ip:5:19", "", ""]
    assert pii.redacted(texts[0], pii.find(texts[:1])[0][1]) == "pay [CARD] [CARD] now"


def test_unseen_cases():
    trees, use = pii.model()
    made = pii.cases(4_000, seed=1234)
    x, y = np.array([pii.describe(t, s) for t, s, _ in made]), np.array([v for *_, v in made])
    for k, kind in enumerate(pii.KINDS):
        own = x[:, 0] == k
        a, b, least = use[kind]
        said = 1 / (1 + np.exp(-(a * trees.margin(x[own]) + b))) >= least
        assert y[own][said].mean() > 0.97 and said[y[own] == 1].mean() > 0.85, kind


def test_query_adds_labelled_spans(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in pii.op1_pii(spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    more = 0
    for d, t in texts.items():
        base = {pii.told([s]) for s in pii.base_spans(t)}
        every = rows[d].spans.split(",") if rows[d].spans else []
        assert base <= set(every)
        for x in set(every) - base:
            kind, a, b = x.split(":")
            more += 1
            if kind == "card":
                assert pii.luhn("".join(c for c in t[int(a) : int(b)] if c.isdigit()))
    assert more


@pytest.mark.parametrize("unit", ["12345 67890 ", "a at b dot c ", "a@b.co ", "+12 3456 789 ", "1.2.", "1", "a.b@", "4465758382889437 "])
def test_time_grows_with_the_text(unit):
    took = []
    for n in (40_000, 160_000):
        t = time.perf_counter()
        pii.find([unit * (n // len(unit))])
        took.append(time.perf_counter() - t)
    assert took[1] < 9 * took[0] + 0.5
