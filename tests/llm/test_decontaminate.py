"""Suffix arrays against all comparisons, blocks against one block, long and repetitive texts."""

import random
import re
import time

import pytest

from quayside.llm import decontaminate as D


def brute(items, docs, window):
    """Hit words, items found, and the longest match's (-length, place), of each document."""
    out = []
    for d in docs:
        w, hit, names, best = D.words(d), set(), set(), []
        for n, t in items:
            x = D.words(t)
            k = min(window, len(x))
            for i in range(len(x) - k + 1 if x else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == x[i : i + k]:
                        m = k
                        while p + m < len(w) and i + m < len(x) and w[p + m] == x[i + m]:
                            m += 1
                        hit |= set(range(p, p + k))
                        names.add(n)
                        best.append((-m, p))
        out.append((len(hit), sorted(names), min(best, default=None)))
    return out


def test_shards_are_searched_as_by_all_comparisons():
    r = random.Random(1)
    for _ in range(400):
        letters = "abc"[: r.randint(1, 3)]
        text = lambda n: " ".join(r.choice(letters + "z" if r.random() < 0.1 else letters) for _ in range(n)).encode()  # noqa: E731, B023
        items = [(str(i), text(r.randint(0, 12))) for i in range(r.randint(0, 5))]
        docs = [text(r.randint(0, 30)) for _ in range(r.randint(1, 4))]
        bench = D.Benchmark(items, r.choice([2, 3, 4, 5]))
        got = D.search_shard(bench, [bench.numbers(d) for d in docs], runs=True)
        for (n, names, best, runs), want, doc in zip(got, brute(items, docs, bench.window), docs, strict=True):
            assert (n, names) == want[:2] and sum(x["end"] - x["start"] for x in runs) == n
            assert (best is None) == (want[2] is None)
            if best:
                assert (-best[0], best[1]) == want[2]
                assert D.words(doc)[best[1] : best[1] + best[0]] == D.words(dict(items)[best[2]])[best[3] : best[3] + best[0]]


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    w = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(w) for _ in range(r.randint(1, 30)))) for i in range(30)] + [(3, "again here"), (3, "again here"), (None, "x y z"), (50, None), (51, "--"), (52, "w1 " * 100)]
    docs = [(i, " ".join(r.choice(w) for _ in range(r.randint(0, 60))), "a") for i in range(60)] + [(i, items[i][1] + " and more words that nobody knows " * (i % 3 * 5), "b") for i in range(30)]
    docs += [(None, items[2][1], "c"), (None, None, "c"), (7, None, "c"), (8, "", "c"), (9, "w1 " * 300, None), (9, "w1 " * 300, None), (10, "again HERE x-y z", "d")]
    return spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as key", "2 as runs", "3 as n_words"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")


def test_blocks_give_what_one_block_gives(tables):
    docs, items = tables
    one, many = rows(D.search(docs, items, window=4)), rows(D.search(docs, items, window=4, block_words=60))
    assert len(one) == docs.count() and any(r[2] for r in one)
    assert [r[:5] for r in one] == [r[:5] for r in many]  # doc_id, n_words, n_hit, items, longest_match
    words = {r.doc_id: D.words((r.text or "").encode()) for r in docs.collect()}
    assert [r[5] for r in one] == [r[5] for r in many] and words


def test_remove_judges_each_row_by_its_own_text(tables):
    docs, items = tables
    want = []
    texts = [((r.item_id is not None and str(r.item_id)) or "", (r.text or "").encode()) for r in items.collect()]
    for r in docs.collect():
        (hit, _, _), = brute(texts, [(r.text or "").encode()], 4)
        if not (hit and 20 * hit >= len(D.words((r.text or "").encode()))):
            want.append(tuple(r))
    for block in (10_000, 60):
        kept = D.remove(docs, items, window=4, block_words=block)
        assert kept.columns == docs.columns and rows(kept) == sorted(want, key=repr)


def test_empty_tables(spark, tables):
    docs, items = tables
    assert D.search(docs.limit(0), items).collect() == [] and D.remove(docs.limit(0), items).collect() == []
    assert {r.n_hit for r in D.search(docs, items.limit(0)).collect()} == {0} and D.remove(docs, items.limit(0)).count() == docs.count()


def test_long_texts_are_split_between_words(monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 16)
    text = "one two-three FOUR fïve 6 " * 20 + "x" * 100 + " y"
    assert [w.decode() for w in D.words(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.replace("FOUR", "four"))
    bench = D.Benchmark([("a", text.encode())], 13)
    assert D.search_shard(bench, [bench.numbers(text.encode())])[0][:2] == (len(D.words(text.encode())), ["a"])


def test_time_grows_with_the_words():
    took = []
    for n in (50_000, 200_000):
        bench = D.Benchmark([("a", b"w " * 200), ("b", b"w " * 5_000)], 13)
        t = time.perf_counter()
        got = D.search_shard(bench, [bench.numbers(b"w " * n)])
        took.append(time.perf_counter() - t)
        assert got[0][:3] == (n, ["a", "b"], (5_000, 0, "b", 0))
    assert took[1] < 10 * took[0] + 0.2
