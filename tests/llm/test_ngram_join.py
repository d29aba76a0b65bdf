"""Components against all pairs where blocks are cut up in every way; joins with hot keys; edge cases."""

import os
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from quayside.llm import common, ngram_join


def all_pairs(sets, num, den):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and den * k >= num * (len(a) + len(sets[j]) - k):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def texts():
    """Texts that share passages without being alike, chains of near copies, and boilerplate in front of all."""
    r = random.Random(9)
    passage = [" ".join(f"p{i}w{j}" for j in range(8)) for i in range(12)]
    out = []
    for _ in range(70):
        out.append(" ".join(r.sample(passage, r.randint(2, 5)) + [f"own{r.randrange(1000)}" for _ in range(r.randint(0, 6))]))
    base = " ".join(passage[:5]).split()
    for i in range(25):  # each like the one before it, the first and the last unlike
        base = [*base]
        base[(i * 7) % len(base)] = f"new{i}"
        out.append(" ".join(base))
    return out + out[:5] + ["", "one", "one", "ONE two"]


@pytest.mark.parametrize(("block", "chunks", "rounds"), [(1_000_000, 8, 2), (60, 1, 1), (60, 2, 2), (400, 1, 2)])
def test_blocks_that_are_cut_up_lose_no_link(spark, monkeypatch, texts, block, chunks, rounds):
    monkeypatch.setattr(ngram_join, "CHUNKS", chunks)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    sets = [set(ngram_join.gram_set(x.encode(), 3).tolist()) for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as cls", "2 as n", "3 as unit")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, 3, 70, 100, block_grams=block).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, all_pairs(sets, 70, 100), strict=True))}


def test_link_block_with_known_labels_is_that_of_all_pairs():
    r = random.Random(2)
    for _ in range(200):
        sets = [set(r.sample(range(30), r.randint(1, 12))) for _ in range(r.randint(2, 12))]
        num = r.choice([40, 60, 80])
        want = all_pairs(sets, num, 100)
        known = [min(i, r.choice([j for j, w in enumerate(want) if w == want[i]])) if r.random() < 0.3 else i for i in range(len(sets))]
        got = dict(ngram_join.link_block(list(range(len(sets))), [len(s) for s in sets], [np.array(sorted(s)) for s in sets], num, 100, known))
        assert got == {i: c for i, c in enumerate(want) if want.count(c) > 1}


def test_index_bits_follow_the_ngrams():
    assert [ngram_join._bits(n, 200) for n in (0, 10**6, 10**9, 10**12, 10**15)] == [8, 8, 11, 21, 26]


@pytest.mark.parametrize("bits", [6, 12, 16, 20])
def test_index_is_the_same_for_any_number_of_buckets(spark, texts, bits):
    df = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("cast(text as binary) as text").coalesce(1)  # in two flushes a class counts twice
    rows = ngram_join._active_rows(df, 3, 70, 100, bits).collect()
    sets = {ngram_join._class_of(s): s for s in (ngram_join.gram_set(t.encode(), 3) for t in texts) if len(s)}
    held = {}
    for s in sets.values():
        for g in s.tolist():
            held[g] = held.get(g, 0) + 1
    for r in rows:
        own = sets[bytes(r.cls)].tolist()
        assert r.n == len(own) and len(r.grams) == sum(held[g] > 1 for g in own)
        assert r.prefix == len(own) - -(-70 * len(own) // 100) + 1 - (len(own) - len(r.grams)) > 0
    want = {c for c, s in sets.items() if 0 < (k := sum(held[g] > 1 for g in s.tolist())) and len(s) - -(-70 * len(s) // 100) + 1 > len(s) - k}
    assert {bytes(r.cls) for r in rows} == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_join_hot_is_a_join(spark, how):
    rows = [(i, 1 if i % 3 else None if i % 2 else i % 50, f"x{i}") for i in range(3000)]
    left = spark.createDataFrame(rows, "a long, key long, b string")
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 60, 2)] + [(1, None)], "key long, c long")
    got, want = common.join_hot(left, right, "key", how), left.join(right, "key", how)
    assert set(got.columns) == set(want.columns)
    order = sorted(want.columns)
    assert sorted(map(repr, got.select(order).collect())) == sorted(map(repr, want.select(order).collect()))


def test_components_of_bytes_and_numbers(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in parent}
    df = spark.createDataFrame(edges, "u long, v long")
    assert {x.node: x.label for x in common.components(df).collect()} == want
    as_bytes = df.selectExpr("to_binary(lpad(hex(u), 8, '0'), 'hex') as u", "to_binary(lpad(hex(v), 8, '0'), 'hex') as v")
    assert {int.from_bytes(x.node): int.from_bytes(x.label) for x in common.components(as_bytes).collect()} == want
    assert common.components(df.limit(0)).collect() == []


def test_released_tables_are_gone(spark):


    df = common.cut(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.exists(path)
    common.release(df, df, spark.range(3))
    assert not os.path.exists(path)


def test_shared_ngrams_go_back_by_number():
    g = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 20000, dtype=np.uint64))
    data = np.uint32(len(g)).tobytes() + ngram_join._pack_grams(g) + ngram_join._pack_counts(np.ones(len(g), np.int64))
    out = ngram_join._shared(6)(pd.DataFrame({"bucket": [3, 3], "flush": [1, 2], "data": [data, data]}))
    assert len(out) == 2 and max(map(len, out["data"])) < 2 * len(g)


def test_texts_are_read_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b c d"), (2, None), (None, "a b c d")], "doc_id long, text string").coalesce(1)
    calls, run = [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda *x, **y: calls.append(1) or run(*x, **y))
    sets, _ = ngram_join._linked(df, 3, 80, 100, keyed=True)
    assert sorted(((r.doc_id, r.n_shingles, r.cls is None) for r in sets.collect()), key=str) == [(1, 2, False), (2, 0, True), (None, 2, False)]
    assert len(calls) == 1


def _posted(monkeypatch, texts, bits, each=400):
    """What a mapper makes of texts (frames), and the bytes it held at most beyond what it had before."""
    monkeypatch.setattr(ngram_join, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    batches = ({"text": pd.Series(texts[i : i + each], dtype="object"), "id": np.arange(i, i + each), "none": np.zeros(each, np.int64), "key": np.zeros(each, np.int64)} for i in range(0, len(texts), each))
    tracemalloc.start()
    frames = [(len(f), sum(map(len, f["data"])), f if len(texts) < 2000 else None) for f in ngram_join._postings(3, bits)(batches)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return frames, most


def test_a_flush_holds_little_more_than_its_ngrams(monkeypatch):
    r = np.random.default_rng(4)
    texts = [b" ".join(b"w%d" % w for w in r.integers(0, 3000, 500)) for _ in range(2000)]
    frames, most = _posted(monkeypatch, texts, 8)
    heads = sum(rows == 1 and size > ngram_join.FRAME // 2 for rows, size, _ in frames)
    assert heads == 1 and len(frames) > 2 and sum(rows for rows, *_ in frames) == 257
    assert most < 45 * 2000 * 498


def test_frames_of_any_size_hold_the_same(monkeypatch, texts):
    def rows(frame):
        monkeypatch.setattr(ngram_join, "FRAME", frame)
        return sorted(x for _, _, f in _posted(monkeypatch, [t.encode() for t in texts], 6, len(texts))[0] for x in f.itertuples(index=False, name=None))

    assert rows(1) == rows(2 << 20) and len(rows(1)) > 60


def test_small_frames_lose_no_link_and_leave_the_setting(spark, monkeypatch, texts):
    monkeypatch.setattr(ngram_join, "FRAME", 300)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    sets = [set(ngram_join.gram_set(x.encode(), 3).tolist()) for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda x: seen.append(spark.conf.get(name)) or cut(x))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, 3, 70, 100).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, all_pairs(sets, 70, 100), strict=True))}
    assert seen[0] == "300" and {*seen[1:], spark.conf.get(name)} == {before}
