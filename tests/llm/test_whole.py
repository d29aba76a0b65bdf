"""Operators do the whole job: nothing is dropped by length, share or rank."""

import time

import numpy as np
import pytest

from quayside.llm import ann, ngram_join, toxicity


def test_toxicity_reads_tokens_of_any_length():
    model = toxicity.char_model(toxicity.char_counts([b"you are a stupid asshole and the clown is a loser with trash " * 50]))
    words = lambda x: toxicity.plain(x, model)
    assert "stupid" in words("st" + "u" * 56 + "pid") and "stupid" in words("St" + "U" * 5000 + "pid!")
    for by in "._,/-":
        assert {"you", "are", "stupid", "loser", "trash"} <= set(words(by.join("you are a stupid clown and a loser and the l0ser is trash".split())))
    assert "loser" in words("this.text.has.many.words.joined.by.dots,l0s3r,and.more") and "stupid" in words("some/words/joined/by/slashes/stuuuupid/and/others/too")
    assert "asshole" in words("@$$h0l3")
    assert words("漢字" * 30) == ("漢字" * 30,)
    assert words("-" * 50) == () == words("1234567890" * 5)


def test_toxicity_scores_long_tokens():
    model = toxicity.char_model(toxicity.char_counts([b"you are a stupid asshole " * 50]))
    scorer = toxicity.Scorer(model, {"stupid": 0.9, "asshole": 0.9}, 0.1)
    for text in ("st" + "u" * 56 + "pid", "a.very.long.text.joined.by.dots.that.is.stupid.all.along", "@$$h0l3"):
        assert scorer.score(text) > 0.8 and {"stupid", "asshole"} & toxicity.Reader(model).words(text)
    assert all(len(t) <= toxicity.REMEMBERED for t in scorer.known)


def test_toxicity_decodes_in_linear_time():
    model = toxicity.char_model(toxicity.char_counts([b"you are a stupid asshole " * 50]))
    start = time.perf_counter()
    toxicity.plain("l0s3r" * 20_000, model)
    assert time.perf_counter() - start < 30


@pytest.mark.parametrize("how", [dict(how=ann.ALL), dict(how=ann.ALL, group_rows=100), dict(how=ann.Setting(2, 2, 50.0, 9))])
def test_neighbours_of_quantised_vectors_tie_to_the_smaller_id(spark, how):
    rng = np.random.default_rng(3)
    vecs = np.unique(rng.integers(0, 2, (500, 10)) * 0.1, axis=0)
    vecs = vecs[vecs.any(1)][rng.permutation(int(vecs.any(1).sum()))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.search(df, df.where("vec_id % 7 = 0"), k=5, **how).collect()}

    def score(a, b):
        total = 0.0
        for p, r in zip(a, b, strict=True):
            total += p * r
        return total

    # With no hash, or all moves of very wide ones, everything is visited.
    for q in range(0, len(vecs), 7):
        want = sorted((-score(vecs[q], v), i) for i, v in enumerate(vecs) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [i for _, i in want]


def test_neighbours_of_equal_scores(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [1.0, i / 500]) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    for how in (None, ann.ALL, ann.Setting(2, 2, 50.0, 9)):
        got = [r.vec_id for r in ann.search(df, df.where("vec_id = 0"), how=how).orderBy("rank").collect()]
        assert got == list(range(1, 21)) or how is None and len(got) == 20  # a fitted setting may miss some


def test_neighbours_groups_of_queries_and_parts_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "QUERY_GROUP", 40)
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.search(df, df.where("vec_id % 2 = 0"), how=ann.ALL, group_rows=70).collect()}
    for q in range(0, 300, 2):
        s = v @ v[q]
        s[q] = -np.inf
        assert [got[q, k + 1] for k in range(20)] == np.argsort(-s)[:20].tolist()


def test_probes_come_in_order_of_estimated_success():
    h = ann.Hashes(3, 1, 2, 2.0)
    q = np.array([[0.3, -0.2, 0.7, 0.0]])
    cells = h.cells(q, 0)[0]
    base, want = np.floor(cells), []
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            cost = sum(0 if m == 0 else (f**2 if m < 0 else (1 - f) ** 2) for m, f in zip((a, b), cells - base, strict=True))
            want.append((cost, int(base[0] + a + (base[1] + b) * 1_000_003)))
    assert h.probes(q, 0, 9)[0].tolist() == [b for _, b in sorted(want)]


def test_keep_one_decides_by_row(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    near = text["a"] + " end"
    rows = [(1, text["a"], "s"), (1, text["a"], "s"), (1, text["a"], "r"), (2, near, "s"), (2, text["b"], "s"), (None, near, "s"), (None, text["c"], "s"), (None, text["c"], "s"), (3, text["d"].upper(), "s"), (4, text["d"], "s"), (5, None, "s"), (5, None, "s"), (None, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as key", "2 as row", "3 as comp")
    got = sorted(((r.doc_id, r.text, r.source) for r in ngram_join.keep_one(df).collect()), key=str)
    assert got == sorted([(1, text["a"], "r"), (2, text["b"], "s"), (None, text["c"], "s"), (3, text["d"].upper(), "s"), (5, None, "s"), (5, None, "s"), (None, "", "s")], key=str)
    unique = df.where("doc_id = 3")
    assert ngram_join.keep_one(unique).collect() == unique.collect()
