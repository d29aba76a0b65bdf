"""The label model against Bayes' rule by hand, and a model that doesn't depend on partitions."""

import math
import time

import numpy as np

from quayside.llm import quality


def test_posterior_is_bayes_by_hand():
    share, chance = 0.7, np.array([[0.4, 0.6, 0.2], [0.1, 0.05, 0.02]])
    patterns = np.array([[a, b, c] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    for row, got in zip(patterns, quality.posterior(patterns, share, chance), strict=True):
        like = {side: math.prod((chance[side, k] if v == 0 else 1 - chance[side, k]) for k, v in enumerate(row) if v >= 0) for side in (0, 1)}
        assert math.isclose(got, share * like[1] / (share * like[1] + (1 - share) * like[0]), rel_tol=1e-9)


def test_label_model_finds_planted_accuracies():
    rng = np.random.default_rng(3)
    good, bad_vote = rng.random(60_000) < 0.8, {1: [0.03, 0.02, 0.05, 0.01], 0: [0.7, 0.5, 0.6, 0.9]}
    v = np.stack([np.where(rng.random(len(good)) < np.where(good, bad_vote[1][k], bad_vote[0][k]), 0, 1) for k in range(4)], 1)
    v[rng.random(v.shape) < 0.2] = -1
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    share, chance = quality.label_model(patterns, counts.astype(float))
    assert abs(share - good.mean()) < 0.01
    assert np.abs(chance - [bad_vote[0], bad_vote[1]]).max() < 0.03


def test_model_is_the_same_in_any_partitioning(spark):
    r = np.random.default_rng(1)
    text = lambda i: " ".join(["word" + str(x) for x in r.integers(0, 50, 30)]) if i % 4 else "!!## $$$ @@ " * (i % 9 + 1)
    rows = [(i % 70, text(i)) for i in range(100)] + [(None, "the same text here again"), (None, None), (5, "")]
    rows = [x for x in rows for _ in range(3)]
    made = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        made.append(quality.train(df, sample_docs=40, sample_chars=5_000))
    assert np.array_equal(made[0]["weights"], made[1]["weights"]) and made[0]["bias"] == made[1]["bias"] and made[0]["share"] == made[1]["share"]


def test_scores_and_decisions_by_hand(spark):
    model = {"weights": np.zeros(quality.DIM), "bias": 0.3}
    words = ["alpha", "Beta", "beta", "ünï"]
    for k, w in enumerate(words):
        model["weights"][quality._slots(w)[0]] += k + 1
    text = "alpha Beta beta beta ünï"
    z = 0.3 + sum(model["weights"][list(quality._slots(w))].sum() for w in text.split()) / 5 + model["weights"][quality._measure_slots(quality.measure(text))].sum()
    assert math.isclose(quality.Scorer(model["weights"], 0.3).score(text), 1 / (1 + math.exp(-z)))
    rows = [(1, "good words make a good text for all of us to read", "x", 1), (1, None, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, votes long")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} <= set(rows)


def test_time_grows_with_the_text():
    took = []
    for n in (100_000, 400_000):
        t = time.perf_counter()
        quality.Scorer(np.zeros(quality.DIM), 0.0).score("the thing is! " * (n // 14))
        took.append(time.perf_counter() - t)
    assert took[1] < 10 * took[0]


def test_a_scoring_worker_keeps_each_word_once():
    quality._forget()
    r = np.random.default_rng(2)
    scorer = quality.Scorer(r.normal(size=quality.DIM), 0.1)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 500, 60)) for _ in range(20)]
    for t in texts:
        m, counts, n = quality.measured(t)
        z = 0.1 + sum(scorer.weights[s] * x for s, x in quality.features(m, counts, n).items())
        quality._slots.cache_clear()
        assert math.isclose(scorer.score(t), 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert len(scorer.known) > 400 and quality._slots.cache_info().currsize == 0
