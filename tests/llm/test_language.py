"""Segmentation-marginalised unigrams against all segmentations, and words of any length."""

import itertools
import time

import numpy as np
import public_tokenizers
import pytest

from quayside.llm import language

PIECES = ["▁", "▁a", "▁ab", "a", "ab", "abc", "b", "bc", "c", "cab", "▁abcab", "bcabca"]


def by_hand(word, p):
    """The sum over all segmentations of the mark and the word."""
    x, number, total = language.START + word, {w: i for i, w in enumerate(PIECES)}, np.zeros(p.shape[1])
    for cuts in itertools.product((False, True), repeat=len(x) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(x)]
        one = np.ones(p.shape[1])
        for a, b in zip(at, at[1:]):
            k = number.get(x[a:b], len(PIECES) + (b - a == 1))  # a single unknown letter counts as unknown
            one = one * p[k]
        total += one
    return total


@pytest.fixture(scope="module")
def p():
    p = np.random.default_rng(4).uniform(0.001, 0.2, (len(PIECES) + 2, 3))
    p[len(PIECES)] = 0
    return p


def test_forward_sums_all_segmentations(p):
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abcx", repeat=n)] + ["abcabcabca"]
    scorer = language.Scorer(PIECES, p)
    for w, got in zip(words, scorer.texts(words), strict=True):
        want = np.log(by_hand(w, p))
        assert np.allclose(got, want)
        assert np.allclose(language.forward_log(p, scorer.number, w, scorer.width), want)


def test_expected_uses_are_those_of_all_segmentations(p):
    q = p[:, :1].copy()
    number = {w: i for i, w in enumerate(PIECES)}
    (at, ids), = language.Lattices(number, ["abcab"], 6).by_length
    got, x, want = language._expected(q, ids, np.array([2.0])), "▁abcab", np.zeros(len(q))
    total = by_hand("abcab", q)[0]
    for cuts in itertools.product((False, True), repeat=len(x) - 1):
        places = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(x)]
        used = [number.get(x[a:b], len(PIECES) + (b - a == 1)) for a, b in zip(places, places[1:])]
        share = np.prod(q[used, 0]) / total
        for k in used:
            want[k] += 2 * share
    assert np.allclose(got, want) and at.tolist() == [0]


@pytest.mark.parametrize("n", [23, 24, 25, 41, 60, 10_000])
def test_words_of_any_length_are_read_whole(p, n):
    word = ("abcab" * n)[:n]
    scorer = language.Scorer(PIECES, p)
    both = scorer.texts([word, f"{word} ab, {word}"])
    assert np.isfinite(both[0]).all()
    assert np.allclose(both[1], 2 * both[0] + scorer.texts(["ab"])[0])
    # One forward pass with big numbers, in logs.
    x, logs = "▁" + word, [np.zeros(3)]
    for j in range(1, len(x) + 1):
        some = [logs[i] + np.log(p[scorer.number.get(x[i:j], len(PIECES) + (j - i == 1))] + 1e-320) for i in range(max(0, j - 6), j)]
        logs.append(np.logaddexp.reduce(some))
    assert np.allclose(both[0], logs[-1])


def test_time_grows_with_the_length_of_a_word(p):
    scorer, took = language.Scorer(PIECES, p), []
    for n in (20_000, 80_000):
        t = time.perf_counter()
        scorer.texts(["abcde" * (n // 5)])
        took.append(time.perf_counter() - t)
    assert took[1] < 9 * took[0]


def test_words_keep_their_marks_and_the_vocabulary_is_whole():
    assert language.words("हिन्दी में, Été 2² x_y") == ["हिन्दी", "में", "été", "x", "y"]
    assert language.words("12 ² Ⅷ ́ !") == [] and language.words("Don't") == ["don", "t"]
    pieces = language.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert "▁" in pieces and max(map(len, pieces)) > 12 and len(pieces) == len(set(pieces))


def test_sample_is_bounded_and_the_same_in_any_partitioning(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, "the cat and the dog " * (1 + i % 3) if i % 2 else "le chat et le chien " * (1 + i % 5), "en" if i % 2 else "fr") for i in range(40)] * 2 + [(99, "la casa y el perro " * 500, "es")]
    made = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
        made.append(language.train(df, path, sample_docs=8, sample_chars=300))
    assert made[0][0] == made[1][0] == ["en", "es", "fr"] and np.array_equal(made[0][1], made[1][1])
