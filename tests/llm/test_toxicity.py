"""The Viterbi decoder against all readings of short words, the lexicon against counts by hand."""

import math
import random

import numpy as np
import pytest

from quayside.llm import toxicity as T


@pytest.fixture(scope="module")
def model():
    return T.char_model(T.char_counts([b"the clown is a loser and an idiot with trash sleep books " * 20, "ünd ß öl ".encode() * 3]))


def readings(word, drawn):
    """(cost without the model, letters) of every path through the lattice."""
    paths = [(0.0, "", "")]
    for c in word.lower():
        looks, new = T.LOOKS.get(c, ""), []
        for cost, text, last in paths:
            for x in looks:
                if x != c:
                    new.append((cost + T.SWAP, text + x, c))
            if c.isalpha():
                new.append((cost, text + c, c))
            else:
                new.append((cost + ((4 * T.DROP if c.isdigit() else T.DROP) if looks else 0.0), text, last))
            if c == last and text and drawn < math.inf:
                for x in [*(y for y in looks if y != c), *([c] if c.isalpha() else [])]:
                    if text[-1] == x:
                        new.append((cost + drawn, text, last))
        paths = new
    return paths


def cost_of(text, model):
    a = b = 0
    total = 0.0
    for x in text:
        k = T._code(x)
        total -= model[a, b, k]
        a, b = b, k
    return total - model[a, b, 0]


@pytest.mark.parametrize("drawn", [T.DRAWN, math.inf])
def test_decode_is_the_likeliest_of_all_readings(model, drawn):
    r = random.Random(8)
    words = ["l0s3r", "1d10t", "cl0wnn", "tr4-sh", "b00ks", "a!!", "loooser", "$l33p", "x", "4", "i.d", "@@a"]
    words += ["".join(r.choice("abel0134$!sst-.") for _ in range(r.randint(1, 6))) for _ in range(300)]
    for w in words:
        every = [(c + cost_of(t, model), t) for c, t, _ in readings(w, drawn)]
        least = min(every)[0]
        assert T.decode(w, model, drawn) in {t for c, t in every if c <= least + 1e-9}, w


def test_score_is_noisy_or_of_the_least_likely_reading(model):
    lexicon = {"loser": 0.9, "idiot": 0.8, "^clow": 0.7}
    s = T.Scorer(model, lexicon, 0.05)
    assert math.isclose(s.score("a l0s3r and an 1diot, clowns"), 1 - 0.1 * 0.2 * 0.3 * 0.95)
    assert math.isclose(s.score(""), 0.05) and math.isclose(s.score("loser loser"), 1 - 0.1 * 0.95)


def test_lexicon_is_chosen_by_its_criterion_alone(spark):
    r = random.Random(2)
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [f"w{r.randrange(2000):04d}" for _ in range(12)] + ([f"vile{'abcdefgh'[(i // 4) % 8]}"] if toxic else [])
        r.shuffle(words)
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    made = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    feats = {i: T.Reader(made["chars"]).words(t) for i, t in texts}
    n, base = len(texts), 100 / 400
    count = {}
    for (i, _), (_, y) in zip(texts, labels, strict=True):
        for w in feats[i]:
            a, b = count.get(w, (0, 0))
            count[w] = (a + y, b + 1)
    least = math.log(len(count)) + T.CHANCE
    gain = lambda a, b: a * math.log(a / b / base) + ((b - a) * math.log((1 - a / b) / (1 - base)) if b > a else 0)
    want = {w: (a + base) / (b + 1) for w, (a, b) in count.items() if a >= T.LEAST_TEXTS and a / b >= T.LEAST_SHARE and gain(a, b) >= least}
    assert made["lexicon"].keys() == want.keys() and {"vilea", "^vile"} <= want.keys()
    assert all(math.isclose(made["lexicon"][w], v) for w, v in want.items())
    rest = [(i, y) for (i, _), (_, y) in zip(texts, labels, strict=True) if not feats[i] & want.keys()]
    assert math.isclose(made["base"], (sum(y for _, y in rest) + 0.5) / (len(rest) + 1)) and n == 400


def test_character_counts_are_trigrams():
    got = T.char_counts([b"ab", None, "É1".encode()])
    want = np.zeros_like(got)
    for x in ([0, 0, 1, 2, 0], [0, 0, 27, 27, 0, 0]):
        for a, b, c in zip(x, x[1:], x[2:]):
            want[a * 784 + b * 28 + c] += 1
    assert (got == want).all()
