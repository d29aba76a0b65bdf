"""A weak-label quality classifier.

Heuristic labellers (LABELLERS) vote good (1), bad (0) or abstain (-1) on every text. How often each pattern of votes
occurs in the whole table is counted, and expectation-maximisation over these counts estimates each labeller's accuracy
and the share of good texts, no label being read. The posterior of a text's pattern is its weak label. A bounded sample
(of the distinct pairs of doc_id and text the first SAMPLE_DOCS by their hash, of SAMPLE_CHARS characters together at
most, whole texts; the shortest, if each is longer) with its weak labels trains a linear scorer on hashed features: words,
their shapes, and the labellers' measurements in steps. Every text is scored by it.

Null counts as an empty text; an empty text has a score like any other (the labellers vote it bad). Repeated rows score
alike and stand in the sample once, so the model doesn't depend on the partitions. With no rows, or weak labels all of one
side, the score is near 1 where they are good or none, else near 0. An empty table gives no rows. Texts of any length are
read whole, in time linear in it. Other columns than doc_id and text play no part; keep_good returns them as they are.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq, mul

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .linear import fit_logistic

SAMPLE_DOCS, SAMPLE_CHARS, DIM = 6_000, 16_000_000, 1 << 18
KEEP = 0.5
#: Words whose weights a worker keeps; beyond that the latest learnt go, down to BACK of them.
KEPT, BACK = 300_000, 0.625

_UPPER, _LOWER, _MARK, _SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LOWER[97:123] = True
_MARK[[ord(c) for c in "!#$%&*+/<=>@\\^_`{|}~"]] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
MEASURES = ["marks", "ends", "doubled", "upper", "repeats", "distinct", "short", "words", "lines", "top", "packed"]
#: (measure, bad from or up to, good up to or from): a measure at or past the first votes bad, one at or past the second good, between them none.
LABELLERS = [("marks", 0.25, 0.03), ("ends", 0.2, 0.03), ("doubled", 0.2, 0.02), ("upper", 0.5, 0.2), ("repeats", 0.2, 0.02), ("distinct", 0.25, 0.4), ("short", 0.08, 0.2), ("words", 0, 5), ("lines", 0.5, 0.1), ("top", 0.25, 0.15), ("packed", 0.15, 0.3)]
#: Texts of fewer words get no vote by these.
SCANT, UNSURE = 8, ("distinct", "short", "lines", "upper", "repeats", "top", "packed")


def measured(text: str) -> tuple[list[float], Counter, int]:
    """measure(text), how often each word occurs, and the number of words."""
    parts = text.split()
    n = len(parts)
    if not n:
        return [0.0] * len(MEASURES), Counter(), 0
    data = text.encode() + b" "
    b = np.frombuffer(data, np.uint8)
    counts = Counter(parts)
    c = np.bincount(b, minlength=256)
    mark = np.flatnonzero(_MARK[b])  # the last byte is a space
    behind = b[mark + 1]
    upper, lower = c[_UPPER].sum(), c[_LOWER].sum()
    lines = [x for x in text.split("\n") if x]
    short = sum(k for w, k in counts.items() if len(w) <= 3)
    return [
        len(mark) / n, int(_SPACE[behind].sum()) / n, int((b[mark] == behind).sum()) / n, upper / max(1, upper + lower),
        sum(map(eq, parts, islice(parts, 1, None))) / max(1, n - 1), min(1.0, len(counts) / min(n, 12 * n**0.5)), short / n, float(n), 1 - len(set(lines)) / max(1, len(lines)),
        max(counts.values()) / n, len(zlib.compress(data, 1)) / len(data),
    ], counts, n


def measure(text: str) -> list[float]:
    """Marks for each word, share of words that end in a mark, doubled marks for each word, share of capitals, share of words like the one before, share of distinct words (of the square-root scale), share of short words, words, share of repeated lines, share of the most frequent word, size after compression."""
    return measured(text)[0]


def votes(m: np.ndarray) -> np.ndarray:
    """(text, labeller) in -1, 0, 1 for measures (text, measure)."""
    out = np.full((len(m), len(LABELLERS)), -1, np.int8)
    for k, (name, bad, good) in enumerate(LABELLERS):
        x = m[:, MEASURES.index(name)]
        out[x <= good if good < bad else x >= good, k] = 1
        out[x >= bad if good < bad else x <= bad, k] = 0
        if name in UNSURE:
            out[m[:, MEASURES.index("words")] < SCANT, k] = -1
    return out


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """(share of good texts, chance of a bad vote among votes (class, labeller)) by expectation-maximisation.

    The start: bad votes are rare on good texts (1 in 50) and come in 2 of 5 on bad ones. Who abstains tells nothing.
    """
    chance = np.empty((2, patterns.shape[1]))
    chance[1], chance[0] = 0.02, 0.4
    share, total = 0.85, counts.sum()
    for _ in range(rounds):
        post = posterior(patterns, share, chance)
        share = float(np.clip((post * counts).sum() / total, 0.01, 0.99))
        for side, w in ((1, post * counts), (0, (1 - post) * counts)):
            # Pseudo votes keep chances above nought.
            chance[side] = (((patterns == 0) * w[:, None]).sum(0) + 0.5) / (((patterns >= 0) * w[:, None]).sum(0) + 1)
    return share, chance


def posterior(patterns: np.ndarray, share: float, chance: np.ndarray) -> np.ndarray:
    bad, good = (patterns == 0).astype(float), (patterns == 1).astype(float)
    z = np.log(share / (1 - share)) + bad @ np.log(chance[1] / chance[0]) + good @ np.log((1 - chance[1]) / (1 - chance[0]))
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


_classes = str.maketrans({**{c: "A" for c in map(chr, range(65, 91))}, **{c: "a" for c in map(chr, range(97, 123))}, **{c: "0" for c in "0123456789"}})
_runs = re.compile(r"(.)\1+")


@functools.lru_cache(maxsize=200_000)
def _slots(word: str) -> tuple[int, int]:
    """Hashed features of a word: the word, lower-cased, and its shape with runs shortened."""
    shape = word.translate(_classes)
    if not word.isascii():
        shape = "".join("a" if c.isalpha() and not c.isupper() else "A" if c.isalpha() else c for c in shape)
    return zlib.crc32(word.lower().encode()) % DIM, zlib.crc32(b"\0" + _runs.sub(r"\1", shape)[:12].encode()) % DIM


#: Steps of each measure.
_STEPS = {"marks": [0.03, 0.1, 0.25, 1, 3], "ends": [0.03, 0.1, 0.2, 0.5], "doubled": [0.02, 0.1, 0.2, 1], "upper": [0.05, 0.2, 0.5, 0.9], "repeats": [0.005, 0.02, 0.1, 0.2, 0.5], "distinct": [0.1, 0.25, 0.4, 0.7], "short": [0.04, 0.08, 0.2, 0.3], "words": [3, 8, 20, 100, 1000], "lines": [0.05, 0.1, 0.3, 0.5], "top": [0.1, 0.15, 0.25, 0.5], "packed": [0.1, 0.15, 0.3, 0.6]}
_SLOT = {(m, s): zlib.crc32(f"\1{m}={s}".encode()) % DIM for m in MEASURES for s in range(len(_STEPS[m]) + 1)}


def _measure_slots(m: list[float]) -> list[int]:
    return [_SLOT[name, bisect_right(_STEPS[name], x)] for name, x in zip(MEASURES, m, strict=True)]


def features(m: list[float], counts: Counter, n: int) -> dict[int, float]:
    """Words and shapes by share of the words, measures at weight 1."""
    out: dict[int, float] = {}
    for w, k in counts.items():
        for s in _slots(w):
            out[s] = out.get(s, 0.0) + k / n
    for s in _measure_slots(m):
        out[s] = out.get(s, 0.0) + 1
    return out


def _vote_rows(pdfs):
    common.hold("quality")
    for pdf in pdfs:
        v = votes(np.array([measure(x or "") for x in pdf["text"]]).reshape(-1, len(MEASURES)))
        yield pd.DataFrame({"votes": [bytes((r + 1).tolist()) for r in v]})


def _feature_rows(pdfs):
    for pdf in pdfs:
        rows = []
        for key, text in zip(pdf["key"], pdf["text"], strict=True):
            m, counts, n = measured(text or "")
            f = features(m, counts, n)
            rows.append((key, bytes((votes(np.array([m]))[0] + 1).tolist()), np.array(list(f), np.int32).tobytes(), np.array(list(f.values()), np.float32).tobytes()))
        yield pd.DataFrame(rows, columns=["key", "votes", "slots", "shares"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict:
    """The model of docs (doc_id, text): weights, bias, share and accuracies (a labeller's chance of being right when it votes)."""
    src = docs.select("doc_id", "text")
    # At most 3 ** len(LABELLERS) patterns reach the driver.
    found = src.select("text").mapInPandas(_vote_rows, "votes binary").groupBy("votes").count().collect()
    if not found:
        return {"weights": np.zeros(DIM), "bias": 10.0, "share": 1.0, "accuracies": {}}
    found.sort(key=lambda r: bytes(r.votes))
    patterns = np.array([list(r.votes) for r in found], np.int64) - 1
    share, chance = label_model(patterns, np.array([r["count"] for r in found], float))
    # What the driver takes of the sample is bounded by sample_docs and sample_chars.
    key, size = F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size")
    first = src.select(key, size).distinct().orderBy("key", "size").limit(sample_docs).collect()
    held, keys = 0, []
    for r in first:
        if held + r["size"] <= sample_chars:
            held += r["size"]
            keys.append((r["key"],))
    keys = docs.sparkSession.createDataFrame(keys or [(min(first, key=lambda r: r["size"])["key"],)], "key long")
    some = src.withColumn("key", key).join(F.broadcast(keys), "key", "left_semi").repartition(common.partitions(docs.sparkSession), "key")
    rows = some.mapInPandas(_feature_rows, "key long, votes binary, slots binary, shares binary").dropDuplicates(["key"]).orderBy("key").collect()
    slots, shares = [np.frombuffer(bytes(r.slots), np.int32) for r in rows], [np.frombuffer(bytes(r.shares), np.float32) for r in rows]
    y = posterior(np.array([list(r.votes) for r in rows], np.int64) - 1, share, chance)
    weights, bias = np.zeros(DIM), 10.0 if y.mean() > 0.5 else -10.0
    if 0 < y.mean() < 1:
        used, cols = np.unique(np.concatenate(slots), return_inverse=True)
        weights[used], bias = fit_logistic(np.repeat(np.arange(len(rows)), [len(x) for x in slots]), cols, np.concatenate(shares).astype(float), y, len(used), l2=1e-4, steps=150)
    right = {LABELLERS[k][0]: float(share * (1 - chance[1, k]) + (1 - share) * chance[0, k]) for k in range(len(LABELLERS))}
    return {"weights": weights, "bias": bias, "share": share, "accuracies": right}


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = {}

    def score(self, text: str) -> float:
        if len(self.known) > KEPT:
            self.known = dict(islice(self.known.items(), int(BACK * KEPT)))
        m, counts, n = measured(text)
        known = self.known
        for w in set(counts).difference(known):
            a, b = _slots.__wrapped__(w)  # known keeps the words already
            known[w] = float(self.weights[a] + self.weights[b])
        z = self.bias + float(self.weights[_measure_slots(m)].sum())
        if n:
            z += math.fsum(map(mul, map(known.__getitem__, counts), counts.values())) / n
        return float(1 / (1 + math.exp(-min(35.0, max(-35.0, z)))))


_made: dict = {}


def _forget() -> None:
    _made.clear()
    _slots.cache_clear()


common.forget["quality"] = _forget


def scorer_udf(spark: SparkSession, model: dict):
    """A column function: score (0 to 1, higher is better) of a text column."""
    nonzero = np.flatnonzero(model["weights"])
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, nonzero, model["weights"][nonzero], model["bias"]))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common.hold("quality")
        key, at, w, bias = sent.value
        if key not in _made:
            _forget()
            weights = np.zeros(DIM)
            weights[at] = w
            _made[key] = Scorer(weights, bias)
        for x in texts:
            yield pd.Series([_made[key].score(t or "") for t in x], dtype="float64")

    return score


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that score under KEEP."""
    return docs.where(scorer_udf(docs.sparkSession, train(docs))(F.col("text")) >= KEEP)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score, keep (1 if the score is KEEP or more, else 0)."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    score = scorer_udf(spark, train(docs))
    return docs.select("doc_id", score("text").alias("score")).withColumn("keep", (F.col("score") >= KEEP).cast("int"))
