"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model: counts over all texts of the corpus.
2. Words with look-alike characters among letters, letters drawn out (three or more) and runs of spaced single letters
   are lattices: a look-alike may stand for its letters or be a separator, a drawn-out letter for one or two. The
   Viterbi path under channel costs and the character model restores the word. Neither a token's length nor its share
   of letters matters; a token with no letter is a number or a rule and gives no word. What punctuation joins is read
   part by part and as one.
3. A lexicon from a bounded sample of labelled rows (SAMPLE_ROWS, the first by a hash of doc_id): all words of the
   restored texts, and beginnings of words, of which toxic texts hold nearly all, more than chance over that many words
   would give. Near copies (the same least 3-word hash) count once. A word's weight is its smoothed share of toxic texts;
   a text's score joins the weights of its restored words by noisy-or.

Null counts as empty; a text with nothing of the lexicon scores the share of toxic texts among such. Repeated rows score
alike. Labels that are null or whose doc_id is null teach nothing; of contradicting labels of one document the toxic one
counts. With no labels, or labels of one side, the score is the (smoothed) share of toxic labels. An empty table gives no
rows; other columns play no part. Texts and tokens of any length are read whole, in time linear in their length.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .language import held_out

SAMPLE_ROWS, THRESHOLD = 24_000, 0.7
#: A word enters the lexicon if so many toxic texts hold it, and this share of the texts that hold it is toxic.
LEAST_TEXTS, LEAST_SHARE, CHANCE = 4, 0.9, 4.0
#: Lengths of the beginnings of words that are features too.
BEGINNINGS = (4, 5, 6)
#: So many tokens are remembered, of so many characters at most; longer ones are read each time.
KEPT, REMEMBERED = 400_000, 40

#: What look-alike characters stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "ß": "b", "v": "v", "*": "aeiou", "#": "h",
}
SYMBOLS = 28  # 0: not a letter, 1 to 26: a to z, 27: another letter
#: Channel costs in nats: a look-alike for its letter, a separator, a letter drawn out.
SWAP, DROP, DRAWN = 1.0, 3.0, 0.5

_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27


def char_counts(texts) -> np.ndarray:
    """Counts of character trigrams, by number a * 784 + b * 28 + c."""
    out = np.zeros(SYMBOLS**3, np.int64)
    for x in texts:
        if x:
            c = _CODE[np.frombuffer(b"  " + x + b" ", np.uint8)].astype(np.int32)
            out += np.bincount(c[:-2] * 784 + c[1:-1] * 28 + c[2:], minlength=len(out))
    return out


def char_model(counts: np.ndarray) -> np.ndarray:
    """Log-probability of a character behind two others, mixed with shorter contexts."""
    n = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    one = (n.sum((0, 1)) + 1) / (n.sum() + SYMBOLS)
    two = (n.sum(0) + 20 * one) / (n.sum((0, 2))[:, None] + 20)
    return np.log((n + 20 * two[None]) / (n.sum(2)[:, :, None] + 20))


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def decode(word: str, model: np.ndarray, drawn: float = DRAWN) -> str:
    """The likeliest word behind an obfuscated one, lower-cased; letters stay, but for drawn-out ones.

    The time is linear in the word's length: a state holds its last letter and a link to those before it.
    """
    beam: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
    for c in word.lower():
        new: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        looks = LOOKS.get(c, "")
        choices = [(x, SWAP) for x in looks if x != c]
        if c.isalpha():
            choices.append((c, 0.0))
        else:
            choices.append(("", (4 * DROP if c.isdigit() else DROP) if looks else 0.0))
        for (a, b, last), (cost, text) in beam.items():
            for x, price in choices:
                if not x:
                    _keep(new, (a, b, last), cost + price, text)
                    continue
                k = _code(x)
                _keep(new, (b, k, c), cost + price - model[a, b, k], (text, x))
                if c == last and text and text[1] == x and drawn < math.inf:  # drawn out: the same character once more stands for nothing
                    _keep(new, (a, b, last), cost + drawn, text)
        beam = new
    return min((cost - model[a, b, 0], _spell(text)) for (a, b, _), (cost, text) in beam.items())[1]


def restore(word: str, model: np.ndarray) -> tuple[str, ...]:
    """The likeliest word, with drawn-out letters shortened to one or two and as they are."""
    return tuple({decode(_drawn.sub(r"\1\1", word.lower()), model), decode(word, model, math.inf)})


def _keep(new: dict, key: tuple, cost: float, text: tuple | None) -> None:
    """Of equally likely texts the first stays."""
    if key not in new or cost < new[key][0]:
        new[key] = (cost, text)


def _spell(text: tuple | None) -> str:
    out = []
    while text:
        text, x = text
        out.append(x)
    return "".join(reversed(out))


_spaced = re.compile(r"(?<![^\s])(?:[^\W_] ){2,}[^\W_](?![^\s.,;:!?])|(?<!\w)(?:[^\W_][.\-_*]){2,}[^\W_](?!\w)")
_odd = re.compile(r"[0-9@$!|+(€£¡*#]")
_edges = re.compile(r"^[^\w@$]+|[\W_]+$")
_drawn = re.compile(r"([^\W\d_])\1{2,}")
_punct = re.compile(r"[^\W\d_]+")
#: What joins words: neither a letter nor a digit nor another look-alike.
_joins = re.compile(r"(?:[^\w@$!|+(€£¡*#]|_)+")


def plain(token: str, model: np.ndarray) -> tuple[str, ...]:
    """The words that a token of any length is read as."""
    core = _edges.sub("", token.lower())
    if core.isalpha():
        return (core, *restore(core, model)) if _drawn.search(core) else (core,)
    parts = tuple(_punct.findall(core))
    if not parts:
        return ()
    odd = [x for x in _joins.split(core) if _odd.search(x) and _punct.search(x)]
    odd += filter(_drawn.search, parts)
    if odd or max(map(len, parts)) < 3:
        odd.append(core)
    return (*parts, *(w for x in dict.fromkeys(odd) for w in restore(x, model)))


def features(words) -> set[str]:
    """The words and, marked by ^, their beginnings."""
    return {*words, *("^" + w[:k] for w in words for k in BEGINNINGS if len(w) >= k)}


def spaced(text: str, model: np.ndarray) -> set[str]:
    """Words from runs of single letters; the first and the last letter may be words of their own (a, I)."""
    runs = {re.sub(r"[ .\-_*]", "", m) for m in _spaced.findall(text)}
    return {w for x in runs for y in (x, x[1:], x[:-1], x[1:-1]) if len(y) > 2 for w in restore(y, model)}


class Reader:
    """Features of restored texts, remembered by token."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def words(self, text: str) -> set[str]:
        if len(self.known) > KEPT:
            self.known.clear()
        out = features(spaced(text, self.model))
        for t in set(text.split()):
            if (found := self.known.get(t)) is None:
                found = tuple(features(plain(t, self.model)))
                if len(t) <= REMEMBERED:
                    self.known[t] = found
            out.update(found)
        return out


class Scorer(Reader):
    """Scores by the lexicon; of a token only the log of the chance that it isn't toxic is remembered."""

    def __init__(self, model: np.ndarray, lexicon: dict[str, float], base: float):
        super().__init__(model)
        self.logs = {w: math.log1p(-p) for w, p in lexicon.items()}
        self.base = base

    def _least(self, words) -> float:
        return min((self.logs.get(w, 0.0) for w in features(words)), default=0.0)

    def score(self, text: str) -> float:
        if len(self.known) > KEPT:
            self.known.clear()
        tokens, known = set(text.split()), self.known
        long = [self._least(plain(t, self.model)) for t in tokens if len(t) > REMEMBERED]
        tokens = [t for t in tokens if len(t) <= REMEMBERED]
        for t in tokens:
            if t not in known:
                known[t] = self._least(plain(t, self.model))
        found = sorted(filter(None, [*long, *map(known.__getitem__, tokens)]))
        found += filter(None, (self._least([w]) for w in sorted(spaced(text, self.model))))
        return 1 - math.exp(math.fsum(found)) * (1 - self.base)


def corpus_model(docs: DataFrame) -> np.ndarray:
    """The character model of all texts of docs."""

    def run(pdfs):
        total = np.zeros(SYMBOLS**3, np.int64)
        for pdf in pdfs:
            total += char_counts(pdf["text"])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most 28 ** 3 rows
    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in rows:
        counts[r.gram] = r.n
    return char_model(counts)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model of docs (doc_id, text) and labels (doc_id, toxic), of which at most sample_rows are read."""
    spark = docs.sparkSession
    model = corpus_model(docs)
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = spark.createDataFrame(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect(), "doc_id long, toxic int")
    sent = spark.sparkContext.broadcast(model)

    def read(pdfs):
        reader = Reader(sent.value)
        for pdf in pdfs:
            texts = [x or "" for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "mark": [_mark(x) for x in texts], "words": [sorted(reader.words(x)) for x in texts]})

    # At most sample_rows ids, so they may be sent to all.
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text")
    some = common.cut(some.mapInPandas(read, "doc_id long, toxic int, mark long, words array<string>"))
    one = some.groupBy("mark", "toxic").agg(F.min("doc_id").alias("doc_id")).join(some.drop("mark", "toxic"), "doc_id").select("doc_id", "toxic", "words")
    n, t = one.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < t < n:
        return {"chars": model, "lexicon": {}, "base": (t + 0.5) / (n + 1)}
    base = t / n
    each = one.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("b"))
    each = common.cut(each)
    # The log likelihood ratio must exceed the log of the number of words by CHANCE: then by chance hardly any would.
    c, share = F.col("b") - F.col("a"), F.col("a") / F.col("b")
    gain = F.col("a") * F.log(share / base) + F.when(c > 0, c * F.log((1 - share) / (1 - base))).otherwise(0.0)
    least = math.log(max(2, each.count())) + CHANCE
    found = each.where((F.col("a") >= LEAST_TEXTS) & (share >= LEAST_SHARE)).withColumn("gain", gain).where(F.col("gain") >= least).collect()
    lexicon = {r.word: (r.a + base) / (r.b + 1) for r in sorted(found, key=lambda r: r.word)}
    # The lexicon holds words of the sample only, so its size is bounded with it.
    sent = spark.createDataFrame([(w,) for w in lexicon], "word string")
    held = one.select("doc_id", F.explode("words").alias("word")).join(F.broadcast(sent), "word", "left_semi").select("doc_id").distinct()
    n, t = one.join(held, "doc_id", "left_anti").agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    return {"chars": model, "lexicon": lexicon, "base": (t + 0.5) / (n + 1)}


def _mark(text: str) -> int:
    """The least hash of three words in a row: near copies mostly have the same."""
    w = text.lower().split()
    return min((zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0)


_made: dict = {}
common.forget["toxicity"] = _made.clear


def scorer_udf(spark: SparkSession, model: dict):
    """A column function: score (0 to 1, higher: likelier toxic) of a text column."""
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, model["chars"], model["lexicon"], model["base"]))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common.hold("toxicity")
        key, chars, lexicon, base = sent.value
        if key not in _made:
            _made.clear()
            _made[key] = Scorer(chars, lexicon, base)
        for x in texts:
            yield pd.Series([_made[key].score(t or "") for t in x], dtype="float64")

    return score


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(1, 3))
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(1, 3))
    score = scorer_udf(spark, train(docs.select("doc_id", "text"), labels))
    return docs.select("doc_id", "held_out", score("text").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
