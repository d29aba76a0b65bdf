"""Language identification by segmentation-marginalised unigrams.

Over a fixed public vocabulary of pieces, each language has a probability for each piece. A word's probability in a
language is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over its
words. The piece probabilities come from expectation-maximisation (forward-backward) over the words of a bounded sample
of labelled documents: of each language the first SAMPLE_DOCS by a hash of doc_id, whole texts, of SAMPLE_CHARS
characters together at most (the shortest one, if each is longer).

A word is a run of letters and the marks on them, lower-cased, with the vocabulary's mark of a word's start. All pieces of
letters, marks and that mark take part, whatever their length, and a word of any length is read as a whole: the forward
pass is rescaled on the way. A letter that no piece covers counts as an unknown piece of probability UNKNOWN.

Null text, empty text or text with no letter: 'und', score 0. So is every text if nothing can be learned. Ties go to the
first language by name. The score is the language's posterior under equal priors. Rows with a null doc_id aren't held
out and aren't learned from. Repeated rows are scored alike (in the sample each counts). An empty table gives no rows;
other columns play no part.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SAMPLE_DOCS, SAMPLE_CHARS, ROUNDS, SMOOTH, UNKNOWN = 200, 2_000_000, 4, 0.05, 1e-7
#: Words of more letters are scored one by one, rescaled; others together, by their length.
TOGETHER = 24
#: Words whose scores a worker keeps; then it starts afresh. Longer words than TOGETHER aren't kept.
KEPT = 400_000
_letters = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
_ascii = re.compile(r"[a-z]+")
_piece = regex.compile(r"▁?[\p{L}\p{M}]*+")
START = "▁"


def vocabulary(path: str) -> list[str]:
    """Pieces of letters and marks, with or without the mark of a word's start, and that mark alone, lower-cased, once each."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()))
    return sorted({p for p in found if p and _piece.fullmatch(p)})


def words(text: str) -> list[str]:
    text = text.lower()
    return _ascii.findall(text) if text.isascii() else _letters.findall(text)


class Lattices:
    """The pieces of words: for each length an array (word, start, piece length) of piece numbers; V: none, V + 1: an unknown letter."""

    def __init__(self, number: dict[str, int], some: list[str], width: int):
        none = len(number)
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []
        groups: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(some):
            groups[len(w)].append(i)
        get = number.get
        for n, at in groups.items():
            n += 1
            spans = [(i, min(n, i + width)) for i in range(n)]
            flat = []
            for k in at:
                w = START + some[k]
                flat += [get(w[i:j], none) for i, top in spans for j in range(i + 1, top + 1)]
            flat = np.array(flat, np.int32).reshape(len(at), -1)
            ids = np.full((len(at), n, min(n, width)), none, np.int32)
            c = 0
            for i, top in spans:
                ids[:, i, : top - i] = flat[:, c : c + top - i]
                c += top - i
            one = ids[:, :, 0]
            one[one == none] = none + 1
            self.by_length.append((np.array(at), ids))


def forward(p: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """alpha (word, place, language); p (piece, language)."""
    b, n, width = ids.shape
    alpha = np.zeros((b, n + 1, p.shape[1]))
    alpha[:, 0] = 1
    for i in range(n):
        for j in range(1, min(width, n - i) + 1):
            alpha[:, i + j] += alpha[:, i] * p[ids[:, i, j - 1]]
    return alpha


def forward_log(p: np.ndarray, number: dict[str, int], word: str, width: int) -> np.ndarray:
    """The log of a word's probability in each language, for words of any length: only the last `width` places are held, and rescaled."""
    none, x = len(number), START + word
    get = number.get
    alpha = np.zeros((width, p.shape[1]))  # by place modulo width
    alpha[0] = 1
    logs = np.zeros(p.shape[1])
    for j in range(1, len(x) + 1):
        starts = range(max(0, j - width), j)
        ids = [get(x[i:j], none) for i in starts]
        if ids[-1] == none:
            ids[-1] = none + 1
        now = (alpha[[i % width for i in starts]] * p[ids]).sum(0)
        alpha[j % width] = now
        if j % 8 == 0:  # 8 letters take less than 1e-70
            top = np.maximum(alpha.max(0), 1e-300)
            alpha /= top
            logs += np.log(top)
    return logs + np.log(np.maximum(alpha[len(x) % width], 1e-300))


def _expected(p: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Expected uses of each piece; p (piece, 1)."""
    b, n, width = ids.shape
    alpha, beta = forward(p, ids)[:, :, 0], np.zeros((b, n + 1))
    beta[:, n] = 1
    for i in range(n - 1, -1, -1):
        for j in range(1, min(width, n - i) + 1):
            beta[:, i] += p[ids[:, i, j - 1], 0] * beta[:, i + j]
    out = np.zeros(len(p))
    share = count / np.maximum(alpha[:, n], 1e-300)
    for i in range(n):
        for j in range(1, min(width, n - i) + 1):
            x = ids[:, i, j - 1]
            out += np.bincount(x, alpha[:, i] * p[x, 0] * beta[:, i + j] * share, len(p))
    return out


def fit(words_: list[str], counts: np.ndarray, pieces: list[str]) -> np.ndarray:
    """A language's probabilities (pieces and the two of Lattices) from its words. Words longer than TOGETHER teach by their parts of that length."""
    number, v, width = {p: i for i, p in enumerate(pieces)}, len(pieces), max(map(len, pieces))
    total: Counter = Counter()
    for w, c in zip(words_, counts.tolist(), strict=True):
        for i in range(0, len(w), TOGETHER):
            total[w[i : i + TOGETHER]] += c
    some = sorted(total)  # one order of addition, whatever the partitions
    n = np.array([total[w] for w in some], float)
    lattices = Lattices(number, some, width)
    q = np.full((v + 2, 1), 1 / v)
    q[v:, 0] = 0, UNKNOWN
    for _ in range(ROUNDS):
        use = sum((_expected(q, ids, n[at]) for at, ids in lattices.by_length), np.zeros(v + 2))[:v]
        q[:v, 0] = (use + SMOOTH) / (use.sum() + SMOOTH * v)
    return q[:, 0]


class Scorer:
    """Log-probabilities of words in all languages, remembered."""

    def __init__(self, pieces: list[str], p: np.ndarray):
        self.number = {x: i for i, x in enumerate(pieces)}
        self.width = max(map(len, pieces))
        self.p = p
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.logs = np.zeros((1024, self.p.shape[1]))

    def learn(self, new: list[str]) -> None:
        base = len(self.row)
        if base + len(new) > len(self.logs):
            self.logs = np.vstack([self.logs, np.zeros((max(len(self.logs), len(new)), self.p.shape[1]))])
        for at, ids in Lattices(self.number, new, self.width).by_length:
            for a in range(0, len(at), 4096):
                alpha = forward(self.p, ids[a : a + 4096])
                self.logs[base + at[a : a + 4096]] = np.log(np.maximum(alpha[:, -1], 1e-300))
        self.row.update(zip(new, range(base, base + len(new)), strict=True))

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Each text's log-probability in each language; None without letters."""
        if len(self.row) > KEPT:
            self.clear()
        split, long = [words(x) if x else [] for x in texts], {}
        for k, w in enumerate(split):
            if w and max(map(len, w)) > TOGETHER:
                long[k] = [x for x in w if len(x) > TOGETHER]
                split[k] = [x for x in w if len(x) <= TOGETHER]
        new = set()
        for w in split:
            new.update(w)
        if fresh := list(new.difference(self.row)):
            self.learn(fresh)
        get = self.row.__getitem__
        out = [self.logs[np.fromiter(map(get, w), np.int64, len(w))].sum(0) if w else None for w in split]
        for k, some in long.items():
            more = sum((n * forward_log(self.p, self.number, w, self.width) for w, n in Counter(some).items()), np.zeros(self.p.shape[1]))
            out[k] = more if out[k] is None else out[k] + more
        return out


def _count_words(pdfs):
    for pdf in pdfs:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            c = Counter(words(text or ""))
            if c:
                yield pd.DataFrame({"lang": [lang] * len(c), "word": list(c), "n": list(c.values())})


def held_out(rest: int, of: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == rest, F.lit(False))


def _fit_rows(pieces: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = fit(pdf["word"].tolist(), pdf["n"].to_numpy(), pieces)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "p": [p.tobytes()]})

    return run


def train(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray, list[str]]:
    """(languages, probabilities, pieces) from docs (doc_id, text, lang), of which the bounded sample is read. Each language is fitted in a task of its own."""
    ok = docs.where("doc_id is not null and lang is not null and text is not null")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "size")
    ids = ok.select("doc_id", "lang", F.length("text").cast("long").alias("size")).withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample_docs)
    chosen, held, least = [], defaultdict(int), {}
    for r in sorted(ids.collect(), key=lambda r: (r.lang, r.r)):  # at most sample_docs for each language
        least[r.lang] = min(least.get(r.lang, (math.inf,)), (r["size"], r.doc_id))
        if held[r.lang] + r["size"] <= sample_chars:
            held[r.lang] += r["size"]
            chosen.append((r.doc_id, r.lang, r["size"]))
    chosen += [(d, lang, n) for lang, (n, d) in least.items() if not held[lang]]
    pieces = vocabulary(path)
    keys = docs.sparkSession.createDataFrame(sorted(set(chosen)), "doc_id long, lang string, size long")
    some = ok.withColumn("size", F.length("text").cast("long")).join(F.broadcast(keys), ["doc_id", "lang", "size"], "left_semi")
    counts = some.select("lang", "text").mapInPandas(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = sorted((r.lang, bytes(r.p)) for r in counts.groupBy("lang").applyInPandas(_fit_rows(pieces), "lang string, p binary").collect())
    p = np.stack([np.frombuffer(x, np.float64) for _, x in rows], 1) if rows else np.zeros((0, 0))
    return [lang for lang, _ in rows], p, pieces


def identify(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, held_out, text)."""
    langs, p, pieces = model
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, langs, p, pieces))

    def run(pdfs):
        common.hold("language")
        key, names, probs, vocab = sent.value
        scorer = _scorer(key, vocab, probs) if names else None
        for pdf in pdfs:
            texts, pred, score = pdf["text"].tolist(), [], []
            for a in range(0, len(texts), 500):
                for x in scorer.texts(texts[a : a + 500]) if scorer else [None] * len(texts[a : a + 500]):
                    best = -1 if x is None else int(x.argmax())
                    pred.append("und" if x is None else names[best])
                    score.append(0.0 if x is None else float(1 / np.exp(x - x[best]).sum()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": pred, "score": score})

    return common.long_ids(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "held_out", "text").mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double"))


_made: dict = {}
common.forget["language"] = _made.clear


def _scorer(key, pieces, p) -> Scorer:
    """One for each worker process and model."""
    if key not in _made:
        _made.clear()
        _made[key] = Scorer(pieces, p)
    return _made[key]


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out(2, 4))
    return identify(docs, train(docs.where(~F.col("held_out")), public_tokenizers.path("piece_bpe_32k.model")))
