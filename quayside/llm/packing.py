"""Harmonic packing of token sequences.

A document's ids are cut into pieces of the capacity, then into halves of it, quarters and so on for what remains, and
a last piece shorter than the least of those. A piece of length l is of class k = capacity // l, that is
capacity/(k+1) < l <= capacity/k, and each bin of class k gets exactly k pieces. So the bins of halves, quarters, ...
are full, and those of a short last piece lack fewer ids than a piece has. Each worker fills its own bins; the pieces
in its last, not yet full bins are dealt out once more, longest first, so that a worker ends with little padding.

Nothing is shuffled: a document is tokenised, cut and placed in the task that reads it. Null text counts as empty (one
piece, the end id). Repeated rows are packed as often as they occur. No documents give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

SCHEMA = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_lengths(n: int, capacity: int, least: int) -> list[int]:
    """Lengths of the pieces of n ids: capacity, then descending halves of it down to least, then what is left."""
    out = [capacity] * (n // capacity)
    n %= capacity
    size = capacity // 2
    while size >= least:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


class Bins:
    """One worker's open bins, one for each class, and the sequences that it has closed."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next = capacity, base
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> list[tuple]:
        """piece: any tuple whose third field is its length. Returns the pieces of a bin that is complete, with sequence and offset."""
        k = self.capacity // piece[2]
        if k == 1:
            return self.close([piece])
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self.close(self.open.pop(k)) if len(held) == k else []

    def close(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for p in pieces:
            out.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def rest(self) -> list[tuple]:
        """What is in open bins, dealt out by first fit, longest first; there are fewer bins than classes."""
        bins: list[list[tuple]] = []
        free: list[int] = []
        for p in sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2]):
            i = next((i for i, f in enumerate(free) if f >= p[2]), None)
            if i is None:
                bins.append([])
                free.append(self.capacity)
                i = len(bins) - 1
            bins[i].append(p)
            free[i] -= p[2]
        self.open = {}
        return [q for b in bins for q in self.close(b)]


def _packer(path: str, end_id: int, capacity: int, least: int, kept: int):
    def run(batches):
        enc = tokens.encoder(path, kept)
        bins = Bins(capacity, TaskContext.get().partitionId() << 36)
        end = np.array([end_id], np.uint32)
        frame = lambda rows: pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        for pdf in batches:
            out: list[tuple] = []
            ids = pdf["doc_id"].tolist()
            texts = [x if isinstance(x, str) else "" for x in pdf["text"]]
            for part in tokens.runs(texts, min(tokens.RUN, 5 * kept)):
                for doc_id, got in zip(ids[part], enc.encode(texts[part]), strict=True):
                    got, start = np.concatenate((got, end)), 0
                    data = memoryview(got.astype("<u4")).cast("B")
                    for n in cut_lengths(len(got), capacity, least):
                        out += bins.add((doc_id, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), len(got)))
                        start += n
            if out:
                yield frame(out)
        if out := bins.rest():
            yield frame(out)

    return run


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048, least: int = 32, kept: int = tokens.KEPT) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. capacity: a power of two; kept: chunks whose ids a worker remembers."""
    src = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.long_ids(src.mapInPandas(_packer(path, end_id, capacity, least, kept), SCHEMA))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
