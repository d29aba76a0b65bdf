"""Benchmark decontamination by suffix arrays over the training texts.

Benchmark words are numbered; a word that no benchmark item has becomes 0, and a suffix that starts in a run of numbered
words shorter than every window cannot match, so a shard's suffix array holds the other suffixes only, sorted by their
first `window` words. Each test suffix is looked up in it by binary search, which gives its places in the shard. Within
what is hit, the suffixes of both sides are sorted in full (by doubling), and the benchmark suffixes next to a training
suffix give its longest verbatim match. A shard is what a task reads of the training texts at a time, one text at least:
its suffix array is made, searched and dropped there, so nothing is shuffled. Time is n log n in a shard's words and hits,
however often a window repeats.

The benchmark is read and sent in blocks of at most BLOCK_WORDS words (an item longer than that is a block of its own);
one block at a time is on the driver and in a worker, which indexes it once. With more than one, the texts are searched
once for each block, and what was found is joined by row.

Null or wordless texts have no words and no hits; items without words have no window. Repeated item rows count once;
repeated rows of texts are each found. An empty table gives no rows; without items nothing is hit. Other columns play no
part; remove() returns them as they are. Texts and items of any length are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK_WORDS = 1_000_000
#: Training words in a shard, and bytes of a text that are split into words at a time.
SHARD_WORDS, CHUNK = 1_000_000, 1 << 20
#: 0-9, a-z (A-Z lower-cased) and all that isn't ASCII belong to words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    data, at = text.translate(TABLE) if text else b"", 0
    while len(data) - at > CHUNK:
        end = data.find(b" ", at + CHUNK)
        if end < 0:
            break
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def words(text: bytes | None) -> list[bytes]:
    return [w for some in word_lists(text) for w in some]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start, as many as its count."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _keys(x: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The depth numbers behind each start as bytes that sort as they do."""
    return np.ascontiguousarray(x[starts[:, None] + np.arange(depth)].astype(">u4")).view(f"S{4 * depth}").ravel()


class Benchmark:
    """Numbered words of items, and their distinct windows in order, with places and items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.number, self.names = window, {}, []
        texts: list[np.ndarray] = []
        for name, text in items:
            x = np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in words(text)), np.int32)
            if len(x):
                self.names.append(name)
                texts.append(x)
        sizes = np.array([len(x) for x in texts], np.int64)
        #: All words, each item's with `window` zeros behind them; where each item begins.
        self.words = np.concatenate([y for x in texts for y in (x, np.zeros(window, np.int32))]) if texts else np.zeros(window, np.int32)
        self.begin = np.cumsum(np.concatenate(([0], sizes[:-1] + window))) if texts else np.empty(0, np.int64)
        deep = np.minimum(sizes, window)
        counts = sizes - deep + 1
        places = _ranges(self.begin, counts) if texts else np.empty(0, np.int64)
        owner, deep = np.repeat(np.arange(len(texts)), counts), np.repeat(deep, counts)
        keys = _keys(self.words, places, window) if len(places) else np.empty(0, f"S{4 * window}")
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) if len(keys) else np.empty(0, np.int64)
        self.keys, self.deep = keys[order][first], deep[order][first]
        #: Of each window its places: places[at[i] : at[i + 1]].
        self.places, self.at = places[order], np.append(first, len(keys))
        # A window's last possible key: what follows a window shorter than the others doesn't matter.
        top = np.frombuffer(self.keys.tobytes(), np.uint8).reshape(len(first), 4 * window).copy()
        top[np.arange(4 * window)[None] >= 4 * self.deep[:, None]] = 255
        self.last = top.view(f"S{4 * window}").ravel()
        # Windows of the same items share a set of names.
        sets: dict[bytes, int] = {}
        owners = np.split(owner[order], first[1:]) if len(first) else []
        self.set_of = np.array([sets.setdefault(np.unique(x).tobytes(), len(sets)) for x in owners], np.int64)
        self.sets = [[self.names[i] for i in np.frombuffer(x, np.int64)] for x in sets]
        self.least = int(deep.min()) if len(deep) else 0

    def numbers(self, text: bytes | None) -> np.ndarray:
        return np.concatenate([np.fromiter(map(self.number.get, some, repeat(0)), np.int32, len(some)) for some in word_lists(text)])


def _joint(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray], int]:
    """The kept numbers of some (numbers, mask) as one array with a number of its own behind each run; for each part the new place of each number (-1: none), and the longest run."""
    out, places, longest, at, ends = [], [], 0, 0, 0
    for x, mask in parts:
        step = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        kept = np.flatnonzero(mask)
        new = at + np.arange(len(kept)) + np.repeat(np.arange(len(begin)), end - begin)
        z = -1 - np.arange(ends, ends + len(kept) + len(begin))
        z[new - at] = x[kept]
        place = np.full(len(x), -1)
        place[kept] = new
        out.append(z)
        places.append(place)
        longest = max(longest, int((end - begin).max(initial=0)))
        at += len(z)
        ends += len(z)
    return np.concatenate(out), places, longest


def _levels(z: np.ndarray, longest: int) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, ... numbers from each place, until all differ or are long enough."""
    out, step = [np.unique(z, return_inverse=True)[1].astype(np.int64)], 1
    while step < longest and out[-1].max(initial=0) + 1 < len(z):
        r = out[-1]
        then = np.zeros(len(r), np.int64)
        then[: len(r) - step] = r[step:] + 1
        out.append(np.unique(r * (len(r) + 1) + then, return_inverse=True)[1].astype(np.int64))
        step *= 2
    return out


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many numbers the suffixes at a and b share."""
    n = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        while True:  # more than once only at the top level
            same = levels[k][a + n] == levels[k][b + n]
            n[same] += 1 << k
            if k < len(levels) - 1 or not same.any():
                break
    return n


def longest_matches(bench: Benchmark, x: np.ndarray, hit: np.ndarray, at: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, length, place in the benchmark) of the longest match from each place, of matches (at: place in x, window); hit: which of x is in a match."""
    short = bench.deep[window] < bench.window
    parts = [(at[short], bench.deep[window[short]], bench.places[bench.at[window[short]]])]
    full = np.unique(window[~short])
    if len(full):
        places = bench.places[_ranges(bench.at[full], bench.at[full + 1] - bench.at[full])]
        cover = np.bincount(places, minlength=len(bench.words) + 1) - np.bincount(places + bench.window, minlength=len(bench.words) + 1)
        z, (here, there), longest = _joint([(x, hit), (bench.words, np.cumsum(cover[: len(bench.words)]) > 0)])
        levels = _levels(z, longest)
        order = np.argsort(levels[-1], kind="stable")
        rank = np.empty(len(z), np.int64)
        rank[order] = np.arange(len(z))
        test = np.zeros(len(z), bool)
        test[there[places]] = True
        test = test[order]
        before = np.maximum.accumulate(np.where(test, np.arange(len(z)), -1))
        behind = np.minimum.accumulate(np.where(test, np.arange(len(z)), len(z))[::-1])[::-1]
        back = np.full(len(z), -1)
        back[there[places]] = places
        p = np.unique(at[~short])
        own = here[p]
        some = []
        for near in (behind[rank[own]], before[rank[own]]):
            ok = np.flatnonzero((near >= 0) & (near < len(z)))
            other = order[near[ok]]
            n, i = np.zeros(len(own), np.int64), np.full(len(own), -1)
            n[ok], i[ok] = _common(levels, own[ok], other), back[other]
            some.append((n, i))
        (n, i), (m, j) = some
        parts.append((p, np.maximum(n, m), np.where(n >= m, i, j)))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def search_shard(bench: Benchmark, docs: list[np.ndarray], runs: bool = False) -> list[tuple]:
    """For each document (as numbers): how many words are hit, the names of the items found, its longest match as (words, place in the document, name, place in the item) or None; and the runs of hit words, if asked for."""
    bounds = np.cumsum([0, *(len(d) + 1 for d in docs)])  # a zero ends each document
    x = np.zeros(bounds[-1] + bench.window, np.int32)
    for a, d in zip(bounds, docs, strict=False):
        x[a : a + len(d)] = d
    step = np.diff(np.concatenate(([0], (x > 0).astype(np.int8), [0])))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - begin >= max(1, bench.least)
    begin, end = begin[long], end[long]
    none = [(0, [], None, []) for _ in docs]
    if not len(begin) or not len(bench.keys):
        return none
    starts = _ranges(begin, end - begin - bench.least + 1)
    keys = _keys(x, starts, bench.window)
    order = np.argsort(keys, kind="stable")
    suffixes, keys = starts[order], keys[order]  # the suffix array
    lo, hi = np.searchsorted(keys, bench.keys, "left"), np.searchsorted(keys, bench.last, "right")
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return none
    count = (hi - lo)[found]
    at, window = suffixes[_ranges(lo[found], count)], np.repeat(found, count)
    cover = np.bincount(at, minlength=len(x) + 1) - np.bincount(at + bench.deep[window], minlength=len(x) + 1)
    hit = np.cumsum(cover[: len(x)]) > 0
    sums = np.concatenate(([0], np.cumsum(hit)))
    owner = np.searchsorted(bounds, at, "right") - 1
    out: list[list] = [[int(sums[b] - sums[a]), set(), None, []] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for pair in np.unique(owner * len(bench.sets) + bench.set_of[window]).tolist():
        out[pair // len(bench.sets)][1].update(bench.sets[pair % len(bench.sets)])
    place, length, test = longest_matches(bench, x, hit, at, window)
    owner = np.searchsorted(bounds, place, "right") - 1
    best = np.lexsort((test, place, -length, owner))
    for k in best[np.flatnonzero(np.diff(owner[best], prepend=-1))].tolist():
        item = int(np.searchsorted(bench.begin, test[k], "right")) - 1
        out[owner[k]][2] = (int(length[k]), int(place[k] - bounds[owner[k]]), bench.names[item], int(test[k] - bench.begin[item]))
    if runs:
        step = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            d = int(np.searchsorted(bounds, a, "right")) - 1
            out[d][3].append({"start": int(a - bounds[d]), "end": int(b - bounds[d])})
    return [(n, sorted(names), longest, r) for n, names, longest, r in out]


_made: dict = {}
common.forget["decontaminate"] = _made.clear


def _benchmark(sent, window: int) -> Benchmark:
    """The index of a sent (key, items), made once in a worker; the one before it goes."""
    common.hold("decontaminate")
    key, items = sent.value
    if (key, window) not in _made:
        _made.clear()
        _made[key, window] = Benchmark(items, window)
    return _made[key, window]


def _searched(bench: Benchmark, texts: list, runs: bool = False) -> Iterator[tuple]:
    """(number of words, *what search_shard gives) for each text."""
    i = 0
    while i < len(texts):
        docs, held = [], 0
        while i < len(texts) and held < SHARD_WORDS:
            docs.append(bench.numbers(texts[i]))
            held += len(docs[-1])
            i += 1
        for d, x in zip(docs, search_shard(bench, docs, runs), strict=True):
            yield (len(d), *x)


COLUMNS = ["n_words", "n_hit", "items", "longest_match", "doc_word", "item_id", "item_word"]
SCHEMA = "n_words long, n_hit long, items array<string>, longest_match long, doc_word long, item_id string, item_word long"
_RUNS = "runs array<struct<start:long,end:long>>"


def _searcher(sent, window: int, keyed: bool = False):
    """Rows of doc_id (and key) with SCHEMA (and the runs of hit words, if keyed)."""

    def run(pdfs):
        bench = _benchmark(sent, window)
        for pdf in pdfs:
            rows = []
            for n, n_hit, names, best, runs in _searched(bench, pdf["text"].tolist(), keyed):
                m, place, name, item_place = best or (0, None, None, None)
                rows.append((n, n_hit, names, m, place, name, item_place, runs))
            out = pd.DataFrame(rows, columns=[*COLUMNS, "runs"]).astype({"doc_word": "Int64", "item_word": "Int64"})
            out.insert(0, "doc_id", pdf["doc_id"])
            if keyed:
                out.insert(1, "key", pdf["key"])
            yield out if keyed else out.drop(columns="runs")

    return run


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, bytes]]]:
    """The distinct items with words, as (item_id as text, text), in blocks of at most block_words words or of one item. An item with no id has the id ''."""
    src = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null").distinct()
    block, held = [], 0
    for r in src.orderBy("item_id", "text").toLocalIterator():
        n = sum(map(len, word_lists(bytes(r.text))))
        if block and held + n > block_words:
            yield block
            block, held = [], 0
        if n:
            block.append((r.item_id, bytes(r.text)))
            held += n
    yield block


def _sent(spark: SparkSession, block: list):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, block))


def _rows(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), *more, F.col("text").cast("binary").alias("text"))


def _by_blocks(docs: DataFrame, blocks: Iterator[list], window: int) -> DataFrame:
    """search() for more than one block: doc_id, key (the text's hash) and the columns of search; a row for each distinct pair."""
    spark = docs.sparkSession
    src, parts = _rows(docs, F.xxhash64("text").alias("key")), []
    for i, block in enumerate(blocks):
        sent = _sent(spark, block)
        part = common.long_ids(src.mapInPandas(_searcher(sent, window, True), f"doc_id string, key long, {SCHEMA}, {_RUNS}"))
        # The first block tells every row's number of words; of the others only hits are kept.
        parts.append(common.cut(part if not i else part.where("n_hit > 0")))
        sent.unpersist()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = F.struct((-F.col("longest_match")).alias("less"), "doc_word", "item_id", "item_word")
    one = every.distinct().groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min(F.when(F.col("longest_match") > 0, best)).alias("best"), F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, r: F.struct(F.greatest(acc["end"], r["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(acc["end"], r["start"]))).alias("n"))
    return one.select("doc_id", "key", "n_words", F.aggregate("runs", start, step)["n"].alias("n_hit"), "items", F.coalesce(-F.col("best.less"), F.lit(0)).alias("longest_match"), "best.doc_word", "best.item_id", "best.item_word")


def _two(benchmark: DataFrame, block_words: int) -> tuple[list, Iterator[list] | None]:
    """The first block, and all blocks if there are more."""
    blocks = blocks_of(benchmark, block_words)
    first = next(blocks)
    second = next(blocks, None)
    return first, None if second is None else chain([first, second], blocks)


def search(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of the items with a window in the text, sorted), and the longest match with its places in the text and the item."""
    first, blocks = _two(benchmark, block_words)
    if blocks is None:
        return common.long_ids(_rows(docs).mapInPandas(_searcher(_sent(docs.sparkSession, first), window), f"doc_id string, {SCHEMA}"))
    found = _by_blocks(docs, blocks, window).withColumnsRenamed({"doc_id": "found_id", "key": "found_key"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text")).alias("key"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key"))).select("doc_id", *COLUMNS)


def is_contaminated():
    """At least one word hit, and a twentieth of the words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without contaminated rows, each judged by its own text. With one block nothing is shuffled; the other columns stay in the JVM."""
    first, blocks = _two(benchmark, block_words)
    if blocks is not None:
        bad = _by_blocks(docs, blocks, window).where(is_contaminated()).select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key"))
        same = docs["doc_id"].cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(docs["text"]) == F.col("bad_key"))
        return docs.join(bad, same, "left_anti")
    sent = _sent(docs.sparkSession, first)

    @F.pandas_udf("boolean")
    def bad(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in texts:
            yield pd.Series([n_hit > 0 and 20 * n_hit >= n for n, n_hit, *_ in _searched(_benchmark(sent, window), x.tolist())], dtype=bool)

    return docs.where(~bad(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, is_contaminated().alias("contaminated"))


OP8_SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents
), b as (
  select cast(item_id as varchar) as item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from benchmark
), win as (
  select distinct item_id, least(13, len(w)) as k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)
), sizes as (select distinct k from win),
spots as (
  select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes where len(w) >= k)
), hit as (select distinct doc_id, i, spots.k, item_id from spots join win on spots.s = win.s and spots.k = win.k),
n_hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as s from hit group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join n_hit on d.doc_id = n_hit.doc_id left join items on d.doc_id = items.doc_id
"""
