"""N-gram Jaccard join by prefix trees.

1. Every text becomes the set of its distinct word n-grams (hashes). Texts with equal sets form one class.
2. An inverted index, dealt out by ranges of the hash (as many as the n-grams need), finds the n-grams that more than one
   class holds. Mappers count first: an n-gram comes to the index once from each flush of up to FLUSH_GRAMS, however many
   classes hold it there, and which of them do waits with the flush, as do the ids of its rows: texts are read once. An
   n-gram held once can link nothing, so only the shared ones travel on, numbered. The global order of n-grams is ascending document frequency, then number; n-grams held
   once come first.
3. By the prefix bound a class can only link if one of its first n - ceil(t n) + 1 n-grams is shared. Classes whose
   prefix holds only n-grams of their own leave here. The others are compared with one class of each shared prefix n-gram,
   ROUNDS times with another one: what is nearly equal is mostly connected by that. An n-gram all of whose holders are
   connected has done its work; the others group the classes into blocks.
4. Each block is stored as a radix trie of its ordered sets. Each set walks the trie once, paths share their partial
   overlap, and a subtree is left when its sizes or the n-grams that remain cannot reach the threshold, or when all of it
   is already known to be connected with the probing set. A block of up to CHUNKS times BLOCK_GRAMS is joined by pairs of
   chunks; a larger one falls into one block for each n-gram that holds it together, and such a block, if too large
   itself, into stretches of sizes that may link.
5. The links (a spanning forest, never all pairs) give components.

Nulls and texts without words: empty sets, linked with nothing. Repeated rows fall in one class. A class is known by a hash
of 128 bits, an n-gram by one of 54. An empty table gives no rows; other columns play no part. Texts of any length
are read whole; one set must fit in a task.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Odd multipliers for the positions of a word in an n-gram.
STEPS = [np.uint64(2 * i * 0x9E3779B97F4A7C15 + 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF | 1) for i in range(1, 33)]
#: n-grams, classes and rows that a mapper gathers before it writes, distinct words whose hash it keeps.
FLUSH_GRAMS, FLUSH_DOCS, FLUSH_ROWS, WORDS = 2_000_000, 65_000, 260_000, 200_000
#: About how many bytes go to or from a worker at once, while texts become postings.
FRAME = 2 << 20
#: Bits of an n-gram's hash, the same at any size: what lies past a bucket's bits travels.
GRAM_BITS = 54
#: The place of no class in a flush.
NONE = 0xFFFF
#: n-grams for which there is a bucket of the index (about 70 bytes each in a task).
BUCKET_GRAMS = 500_000
#: Shared n-grams that one task joins, chunks of which a block is joined by pairs, comparisons with single classes.
BLOCK_GRAMS, CHUNKS, ROUNDS = 1_000_000, 8, 2


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()
common.forget["ngram_join"] = _words.clear


def gram_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words; one of the whole text if it has fewer words."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out += h[i : i + len(out)] * STEPS[i]
    return np.unique(common.mix64(out))


def _class_of(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _pack_counts(counts: np.ndarray) -> bytes:
    """A bit for each count that tells whether it is over one, then the counts over one."""
    more = counts > 1
    return np.packbits(more).tobytes() + counts[more].astype(np.uint16).tobytes()


def _unpack_counts(x: bytes, k: int, at: int) -> np.ndarray:
    more = np.unpackbits(np.frombuffer(x, np.uint8, (k + 7) // 8, at), count=k).view(bool)
    out = np.ones(k, np.int64)
    out[more] = np.frombuffer(x, np.uint16, int(more.sum()), at + (k + 7) // 8)
    return out


def _pack_planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest bytes first, compressed after their size."""
    data = zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)
    return np.uint32(len(data)).tobytes() + data


def _unpack_planes(x: bytes, k: int, at: int, kind: type) -> tuple[np.ndarray, int]:
    """k numbers, and where they end."""
    n, size = int(np.frombuffer(x, np.uint32, 1, at)[0]), np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(x[at + 4 : at + 4 + n], size * k), np.uint8).reshape(size, k)
    return np.ascontiguousarray(planes.T).view(kind).ravel(), at + 4 + n


def _pack_grams(g: np.ndarray) -> bytes:
    """The low 48 bits of ascending n-grams: the steps of the upper 32, and the lower 16."""
    return _pack_planes(np.diff((g >> np.uint64(16)).astype(np.uint32), prepend=np.uint32(0))) + (g & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def _unpack_grams(x: bytes, k: int, at: int) -> tuple[np.ndarray, int]:
    """k n-grams, and where they end."""
    steps, at = _unpack_planes(x, k, at, np.uint32)
    hi = np.cumsum(steps, dtype=np.uint32)
    return hi.astype(np.uint64) << np.uint64(16) | np.frombuffer(x, np.uint16, k, at), at + 2 * k


def _posted(rows: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "flush", "data"])


def _postings(n: int, bits: int):
    """Rows (bucket, flush, data): a flush's distinct n-grams of a hash range, each with the number of classes that hold it there; past the buckets, each flush's rows, classes, their sizes and which of them hold each n-gram."""

    def run(batches):
        common.hold("ngram_join")
        part, seq = TaskContext.get().partitionId(), 0
        sets: list[np.ndarray] = []
        classes: dict[bytes, int] = {}
        #: Of each row: id, whether it has none, key, and the place of its class (NONE without words).
        docs: list[tuple[int, int, int, int]] = []
        held = 0

        def flush():
            """Heads first, then the n-grams in small frames. What a step has read goes before the next one, as a flush is most of a worker's memory."""
            nonlocal sets, classes, docs, held, seq
            flush_id, k, size = (part << 24) | seq, len(sets), np.array([len(s) for s in sets], np.int64)
            ids, none, keys, of = np.array(docs, np.int64).T
            head = [ids.tobytes(), keys.tobytes(), none.astype(np.uint8).tobytes(), of.astype(np.uint16).tobytes(), *classes, size.tobytes()]
            g, rows = np.concatenate([np.empty(0, np.uint64), *sets]), len(docs)
            sets, classes, docs, held, seq = [], {}, [], 0, seq + 1
            g >>= np.uint64(64 - GRAM_BITS)
            order = np.argsort(g, kind="stable")
            doc = np.repeat(np.arange(k, dtype=np.uint16), size)[order].tobytes()
            g = g[order]
            del order, ids, none, keys, of
            total = len(g)
            first = np.flatnonzero(np.concatenate((np.ones(min(total, 1), bool), g[1:] != g[:-1])))
            # A flush has fewer than 65,536 classes.
            counts = np.empty(len(first), np.uint16)
            np.subtract(first[1:], first[:-1], out=counts[:-1], casting="unsafe")
            counts[-1:] = total - first[-1:]
            g = g[first]
            del first
            place = (g >> np.uint64(GRAM_BITS - bits)).astype(np.uint32)
            start = np.flatnonzero(np.concatenate((np.ones(min(len(g), 1), bool), place[1:] != place[:-1])))
            buckets, ends = place[start].astype(np.int64), np.append(start[1:], len(g))[: len(start)]
            del place
            g &= np.uint64((1 << (GRAM_BITS - bits)) - 1)
            head = b"".join([np.array([k, total, len(buckets), rows], np.int64).tobytes(), *head, buckets.tobytes(), ends.astype(np.int64).tobytes(), doc, _pack_counts(counts)])
            del doc
            yield _posted([((1 << bits) + flush_id, flush_id, head)])
            del head
            out, held_bytes = [], 0
            for b, a, z in zip(buckets.tolist(), start.tolist(), ends.tolist(), strict=True):
                out.append((b, flush_id, np.uint32(z - a).tobytes() + _pack_grams(g[a:z]) + _pack_counts(counts[a:z])))
                held_bytes += len(out[-1][2])
                if held_bytes >= FRAME:
                    yield _posted(out)
                    out, held_bytes = [], 0
            if out:
                yield _posted(out)

        for pdf in batches:
            for text, *row in zip(pdf["text"], pdf["id"].tolist(), pdf["none"].tolist(), pdf["key"].tolist(), strict=True):
                s = gram_set(text, n)
                at = NONE
                if len(s) and (at := classes.setdefault(_class_of(s), len(sets))) == len(sets):
                    sets.append(s)
                    held += len(s)
                docs.append((*row, at))
                if held >= FLUSH_GRAMS or len(sets) >= FLUSH_DOCS or len(docs) >= FLUSH_ROWS:
                    yield from flush()
                    common.trim()
        if docs:
            yield from flush()
        common.trim()

    return run


def _shared(bits: int):
    """For each flush, which of its n-grams in a bucket two or more classes hold anywhere, and how many: rows (flush, bucket, data). An n-gram comes once from a flush, however many hold it there, and goes back by its number among the bucket's shared ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        if bucket >= 1 << bits:
            return pd.DataFrame({"flush": pdf["flush"], "bucket": -1, "data": pdf["data"]})
        grams, counts = [], []
        for x in pdf["data"]:
            k = int(np.frombuffer(x, np.uint32, 1)[0])
            g, at = _unpack_grams(x, k, 4)
            grams.append(g)
            counts.append(_unpack_counts(x, k, at).astype(np.uint16))
        ends = np.cumsum([0, *map(len, grams)])
        g, c = np.concatenate(grams), np.concatenate(counts)
        order = np.argsort(g, kind="stable")
        sorted_g = g[order]
        starts = np.flatnonzero(np.concatenate(([True], sorted_g[1:] != sorted_g[:-1])))
        total = np.minimum(np.add.reduceat(c[order], starts, dtype=np.int64), 65535).astype(np.uint16)
        times = np.diff(np.append(starts, len(g)))
        df, number = np.empty(len(g), np.uint16), np.empty(len(g), np.uint32)
        df[order] = np.repeat(total, times)
        number[order] = np.repeat((np.cumsum(total > 1) - 1).astype(np.uint32), times)
        keep = df > 1
        out = []
        for flush, a, b in zip(pdf["flush"], ends[:-1], ends[1:], strict=True):
            k = keep[a:b]
            if k.any():
                out.append((flush, bucket, np.packbits(k).tobytes() + _pack_planes(np.diff(number[a:b][k], prepend=np.uint32(0))) + _pack_planes(df[a:b][k])))
        return pd.DataFrame(out, columns=["flush", "bucket", "data"])

    return run


def _active(bits: int, num: int, den: int):
    """The classes of a flush that can link: (cls, n, grams: shared n-grams in the global order, prefix: how many of them are in the prefix). And its rows, whose prefix is 0: (id, none, key, cls, n)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.loc[pdf["bucket"] < 0, "data"].iloc[0]
        k, held, m, rows = np.frombuffer(head, np.int64, 4).tolist()
        ids, keys, none = np.frombuffer(head, np.int64, rows, 32), np.frombuffer(head, np.int64, rows, 32 + 8 * rows), np.frombuffer(head, np.uint8, rows, 32 + 16 * rows)
        of, at = np.frombuffer(head, np.uint16, rows, 32 + 17 * rows).astype(np.int64), 32 + 19 * rows
        cls, at = [head[at + 16 * i : at + 16 + 16 * i] for i in range(k)], at + 16 * k
        size, at = np.frombuffer(head, np.int64, k, at), at + 8 * k
        buckets, ends, at = np.frombuffer(head, np.int64, m, at), np.frombuffer(head, np.int64, m, at + 8 * m), at + 16 * m
        d = np.frombuffer(head, np.uint16, held, at)
        total = int(ends[-1]) if m else 0
        holders = _unpack_counts(head, total, at + 2 * held)
        kept, gram, df = np.zeros(total, bool), np.zeros(total, np.uint64), np.zeros(total, np.uint16)
        for bucket, x in zip(pdf["bucket"].tolist(), pdf["data"], strict=True):
            if bucket >= 0:
                i = int(np.searchsorted(buckets, bucket))
                a, b = int(ends[i - 1]) if i else 0, int(ends[i])
                w = (b - a + 7) // 8
                at = a + np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8, w), count=b - a))
                kept[at] = True
                steps, end = _unpack_planes(x, len(at), w, np.uint32)
                gram[at] = np.cumsum(steps, dtype=np.uint64) << np.uint64(bits) | np.uint64(bucket)
                df[at], _ = _unpack_planes(x, len(at), end, np.uint16)
        d, g, f = d[np.repeat(kept, holders)], np.repeat(gram[kept], holders[kept]), np.repeat(df[kept], holders[kept])
        count = np.bincount(d, minlength=k)
        prefix = size - (num * size + den - 1) // den + 1 - (size - count)
        keep = (prefix > 0) & (count > 0)
        sel = keep[d]
        g, d, f = g[sel], d[sel], f[sel]
        order = np.lexsort((g, f, d))
        g, d = g[order], d[order]
        ends = np.searchsorted(d, np.arange(k + 1))
        at = np.flatnonzero(keep)
        pad, names, sizes = np.zeros(len(at), np.int64), [*cls, *[None] * (NONE + 1 - k)], np.append(size, 0)
        out = pd.DataFrame(
            {
                "id": np.append(ids, pad),
                "none": np.append(none.astype(np.int64), pad),
                "key": np.append(keys, pad),
                "cls": [*(names[i] for i in of), *(cls[i] for i in at)],
                "n": np.append(sizes[np.minimum(of, k)], size[at]),
                "prefix": np.append(np.zeros(rows, np.int64), prefix[at]),
                "grams": pd.Series([*[None] * rows, *(g[ends[i] : ends[i + 1]].astype(np.int64) for i in at)], dtype="object"),
            }
        )
        del kept, gram, df, f, order, sel
        common.trim()
        return out

    return run


class _Node:
    __slots__ = ("lo", "hi", "start", "end", "kids", "pure", "least", "most", "longest")


def _trie(sets: list[list[int]], sizes: list[int]) -> _Node:
    """The radix trie of lexicographically sorted sets; a node spans the depths start to end of the sets lo to hi."""

    def node(lo: int, hi: int, start: int) -> _Node:
        x = _Node()
        x.lo, x.hi, x.start, x.kids, x.pure = lo, hi, start, (), hi - lo == 1
        x.least, x.most, x.longest = min(sizes[lo:hi]), max(sizes[lo:hi]), max(map(len, sets[lo:hi]))
        a, b = sets[lo], sets[hi - 1]  # in sorted order these two share what all share
        end, top = start, min(len(a), len(b))
        while end < top and a[end] == b[end]:
            end += 1
        x.end = len(a) if hi - lo == 1 else end
        return x

    root = node(0, len(sets), 0)
    todo = [root]
    while todo:
        x = todo.pop()
        if x.hi - x.lo == 1:
            continue
        kids, i = [], x.lo
        while i < x.hi:
            j = i + 1
            if len(sets[i]) > x.end:
                t = sets[i][x.end]
                while j < x.hi and sets[j][x.end] == t:
                    j += 1
            kids.append(node(i, j, x.end))
            i = j
        x.kids = tuple(kids)
        todo += kids
    return root


def link_block(cls: list, sizes: list[int], grams: list[np.ndarray], num: int, den: int, known: list | None = None) -> list[tuple]:
    """(class, smallest class connected with it) for the classes of one block that are connected with another; 100 * i >= 90 * u has num 90, den 100. known: for each class a label that is the same for classes known to be connected."""
    flat = np.concatenate(grams)
    u, inv, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(u), np.int64)
    rank[np.lexsort((u, -count))] = np.arange(len(u))  # the block's order: most shared first, so that near copies share paths
    ranks, a = rank[inv], 0
    sets = []
    for g in grams:
        sets.append(np.sort(ranks[a : a + len(g)]).tolist())
        a += len(g)
    order = sorted(range(len(sets)), key=sets.__getitem__)
    sets, sizes, cls = [sets[i] for i in order], [sizes[i] for i in order], [cls[i] for i in order]
    parent = list(range(len(sets)))
    if known:
        first: dict = {}
        parent = [first.setdefault(known[i], k) for k, i in enumerate(order)]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    root = _trie(sets, sizes)
    for i, x in enumerate(sets):
        xs, nx = frozenset(x), sizes[i]
        todo: list[tuple[_Node, int, bool]] = [(root, 0, False)]
        while todo:
            node, overlap, leaving = todo.pop()
            if leaving:
                node.pure = all(k.pure for k in node.kids) and len({find(k.lo) for k in node.kids}) == 1
                continue
            if node.pure and find(node.lo) == find(i):
                continue
            if den * node.most < num * nx or num * node.least > den * nx:
                continue
            path = sets[node.lo][node.start : node.end]
            overlap += len(xs.intersection(path))
            rest = min(len(x) - bisect_right(x, path[-1]) if path else len(x), node.longest - node.end)
            if (overlap + rest) * (num + den) < num * (nx + node.least):
                continue
            if node.kids:
                todo.append((node, overlap, True))
                todo += [(k, overlap, False) for k in node.kids]
            elif node.lo != i and overlap * (num + den) >= num * (nx + sizes[node.lo]):
                a, b = find(i), find(node.lo)
                parent[max(a, b)] = min(a, b)
    least: dict = {}
    members: dict[int, int] = {}
    for i in range(len(sets)):
        r = find(i)
        least[r] = min(least.get(r, cls[i]), cls[i])
        members[r] = members.get(r, 0) + 1
    return [(cls[i], least[find(i)]) for i in range(len(sets)) if members[find(i)] > 1]


def _join(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["unit", "i", "j"], sort=False):
            out += link_block(g["cls"].tolist(), g["n"].tolist(), [np.asarray(x, np.int64) for x in g["grams"]], num, den, g["label"].tolist())
        common.trim()
        return pd.DataFrame(out, columns=["u", "v"])

    return run


def _bits(n: int, parts: int) -> int:
    """How many bits of the hash deal out an index of n n-grams."""
    return min(26, max(6, (parts - 1).bit_length(), (max(1, n // BUCKET_GRAMS) - 1).bit_length()))


def _index(src: DataFrame, n: int, num: int, den: int, bits: int) -> DataFrame:
    """What _active makes of src (text; id, none and key if they matter), a class once for each flush that holds it."""
    src = src.select("text", *(c if c in src.columns else F.lit(0).cast("long").alias(c) for c in ("id", "none", "key")))
    posts = src.mapInPandas(_postings(n, bits), "bucket long, flush long, data binary")
    shared = posts.groupBy("bucket").applyInPandas(_shared(bits), "flush long, bucket long, data binary")
    with common.setting(src.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(FRAME)):
        return common.cut(shared.groupBy("flush").applyInPandas(_active(bits, num, den), "id long, none long, key long, cls binary, n long, prefix long, grams array<long>"))


def _classes(index: DataFrame) -> DataFrame:
    """cls, n, prefix, grams: the classes that can link, once each."""
    # A class has the same row from each flush that holds it.
    return common.cut(index.where("prefix > 0").groupBy("cls").agg(F.any_value(F.struct("n", "prefix", "grams")).alias("x")).select("cls", "x.*"))


def _active_rows(src: DataFrame, n: int, num: int, den: int, bits: int) -> DataFrame:
    return _classes(_index(src, n, num, den, bits))


def _round(held: DataFrame, rows: DataFrame, num: int, den: int, last: bool) -> DataFrame:
    """Links (u, v) of the holders (cls, n, gram, label) of each n-gram with one of them: the first of the first label, or of the last one."""
    one, of, by = F.struct("cls", "n"), "hi" if last else "lo", F.struct("label", "cls")
    hub = held.groupBy("gram").agg((F.max_by(one, by) if last else F.min_by(one, by)).alias("v"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    pairs = common.join_hot(held, hub.select("gram", "v", of), "gram").where(f"label <> {of} and {den} * least(n, v.n) >= {num} * greatest(n, v.n)")
    pairs = common.cut(pairs.select(F.col("cls").alias("u"), F.col("n").alias("n_u"), F.col("v.cls").alias("v"), F.col("v.n").alias("n_v")).distinct())
    grams = lambda c: rows.select(F.col("cls").alias(c), F.col("grams").alias(f"grams_{c}"))
    # Many pairs may have one v, but few one u.
    both = common.join_hot(pairs, grams("v"), "v").join(grams("u"), "u")
    return both.where((num + den) * F.size(F.array_intersect("grams_u", "grams_v")) >= num * (F.col("n_u") + F.col("n_v"))).select("u", "v")


def _mixed(pre: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of pre, labelled, of the n-grams whose holders aren't all connected yet."""
    held = pre.drop("label").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    held = common.cut(held)
    mixed = held.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("gram")
    return common.cut(common.join_hot(held, mixed, "gram", "left_semi"))


def _blocks(mixed: DataFrame) -> DataFrame:
    """cls, n, block: what holders of the same n-grams are connected by, one n-gram after the other."""
    first = mixed.groupBy("gram").agg(F.min("cls").alias("v"))
    near = common.join_hot(mixed, first, "gram").where("cls <> v").select(F.col("cls").alias("u"), "v").distinct()
    return common.components(near).withColumnsRenamed({"node": "cls", "label": "block"})


def _links(rows: DataFrame, num: int, den: int, block_grams: int) -> DataFrame:
    """node, label: components of the classes in rows (of _active_rows)."""
    mixed = common.cut(rows.select("cls", "n", F.explode(F.slice("grams", F.lit(1), F.col("prefix").cast("int"))).alias("gram"), F.col("cls").alias("label")))
    unit = lambda kind, *cols: F.xxhash64(F.lit(kind), *cols).alias("unit")
    links = None
    for k in range(ROUNDS):
        found = _round(mixed, rows, num, den, k % 2 == 1)
        links = common.cut(found if links is None else links.unionByName(found))
        labels = common.components(links)
        mixed = _mixed(mixed, labels)
        if not mixed.limit(1).count():
            return labels
        held = common.cut(_blocks(mixed).join(rows.select("cls", "n", F.size("grams").alias("k")), "cls"))
        total = held.groupBy("block").agg(F.sum("k").alias("all"))
        large = common.cut(total.where(F.col("all") > CHUNKS * block_grams).select("block"))
        # Another round only pays for blocks that would be cut up.
        if not (cut_up := large.limit(1).count()):
            break
    # unit, cls, n, k: which classes are joined with each other.
    if cut_up:
        units = common.join_hot(held, total.where(F.col("all") <= CHUNKS * block_grams).select("block"), "block", "left_semi").select(unit("block", "block"), "cls", "n", "k")
        own = common.join_hot(held, large, "block", "left_semi").select("cls", "k")
        own = common.cut(mixed.select("cls", "n", "gram").join(own, "cls"))
        sums = own.groupBy("gram").agg(F.sum("k").alias("all"))
        fits, over = (common.join_hot(own, sums.where(c).select("gram"), "gram", "left_semi") for c in (F.col("all") <= block_grams, F.col("all") > block_grams))
        # Sizes that may link lie in one stretch or in neighbours: each stretch is joined with the one above it.
        stretch = F.floor(F.log("n") / F.lit(math.log(den / num) + 1e-9) if num < den else F.col("n")).cast("long")
        over = over.withColumn("s", F.explode(F.array(stretch, stretch - 1)))
        units = units.unionByName(fits.select(unit("gram", "gram"), "cls", "n", "k")).unionByName(over.select(unit("sizes", "gram", "s"), "cls", "n", "k"))
        units = common.cut(units)
    else:
        units = held.select(unit("block", "block"), "cls", "n", "k")
    sums = units.groupBy("unit").agg(F.sum("k").alias("all"), F.count("*").alias("m"))
    sums = sums.where("m > 1").select("unit", F.ceil(F.col("all") / block_grams).cast("int").alias("chunks"))
    rest = common.join_hot(units, sums, "unit").withColumn("c", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    # Pairs of chunks cover what lies inside of a chunk too; a small unit is the pair (0, 0).
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("chunks") - 1), F.col("c")))
    rest = rest.withColumn("o", F.explode(others)).select("unit", "cls", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "chunks", "k")
    rest = common.cut(rest)
    weight = rest.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    bins = max(common.partitions(rows.sparkSession), 16, 2 * weight // block_grams)
    rest = rest.withColumn("bin", F.when(F.col("chunks") == 1, F.pmod("unit", F.lit(bins))).otherwise(F.lit(bins) + F.pmod(F.xxhash64("unit", "i", "j"), F.lit(1 << 40)))).drop("chunks", "k")
    whole = rows.select("cls", "n", "grams").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    more = rest.join(whole, "cls").groupBy("bin").applyInPandas(_join(num, den), "u binary, v binary")
    return common.components(links.unionByName(more))


def _linked(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", block_grams: int = BLOCK_GRAMS, keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """For each row doc_id, n_shingles and cls (null without words); if keyed, key too, the text's hash. And the components (node, label) of the classes that link."""
    # pandas would make floats of nullable numbers.
    own = F.col(id_col).cast("long")
    src = docs.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNull().cast("long").alias("none"), (F.xxhash64(text_col) if keyed else F.lit(0).cast("long")).alias("key"), F.col(text_col).cast("binary").alias("text"))
    # About six bytes make a word; in texts of shorter words, buckets hold up to three times the n-grams.
    grams = src.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0] // 6
    index = _index(src, n, num, den, _bits(grams, common.partitions(docs.sparkSession)))
    sets = common.cut(index.where("prefix = 0").select(F.when(F.col("none") == 0, F.col("id")).alias("doc_id"), *(["key"] if keyed else []), F.col("n").alias("n_shingles"), "cls"))
    rows = _classes(index)
    common.release(index)
    return sets, _links(rows, num, den, block_grams)


def _least(sets: DataFrame, labels: DataFrame, row: Column) -> DataFrame:
    """cls, least: the least row value of each class's component. Rows of one class, and classes of one component, are reduced before they are dealt out."""
    own = common.cut(sets.where("cls is not null").groupBy("cls").agg(F.min(row).alias("own")))
    own = own.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    least = own.where("label is not null").groupBy("label").agg(F.min("own").alias("least"))
    return common.join_hot(own, least, "label", "left").select("cls", F.coalesce("least", "own").alias("least"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links of Jaccard similarity num/den or more)."""
    sets, labels = _linked(docs, n, num, den, id_col, text_col, block_grams)
    named = common.join_hot(sets, _least(sets, labels, F.col("doc_id")), "cls", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group: of the smallest doc_id (rows with none come last), then the least hash of the text, then the least row. Rows without words all stay."""
    sets, labels = _linked(docs, n, num, den, keyed=True)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    pairs = common.cut(sets.where("cls is not null").groupBy("cls", "doc_id", "key").agg(F.count("*").alias("rows")))
    pairs = common.join_hot(pairs, _least(sets, labels, row), "cls")
    # Rows that go, and those of which one stays; the rest isn't listed.
    marks = common.cut(pairs.select(F.col("doc_id").alias("mark_id"), F.col("key").alias("mark_key"), row.eqNullSafe(F.col("least")).alias("mark_first"), "rows").where("not mark_first or rows > 1").drop("rows"))
    # Marks grow with the data, so they are dealt out at every size, never sent to every task.
    marks = marks.hint("merge")
    key = F.xxhash64(docs["text"])
    same = (key == F.col("mark_key")) & docs["doc_id"].cast("long").eqNullSafe(F.col("mark_id"))
    kept = docs.join(marks, same, "left_anti")
    again = marks.where("mark_first")
    if again.limit(1).count():
        some = docs.join(again, same, "left_semi")
        kept = kept.unionByName(some.groupBy(F.xxhash64("text"), "doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))
    return kept.select(*docs.columns)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"), n=3, num=90, den=100)


OP6_SQL = r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda w: w <> '') as w from documents
), g as (
  select distinct doc_id, s from (
    select doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') as s from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) as i from d where len(w) > 0))
), n as (select doc_id, count(*) as n from g group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as i from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * i >= 90 * (p.n + q.n - i)),
reach(a, z) as (select doc_id, doc_id from d union select reach.a, links.y from reach join links on reach.z = links.x)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, r.c as component_id
from d left join n on d.doc_id = n.doc_id join (select a, min(z) as c from reach group by a) r on r.a = d.doc_id
"""
