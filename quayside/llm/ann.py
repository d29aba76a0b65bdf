"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product.

Vectors are divided by the largest norm M and get one more component, sqrt(1 - |x|^2); queries get norm 1 and a 0. Then a
larger inner product is a smaller Euclidean distance, for which Gaussian projections floor((a x + b) / w) are the
p-stable hash. A table joins `hashes` of them to one bucket. A query visits its own bucket and perturbed ones (each
hash moved by -1, 0 or 1) in order of estimated success: the least sum of squared distances to the boundaries crossed.
Candidates of all visited buckets are merged and ranked again by the exact inner product of the original vectors.

How many tables, hashes and probes, and how wide, is fitted (`fit`): the exact neighbours of a bounded sample of queries
tell the share that each setting finds, a bounded sample of vectors how much it visits; of the settings that find RECALL
of the neighbours the cheapest is taken. Where none does (perturbed buckets are too near), everything is one bucket.

Equal vectors are one class, which keeps the k + 1 smallest of its ids: more can't be in an answer, as ties go to the
smaller id. So a vector that is copied a million times is hashed, visited and scored once. Buckets are dealt out to shards
of about GROUP_ROWS classes; a larger shard is split and asked in each part, and so are the queries of a shard beyond
QUERY_GROUP; no candidate is capped.

Vectors that are null, zero, or hold a null, NaN or infinity take no part, nor do vectors of another length than the
most frequent one (ties: the longer), nor rows without vec_id. Repeated rows with the same id and vector count once; with
the same id on different vectors, each of them is a row of its own. Fewer than k candidates give fewer rows; a query
whose buckets hold fewer than there are is compared with all, in blocks. Empty tables give no rows; other columns of the
tables play no part, whatever their names.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: What fit() may choose.
TABLES, HASHES, WIDTHS = (2, 3, 4), (2, 4, 6, 8), (1.5, 2.0, 3.0, 4.0)
#: The sample that fit() reads: queries, and components of vectors. The share of neighbours that it is to find, and what
#: visiting a bucket costs, in scored vectors.
SAMPLE_QUERIES, SAMPLE_VALUES, RECALL, PROBE_COST = 128, 1_300_000, 0.94, 4.0
#: Classes, and queries, that are searched together in a task.
GROUP_ROWS, QUERY_GROUP = 16_384, 16_384
#: Queries whose scores with a bucket are held at a time, and whose buckets are found at a time.
QUERY_ROWS, PROBED_ROWS = 512, 64
_BASE = np.int64(1_000_003)


class Setting(NamedTuple):
    tables: int
    hashes: int
    width: float
    probes: int


#: Everything in one bucket.
ALL = Setting(1, 0, 1.0, 1)


class Hashes:
    """The tables' projections, the same in every process."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, dim + 1, hashes))
        self.b = rng.uniform(0, width, (tables, 1, hashes))
        self.width = width
        self.moves = np.array(list(itertools.product((-1, 0, 1), repeat=hashes)), np.int64)
        self.place = _BASE ** np.arange(hashes, dtype=np.int64)  # wraps: a bucket's number needn't be invertible

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.a[table] + self.b[table]) / self.width

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        return (np.floor(cells).astype(np.int64) * self.place).sum(1)

    def costs(self, at: np.ndarray) -> np.ndarray:
        """For each row of distances to the lower boundaries the cost of each move."""
        cost = np.zeros((len(at), len(self.moves)))
        for i in range(at.shape[1]):
            cost += np.stack([at[:, i] ** 2, np.zeros(len(at)), (1 - at[:, i]) ** 2], 1)[:, self.moves[:, i] + 1]
        return cost

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """For each row the buckets to visit, the likeliest first."""
        cells = self.cells(x, table)
        steps, out = (self.moves * self.place).sum(1), []
        for i in range(0, len(x), PROBED_ROWS):
            c = cells[i : i + PROBED_ROWS]
            order = np.argsort(self.costs(c - np.floor(c)), axis=1, kind="stable")[:, :count]
            out.append(self.bucket(c)[:, None] + steps[order])
        return np.concatenate(out) if out else np.empty((0, count), np.int64)

    def order(self, q: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q its cells, and the place of each move in the order of visits."""
        cells = self.cells(q, table)
        place = np.empty((len(q), len(self.moves)), np.int32)
        for i in range(0, len(q), PROBED_ROWS):
            c = cells[i : i + PROBED_ROWS]
            by = np.argsort(self.costs(c - np.floor(c)), axis=1, kind="stable")
            np.put_along_axis(place[i : i + PROBED_ROWS], by, np.arange(by.shape[1], dtype=np.int32)[None], 1)
        return np.floor(cells).astype(np.int64), place

    def ranks(self, cells: np.ndarray, place: np.ndarray, x: np.ndarray, table: int) -> np.ndarray:
        """How many buckets the query of each row is to visit before that of the same row of x; the number of moves if it never does."""
        d = np.floor(self.cells(x, table)).astype(np.int64) - cells
        move = ((d + 1) * 3 ** np.arange(d.shape[1])[::-1]).sum(1)
        near = (np.abs(d) <= 1).all(1)
        return np.where(near, place[np.arange(len(d)), np.where(near, move, 0)], len(self.moves))


def _augmented(x: np.ndarray, largest: float) -> np.ndarray:
    y = x / largest
    return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1, keepdims=True)))])


def _as_queries(x: np.ndarray) -> np.ndarray:
    return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])


def choose(queries: np.ndarray, pairs: np.ndarray, near: np.ndarray, sample: np.ndarray, n: int, largest: float) -> Setting:
    """The cheapest setting that finds RECALL of the pairs (number of the query, row of near), where sample stands for all n vectors."""
    if not len(pairs):
        return ALL
    dim, best = queries.shape[1], (np.inf, ALL)
    q, x, y = _as_queries(queries), _augmented(near, largest), _augmented(sample, largest)
    for hashes in HASHES:
        for width in WIDTHS:
            h = Hashes(dim, max(TABLES), hashes, width)
            ranks, sizes = [], []
            for t in range(max(TABLES)):
                cells, place = h.order(q, t)
                ranks.append(h.ranks(cells[pairs], place[pairs], x, t))
                buckets, counts = np.unique(h.bucket(h.cells(y, t)), return_counts=True)
                seen = np.zeros(len(h.moves))  # vectors in the bucket that is visited at each place
                steps = (h.moves * h.place).sum(1)
                for i in range(0, len(q), max(1, len(q) // 24)):
                    visited = (cells[i] * h.place).sum() + steps
                    at = np.minimum(np.searchsorted(buckets, visited), len(buckets) - 1)
                    seen[place[i]] += np.where(buckets[at] == visited, counts[at], 0)
                sizes.append(np.cumsum(seen) / len(range(0, len(q), max(1, len(q) // 24))) / len(sample))
                if t + 1 in TABLES:
                    least = np.sort(np.minimum.reduce(ranks))[int(np.ceil(RECALL * len(pairs))) - 1]
                    if least < len(h.moves):
                        cost = n * sum(s[least] for s in sizes) + PROBE_COST * (t + 1) * (least + 1)
                        best = min(best, (cost, Setting(t + 1, hashes, width, int(least) + 1)))
    return best[1]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _nearest(sent, k: int):
    """The k exact neighbours of the sent (class, vector)s among a task's classes."""

    def run(pdfs):
        qcls, q = sent.value
        held = pd.DataFrame({"i": pd.Series(dtype="int64"), "cls": pd.Series(dtype="int64"), "near": pd.Series(dtype="float64"), "data": pd.Series(dtype="object")})
        for pdf in pdfs:
            if len(pdf):
                x, cls = _matrix(pdf["vec"]), pdf["cls"].to_numpy()
                s = q @ x.T
                s[qcls[:, None] == cls] = -np.inf
                at = np.argsort(-s, axis=1, kind="stable")[:, :k]
                i = np.repeat(np.arange(len(q)), at.shape[1])
                found = pd.DataFrame({"i": i, "cls": cls[at.ravel()], "near": s[i, at.ravel()], "data": [x[j].tobytes() for j in at.ravel()]})
                held = pd.concat([held, found[found["near"] > -np.inf]]).sort_values(["i", "near", "cls"], ascending=[True, False, True])
                held = held.groupby("i").head(k)
        yield held

    return run


def fit(classes: DataFrame, qclasses: DataFrame, dim: int, largest: float, n: int, k: int) -> Setting:
    """A setting for classes (cls, vec), of which at most SAMPLE_VALUES components, and SAMPLE_QUERIES queries, reach the driver."""
    first = lambda df, m: df.select("cls", "vec").orderBy(F.xxhash64("cls"), "cls").limit(m).toArrow()
    some, rows = first(qclasses, SAMPLE_QUERIES), first(classes, max(256, SAMPLE_VALUES // dim))
    vectors = lambda t: t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    if not some.num_rows:
        return ALL
    q = vectors(some)
    sent = classes.sparkSession.sparkContext.broadcast((some["cls"].to_numpy(), q))
    near = classes.select("cls", "vec").mapInPandas(_nearest(sent, k), "i long, cls long, near double, data binary")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("near"), "cls"))).where(F.col("r") <= k).select("i", "data").collect()
    x = np.frombuffer(b"".join(bytes(r.data) for r in near), np.float64).reshape(-1, dim)
    return choose(q, np.array([r.i for r in near], np.int64), x, vectors(rows), n, largest)


def _shards(buckets: np.ndarray, shards: int) -> np.ndarray:
    return (common.mix64(buckets.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _index_rows(dim: int, largest: float, how: Setting, shards: int):
    def run(pdfs):
        h = Hashes(dim, how.tables, how.hashes, how.width)
        for pdf in pdfs:
            if len(pdf):
                x = _matrix(pdf["vec"])
                y = _augmented(x, largest)
                data = [v.tobytes() for v in x]
                for t in range(how.tables):
                    b = h.bucket(h.cells(y, t))
                    yield pd.DataFrame({"table": t, "shard": _shards(b, shards), "bucket": b, "cls": pdf["cls"], "data": data})

    return run


def _query_rows(dim: int, how: Setting, shards: int):
    """A row for each shard that a query visits, with the buckets that it visits there."""

    def run(pdfs):
        h = Hashes(dim, how.tables, how.hashes, how.width)
        for pdf in pdfs:
            x = _matrix(pdf["vec"]) if len(pdf) else None
            for i in range(0, len(pdf), QUERY_ROWS):
                part = x[i : i + QUERY_ROWS]
                y, cls = _as_queries(part), pdf["cls"].to_numpy()[i : i + QUERY_ROWS]
                data = [v.tobytes() for v in part]
                for t in range(how.tables):
                    p = h.probes(y, t, how.probes)
                    who, flat = np.repeat(np.arange(len(p)), p.shape[1]), p.ravel()
                    s = _shards(flat, shards)
                    order = np.lexsort((s, who))
                    who, flat, s = who[order], flat[order], s[order]
                    cut = np.flatnonzero((who[1:] != who[:-1]) | (s[1:] != s[:-1])) + 1
                    first = np.concatenate(([0], cut))
                    yield pd.DataFrame({"table": t, "shard": s[first], "buckets": [b.tobytes() for b in np.split(flat, cut)], "qcls": cls[who[first]], "data": [data[w] for w in who[first]]})

    return run


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows (of a row and rows), added up one component after another, as Spark does."""
    s = np.zeros(len(x))
    for i in range(x.shape[1]):
        s += q[..., i] * x[:, i]
    return s


def _searcher(keep: int):
    """Of a shard's classes, the keep best of the visited ones for each query by exact score, ties to the smaller class."""

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"qcls": pd.Series(dtype="int64"), "cls": pd.Series(dtype="int64"), "near": pd.Series(dtype="float64")})
        if not len(index) or not len(queries):
            return out
        decode = lambda col: np.frombuffer(b"".join(col), np.float64).reshape(len(col), -1)
        order = np.argsort(index["bucket"].to_numpy(), kind="stable")
        x, cls, bucket = decode(index["data"])[order], index["cls"].to_numpy()[order], index["bucket"].to_numpy()[order]
        q, qcls = decode(queries["data"]), queries["qcls"].to_numpy()
        # Scores of a product of matrices and exact ones that are further apart than this are in the same order.
        margin = (x.shape[1] + 2) * 2.0**-50 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        held, lo_of = np.unique(bucket, return_index=True)
        hi_of = np.append(lo_of[1:], len(bucket))
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        asked = [np.frombuffer(b, np.int64) for b in queries["buckets"]]
        for i in range(0, len(q), QUERY_ROWS):
            visits = np.concatenate(asked[i : i + QUERY_ROWS])
            who = np.repeat(np.arange(i, min(len(q), i + QUERY_ROWS)), [len(b) for b in asked[i : i + QUERY_ROWS]])
            at = np.minimum(np.searchsorted(held, visits), len(held) - 1)
            ok = held[at] == visits
            at, who = at[ok], who[ok]
            order = np.argsort(at, kind="stable")
            at, who = at[order], who[order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            for b, w in zip(at[first], np.split(who, first[1:]), strict=True) if len(at) else ():
                lo, hi = lo_of[b], hi_of[b]
                s = q[w] @ x[lo:hi].T
                if hi - lo > keep:
                    top = s >= (np.partition(s, hi - lo - keep, axis=1)[:, hi - lo - keep] - margin[w])[:, None]
                    for k in np.flatnonzero(top.sum(1) > keep):  # ties, or nearly
                        some = np.flatnonzero(top[k])
                        top[k, some[np.lexsort((cls[lo + some], -_exact(q[w[k]], x[lo + some])))[keep:]]] = False
                else:
                    top = np.ones(s.shape, bool)
                row, of = np.nonzero(top)
                best.append((w[row], lo + of, s[row, of]))
        if not best:
            return out
        w, c, s = (np.concatenate(z) for z in zip(*best, strict=True))
        order = np.lexsort((-s, w))
        w, c, s = w[order], c[order], s[order]
        last = np.minimum(np.searchsorted(w, w) + keep, np.searchsorted(w, w, "right")) - 1
        ok = s >= s[last] - margin[w]
        w, c = w[ok], c[ok]
        s = np.concatenate([_exact(q[w[i : i + 65_536]], x[c[i : i + 65_536]]) for i in range(0, len(w), 65_536)])
        order = np.lexsort((cls[c], -s, w))
        w, c, s = w[order], c[order], s[order]
        ok = np.arange(len(w)) - np.searchsorted(w, w) < keep
        return pd.DataFrame({"qcls": qcls[w[ok]], "cls": cls[c[ok]], "near": s[ok]})

    return run


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id long, vec array<double> of the rows that take part, distinct; -0.0 becomes 0.0."""
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    bad = "exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity')) or forall(vec, x -> x = 0)"
    return v.where(f"not ({bad})").select("vec_id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec")).distinct()


def _best(classes: DataFrame, qclasses: DataFrame, size: tuple, how: Setting) -> DataFrame:
    """qcls, all: the k + 1 best (less = -score, vec_id) of the ids in the visited buckets."""
    dim, largest, n, k, group_rows = size
    shards = max(1, -(-n // group_rows))
    index = classes.select("cls", "vec").mapInPandas(_index_rows(dim, largest, how, shards), "table int, shard long, bucket long, cls long, data binary")
    asks = qclasses.select("cls", "vec").mapInPandas(_query_rows(dim, how, shards), "table int, shard long, buckets binary, qcls long, data binary")
    # Where a shard is too large for a task its classes are dealt to parts, and so are its queries to groups; each group asks each part.
    place = ["table", "shard"]
    count = lambda df, by, name: df.groupBy(*place).agg(F.ceil(F.count("*") / by).cast("int").alias(name))
    split = count(index.select(*place), group_rows, "parts").join(count(asks.select(*place), QUERY_GROUP, "groups"), place)
    split = common.cut(split.where("parts > 1 or groups > 1"))
    one = lambda name: F.coalesce(F.col(name), F.lit(1))
    each = lambda name: F.explode(F.sequence(F.lit(0), one(name) - 1))
    index = index.join(split, place, "left").withColumn("part", F.pmod(F.xxhash64("cls"), one("parts")).cast("int")).withColumn("group", each("groups")).drop("parts", "groups")
    asks = asks.join(split, place, "left").withColumn("group", F.pmod(F.xxhash64("qcls"), one("groups")).cast("int")).withColumn("part", each("parts")).drop("parts", "groups")
    keep = k + 2
    key = [*place, "part", "group"]
    found = index.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(_searcher(keep), "qcls long, cls long, near double")
    # The scores are exact and in one order of addition, so equal ones are equal wherever they were found.
    found = found.groupBy("qcls", "cls").agg(F.max("near").alias("near"))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("qcls").orderBy(F.desc("near"), "cls"))).where(F.col("r") <= keep)
    found = found.join(classes.select("cls", "ids"), "cls")
    ids = F.transform("ids", lambda i: F.struct((-F.col("near")).alias("less"), i.alias("vec_id")))
    return found.select("qcls", ids.alias("some")).groupBy("qcls").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, k + 1).alias("all"))


def search(embeddings: DataFrame, queries: DataFrame, k: int = 20, how: Setting | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k found rows of embeddings with the largest inner product, but not the query's own id.

    queries: rows (vec_id, embedding) that occur in embeddings. how: a setting instead of the fitted one.
    """
    spark = embeddings.sparkSession
    every = usable(embeddings)
    common_dim = every.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common_dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common_dim["dim"]
    every = every.where(F.size("vec") == dim)
    # row_number() <= n is cut in each task before the shuffle, so a vector's copies never meet in one task.
    least = every.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = common.cut(least.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "ids", "vec"))
    largest, n, ids = classes.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))), F.count("*"), F.sum(F.size("ids"))).first()
    asked = usable(queries).where(F.size("vec") == dim)
    asked = common.cut(asked.join(classes.select("cls", "vec"), "vec").select(F.col("vec_id").alias("query_id"), F.col("cls").alias("qcls")))
    qclasses = common.cut(classes.join(asked.select(F.col("qcls").alias("cls")).distinct(), "cls", "left_semi"))

    size = (dim, largest, n, k, group_rows)
    lists = common.cut(_best(classes, qclasses, size, how or fit(classes, qclasses, dim, largest, n, k)))
    # A query that found fewer than there are is compared with every class: in one bucket, whose shard is split.
    full = lists.where(F.size("all") >= min(k + 1, ids))
    short = qclasses.join(full.select(F.col("qcls").alias("cls")), "cls", "left_anti")
    if short.limit(1).count():
        lists = full.unionByName(_best(classes, common.cut(short), size, ALL))
    lists = asked.join(lists, "qcls").select("query_id", F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("all"))
    return lists.select("query_id", F.posexplode("all").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = common.table(spark, sf_dir, "embeddings")
    return search(embeddings, embeddings.where(F.col("vec_id") % 20 == 0))
