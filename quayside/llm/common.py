"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

_own: dict[str, str] = {}
#: Tables of cut() that weren't released, by id, and where they lie.
_written: dict[int, tuple[DataFrame, str]] = {}

#: How to empty what a module remembers in a worker process, by module.
forget: dict[str, Callable[[], None]] = {}
_holder: list[str] = []


def hold(module: str) -> None:
    """Called in a worker by an operator that remembers words: a reused worker drops what the last one remembered."""
    if _holder and _holder[0] != module:
        for empty in forget.values():
            empty()
        gc.collect()
        trim()
    _holder[:] = [module]


def trim() -> None:
    """Give a worker's free memory back to the machine, where the libraries can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset: a temporary folder in local mode, else an error, as executors wouldn't share it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="quayside-")
            atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        base = "file://" + _own["dir"]
    return f"{base.rstrip('/')}/quayside-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df in the shared folder and read it back: later steps don't depend on executors that computed it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


def release(*dfs: DataFrame) -> None:
    """Remove what cut() wrote for dfs, once nothing will read it again; the folder's owner clears the rest."""
    for df in dfs:
        _, path = _written.pop(id(df), (None, None))
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jpath, True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting holds value for what runs inside, and is as before after it."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def plan_bytes(df: DataFrame) -> int:
    """About how many bytes of files df reads, as the planner knows it; 0 if it doesn't."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def long_ids(df: DataFrame) -> DataFrame:
    """doc_id, which goes through Python as text, since pandas would make a float of a nullable number, back as a number."""
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A key with more than one in HOT rows of a table is joined in parts.
HOT = 256


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined (inner, left or left_semi) with right, which has one row for each key, by a key that may hold a large share of left.

    The rows of a hot key are dealt to parts, to each of which right's row goes. There are at most HOT such keys, and their
    list is all that is sent to every task. Null keys, which match nothing, stay where they are. left is read twice.
    """
    spark, n = left.sparkSession, left.count()
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    hot = [(r[0], -(-r[1] * 4 * HOT // n)) for r in counts.orderBy(F.desc("_rows"), key).limit(HOT).collect() if r[1] * HOT > n and r[1] >= HOT]
    found = left.where(F.col(key).isNotNull())
    if hot:
        parts = F.broadcast(spark.createDataFrame(hot, StructType([left.schema[key], StructField("_parts", IntegerType())])))
        of = F.coalesce("_parts", F.lit(1))
        found = found.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), of).cast("int")).drop("_parts")
        right = right.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), of - 1))).drop("_parts")
    found = found.join(right, [key, "_part"] if hot else key, how).drop("_part")
    if how == "left":
        more = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in (key, "_part")]
        found = found.unionByName(left.where(F.col(key).isNull()).select("*", *more))
    return found


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v), numbers or bytes: node, label (the component's smallest node).

    Min-label propagation with pointer jumping; each round is written to the shared folder, where the last one's goes, and
    only whether a label changed reaches the driver. Self loops are harmless; no edges give no rows.
    """
    e = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    e = cut(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    held = cut(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        labels = held.select("node", "label")
        near = e.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        low = labels.withColumnRenamed("label", "old").join(near, "node").select("node", "old", F.least("old", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = cut(low.join(up, "label").select("node", "old", F.least("label", "top").alias("label")))
        release(held)
        if not new.where("label <> old").limit(1).count():
            release(e)
            return new.select("node", "label")
        held = new
