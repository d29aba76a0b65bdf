"""Shards of files: order, heavy and null ids, repeats, shuffled reads."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quayside.llm import common, records

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_order_shards_and_whole_results(spark):
    rows = [(i, f"text number {i}") for i in range(200)] + [(7, f"heavy {i}") for i in range(300)] + [(None, f"none {i}") for i in range(150)] + [(9_007_199_254_740_993, None), (5, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as start", "3 as n_tokens").repartition(5)
    folder = common.shared_dir(spark)
    made = records.write(df, folder, PATH, shards=12)
    sizes = {r.shard: r.n_docs for r in made.collect()}
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) < 120  # neither 7 nor null lies in one shard
    got = records.read(made, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    got.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    t = Tokenizer.from_file(PATH)
    want = Counter((d, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for d, x in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    for shard, n in list(sizes.items())[:3]:  # by the index, last to first
        read = [records.read_at(folder, shard, i) for i in reversed(range(n))]
        assert len(read) == n and all(x[-1] == 0 for _, x in read)


def test_each_shard_is_a_task(spark):
    df = spark.range(1000).selectExpr("id as doc_id", "'x' as text")
    shard, n = records.shard_of(df, 16)
    assert n == 16
    dealt = df.withColumn("shard", shard).repartitionById(n, "shard").selectExpr("shard", "spark_partition_id() as p").distinct().collect()
    assert len({r.p for r in dealt}) == len({r.shard for r in dealt}) == len(dealt) == 16


def test_a_repeated_task_replaces_its_files(spark):
    df = spark.createDataFrame([(i, f"t {i}") for i in range(30)], "doc_id long, text string")
    folder = common.shared_dir(spark)
    first = records.write(df, folder, PATH, shards=3)
    again = records.write(df, folder, PATH, shards=3)
    assert sorted(first.collect()) == sorted(again.collect())
    assert sorted(records.read(again, folder).collect()) == sorted(records.read(first, folder).collect()) and records.read(first, folder).count() == 30
