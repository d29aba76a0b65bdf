"""Token ids as files of length-delimited binary records, with an index of offsets.

A shard file is a row of records: payload length (uint64), masked checksum of those 8 bytes (uint32), payload, masked
checksum of the payload (uint32), all little-endian. The checksum is CRC-32 (the zlib polynomial), masked as
rotate-right by 15 plus 0xA282EAD8, so that a stored checksum isn't taken for data. A payload is a flag byte (1: has a
doc_id), doc_id (int64), bytes for each id (uint8: 2 or 4), then the ids. Beside shard-00000.rec, shard-00000.idx holds
a row of (offset uint64, ids uint64) for each record, so that a reader can visit records in any order.

Documents lie in ascending doc_id order, shard by shard (null first; rows with the same doc_id by a hash of the text, then
the text). Shards are cut at approximate quantiles of doc_id, and a doc_id that holds several of them is cut by that hash,
so the number of shards, not their size, grows with the table: there are at least as many as shuffle partitions, and one for
SHARD_BYTES of the table's files. Each shard is a task of its own. A task writes to a name of its own and renames, so a
repeated task replaces its file with the same one.

Null and empty texts have the end id alone. Repeated rows are written as often as they occur. An empty table gives no files
and no rows; other columns play no part. A text of any length is one record, encoded whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

MASK = 0xA282EAD8
SHARD_BYTES = 64 << 20
HEAD = struct.Struct("<QI")
META = struct.Struct("<BqB")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return n + struct.pack("<I", masked(n)) + payload + struct.pack("<I", masked(payload))


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return META.pack(doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    has, doc_id, width = META.unpack_from(data)
    return (doc_id if has else None), np.frombuffer(data, f"<u{width}", offset=META.size).astype("<u4")


def read_record(f) -> bytes | None:
    """The next payload; None at the end. ValueError if lengths or checksums are wrong."""
    head = f.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("cut short")
    n, c = HEAD.unpack(head)
    if c != masked(head[:8]):
        raise ValueError("wrong checksum of a length")
    data, end = f.read(n), f.read(4)
    if len(data) < n or len(end) < 4 or struct.unpack("<I", end)[0] != masked(data):
        raise ValueError("wrong checksum of a record")
    return data


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, path: str, end_id: int):
    def run(pdfs):
        enc = tokens.encoder(path)
        width = 2 if max(enc.vocabulary, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], np.uint32)
        files, base = _filesystem(folder)
        shard, out, temp, index, total = None, None, "", [], 0

        def close():
            out.close()
            with files.open_output_stream(f"{temp}.idx") as f:
                f.write(np.array(index, "<u8").tobytes())
            for kind in ("idx", "rec"):
                files.move(f"{temp}.{kind}", f"{base}/shard-{shard:05d}.{kind}")
            return pd.DataFrame({"shard": [shard], "n_docs": [len(index)], "n_ids": [total]})

        for pdf in pdfs:
            texts = [x if isinstance(x, str) else "" for x in pdf["text"]]
            doc_ids = [None if x is None else int(x) for x in pdf["doc_id"]]
            shards = pdf["shard"].tolist()
            for part in tokens.runs(texts):
                for s, doc_id, ids in zip(shards[part], doc_ids[part], enc.encode(texts[part]), strict=True):
                    if s != shard:
                        if out:
                            yield close()
                        shard, index, total, temp = s, [], 0, f"{base}/.{uuid.uuid4().hex}"
                        out = files.open_output_stream(f"{temp}.rec", buffer_size=1 << 20)
                        at = 0
                    ids = np.concatenate((ids, end))
                    record = frame(payload(doc_id, ids, width))
                    out.write(record)
                    index.append((at, len(ids)))
                    at += len(record)
                    total += len(ids)
        if out:
            yield close()

    return run


def shard_of(src: DataFrame, shards: int) -> tuple[Column, int]:
    """The number of a row's shard, ascending with doc_id (null first) and, within a doc_id, with the text's hash; and how many there may be."""
    cuts, nulls, n = src.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)] or [0.5], 100 * shards), F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    cuts = sorted(cuts or []) if shards > 1 else []
    # Of rows with one doc_id those in the k-th of equal stretches of hashes go to its k-th shard. A hash is about uniform over 2 ** 64 values.
    part = lambda of: F.least(F.floor((F.xxhash64("text") / 2.0**64 + 0.5) * of), of - 1)
    none = -(-nulls * shards // max(1, n))
    shard = F.lit(none)
    if cuts:
        # A shard holds the doc_ids up to and with its quantile. One that is the quantile of several shards has them for itself.
        many = {c: k for c, k in Counter(cuts).items() if k > 1}
        own = F.lit(0)
        if many:
            of = F.create_map(*[x for c, k in many.items() for x in (F.lit(c).cast("long"), F.lit(k))])[F.col("doc_id")]
            own = F.when(of.isNotNull(), part(of)).otherwise(0)
        shard = none + F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("doc_id"))) + own
    return F.when(F.col("doc_id").isNull(), part(F.lit(none))).otherwise(shard).cast("int"), none + len(cuts) + 1


def write(docs: DataFrame, folder: str, path: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Write the shards; a row for each: shard, n_docs, n_ids."""
    spark = docs.sparkSession
    shards = shards or max(common.partitions(spark), -(-common.plan_bytes(docs) // SHARD_BYTES))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shard, shards = shard_of(src, shards)
    src = src.withColumn("shard", shard)
    files, base = _filesystem(folder)
    files.create_dir(base, recursive=True)
    dealt = src.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.asc_nulls_first("text"))
    dealt = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "shard")
    return common.cut(dealt.mapInPandas(_writer(folder, path, end_id), "shard int, n_docs long, n_ids long"))


def _reader(folder: str):
    def run(pdfs):
        files, base = _filesystem(folder)
        for pdf in pdfs:
            for shard, start, n_docs in zip(pdf["shard"], pdf["start"], pdf["n_docs"], strict=True):
                rows = []
                with files.open_input_stream(f"{base}/shard-{shard:05d}.rec", buffer_size=1 << 20) as f:
                    while (data := read_record(f)) is not None:
                        doc_id, ids = parse(data)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                if len(rows) != n_docs:
                    raise ValueError(f"shard {shard} holds {len(rows)} records, not {n_docs}")
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                out["doc_id"] = [None if r[0] is None else str(r[0]) for r in rows]
                yield out

    return run


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. manifest: what write() gave (a row for each file)."""
    spark = manifest.sparkSession
    rows, start = [], 0
    for r in manifest.orderBy("shard").collect():
        rows.append((r.shard, start, r.n_docs))
        start += r.n_ids
    shards = spark.createDataFrame(rows, "shard int, start long, n_docs long").repartition(max(1, len(rows)))
    return common.long_ids(shards.mapInPandas(_reader(folder), "doc_id string, start long, n_tokens long, ids_crc32 long"))


def read_at(folder: str, shard: int, i: int) -> tuple[int | None, np.ndarray]:
    """Record i of a shard by the index alone, for reads in shuffled order."""
    files, base = _filesystem(folder)
    with files.open_input_file(f"{base}/shard-{shard:05d}.idx") as f:
        f.seek(16 * i)
        at = struct.unpack("<Q", f.read(8))[0]
    with files.open_input_file(f"{base}/shard-{shard:05d}.rec") as f:
        f.seek(at)
        return parse(read_record(f))


def op9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.shared_dir(spark)
    return read(write(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json")), folder)
