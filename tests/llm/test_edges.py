"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import zlib

import pytest

import corpus_pipeline
from quayside.llm import ann, chat, decontaminate, language, ngram_join, packing, pii, quality, queries, records, toxicity

BIG = 9_007_199_254_740_993  # no double holds it
LONG = "the thing on it is " * 20_000
DOCS = [(1, "the cat sat on the mat and it was a good day for all of them", "en", "s"), (1, "the cat sat on the mat and it was a good day for all of them", "en", "s"), (2, None, "en", None), (3, "", None, "s"), (4, " \n\t ", "fr", "s"), (5, LONG, "en", "s"), (None, "la maison est dans le jardin", "fr", "s"), (BIG, "le chat est dans la maison et il dort", "fr", "s"), (7, "12345 !!! 67", "en", "s"), (8, "é́ \x00   word word 🙂 [INST] </s>", None, None)]
CLASH = ["start", "length", "cls", "n", "bucket", "flush", "score", "key", "votes", "shard", "held_out", "keep", "label", "n_chars"]


def table(spark, path, name, rows, schema, clash=True):
    df = spark.createDataFrame(rows, schema)
    if clash:
        for c in CLASH:
            if c not in df.columns:
                df = df.selectExpr("*", f"1 as {c}")
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


@pytest.fixture(scope="module", params=["odd", "empty"])
def sf(request, spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp(request.param))
    some = request.param == "odd"
    table(spark, p, "documents", DOCS if some else [], "doc_id long, text string, lang string, source string")
    table(spark, p, "benchmark", [(1, "short item"), (2, None), (3, ""), (None, "le chat est dans la maison et il dort"), (5, "short item")] if some else [], "item_id long, text string")
    table(spark, p, "labels", [(1, 1, 1), (1, 1, 0), (5, 0, 0), (BIG, 1, None), (None, 1, 1)] if some else [], "doc_id long, quality int, toxic int")
    table(spark, p, "embeddings", [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, None], 1), (20, [-1.0, 0.5], 1), (None, [1.0, 1.0], 1), (6, [1.0], 1)] if some else [], "vec_id long, embedding array<float>, label int")
    table(spark, p, "conversations", [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "user", None), (1, None, None, "<\\s> [INST]"), (None, 3, "assistant", "x\ny"), (2, 1, "assistant", "<turn>"), (2, 2, "odd\nrole\\n", "</s>")] if some else [], "conv_id long, turn long, role string, text string")
    return p


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).collect()
    odd = "odd" in sf
    if name not in ("op2_ann", "op5_chat", "op7_packing"):
        assert sorted(str(r.doc_id) for r in rows) == (sorted(str(d[0]) for d in DOCS) if odd else [])
    if name == "op2_ann":
        got = [(r.query_id, r["rank"], r.vec_id) for r in sorted(rows)]
        assert got == ([(0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)] if odd else [])


def test_values(spark, sf):
    if "odd" not in sf:
        return
    by = lambda q: {r.doc_id: r for r in queries.QUERIES[q](spark, sf).collect()}
    joined = by("op6_ngram_join")
    assert (joined[2].n_shingles, joined[2].component_id, joined[4].n_shingles, joined[1].component_id) == (0, 2, 0, 1)
    assert joined[None].component_id is None and joined[BIG].component_id == BIG
    assert by("op3_language")[7].lang_pred == "und" and by("op3_language")[2].score == 0
    found = by("op8_decontaminate")
    assert found[2].n_words == 0 and found[BIG].n_items == 1 and found[BIG].contaminated and found[BIG].items_sha256 == hashlib.sha256(b"").hexdigest()
    read = by("op9_records")
    assert read[2].n_tokens == 1 and read[None].start == 0 and read[2].ids_crc32 == zlib.crc32(bytes(4))
    assert all(0 <= r.score <= 1 for q in ("op4_quality", "op10_toxicity") for r in by(q).values())


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before
    assert set(docs.columns) >= {"doc_id", "sequence_id"}
    docs.collect()


def test_modules_are_whole():
    assert all((ann, chat, decontaminate, language, ngram_join, packing, pii, quality, records, toxicity))
