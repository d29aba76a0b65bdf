"""Documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), with the columns of documents, and returns a DataFrame; all but the last return
the columns of docs. run() writes each stage's result in the shared folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import common, decontaminate, ngram_join, packing, pii, quality


#: Chunks whose ids a worker of the packing stage keeps: fewer than op7's, as the executors' heaps have grown in earlier stages.
KEPT_CHUNKS = 250_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null texts count as empty ones, repeated rows are judged alike; an empty table stays empty."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles, one row stays: of the smallest doc_id (null last), then the least hash of the text, then the least row. Null and wordless texts, of which there may be many, all stay."""
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go, each row judged by its own text. Null and wordless texts stay; so does everything where the benchmark is empty."""
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the texts, null texts stay null; n_chars follows, where it wasn't null. All rows stay."""
    done = docs.withColumn("text", pii.redact(spark, F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 2048 ids; null and empty texts have the end id alone, repeated rows are packed as often as they occur."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), kept=KEPT_CHUNKS)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir))
    return docs
