"""From raw documents to packed training sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlog.llm import mixing, packing, quality, secretscan, simhash
from dirlog.llm.base import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go; without labels of both kinds all stay.

    Null and empty texts weigh 0 and are judged like others; repeated rows have equal keys and go or stay together.
    """
    return quality.resampled(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more) one row stays.

    It is the one with the smallest id; rows without an id come last. Rows without words are copies of each other.
    """
    marked = stored(simhash.near_texts(docs, words=5, least=0.8))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    kept = marked.groupBy("component_id").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.th").alias("kept_th"))
    mine = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_th"))
    out = docs.join(kept, mine, "left_semi")
    repeated = not marked.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return (out.dropDuplicates(["doc_id", "text"]) if repeated else out).select(docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are replaced in the texts; n_chars follows. All rows stay; null and empty texts as they are."""
    clean = secretscan.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, some not at all and some twice.

    A null source is one more source; texts without words follow their source's passes; repeated rows share their fate.
    """
    return mixing.mixture(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences: every row once, null and empty texts as one end token, null ids as they are."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has neither the n-gram model nor the tagger; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
