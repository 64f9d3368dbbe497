"""The corpus pipeline: five stages over documents, each a call of one of the operators in pagelens.llm.

quality rules -> n-gram Jaccard join -> secret scan -> source mix -> byte BPE. The output of each
stage is written to the shared folder and read back as the next one's documents. All stages but
the last return the columns of documents.

Defined results: rows without a doc_id are documents as any other, as are rows that share a doc_id
but differ in text; rows that repeat doc_id and text are one document from the second stage on; an
empty table passes through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import byte_bpe, common, jaccard_join, quality_rules, secret_scan, source_mix


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject. The list is learned from labels of these documents."""
    rules = quality_rules.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules).where("quality.kept").select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, from each class of near duplicates."""
    docs = docs.withColumn("__th", F.xxhash64("text"))
    firsts = jaccard_join.joined(docs.drop("__th")).where("is_first").select(F.col("doc_id").alias("__id"), F.col("th").alias("__hash"))
    kept = docs.join(firsts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__hash")), "left_semi")
    repeated = not docs.groupBy("doc_id", "__th").count().where("count > 1").isEmpty()
    return (kept.dropDuplicates(["doc_id", "__th"]) if repeated else kept).drop("__th")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every span of a secret is replaced, and n_chars follows the text."""
    found = secret_scan.scan(docs, redacted=True)
    text = F.coalesce("secrets.redacted", "text")
    return found.withColumns({"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities that bring sources, languages and topics to their target weights."""
    return source_mix.mixed(docs).where("mix.kept").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to."""
    return byte_bpe.digests(docs.select("doc_id", "text")).select("doc_id", "bpe.*")


STAGES = [("quality rules", keep_good), ("n-gram Jaccard join", keep_distinct), ("secret scans", redact_secrets), ("source mix", mix_sources), ("BPE encoding and decoding", encode)]

#: Learned rules, minhash paths, calibrated draws and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
