"""From raw documents to packed sequences: quality, near copies, leaks, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import bounded_batches, materialise, table
from sparkloom.llm.decontaminate import decontaminated
from sparkloom.llm.pack_binary import pack_documents, public_tokenizer
from sparkloom.llm.pii import redact
from sparkloom.llm.quality_classifier import keep_quality
from sparkloom.llm.shingle_dedup import one_of_similar
from sparkloom.llm.simhash_dedup import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    bounded_batches(spark)
    return keep_quality(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: within three bits, then sharing 0.8 of their 5-word shingles."""
    bounded_batches(spark)
    return one_of_similar(materialise(one_of_each(docs)))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without test items."""
    bounded_batches(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    bounded_batches(spark)
    return pack_documents(docs, public_tokenizer(), with_ids=False)


STAGES = [("quality", quality), ("near_copies", near_copies), ("leaks", leaks), ("personal_data", personal_data), ("packing", packing)]

#: SQL cannot express training, fingerprints and tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
