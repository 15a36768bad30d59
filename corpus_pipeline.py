"""A pipeline over documents: each stage works on what the one before it kept.

``run`` writes each stage's result as Parquet in a shared folder and reads it again as the
next one's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, jaccard, mixing, pii, quality
from tidemark.llm.shared import documents, set_aside, shared_folder

#: Boosted trees and exact merging have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the trees keep."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own, back = set_aside(docs, quality.ADDED)
    return quality.assess(own, model).where("kept").select(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    return jaccard.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    own, back = set_aside(docs, ["spans"])
    return pii.redact(pii.find(own, pii.train(docs)), own.columns).select(back)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids and what they decode to."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"])


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing sources to target weights", mixture), ("BPE encoding and decoding", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        folder = shared_folder(spark, "stage-" + name.split(" ")[0].lower())
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
