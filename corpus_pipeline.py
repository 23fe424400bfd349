"""Corpus pipeline: raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir); its output is written as Parquet in the cluster's shared folder and read again as the next one's docs, so a lost executor costs one stage at most.
All but the last return the columns the documents came with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyframe.llm import bpe, decontaminate, neardup, pii, quality_model
from studyframe.llm.queries import vocabulary_path
from studyframe.llm.work import handed_off, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the labelled ones among them, predicts to be good."""
    return quality_model.kept(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id."""
    return neardup.kept(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; the length column follows the new text if there is one."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): the token ids of each document, with their digests."""
    found = bpe.encode(docs, vocabulary_path(), hashed=True)
    return bpe.digests(found, "ids")


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("benchmark decontamination", decontamination),
          ("personal data", personal_data), ("BPE encoding", tokenisation)]

#: A learned model, hash signatures and BPE can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = handed_off(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
