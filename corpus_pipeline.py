"""The training-data pipeline: documents in, encoded training rows out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventlane.llm import bpe, decontaminate, langid, quality, simhash
from eventlane.llm.common import shared_path, table
from eventlane.llm.oracle import ORACLE
from eventlane.llm.queries import QUERIES, ratings, teaches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and not ambiguous."""
    return langid.understood(docs, langid.train(docs.where(teaches())))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have the highest grade with at least even chance."""
    return quality.select(docs, quality.train(docs, ratings(spark, sf_dir)))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near-duplicates."""
    return simhash.one_of_each(docs, shingle=3, distance=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.without_overlap(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training rows: each document's ids, with the digests of ids and decoded text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.encode(docs.select("doc_id", "text", "lang", "source"), path)
    return bpe.digested(rows, path).drop("text")


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as a table and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        path = shared_path(spark, "stage")
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs


# Trained models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None

LLM_QUERIES = {**QUERIES, "pipeline": run}
LLM_ORACLE = dict(ORACLE)
