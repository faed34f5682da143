"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlane.llm import archive, bpe, decontaminate, embeddings, hmm, html_text, langid, licenses, negatives, quality, simhash, token_counts, turns
from eventlane.llm.common import table, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

CONTEXT = 4096


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    return counted.select("doc_id", size, "n_tokens", (F.col("n_tokens") > CONTEXT).alias("over_limit"))


@query
def op2_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.extract(pages, html_text.train()).select("page_id", "url", "text")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op3_bpe_codec(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


@query
def op4_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ratings of the labels: 0 toxic, 1 poor, 2 good."""
    labels = table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


@query
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.grade(docs, quality.train(docs, ratings(spark, sf_dir))).drop("text")


@query
def op6_warc(spark, sf_dir):
    path = archive.archived(archive.page_records(table(spark, sf_dir, "pages")))
    return archive.page_rows(spark.read.format("warc").load(path))


@query
def op7_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op8_decontamination(spark, sf_dir):
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def teaches(id_col: str = "doc_id"):
    """Rows that language identification may learn from; the others are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


@query
def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(teaches()))
    named = langid.identify(docs.withColumn("held_out", ~teaches()), model)
    return named.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query
def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query
def op12_conversations(spark, sf_dir):
    return turns.repair(turns.damaged(table(spark, sf_dir, "conversations")))


def lm_teaches(id_col: str = "doc_id"):
    """Rows that the language model may learn from; the others are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 1, F.lit(True))


@query
def op13_lm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = hmm.vocabulary(docs.where(lm_teaches()))
    encoded = hmm.encode(docs, vocab, lm_teaches())
    scored = hmm.score(encoded, vocab, hmm.train(encoded, vocab))
    return scored.select("doc_id", (~lm_teaches()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
