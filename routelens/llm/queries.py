"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.llm.alignment import alignment_scores
from routelens.llm.collocations import collocations
from routelens.llm.common import crc_fold, read_table
from routelens.llm.embeddings import near_duplicate_vectors
from routelens.llm.encoding import token_digests
from routelens.llm.language import learn_languages, predict_languages
from routelens.llm.lbl import learn_language_model, score_texts
from routelens.llm.line_dedup import drop_repeated_lines
from routelens.llm.minhash import near_duplicates
from routelens.llm.packing import pack_documents
from routelens.llm.quality import quality_rules
from routelens.llm.token_counts import count_tokens
from routelens.llm.toxicity import learn_toxicity, score_toxicity
from routelens.llm.url_filters import judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read_table(spark, sf_dir, "documents"),
                         public_tokenizers.path("word_bpe_49k.json"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc_fold(F.col("doc_id"), 5)
    model = learn_languages(docs, fold != 0)
    return predict_languages(docs, model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        F.col("prediction.lang").alias("lang_pred"), F.col("prediction.score").alias("score"),
        F.col("prediction.rejected").alias("rejected"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = crc_fold(F.col("doc_id"), 7)
    model, counted = learn_language_model(docs, fold != 2)
    return score_texts(docs, fold == 2, model, counted)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = crc_fold(F.col("doc_id"), 4)
    model = learn_toxicity(docs, read_table(spark, sf_dir, "labels"), fold != 2)
    return score_toxicity(docs, model).select(
        "doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"),
                          public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_scores(read_table(spark, sf_dir, "documents"),
                            public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    query.__name__: query for query in (
        op1_line_dedup, op2_minhash, op3_bpe, op4_language, op5_embeddings, op6_token_counts,
        op7_lm, op8_toxicity, op9_packing, op10_quality, op11_url_filters, op12_collocations,
        op13_alignment)
}
