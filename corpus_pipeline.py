"""From raw documents to packed training windows, in five stages.

Every stage reads what the one before wrote. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.llm.common import read_table, written
from routelens.llm.language import learn_languages, predict_languages
from routelens.llm.line_dedup import drop_repeated_lines
from routelens.llm.minhash import near_duplicates
from routelens.llm.packing import pack_documents
from routelens.llm.toxicity import learn_toxicity, score_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Least toxicity of a document that goes.
TOXIC = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike every language of the labelled ones, go."""
    model = learn_languages(docs, F.lit(True))
    return predict_languages(docs, model).where("NOT prediction.rejected").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = learn_toxicity(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    return score_toxicity(docs, model).where(F.col("toxicity") < TOXIC).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars is that of the lines that stay."""
    kept = drop_repeated_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the smallest doc_id stays, in one row; of rows that repeat it, one with words.

    Rows with a NULL doc_id all stay.
    """
    dropped = written(near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("__doc")).distinct())
    # Few ids are repeated, so the texts of the others need not move.
    repeated = written(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__doc"))
                       .agg(F.count("*").alias("n")).where("n > 1").select("__doc"))
    same = F.col("doc_id") == F.col("__doc")
    once = docs.join(repeated, same, "left_anti").join(dropped, same, "left_anti").select(*docs.columns)
    blank = ~F.coalesce(F.col("text").rlike(r"[^ \t\n\r\x0b\f]"), F.lit(False))
    order = F.struct(blank, F.xxhash64("text"), F.xxhash64(*docs.columns))
    several = (docs.join(repeated, same, "left_semi").join(dropped, same, "left_anti")
               .groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")))
    return once.unionByName(several.select("row.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("packing", pack),
]

#: Neither the models nor the packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs)
    return docs
