"""From raw documents to packed training sequences, in four stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import langid, packing, quality, simhash
from cadenza.llm.common import materialize, table
from cadenza.llm.queries import vocabulary

#: A document whose likeliest language has less than this mean probability is in none of the known languages (a mixture of two has about a half).
MIN_LANGUAGE_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language. Null and letterless texts (``und``) and those below MIN_LANGUAGE_SCORE go. Learns as op2 does."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    net = langid.train(docs.where(~held_out).select("text", "lang"))
    found = langid.predict(docs, net, names=("_cadenza_lang", "_cadenza_score"))
    return found.where((F.col("_cadenza_lang") != langid.UNKNOWN) & (F.col("_cadenza_score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier, learnt from the labels as op10 learns, takes for label 1."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality.predict(docs, model, names=("_cadenza_score", "_cadenza_predicted")).where("_cadenza_predicted = 1").select(*docs.columns)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by SimHash one row stays: that with the smallest doc_id, nulls last. Rows are told apart by all their columns, not by doc_id."""
    return simhash.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", remove_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: Networks and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
