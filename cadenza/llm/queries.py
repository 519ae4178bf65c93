"""The thin opN queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, merkle, packing, quality, sharding, simhash, url_filter, vectors, warc, whitening
from .common import table


def vocabulary() -> str:
    """Where the public word-level vocabulary lies; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id isn't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    net = langid.train(docs.where(~held_out).select("text", "lang"))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), net).drop("text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_dedup(table(spark, sf_dir, "embeddings"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings")
    return vectors.nearest(held, held.where("vec_id % 100 = 0"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    done = chat.format_conversations(turns.unionByName(extra))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.page_outcomes(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id isn't held out, and never learnt from, as no label can name it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels)
    return quality.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law is ``bytes``; a null text has the CRC of no bytes."""
    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint"))
    placed = sharding.assign(docs, shards=40, keep=("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 2 divides the CRC32 of the doc_id the text loses its line feeds; a null doc_id isn't tampered with."""
    docs = table(spark, sf_dir, "documents")
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(docs, altered, proofs=False).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {"op13_merkle": op13_merkle, "op12_whitening": op12_whitening, "op11_sharding": op11_sharding, "op4_embedding_dedup": op4_embedding_dedup, "op7_nearest": op7_nearest, "op10_quality": op10_quality, "op1_simhash": op1_simhash, "op2_langid": op2_langid, "op3_best_fit_packing": op3_best_fit_packing, "op9_bpe": op9_bpe, "op5_warc": op5_warc, "op6_chat_format": op6_chat_format, "op8_url_filter": op8_url_filter}
