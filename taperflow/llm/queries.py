"""The queries of this subpackage, as the driver's contract names them."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_file
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, linededup, lm, media_ts, packing, sharding, simhash, toxicity
from .common import doc_crc32, table

#: The labels' categories in the order of the chain.
TOXIC_CHAIN = ("low_quality", "toxic")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), keep_ids=False)


def op2_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    got = toxicity.predict(docs, toxicity.fit(docs, labels, TOXIC_CHAIN))
    return got.select("doc_id", "p_low_quality", F.col("p_toxic").alias("score"), F.col("rejected").alias("toxic"))


def op3_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.predict(docs, langid.fit(docs, ~langid.held_out()))
    return got.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_anchor_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), doc_crc32() % 7 == 2)


def op8_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_ts.store(media_ts.mux_documents(table(spark, sf_dir, "documents")))
    return media_ts.read_media(media, keep_payload=False)


def op9_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_harmonic_packing, op2_classifier_chain, op3_adaptive_scan, op4_nearest_centroid, op5_kd_tree, op6_anchor_covering, op7_deleted_interpolation, op8_transport_streams, op9_pair_index_bpe, op10_line_winnowing)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op10_line_winnowing": linededup.ORACLE}
