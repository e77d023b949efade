"""The registered queries of the training-data operators, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import bpe, fingerprint, langid, licenses, matroska, minhash, mixing, quality_fm, repair, sharding
from wayfare.llm.common import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.language_of(documents(spark, sf_dir))


def op2_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's ids start, and their digest, decoded from the compressed files."""
    files = repair.write_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return repair.read_shards(files)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of every document, read back from its media file."""
    return matroska.read_back(matroska.store_texts(documents(spark, sf_dir)))


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of every document."""
    return licenses.scan(documents(spark, sf_dir)).drop("spans")


def op6_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.edited_pairs(documents(spark, sf_dir))


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_fm.quality_of(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document, linked at a similarity of 0.85."""
    return minhash.link_components(documents(spark, sf_dir), minhash.MinHashParams(percent=85))


def op9_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard_documents(documents(spark, sf_dir))


def op10_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return bpe.tokenize(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_repair_ids, op3_source_mix, op4_matroska, op5_license_rules, op6_canonical_digest, op7_quality_fm, op8_minhash, op9_hash_tree, op10_backtracking_bpe]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": mixing.SQL, "op8_minhash": minhash.SQL}
