"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.plans.tables import Scratch, materialize, shared_dir

__all__ = ["Scratch", "ascii_lower", "batches_of", "documents", "fresh", "id_crc", "materialize", "shared_dir", "shuffle_partitions", "text_ids", "typed_ids"]


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the tables written inside: for rows that carry texts or
    files, what a Python worker holds at once is then bounded by a few of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores added until no column of ``taken`` has it (in any case)."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def text_ids(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with ids as text: a batch of integers with nulls would come to Python as floats."""
    return rows.withColumn(key, F.col(key).cast("string"))


def typed_ids(found: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``found`` with text ids as ``rows`` has them."""
    return found.withColumn(key, F.col(key).cast(rows.schema[key].dataType))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as decimal text; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other scripts)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
