"""A training-corpus pipeline over ``documents``: each stage is one operator, written
as Parquet and reread as the next one's input.

Stages but the last return the columns of ``documents``.  Every stage decides by row: rows that
share an id, or have none, are filtered by their own texts, and of rows with one id and
one text the near-duplicate stage keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import bpe, langid, minhash, mixing, quality_fm
from wayfare.llm.common import Scratch

#: A language score below this counts as undecided.
LEAST_LANGUAGE_SCORE = 0.5
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python ``BATCH_ROWS`` at a time, for this session: what a worker holds stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.  It learns from the labels of the documents given."""
    _small_batches(spark)
    model = quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.accept(docs, model)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided."""
    _small_batches(spark)
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    return langid.accept(docs, model, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, a similarity of 0.8), decided by row."""
    return minhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix, repeats included."""
    _small_batches(spark)
    return bpe.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("tokens", tokens),
]

#: Classifiers, MinHash links and byte pairs are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole ``documents`` table; a stage's input goes once its output is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out = scratch.table(out, name)
            scratch.drop(docs)
        docs = out
    return docs
