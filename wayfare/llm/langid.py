"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language on the executors, sums them with a grouped
aggregate and brings one ``languages x buckets`` matrix to the driver, whose
size does not depend on the corpus.  Scoring broadcasts the log-probability
matrix and works document by document on the sparse non-zero buckets.

Defined results: a null text or one without a letter is ``und`` with score 0;
with nothing to learn from every text is ``und``; a null id counts as held out;
ties go to the language that sorts first; repeated rows each give a row; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import id_crc, text_ids, typed_ids

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


@dataclass(frozen=True)
class LangIdParams:
    """``max_docs_per_lang`` bounds (in expectation) the documents learned from, ``max_languages`` the
    languages: those with most documents (a dirty ``lang`` column may hold any number of values)."""

    bucket_bits: int = 15
    orders: tuple[int, ...] = (1, 2, 3)
    smoothing: float = 0.05
    max_docs_per_lang: int = 1500
    max_languages: int = 256
    evidence: int = 100  # n-grams' worth of evidence behind a score; keeps it off 0 and 1


@dataclass(frozen=True)
class LangIdModel:
    languages: tuple[str, ...]
    prior: np.ndarray  # (languages,)
    log_prob: np.ndarray  # (buckets, languages)
    params: LangIdParams


def ngram_buckets(text: str, params: LangIdParams) -> np.ndarray:
    """Hash buckets of all character n-grams of the lower-cased text, framed by spaces."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    shift = np.uint32(32 - params.bucket_bits)
    found = []
    rolled = np.zeros(len(points), dtype=np.uint32)
    for order in range(1, max(params.orders) + 1):
        if order > len(points):
            break
        width = len(points) - order + 1
        rolled = (rolled[:width] ^ points[order - 1 :]) * np.uint32(_MULTIPLIERS[order % 3])
        rolled = rolled ^ (rolled >> np.uint32(15))
        if order in params.orders:
            found.append(((rolled + np.uint32(order)) * np.uint32(0x27D4EB2F)) >> shift)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


def _counter(params: LangIdParams):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                if text:
                    counts = np.bincount(ngram_buckets(text, params), minlength=1 << params.bucket_bits)
                    totals[lang] = totals[lang] + counts if lang in totals else counts
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": counts[at].astype(np.int64)})

    return count


def train(docs: DataFrame, learn_from: Column, params: LangIdParams = LangIdParams()) -> LangIdModel:
    """Learn from rows where ``learn_from`` holds and ``lang`` is not null.

    Language priors count all those rows.  N-gram counts come from a hash
    sample by id, per language, of about ``max_docs_per_lang`` documents.
    """
    rows = docs.select("doc_id", "text", "lang", learn_from.alias("learn")).where("learn and lang is not null")
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(params.max_languages)
    sizes = {r["lang"]: r["n"] for r in counted.collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LangIdModel((), np.zeros(0), np.zeros((1 << params.bucket_bits, 0)), params)
    rates = {k: min(1.0, params.max_docs_per_lang / n) for k, n in sizes.items()}
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("lang")]
    counted = (
        rows.where(draw < rate)
        .select("lang", "text")
        .mapInPandas(_counter(params), "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    counts = np.zeros((1 << params.bucket_bits, len(languages)))
    at = {k: i for i, k in enumerate(languages)}
    counts[counted["bucket"].to_numpy(), counted["lang"].map(at).to_numpy(dtype=int)] = counted["n"].to_numpy()
    smooth = counts + params.smoothing
    log_prob = np.log(smooth) - np.log(smooth.sum(axis=0, keepdims=True))
    total = sum(sizes.values())
    prior = np.log(np.array([sizes[k] / total for k in languages]))
    return LangIdModel(languages, prior, log_prob.astype(np.float32), params)


def classify(text: str | None, model: LangIdModel) -> tuple[str, float]:
    """Language and score of one whole text."""
    if not text or not model.languages or not _LETTER.search(text):
        return UNDETERMINED, 0.0
    counts = np.bincount(ngram_buckets(text, model.params), minlength=1 << model.params.bucket_bits)
    at = np.flatnonzero(counts)
    n = counts[at]
    total = int(n.sum())
    likelihood = model.prior + n.astype(np.float64) @ model.log_prob[at].astype(np.float64)
    best = int(np.argmax(likelihood))
    tempered = (likelihood - likelihood[best]) * min(1.0, model.params.evidence / max(total, 1))
    return model.languages[best], float(1.0 / np.exp(tempered).sum())


def predict(docs: DataFrame, model: LangIdModel) -> DataFrame:
    """``docs`` columns ``doc_id`` and ``text`` to ``doc_id, lang_pred, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for batch in batches:
            out = [classify(t, held) for t in batch["text"]]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "lang_pred": [x[0] for x in out], "score": np.array([x[1] for x in out], dtype=float)}
            )

    return typed_ids(text_ids(docs.select("doc_id", "text")).mapInPandas(score, "doc_id string, lang_pred string, score double"), docs)


def accept(docs: DataFrame, model: LangIdModel, least: float) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is decided with a score of ``least`` or more; without a join.

    With no language learned nothing can be decided, and every text with a letter stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def certainty(text: pd.Series) -> pd.Series:
        held = shared.value
        if not held.languages:
            return text.map(lambda t: 1.0 if t and _LETTER.search(t) else -1.0).astype(float)
        found = [classify(t, held) for t in text]
        return pd.Series([-1.0 if lang == UNDETERMINED else score for lang, score in found], dtype=float)

    return docs.where(certainty(F.col("text")) >= least)


def held_out(doc_id: Column) -> Column:
    """Fifth of the ids that is never learned from; null ids belong to it."""
    return F.coalesce(F.pmod(id_crc(doc_id), F.lit(5)) == 0, F.lit(True))


def language_of(docs: DataFrame, params: LangIdParams = LangIdParams()) -> DataFrame:
    """Train on ``docs`` without the held-out fifth and predict every row."""
    model = train(docs, ~held_out(F.col("doc_id")), params)
    out = predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
