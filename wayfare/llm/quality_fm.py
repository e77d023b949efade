"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

``score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``; the pair
sum is computed in linear time as ``0.5 * sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)``.
The features of a bounded, hash-drawn sample of labelled rows come to the driver,
where the model is fitted; every text is scored whole on the executors.

Defined results: a null text scores as an empty one; with no labels (or one
class only) every score is that class's share (0.5 with none); a null id is held
out; several labels of one id are all learned from, on one of its texts; a null label is skipped;
repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import id_crc, text_ids, typed_ids


@dataclass(frozen=True)
class FmParams:
    """``max_docs_per_class`` bounds (in expectation) the labelled rows learned from."""

    word_bits: int = 13
    rank: int = 8
    epochs: int = 30
    batch: int = 128
    rate: float = 0.05
    decay: float = 2e-4
    max_docs_per_class: int = 2500
    seed: int = 7


@dataclass(frozen=True)
class FmModel:
    bias: float
    linear: np.ndarray  # (features,)
    factors: np.ndarray  # (features, rank)
    params: FmParams


#: Structure statistics are cut into bins, one feature for each statistic and bin.
BINS = 12
STATISTICS = (
    "upper", "digit", "punct", "pipe", "bang", "symbol", "non_ascii", "space", "newline", "word_length",
    "distinct_words", "top_word", "distinct_lines", "short_words", "ends_odd", "all_caps", "log_chars", "log_words",
    "declared_chars", "sentence_end",
)
_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other, 1 upper, 2 digit, 3 plain punctuation, 4 symbol, 5 space, 6 newline, 7 non-ASCII
_CLASS[65:91] = 1
_CLASS[48:58] = 2
for _c in b".,;:'\"()-?":
    _CLASS[_c] = 3
for _c in b"!#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_c] = 4
_CLASS[32] = _CLASS[9] = 5
_CLASS[10] = 6
_CLASS[128:] = 7


def n_features(params: FmParams) -> int:
    return (1 << params.word_bits) + BINS * len(STATISTICS)


def _statistics(raw: bytes, words: list[bytes], counts: Counter, declared: float) -> list[float]:
    """Values in 0 to 1, in the order of ``STATISTICS``."""
    n, n_words = max(len(raw), 1), max(len(words), 1)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=8) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    odd = sum(c for w, c in counts.items() if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in b".,;:?\"')"))
    caps = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    return [
        kinds[1], kinds[2], kinds[3], raw.count(b"|") / n * 10, raw.count(b"!") / n * 10, kinds[4], kinds[7], kinds[5], kinds[6] * 10,
        (sum(map(len, words)) / n_words) / 16, len(counts) / n_words, max(counts.values(), default=0) / n_words,
        len(set(lines)) / max(len(lines), 1), sum(c for w, c in counts.items() if len(w) <= 3) / n_words,
        odd / n_words, caps / n_words, np.log2(n) / 20, np.log2(n_words) / 16,
        -1.0 if not declared > 0 else np.log2(declared) / 20, sum(c for w, c in counts.items() if w[-1:] in b".?") / n_words * 4,
    ]


def features(text: str | None, declared: float | None, params: FmParams) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one text; ``declared`` is the table's length column (null: unknown)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    counts = Counter(words)
    stats = _statistics(raw, words, counts, float("nan") if declared is None else float(declared))
    at = [(1 << params.word_bits) + i * BINS + (BINS - 1 if v < 0 else min(int(v * (BINS - 1)), BINS - 2)) for i, v in enumerate(stats)]
    mask = (1 << params.word_bits) - 1
    hashed = np.fromiter((zlib.crc32(w.lower()) & mask for w in counts), dtype=np.int32, count=len(counts))
    weight = np.sqrt(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    if len(weight):
        weight /= np.linalg.norm(weight)
    return (
        np.concatenate([np.array(at, dtype=np.int32), hashed]),
        np.concatenate([np.full(len(at), 1 / np.sqrt(len(STATISTICS))), weight]),
    )


def raw_score(at: np.ndarray, x: np.ndarray, model: FmModel) -> float:
    """The machine's output before the sigmoid, by the sum-of-squares identity."""
    vx = model.factors[at] * x[:, None]
    total = vx.sum(axis=0)
    return float(model.bias + model.linear[at] @ x + 0.5 * (total @ total - (vx * vx).sum()))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], params: FmParams = FmParams()) -> FmModel:
    """Adagrad on the class-weighted log loss.  ``rows``: indices, values, label."""
    labels = np.array([r[2] for r in rows], dtype=np.float64)
    size = n_features(params)
    if not len(rows) or labels.min() == labels.max():
        share = 0.5 if not len(rows) else labels.mean()
        return FmModel(float(np.clip(np.log(share + 1e-6) - np.log(1 - share + 1e-6), -14, 14)), np.zeros(size), np.zeros((size, params.rank)), params)
    rng = np.random.default_rng(params.seed)
    bias, linear, factors = 0.0, np.zeros(size), rng.normal(0, 0.05, (size, params.rank))
    g_bias, g_linear, g_factors = 1e-8, np.full(size, 1e-8), np.full((size, params.rank), 1e-8)
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(params.epochs):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), params.batch):
            picked = order[begin : begin + params.batch]
            lengths = np.array([len(rows[i][0]) for i in picked])
            at = np.concatenate([rows[i][0] for i in picked])
            x = np.concatenate([rows[i][1] for i in picked])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            vx = factors[at] * x[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            z = bias + np.add.reduceat(linear[at] * x, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            grad = (_sigmoid(z) - labels[picked]) * weight[picked] / len(picked)
            per = np.repeat(grad, lengths)
            used, where = np.unique(at, return_inverse=True)
            d_linear = np.bincount(where, weights=per * x) + params.decay * linear[used]
            d_vx = per[:, None] * x[:, None] * (np.repeat(total, lengths, axis=0) - vx)
            d_factors = np.stack([np.bincount(where, weights=d_vx[:, f]) for f in range(params.rank)], axis=1) + params.decay * factors[used]
            d_bias = grad.sum()
            g_bias += d_bias**2
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            bias -= params.rate * d_bias / np.sqrt(g_bias)
            linear[used] -= params.rate * d_linear / np.sqrt(g_linear[used])
            factors[used] -= params.rate * d_factors / np.sqrt(g_factors[used])
    return FmModel(float(bias), linear, factors, params)


def held_out(doc_id: Column) -> Column:
    """Third of the ids that labels are never learned from; null ids belong to it."""
    return F.coalesce(F.pmod(id_crc(doc_id), F.lit(3)) == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, params: FmParams = FmParams()) -> FmModel:
    """Fit on a sample of ``labels`` (``doc_id, quality``) outside the held-out third.

    The sample is drawn by a hash of the id, about ``max_docs_per_class`` rows a
    class however many labels there are, so its broadcast and what reaches the
    driver stay bounded.
    """
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(
        F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    sizes = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([], params)
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rate = F.when(F.col("quality") == 1, F.lit(min(1.0, params.max_docs_per_class / sizes.get(1, 1)))).otherwise(
        F.lit(min(1.0, params.max_docs_per_class / sizes.get(0, 1)))
    )
    sample = marked.where(draw < rate)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [features(t, n, params) for t, n in zip(batch["text"], batch["n_chars"])]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "quality": batch["quality"],
                    "at": [x[0].tobytes() for x in out],
                    "x": [x[1].astype(np.float32).tobytes() for x in out],
                }
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    # of rows that share a labelled id one is learned from, the first by the hash of its text: as many as there are labels
    row = F.struct("text", F.col("n_chars").cast("double").alias("n_chars"))
    picked = (
        docs.select("doc_id", row.alias("row"), F.xxhash64("text").alias("order"))
        .join(F.broadcast(sample.distinct()), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min_by("row", "order").alias("row"))
    )
    got = (
        picked.select("doc_id", "quality", "row.text", "row.n_chars")
        .mapInPandas(extract, f"doc_id {id_type}, quality int, at binary, x binary")
        .toPandas()
        .sort_values(["doc_id", "quality", "at"])
    )
    rows = [
        (np.frombuffer(a, dtype=np.int32), np.frombuffer(x, dtype=np.float32).astype(np.float64), int(q))
        for a, x, q in zip(got["at"], got["x"], got["quality"])
    ]
    return fit(rows, params)


def score(docs: DataFrame, model: FmModel) -> DataFrame:
    """``doc_id, score`` of every row of ``docs`` (``doc_id, text, n_chars``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for batch in batches:
            z = np.array([raw_score(*features(t, n, held.params), held) for t, n in zip(batch["text"], batch["n_chars"])], dtype=float)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": _sigmoid(z)})

    rows = text_ids(docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars")))
    return typed_ids(rows.mapInPandas(run, "doc_id string, score double"), docs)


def accept(docs: DataFrame, model: FmModel) -> DataFrame:
    """Rows of ``docs``, all columns, that score at least 0.5; one pass, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series, declared: pd.Series) -> pd.Series:
        held = shared.value
        return pd.Series(_sigmoid(np.array([raw_score(*features(t, n, held.params), held) for t, n in zip(text, declared)], dtype=float)))

    return docs.where(scored(F.col("text"), F.col("n_chars").cast("double")) >= 0.5)


def quality_of(docs: DataFrame, labels: DataFrame, params: FmParams = FmParams()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    out = score(docs, train(docs, labels, params))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
