"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, targets found by water-filling, and each document
is taken ``floor(rate)`` times plus once more with probability equal to the
fraction, by a draw seeded with the hash of its id.  Eight seeds are tried in the
same aggregate and each source keeps the one whose total falls nearest its
target; every draw stays a Bernoulli draw that depends on id and seed alone.

Defined results: a null text has size 0; null sources form one source, last in
order; an empty source has target 0; repeated rows draw alike; a null id draws
as the empty string; extra columns are ignored by ``mix`` and kept by ``emit``, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import Scratch, fresh, materialize

WEIGHTS = (5, 2, 1)
CAP = 3
SEEDS = 8
#: Most sources whose table is sent to every executor; beyond, the same join is shuffled.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs without white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draws(doc_id: Column) -> Column:
    """``SEEDS`` independent numbers in 0 to 1 (32 bits each) from one digest of the id."""
    digest = F.sha2(F.coalesce(doc_id.cast("string"), F.lit("")), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double") / F.lit(4294967296.0) for i in range(SEEDS)])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Sources are few (a row each), so one ordered pass over them in one task is cheap; texts and
    documents are not in it.  With sources in the order of ``cap * size / weight`` the full ones are a prefix;
    the first source that fits fixes the level that the rest share.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), k.cast("int") + 1).cast("double"))
    ratio = F.col("source_size") * cap / F.col("weight")
    order = Window.orderBy(ratio.asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    leveled = weighed.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "full": F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)),
            "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    fits = F.col("level") * F.col("weight") <= F.col("source_size") * cap
    shared = F.min_by(F.when(fits, F.col("level")), F.when(fits, ratio)).over(everything)
    return leveled.withColumn("shared", shared).select(
        "source",
        "source_size",
        F.least(F.col("source_size") * F.lit(float(cap)), F.coalesce("shared", F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def _copies(doc_id: Column, rate: Column, seed: Column) -> Column:
    """Copies of a row whose source has this rate and seed: the rate's whole part and a draw on its fraction."""
    whole = F.floor(rate)
    return (whole + F.when(F.element_at(draws(doc_id), seed) < rate - whole, 1).otherwise(0)).cast("long")


def rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``of, source_size, target, rate, seed`` of each source, from rows ``doc_id, source, size``: a written table, one row a source."""
    # A hot source is pre-aggregated in each task before its few partial rows are shuffled.
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    aims = aims.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    scratch = Scratch(sized.sparkSession, "mix")
    aims = scratch.table(aims.withColumnRenamed("source", "of"), "aims")
    joined = sized.join(_few(aims), F.col("source").eqNullSafe(F.col("of")))
    extra = F.col("rate") - F.floor("rate")
    # the digest is a column of its own first, so that it is made once a row
    drawn = joined.select("source", "target", "size", "rate", draws(F.col("doc_id")).alias("draw"))
    by_seed = drawn.groupBy("source", "target").agg(
        *[F.sum(F.col("size") * (F.floor("rate") + F.when(F.col("draw")[i] < extra, 1).otherwise(0))).alias(f"t{i}") for i in range(SEEDS)]
    )
    misses = F.array(*[F.abs(F.col(f"t{i}") - F.col("target")) for i in range(SEEDS)])
    chosen = by_seed.select(F.col("source").alias("source_"), F.array_position(misses, F.array_min(misses)).cast("int").alias("seed"))
    out = scratch.table(aims.join(chosen, F.col("of").eqNullSafe(F.col("source_"))).drop("source_"), "rates")
    scratch.keep_only(out)
    return out


def _few(sources: DataFrame) -> DataFrame:
    """A written table of sources for a join: broadcast if it has at most ``BROADCAST_SOURCES`` rows."""
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row.

    The texts are read once; only ids, sources and sizes are kept.
    """
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    found = _few(rates(sized, weights, cap))
    joined = sized.join(found, F.col("source").eqNullSafe(F.col("of")))
    final = joined.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("doc_id"), F.col("rate"), F.col("seed")).alias("copies"))
    return final.withColumn("taken", F.col("copies") * F.col("size"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with each row as often as its mix takes it (not at all for 0).

    A row's copies depend on its id and its source's rate and seed alone, so the small table of sources
    goes to the rows: no text is shuffled.
    """
    scratch = Scratch(docs.sparkSession, "emit")
    sized = scratch.table(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    found = rates(sized, weights, cap)
    scratch.drop(sized)
    columns = docs.columns
    renamed = {c: fresh(columns, c) for c in ("of", "source_size", "target", "rate", "seed")}
    few = _few(found)
    for name, new in renamed.items():
        few = few.withColumnRenamed(name, new)
    joined = docs.join(few, docs["source"].eqNullSafe(F.col(renamed["of"])))
    copies = _copies(docs["doc_id"], F.col(renamed["rate"]), F.col(renamed["seed"])).cast("int")
    copy = fresh([*columns, *renamed.values()], "copy")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*[docs[c] for c in columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         sha256(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, CAST(source_size * 3 AS DOUBLE) / weight AS ratio FROM s
), m AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(source_size * 3) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM l
), t AS (
  SELECT source, source_size,
         least(source_size * 3.0::DOUBLE, weight * (SELECT arg_min(level, ratio) FROM m WHERE level * weight <= source_size * 3)) AS target
  FROM m
), j AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, d.digest,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT j.*, i.i AS seed,
         CAST(floor(rate) AS BIGINT)
         + CASE WHEN CAST(CAST('0x' || substr(digest, 1 + 8 * i.i, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM j, (SELECT unnest(range(8)) AS i) i
), b AS (
  SELECT source, arg_min(seed, (miss, seed)) AS seed
  FROM (SELECT source, seed, abs(sum(size * copies) - any_value(target)) AS miss FROM k GROUP BY source, seed) GROUP BY source
)
SELECT k.doc_id, k.size, k.source_size, round(k.target, 6) AS target, CAST(k.copies * k.size AS BIGINT) AS taken
FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.seed = b.seed
"""
