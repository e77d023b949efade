"""Line-range coverage and keyword ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.text import path_key, terms

LEAST_TERM = 3


def page_lines(pages: DataFrame, key: str = "path") -> DataFrame:
    """``key, line, chars`` (1-based; a line's newline counts) of every page."""
    pieces = F.split("text", "\n", -1)
    last = F.element_at(pieces, -1)
    lines = F.when(last == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    rows = pages.select(key, F.size(pieces).alias("n_"), F.posexplode(lines).alias("at_", "body_"))
    newline = (F.col("at_") + 1 < F.col("n_")).cast("int")
    return rows.select(key, (F.col("at_") + 1).alias("line"), (F.length("body_") + newline).alias("chars"))


def merge_ranges(ranges: DataFrame, key: str = "path") -> DataFrame:
    """Overlapping or touching ranges of a page as one: ``key, first, last``.

    One window pass by page; rows stay proportional to the ranges.
    """
    order = Window.partitionBy(key).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0)
    island = ranges.where("first <= last").withColumn("begins_", begins).withColumn("island_", F.sum("begins_").over(order))
    return island.groupBy(key, "island_").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island_")


def coverage(pages: DataFrame, ranges: DataFrame, key: str = "path") -> DataFrame:
    """``key, chars, lines`` in the union of a page's ranges.

    Ranges are merged first, so every line meets at most one; the equi-join on the
    page carries the range condition.
    """
    merged = merge_ranges(ranges, key).select(F.col(key).alias("k_"), F.col("first").alias("a_"), F.col("last").alias("z_"))
    lines = page_lines(pages, key)
    inside = lines.join(merged, (F.col(key) == F.col("k_")) & F.col("line").between(F.col("a_"), F.col("z_")))
    return inside.groupBy(key).agg(F.sum("chars").alias("chars"), F.count("*").alias("lines"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` (``first, last``) whose range meets some range of ``right`` with the same keys."""
    other = right.select(*[F.col(k).alias(f"{k}_r") for k in keys], F.col("first").alias("first_r"), F.col("last").alias("last_r"))
    on = (F.col("first") <= F.col("last_r")) & (F.col("first_r") <= F.col("last"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"{k}_r"))
    return left.join(other, on, "left_semi")


def query_terms(query: Column) -> Column:
    """Distinct lower-cased terms of at least three characters, in order."""
    return F.array_distinct(terms(query, LEAST_TERM))


def keyword_topk(pages: DataFrame, queries: DataFrame, k: int, key: str = "path", ordering: Column | None = None) -> DataFrame:
    """``query_id, key, terms_matched, occurrences, rank`` of the best ``k`` pages a query.

    Pages are tokenised once; an inverted index row meets only the queries that have
    its term.  Counts are taken per page and term before the join with the queries.
    """
    wanted = queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term"))
    all_terms = wanted.select("term").distinct()
    index = pages.select(key, F.explode(terms(F.col("text"), LEAST_TERM)).alias("term")).join(all_terms, "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("n"))
    hits = index.join(wanted, "term").groupBy("query_id", key).agg(F.count("*").alias("terms_matched"), F.sum("n").alias("occurrences"))
    by = path_key(F.col(key)) if ordering is None else ordering
    order = Window.partitionBy("query_id").orderBy(F.desc("terms_matched"), F.desc("occurrences"), by)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
