"""Retrieval metrics of walks against a labelled set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.text import tenth
from wayfare.operators.ranking import overlapping

SWEEP = (0.5, 0.6, 0.7, 0.8)
PRICE_PER_TOKEN = 0.042 / 1_000_000


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where there is no whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def label_parts(wanted: DataFrame, sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Labels (``query_id, page, heading, first, last``) as line ranges, with an ``error`` where one cannot be placed.

    A bare page is all its lines; a heading must name exactly one section; lines must lie in the page.
    ``sections``: ``page, heading, first, last``; ``pages``: ``page, lines``.
    """
    named = sections.groupBy("page", "heading").agg(F.count("*").alias("found"), F.min("first").alias("s_first"), F.min("last").alias("s_last"))
    rows = wanted.join(pages, "page", "left").join(named, ["page", "heading"], "left")
    by_heading = F.col("heading").isNotNull()
    first = F.when(by_heading, F.col("s_first")).otherwise(F.coalesce("first", F.lit(1)))
    last = F.when(by_heading, F.col("s_last")).otherwise(F.coalesce("last", "lines"))
    error = (
        F.when(F.col("lines").isNull(), "no such page")
        .when(by_heading & F.col("found").isNull(), "no such heading")
        .when(by_heading & (F.col("found") > 1), "heading names several sections")
        .when(~by_heading & ((first < 1) | (first > last) | (last > F.col("lines"))), "lines outside the page")
    )
    return rows.select("query_id", "page", first.alias("first"), last.alias("last"), error.alias("error"))


def score_lists(wanted: DataFrame, returned: DataFrame, visited: DataFrame, returned_ranges: DataFrame) -> DataFrame:
    """One row a query: gold, returned, visited, found, reached pages and gold and found parts.

    ``wanted``: ``query_id, page, first, last``; ``returned, visited``: ``query_id, page``;
    ``returned_ranges``: ``query_id, page, first, last``.
    """
    pages = wanted.select("query_id", "page").distinct()
    key = ["query_id", "page"]
    one = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    got, seen = returned.select(*key).distinct(), visited.select(*key).distinct()
    parts = [
        one(got, "returned"),
        one(seen, "visited"),
        one(pages.join(got, key, "left_semi"), "found"),
        one(pages.join(seen, key, "left_semi"), "reached"),
        one(wanted, "parts"),
        one(overlapping(wanted, returned_ranges, key), "parts_found"),
    ]
    out = one(pages, "gold")
    for p in parts:
        out = out.join(p, "query_id", "left")
    return out.na.fill(0)


def rates(scores: DataFrame) -> DataFrame:
    """Recall, precision, precision over visited, section recall and unreached of each row."""
    return scores.withColumns(
        {
            "recall": share(F.col("found"), F.col("gold")),
            "precision": share(F.col("found"), F.col("returned")),
            "precision_visited": share(F.col("found"), F.col("visited")),
            "section_recall": share(F.col("parts_found"), F.col("parts")),
            "unreached": F.col("gold") - F.col("reached"),
        }
    )


def means(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro-averages over runs; 0 for none."""
    names = ("recall", "precision", "precision_visited", "section_recall")
    return scored.groupBy(*(by or [])).agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(f"mean_{n}") for n in names], F.count("*").alias("runs"))


def spend(answers: DataFrame, by: list[str]) -> DataFrame:
    """What answers cost: ``served, bought, requests, tokens, latency`` sums and the models seen.

    ``answers``: ``requests, input_tokens, output_tokens, latency_ms, bought, model``.
    """
    bought = F.col("bought")
    return answers.groupBy(*by).agg(
        F.count("*").alias("served"),
        F.count_if(bought).alias("bought"),
        F.sum("requests").alias("requests"),
        F.sum("input_tokens").alias("input_tokens"),
        F.coalesce(F.sum(F.when(bought, F.col("input_tokens"))), F.lit(0)).alias("bought_tokens"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        share(F.sum("requests"), F.count("*")).alias("requests_per_answer"),
        (F.sum("input_tokens") * PRICE_PER_TOKEN).alias("cost"),
        F.array_sort(F.collect_set("model")).alias("models"),
    )


def threshold_sweep(scored: DataFrame, by: list[str], thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """Rows at or above each threshold: ``by, threshold, kept, found``.  ``scored``: ``by, score, wanted``.

    Thresholds are an array column, not a join; partial sums leave each task.
    """
    at = scored.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    hit = F.col("score") >= F.col("threshold")
    return at.groupBy(*by, "threshold").agg(F.count_if(hit).alias("kept"), F.count_if(hit & F.col("wanted")).alias("found"), F.count_if(F.col("wanted")).alias("gold"))


def calibration(arrivals: DataFrame) -> DataFrame:
    """By decile of scent: count, mean scent, mean relevance, wanted share; empty bins do not appear."""
    return arrivals.groupBy(tenth(F.col("scent")).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("scent").alias("mean_scent"), F.avg("relevance").alias("mean_relevance"), share(F.count_if("wanted"), F.count("*")).alias("wanted_share")
    )


def calibration_links(links: DataFrame) -> DataFrame:
    """By decile of scent: judged links, followed ones, and the wanted share among the followed."""
    return links.groupBy(tenth(F.col("scent")).alias("bin")).agg(
        F.count("*").alias("n"), F.count_if("followed").alias("followed"), share(F.count_if(F.col("followed") & F.col("wanted")), F.count_if("followed")).alias("wanted_when_followed")
    )


def follow_decision(links: DataFrame, threshold: float) -> DataFrame:
    """Wanted rates of followed and passed links, and passed links that cleared the threshold."""
    return links.agg(
        F.count_if("followed").alias("followed"),
        F.count_if(~F.col("followed")).alias("passed"),
        share(F.count_if(F.col("followed") & F.col("wanted")), F.count_if("followed")).alias("followed_wanted"),
        share(F.count_if(~F.col("followed") & F.col("wanted")), F.count_if(~F.col("followed"))).alias("passed_wanted"),
        F.count_if(~F.col("followed") & (F.col("scent") >= threshold)).alias("passed_but_cleared"),
    )


def unreached(wanted: DataFrame, visited: DataFrame) -> DataFrame:
    """Wanted pages that no walk visited."""
    key = ["query_id", "page"]
    return wanted.select(*key).distinct().join(visited.select(*key), key, "left_anti")


def corpus_floor(wanted: DataFrame, pages: int, chars: int) -> DataFrame:
    """Precision of returning every page, and the tokens of reading the corpus once a query."""
    gold = wanted.select("query_id", "page").distinct().groupBy("query_id").agg(F.count("*").alias("gold"))
    return gold.agg(F.avg(F.col("gold") / F.lit(float(pages))).alias("floor"), (F.count("*") * F.lit(-(-chars // 4))).alias("corpus_tokens"))


def disposition_census(links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many links were followed and how many were passed over, by reason."""
    return links.groupBy(*(by or []), F.coalesce("reason", F.lit("followed")).alias("disposition")).agg(F.count("*").alias("n"))
