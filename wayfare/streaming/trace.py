"""The event log of walks: replay summaries, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DROPPED = ("beam", "max-files")


def _is(event: str) -> Column:
    return F.col("event") == event


def trace_summary(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a run: files, pops, requests, answers bought and cached, links followed, passed over and dropped, pages earned, duration."""
    pruned, gone = _is("pruned"), F.col("reason").isin(*DROPPED)
    return events.groupBy(*(by or [])).agg(
        F.count_distinct(F.when(_is("result"), F.col("path"))).alias("files"),
        F.count_if(_is("popped")).alias("pops"),
        F.count_if(_is("requested")).alias("requests"),
        F.count_if(_is("answered")).alias("answered"),
        F.count_if(_is("answered") & ~F.coalesce("cached", F.lit(False))).alias("bought"),
        F.count_if(_is("answered") & F.coalesce("cached", F.lit(False))).alias("cached"),
        F.count_if(_is("admitted")).alias("followed"),
        F.count_if(pruned & ~F.coalesce(gone, F.lit(False))).alias("passed_over"),
        F.count_if(pruned & gone).alias("dropped"),
        F.count_distinct(F.when(_is("result") & F.col("earned_a_place"), F.col("path"))).alias("earned"),
        F.coalesce(F.max("t_ms"), F.lit(0)).alias("duration_ms"),
    )


def streaming_counts(events: DataFrame, by: list[str], at: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The summary's counts over a stream, by run.  A page has one result event a walk, so
    results are counted; a stream cannot count distinct values exactly.

    With ``at``, the column of a run's start time (the same in all its events), runs are kept until the watermark is ``delay``
    past it, then given out for good and forgotten; without, every run is kept as long as the stream goes on.
    """
    pruned, gone = _is("pruned"), F.coalesce(F.col("reason").isin(*DROPPED), F.lit(False))
    timed = events if at is None else events.withWatermark(at, delay)
    return timed.groupBy(*([at] if at else []), *by).agg(
        F.count_if(_is("result")).alias("files"),
        F.count_if(_is("popped")).alias("pops"),
        F.count_if(_is("requested")).alias("requests"),
        F.count_if(_is("answered")).alias("answered"),
        F.count_if(_is("admitted")).alias("followed"),
        F.count_if(pruned & ~gone).alias("passed_over"),
        F.count_if(pruned & gone).alias("dropped"),
        F.count_if(_is("result") & F.col("earned_a_place")).alias("earned"),
        F.max("t_ms").alias("duration_ms"),
    )


def stream_trace(spark, folder: str, ddl: str) -> DataFrame:
    """A stream of JSON-line trace files that appear in ``folder``."""
    return spark.readStream.schema(ddl).json(folder)


def best_paths(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``path, hop, source, target, scent``: the links along the path by which each page was popped."""
    by = by or []
    popped = events.where(_is("popped")).select(*by, "path", F.concat("via", F.array("path")).alias("steps"))
    hops = popped.where(F.size("steps") > 1).select(*by, "path", F.posexplode(F.slice("steps", F.lit(1), F.size("steps") - 1)).alias("hop", "source"), "steps")
    hops = hops.withColumn("target", F.element_at("steps", F.col("hop") + 2)).drop("steps")
    admitted = events.where(_is("admitted")).groupBy(*by, "source", "target").agg(F.max("scent").alias("scent"))
    return hops.join(admitted, [*by, "source", "target"], "left")
