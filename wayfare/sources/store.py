"""The store of judged answers: content-addressed, read by an equi-join on the request's key."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare import schema
from wayfare.plans.tables import materialize

FORMAT = 3


def location(env: Mapping[str, str], variable: str = "WAYFARE_STORE") -> str:
    """The store's folder: its own variable, else the XDG cache, else ``~/.cache``; blank counts as unset."""
    if env.get(variable, "").strip():
        return env[variable]
    if env.get("XDG_CACHE_HOME", "").strip():
        return os.path.join(env["XDG_CACHE_HOME"], "wayfare")
    if env.get("HOME", "").strip():
        return os.path.join(env["HOME"], ".cache", "wayfare")
    raise LookupError("no folder for stored answers")


def read_entries(spark: SparkSession, folder: str) -> DataFrame:
    """``key, judgment, detail`` of JSON entries named by their key; other formats and broken files are misses."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    body = F.from_json(F.col("content").cast("string"), schema.STORED.replace("key string, ", ""))
    rows = files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("key"), body.alias("e"))
    return rows.where((F.col("e.format") == FORMAT) & F.col("e.judgment.relevance").isNotNull()).select("key", "e.judgment", "e.detail")


class JudgmentStore:
    """A Parquet table of answers by key; ``judge`` asks only for what is not in it."""

    def __init__(self, spark: SparkSession, folder: str | None):
        self.spark, self.folder = spark, folder

    def entries(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        if self.folder is None:
            return None
        try:
            return self.spark.read.parquet(self.folder)
        except AnalysisException:
            return None

    def judge(self, asked: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``asked(key, ...)`` with ``judgment, detail, bought`` (and ``error`` where ``answer`` gives one).

        Only keys that the store lacks go to ``answer``, each once.  What it gives is written first and read from
        there, so that a judge is asked once however often the result is used; failures are not kept.
        """
        known = self.entries()
        missing = asked.dropDuplicates(["key"])
        missing = missing if known is None else missing.join(known.select("key"), "key", "left_anti")
        bought = materialize(answer(missing), "bought").withColumn("bought", F.lit(True))
        if "error" not in bought.columns:
            bought = bought.withColumn("error", F.lit(None).cast("string"))
        bought = bought.select("key", "judgment", "detail", "bought", "error")
        out = asked.join(bought, "key")
        if known is not None:
            held = known.dropDuplicates(["key"]).withColumns({"bought": F.lit(False), "error": F.lit(None).cast("string")})
            held = held.join(bought.select("key"), "key", "left_anti")  # what this call stores is not read twice
            out = out.unionByName(asked.join(held, "key"))
        self._keep(bought.where("error is null"))
        return out

    def _keep(self, found: DataFrame) -> None:
        if self.folder is not None and not found.isEmpty():
            found.select("key", "judgment", "detail").write.mode("append").parquet(self.folder)


def calls(judged: DataFrame) -> DataFrame:
    """Answers served and answers bought."""
    return judged.agg(F.count("*").alias("served"), F.count_if("bought").alias("calls"))
