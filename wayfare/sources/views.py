"""Tables as temporary views, so that ``spark.sql`` works over everything the engine reads or makes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Tables that a data folder may hold, one Parquet file or folder each.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def register_folder(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """A view for each table of a data folder."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def register(frames: Mapping[str, DataFrame]) -> None:
    """A view for each frame, for example parsed pages, judgments or visits."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
