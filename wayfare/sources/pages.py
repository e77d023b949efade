"""Page sources: a folder of markdown and text files, or any table of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.text import path_key


class EmptyCorpus(ValueError):
    """There is no page to read."""


def list_pages(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` of every ``.md``/``.txt`` file below ``root`` (any case), in path order.

    Folders whose name starts with a dot are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    relative = F.element_at(F.split(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", ""), F.lit(r"\Q" + base + r"/\E"), 2), -1)
    rows = files.select(relative.alias("path"), "content")
    hidden = F.exists(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), lambda c: c.startswith("."))
    return rows.where(F.lower("path").rlike(r"[^/]\.(md|txt)$") & ~hidden).orderBy(path_key(F.col("path")))


def read_pages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``path, content`` to (``path, text``; ``path, error``): bytes that are not UTF-8 are failures."""
    decoded = files.withColumn("text", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")))
    bad = F.when(F.col("content").isNull(), "unreadable").otherwise("not UTF-8")
    return decoded.where("text is not null").select("path", "text"), decoded.where("text is null").select("path", bad.alias("error"))


def load_corpus(spark: SparkSession, root: str) -> DataFrame:
    """All pages of a folder with their text; none at all is an error."""
    pages, failed = read_pages(list_pages(spark, root))
    if pages.isEmpty():
        raise EmptyCorpus(root)
    broken = failed.first()
    if broken is not None:
        raise UnicodeError(f"{broken['path']}: {broken['error']}")
    return pages


def revision(pages: DataFrame) -> str:
    """sha256 over path, a zero byte, text and a zero byte of all pages in path order.

    The digest is sequential by definition: rows stream to the driver in order, one
    partition at a time, and are not held.
    """
    import hashlib

    state = hashlib.sha256()
    for row in pages.select("path", "text").orderBy(path_key(F.col("path"))).toLocalIterator():
        state.update(row["path"].encode() + b"\0" + row["text"].encode() + b"\0")
    return state.hexdigest()
