"""Tables of a run: the driver's inputs, and the tables that cut an iterative plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a temporary folder is made and set, but only for a ``local`` master:
    executors of a cluster would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wayfare-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """The tables of one run of an operator, in a folder of their own under the shared one.

    A table cuts the lineage: a lost executor costs a reread, not a recomputation.
    ``drop`` deletes tables that nothing will read again; what a returned frame still
    reads stays until the session's owner clears the folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/wayfare/{label}-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written as Parquet and read back."""
        path = f"{self.folder}/{label}-{len(self._paths)}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables; frames that are not this run's are left alone."""
        for df in tables:
            kept, path = self._paths.get(id(df), (None, ""))
            if kept is df and df is not None and path:
                _delete(self.spark, path)
                self._paths[id(df)] = (df, "")

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete every table of the run but these."""
        kept = {id(t) for t in tables}
        self.drop(*[df for k, (df, _) in list(self._paths.items()) if k not in kept])


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """One table in the shared folder, read back."""
    return Scratch(df.sparkSession, label).table(df, label)
