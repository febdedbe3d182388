"""Shared-folder staging that survives the loss of executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``; a local folder is set only where the session names none, and only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = "file://" + os.path.join(tempfile.gettempdir(), "weftgraph-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


class Scratch:
    """The staged frames and folders of one run of an operator, so that those which its result doesn't read can go."""

    def __init__(self, spark: SparkSession):
        self._spark, self._folders = spark, {}

    def folder(self, purpose: str) -> str:
        path = shared_dir(self._spark, purpose)
        self._folders[path] = None
        return path

    def staged(self, df: DataFrame, purpose: str) -> DataFrame:
        path = self.folder(purpose)
        df.write.parquet(path)
        self._folders[path] = out = df.sparkSession.read.schema(df.schema).parquet(path)
        return out

    def discard(self, *keep: DataFrame | str) -> None:
        """Deletes all folders but those of ``keep``. What has been written from them must have been written whole."""
        for path, df in list(self._folders.items()):
            if not any(x is df or x == path for x in keep if isinstance(x, str) or df is not None):
                where = self._spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(where, True)
                del self._folders[path]


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it cuts the lineage."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_with(df: DataFrame, purpose: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``staged``, and what the job that writes it sees: ``n``, the number of rows, and the given aggregates.

    A write that is partly run again may count rows twice: trust that ``n`` is 0 or not, and take it for an estimate else.
    """
    seen = Observation()
    out = staged(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()]), purpose)
    return out, seen.get
