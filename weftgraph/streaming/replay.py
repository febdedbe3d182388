"""Structured Streaming over update files: lines ``time|dependency|op|field|...`` without header.

Files count in the order of their names and lines in the order of their file, whatever splits, sizes or triggers the scan has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.updates import LOG_SCHEMA
from ..session import staged

_SOURCE = "value", "_metadata.file_path as file", "_metadata.file_block_start as block"


def _placed(lines: DataFrame) -> DataFrame:
    """(value, file, block) to ``value, file, line``: the number of the line in its file.

    The rows of a split are consecutive in the scan, so a line's number is that of its split's first line, a sum over the few
    rows that splits are, and its place in the split. Staged, as a scan that is run again may number its rows anew.
    """
    rows = staged(lines.withColumn("spread", F.monotonically_increasing_id()), "lines")
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("spread").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(splits, ["file", "block"]).select("value", "file", (F.col("spread") + F.col("shift")).alias("line"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (file, line, ...) with ``seq``: files in the order of their names, lines in that of their file."""
    files = rows.groupBy("file").agg((F.max("line") + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # one row for each file
    return rows.join(files.select("file", F.coalesce(before, F.lit(0)).alias("start")), "file").withColumn("seq", F.col("start") + F.col("line")).drop("file", "line", "start")


def parse(rows: DataFrame) -> DataFrame:
    """(value, ...) to ``op, fields, ...``: lines with at least three fields; the schedule in the first two is ignored."""
    parts = F.split("value", r"\|", -1)
    fields = F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0)))
    kept = rows.where(F.size(parts) >= 3).withColumns({"op": F.get(parts, F.lit(2)).try_cast("int"), "fields": fields})
    return kept.drop("value").where("op between 1 and 8")


def read_batch(spark: SparkSession, *paths: str) -> DataFrame:
    """The log of whole files, ``seq, op, fields``; seq is unique, with gaps."""
    return _numbered(parse(_placed(spark.read.text(list(paths)).selectExpr(*_SOURCE)))).select("seq", "op", "fields")


def replay(spark: SparkSession, source: str, log: str, checkpoint: str, files_per_trigger: int = 16) -> StreamingQuery:
    """Appends every line of the files in ``source`` to the Parquet log, once each, with its file and place in it.

    A batch that is run again after a failure overwrites its own folder.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(source).selectExpr(*_SOURCE)

    def write(batch: DataFrame, batch_id: int) -> None:
        parse(_placed(batch)).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The replayed log, ``seq, op, fields``: the order of files is that of their names, not that of the batches."""
    rows = spark.read.schema("file string, line long, op int, fields array<string>, batch long").parquet(log)
    return _numbered(rows).select(*[x.split()[0] for x in LOG_SCHEMA.split(", ")])
