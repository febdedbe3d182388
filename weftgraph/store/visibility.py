"""What a snapshot sees of an edge log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..model import INSERT

KEY = ["src", "edge_type", "dst"]


def latest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest record of each (src, edge_type, dst) up to the snapshot, tombstones included."""
    seen = log if snapshot is None else log.where(F.col("ts") <= snapshot)
    return seen.groupBy(*KEY).agg(F.max_by("marker", "ts").alias("marker"), F.max("ts").alias("ts")).select("src", "dst", "edge_type", "ts", "marker")


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The edges whose newest record is an insert."""
    return latest(log, snapshot).where(F.col("marker") == INSERT).drop("marker")


def overlay(base: DataFrame, delta: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``src, edge_type, dst`` of a base image (no timestamps) under a delta log whose deletes hide base edges."""
    newest = latest(delta, snapshot)
    kept = base.select(*KEY).distinct().join(newest.select(*KEY), KEY, "left_anti")
    return kept.union(newest.where(F.col("marker") == INSERT).select(*KEY))
