"""Aggregations that the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def argmax(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; the order should end in a unique column."""
    return df.withColumn("nth row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth row") == 1).drop("nth row")


def zero_preserving_count(groups: DataFrame, members: DataFrame, keys: list[str], counted: str, name: str) -> DataFrame:
    """Every group with its number of matching members, also 0."""
    return groups.join(members, keys, "left").groupBy(*groups.columns).agg(F.count(counted).alias(name))


def adjacency(edges: DataFrame) -> DataFrame:
    """``src, edge_type, neighbors``: each neighbour once, newest first, then by id; with the stats of the build."""
    newest = edges.groupBy("src", "edge_type", "dst").agg(F.max("ts").alias("ts"), F.count("*").alias("records"))
    return newest.groupBy("src", "edge_type").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("ts")).alias("age"), "dst"))), lambda x: x["dst"]).alias("neighbors"),
        F.sum("records").alias("records"), (F.sum("records") - F.count("*")).alias("duplicates"),
    )


def adjacency_to_edges(lists: DataFrame) -> DataFrame:
    """The edges of adjacency lists, with timestamps that give the same order again."""
    return lists.select("src", "edge_type", F.size("neighbors").alias("n"), F.posexplode("neighbors").alias("at", "dst")).select("src", "dst", "edge_type", (F.col("n") - F.col("at")).cast("long").alias("ts"))


def segment_stats(edges: DataFrame, keys: list[str]) -> DataFrame:
    """What a segment's header holds: sources, label and type if there is one only (else 0), ranges and count."""
    label = F.shiftrightunsigned("src", 56).cast("int")
    single = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(0)
    return edges.groupBy(*keys).agg(
        F.count_distinct("src").alias("sources"), single(label).alias("src_label"), single(F.col("edge_type")).alias("single_type"),
        F.min("src").alias("min_src"), F.max("src").alias("max_src"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count("*").alias("edges"),
    )
