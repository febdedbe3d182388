"""Neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..graph import Graph


def out_expand(frontier: DataFrame, edges: DataFrame, on: str = "v") -> DataFrame:
    """The frontier's rows with every ``dst`` (and edge property) of their vertex; vertices without edges go."""
    return frontier.join(edges, frontier[on] == edges["src"]).drop("src")


def in_expand(frontier: DataFrame, edges: DataFrame, on: str = "v") -> DataFrame:
    return frontier.join(edges, frontier[on] == edges["dst"]).drop("dst")


def friends(g: Graph, person: int | Column) -> DataFrame:
    """Distinct direct friends as ``v``; the person itself is never one."""
    return g.knows.where(F.col("src") == person).select(F.col("dst").alias("v")).where(F.col("v") != person).distinct()


def k_hop(g: Graph, person: int | Column, hops: int = 2) -> DataFrame:
    """Distinct persons within ``hops`` steps, without the start."""
    levels = [friends(g, person)]
    for _ in range(hops - 1):
        levels.append(out_expand(levels[-1], g.knows.select("src", "dst")).select(F.col("dst").alias("v")))
    return reduce(DataFrame.union, levels).where(F.col("v") != person).distinct()


def friends_of_friends(g: Graph, person: int | Column) -> DataFrame:
    """Exactly two steps away: neither the start nor a friend."""
    direct = friends(g, person)
    return k_hop(g, person, 2).join(direct, "v", "left_anti")


def distances(g: Graph, person: int | Column, hops: int = 3) -> DataFrame:
    """``v, distance`` of all persons within ``hops`` steps, without the start."""
    level, levels = friends(g, person), []
    for d in range(1, hops + 1):
        levels.append(level.withColumn("distance", F.lit(d)))
        level = out_expand(level, g.knows.select("src", "dst")).select(F.col("dst").alias("v")).distinct()
    return reduce(DataFrame.union, levels).where(F.col("v") != person).groupBy("v").agg(F.min("distance").alias("distance"))


def residents(g: Graph, countries: list[int]) -> DataFrame:
    """Persons whose city is part of one of the countries, as ``v``."""
    cities = g.place.where(F.col("is_part_of").isin(countries)).select(F.col("id").alias("place"))
    return g.person.select(F.col("id").alias("v"), "place").join(cities, "place", "left_semi").select("v").distinct()


def organisations_of(g: Graph, persons: DataFrame, relation: str, year: str) -> DataFrame:
    """``v, entries``: the (name, year, place) of a person's organisations; one empty entry for those without any."""
    orgs = g.organisation.select(F.col("id").alias("dst"), F.col("name").alias("org"), "place")
    places = g.place.select(F.col("id").alias("place"), F.col("name").alias("place_name"))
    edges = g.edges[relation].join(persons.select(F.col("v").alias("src")), "src", "left_semi")
    rows = edges.join(orgs, "dst", "left").join(places, "place", "left")
    entry = F.struct(F.coalesce("org", F.lit("")).alias("name"), F.coalesce(year, F.lit(0)).alias("year"), F.coalesce("place_name", F.lit("")).alias("place"))
    lists = rows.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    empty = F.array(F.struct(F.lit("").alias("name"), F.lit(0).alias("year"), F.lit("").alias("place")))
    return persons.select("v").join(lists, "v", "left").select("v", F.coalesce("entries", empty).alias("entries"))
