"""Breadth-first search and shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..graph import Graph
from ..session import staged, staged_with
from .closure import COMPACT

UNREACHABLE = -1


def _vertex(spark: SparkSession, v: int) -> DataFrame:
    return spark.range(1).select(F.lit(v).cast("long").alias("v"), F.lit(0).alias("depth"))


class Side:
    """A breadth-first search, level by level: what it has visited as ``v, depth``, and its last level.

    The frontier joins the steps, what has been visited is taken out, the new level is written to the shared folder by
    one job that also says how large it is. The driver sees only that.
    """

    def __init__(self, steps: DataFrame, start: int):
        self._steps = steps  # at, to
        self.visited = self.frontier = staged(_vertex(steps.sparkSession, start), "bfs")
        self.depth, self.size = 0, 1

    def advance(self, wanted: DataFrame | None = None) -> int:
        """Goes one level on; the number of its vertices that are among ``wanted`` (``v``)."""
        self.depth += 1
        ahead = self.frontier.join(self._steps, F.col("v") == F.col("at")).select(F.col("to").alias("v")).distinct()
        level = ahead.join(self.visited.select("v"), "v", "left_anti").withColumn("depth", F.lit(self.depth))
        hit = F.lit(False)
        if wanted is not None:
            level, hit = level.join(wanted.select("v", F.lit(True).alias("wanted")), "v", "left"), F.col("wanted")
        self.frontier, seen = staged_with(level, "bfs", hits=F.count_if(hit))
        self.frontier, self.size = self.frontier.select("v", "depth"), seen["n"]
        self.visited = self.visited.union(self.frontier)
        if self.depth % COMPACT == 0:
            self.visited = staged(self.visited, "bfs-visited")
        return seen["hits"]


def bfs_levels(edges: DataFrame, start: int, depth: int | None = None, wanted: DataFrame | None = None, enough: int = 1) -> DataFrame:
    """``v, depth`` of what is reached from ``start``: all, or down to a depth, or to the level at which ``enough`` of
    the distinct ``wanted`` (``v``) have been met, so that the nearest of those are among them."""
    side, met = Side(edges.select(F.col("src").alias("at"), F.col("dst").alias("to")), start), 0
    while side.size and (depth is None or side.depth < depth) and (wanted is None or met < enough):
        met += side.advance(wanted)
    return side.visited


def _meet(g: Graph, one: int, two: int) -> tuple[Side, Side] | None:
    """Searches from both ends, the smaller level first, that have just met: the length is the sum of their depths.

    Levels are whole, so the first level that meets the other side meets its last level. None if there is no path.
    """
    edges = g.knows
    ahead = Side(edges.select(F.col("src").alias("at"), F.col("dst").alias("to")), one)
    back = Side(edges.select(F.col("dst").alias("at"), F.col("src").alias("to")), two)
    while ahead.size and back.size:
        near, far = (ahead, back) if ahead.size <= back.size else (back, ahead)
        if near.advance(far.frontier):
            return ahead, back
    return None


def shortest_path_length(g: Graph, one: int, two: int) -> int:
    """0 for equal ids, known or not; -1 if there is no path."""
    if one == two:
        return 0
    sides = _meet(g, one, two)
    return UNREACHABLE if sides is None else sides[0].depth + sides[1].depth


def all_shortest_paths(g: Graph, one: int, two: int) -> DataFrame:
    """``path`` (array of ids) of every shortest path; empty if there is none."""
    spark = g.knows.sparkSession
    if one == two:
        return spark.range(1).select(F.array(F.lit(one).cast("long")).alias("path"))
    sides = _meet(g, one, two)
    if sides is None:
        return spark.range(0).select(F.array("id").alias("path"))
    ahead, back = sides
    steps = g.knows.select("src", "dst")
    mids = ahead.visited.where(F.col("depth") == ahead.depth).join(back.visited.where(F.col("depth") == back.depth), "v", "left_semi")
    paths = mids.select(F.array("v").alias("path"), F.col("v").alias("head"), F.col("v").alias("tail"))
    for d in range(ahead.depth - 1, -1, -1):  # only edges between neighbouring levels
        at = ahead.visited.where(F.col("depth") == d).select(F.col("v").alias("src"))
        paths = paths.join(steps.join(at, "src", "left_semi").distinct(), F.col("head") == F.col("dst")).select(F.concat(F.array("src"), "path").alias("path"), F.col("src").alias("head"), "tail")
    for d in range(back.depth - 1, -1, -1):
        at = back.visited.where(F.col("depth") == d).select(F.col("v").alias("dst"))
        paths = paths.join(steps.join(at, "dst", "left_semi").distinct(), F.col("tail") == F.col("src")).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("tail"))
    return paths.select("path")


def pair_weights(g: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """``p1, p2, weight`` (p1 <= p2): 1.0 for each reply to a post of the other, 0.5 for each reply to a comment.

    For ``pairs`` (p1, p2) only their own messages are read: those by a person of a pair, on either side of a reply.
    """
    def by(messages: DataFrame) -> DataFrame:
        if pairs is None:
            return messages
        persons = pairs.select(F.explode(F.array("p1", "p2")).alias("creator")).distinct()
        return messages.join(persons, "creator", "left_semi")

    replies = by(g.comment.select("creator", "reply_of_post", "reply_of_comment"))
    sides = ((g.post, "reply_of_post", 1.0), (g.comment, "reply_of_comment", 0.5))
    parts = [replies.join(by(m.select("id", "creator")).select(F.col("id").alias(key), F.col("creator").alias("other")), key).select(F.least("creator", "other").alias("p1"), F.greatest("creator", "other").alias("p2"), F.lit(w).alias("w")) for m, key, w in sides]
    both = parts[0].union(parts[1])
    if pairs is not None:
        both = both.join(pairs, ["p1", "p2"], "left_semi")
    return both.groupBy("p1", "p2").agg(F.sum("w").alias("weight"))


def weighted_paths(g: Graph, one: int, two: int) -> DataFrame:
    """``path, weight`` of all shortest paths: the sum of the weights of neighbouring pairs."""
    spark = g.knows.sparkSession
    if one == two:
        return spark.range(1).select(F.array(F.lit(one).cast("long")).alias("path"), F.lit(0.0).alias("weight"))
    paths = staged(all_shortest_paths(g, one, two), "paths")
    pairs = paths.select("path", F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as a, path[i] as b))")).alias("x"))
    pairs = pairs.select("path", F.least("x.a", "x.b").alias("p1"), F.greatest("x.a", "x.b").alias("p2"))
    weights = pair_weights(g, pairs.select("p1", "p2").distinct())
    return pairs.join(weights, ["p1", "p2"], "left").groupBy("path").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))
