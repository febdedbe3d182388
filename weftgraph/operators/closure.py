"""Closures of the reply forest and the tag-class tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph
from ..session import staged, staged_with

ROUNDS = 40
#: After so many levels their union is written as one frame, so that plans don't grow with the depth.
COMPACT = 16


def root_posts(g: Graph, messages: DataFrame | None = None) -> DataFrame:
    """``id, root_post`` of comments (all, or those of ``messages``): the post at the end of the reply chain.

    Pointer doubling: every round replaces a comment's pointer by its target's, so a chain of n replies takes log2(n)
    rounds, each one join on the pointer. Chains that end in a missing comment or run in a circle have no root and
    are left out. For few messages only their own chains are followed, one step a round; those that are longer than
    ``ROUNDS`` are left to pointer doubling.
    """
    links = g.comment.select("id", "reply_of_comment", "reply_of_post")
    if messages is not None:
        return _follow(links, messages)
    return _doubled(links)


def _doubled(links: DataFrame) -> DataFrame:
    parts = [links.where("reply_of_post is not null").select("id", F.col("reply_of_post").alias("root_post"))]
    open_ = links.where("reply_of_post is null and reply_of_comment is not null").select("id", F.col("reply_of_comment").alias("next"))
    for _ in range(ROUNDS):
        done = reduce(DataFrame.union, parts)
        hit = staged(open_.join(done.select(F.col("id").alias("next"), "root_post"), "next").select("id", "root_post"), "roots")
        parts.append(hit)
        jump = open_.select(F.col("id").alias("next"), F.col("next").alias("further"))
        open_, seen = staged_with(open_.join(hit, "id", "left_anti").join(jump, "next").select("id", F.col("further").alias("next")), "roots-open")
        if not seen["n"]:
            break
    return reduce(DataFrame.union, parts)


def _follow(links: DataFrame, messages: DataFrame) -> DataFrame:
    at, hits = messages.select("id", F.col("id").alias("at")), []
    goes_on = "reply_of_post is null and reply_of_comment is not null and reply_of_comment <> id"
    for _ in range(ROUNDS):
        step = at.join(links.select(F.col("id").alias("at"), "reply_of_comment", "reply_of_post"), "at")
        step, seen = staged_with(step.select("id", "reply_of_comment", "reply_of_post"), "chain", open=F.count_if(F.expr(goes_on)))
        hits.append(step.where("reply_of_post is not null").select("id", F.col("reply_of_post").alias("root_post")))
        if not seen["open"]:
            return reduce(DataFrame.union, hits)
        at = step.where(goes_on).select("id", F.col("reply_of_comment").alias("at"))
    ends = _doubled(links).select(F.col("id").alias("at"), "root_post")
    return reduce(DataFrame.union, hits).union(at.join(ends, "at").select("id", "root_post"))


def tag_class_descendants(g: Graph, name: str) -> DataFrame:
    """The ids of the class and of all classes below it, as ``id``."""
    below = g.tag_class.select(F.col("id").alias("child"), F.col("is_subclass_of").alias("of"))
    found, seen = staged_with(g.tag_class.where(F.col("name") == name).select("id").distinct(), "classes")
    at, level = found, 0
    while seen["n"]:  # only new classes go on, so a circle ends
        at = below.join(at, F.col("of") == F.col("id")).select(F.col("child").alias("id")).distinct()
        at, seen = staged_with(at.join(found, "id", "left_anti"), "classes-at")
        found, level = found.union(at), level + 1
        if level % COMPACT == 0:
            found = staged(found, "classes")
    return found
