"""The seven short reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph
from ..operators.closure import root_posts
from .complex_reads import replies_to


def message(g: Graph, message_id: int) -> DataFrame:
    """One row: the post of that id, else the comment."""
    return g.message.where(F.col("id") == message_id).orderBy(F.desc("kind")).limit(1)


def with_roots(g: Graph, messages: DataFrame) -> DataFrame:
    """The messages (kind, id, ...) with ``root_post``; comments without a root go."""
    posts = messages.where("kind = 'post'").withColumn("root_post", F.col("id"))
    comments = messages.where("kind = 'comment'")
    return posts.unionByName(comments.join(root_posts(g, comments.select("id")), "id"))


def is1(g: Graph, person: int) -> DataFrame:
    return g.person.where(F.col("id") == person).select("first_name", "last_name", "birthday", "location_ip", "browser_used", F.col("place").alias("city_id"), "gender", "creation_date")


def is2(g: Graph, person: int, limit: int = 10) -> DataFrame:
    """The person's latest messages with the post at the root of each and its author; rows lacking any go first."""
    mine = with_roots(g, g.message.where(F.col("creator") == person).select("kind", "id", "creation_date", "content"))
    authors = g.post.select(F.col("id").alias("root_post"), F.col("creator").alias("author")).join(g.person.select(F.col("id").alias("author"), "first_name", "last_name"), "author")
    rows = mine.join(authors, "root_post").orderBy(F.desc("creation_date"), "id").limit(min(limit, 10))
    return rows.select(
        F.col("id").alias("message_id"), F.col("content").alias("message_content"), F.col("creation_date").alias("message_creation_date"), F.col("root_post").alias("original_post_id"),
        F.col("author").alias("original_post_author_id"), F.col("first_name").alias("original_post_author_first_name"), F.col("last_name").alias("original_post_author_last_name"),
    )


def is3(g: Graph, person: int) -> DataFrame:
    """Friends with the date of the friendship, latest first."""
    rows = g.knows.where(F.col("src") == person).join(g.person.select(F.col("id").alias("dst"), "first_name", "last_name"), "dst")
    return rows.select(F.col("dst").alias("person_id"), "first_name", "last_name", F.col("creation_date").alias("friendship_creation_date")).orderBy(F.desc("friendship_creation_date"), "person_id")


def is4(g: Graph, message_id: int) -> DataFrame:
    return message(g, message_id).select(F.col("creation_date").alias("message_creation_date"), F.col("content").alias("message_content"))


def is5(g: Graph, message_id: int) -> DataFrame:
    m = message(g, message_id).select(F.col("creator").alias("person_id"))
    return m.join(g.person.select(F.col("id").alias("person_id"), "first_name", "last_name"), "person_id").select("person_id", "first_name", "last_name")


def is6(g: Graph, message_id: int) -> DataFrame:
    """The forum of the message's root post and its moderator."""
    root = with_roots(g, message(g, message_id).select("kind", "id"))
    forum = root.join(g.post.select(F.col("id").alias("root_post"), F.col("forum")), "root_post").join(g.forum.select(F.col("id").alias("forum"), "title", "moderator"), "forum")
    rows = forum.join(g.person.select(F.col("id").alias("moderator"), "first_name", "last_name"), "moderator")
    return rows.select(F.col("forum").alias("forum_id"), F.col("title").alias("forum_title"), F.col("moderator").alias("moderator_id"), F.col("first_name").alias("moderator_first_name"), F.col("last_name").alias("moderator_last_name"))


def is7(g: Graph, message_id: int) -> DataFrame:
    """Direct replies, latest first, and whether each author is a friend of the message's."""
    m = message(g, message_id).select("kind", "id", "creator")
    replies = replies_to(g, m).select(F.col("id").alias("comment_id"), F.col("content").alias("comment_content"), F.col("creation_date").alias("comment_creation_date"), F.col("creator").alias("reply_author_id"))
    known = m.select(F.col("creator").alias("src")).join(g.knows.select("src", "dst"), "src").select(F.col("dst").alias("reply_author_id"), F.lit(True).alias("knows")).distinct()
    rows = replies.join(g.person.select(F.col("id").alias("reply_author_id"), F.col("first_name").alias("reply_author_first_name"), F.col("last_name").alias("reply_author_last_name")), "reply_author_id")
    rows = rows.join(known, "reply_author_id", "left").select("comment_id", "comment_content", "comment_creation_date", "reply_author_id", "reply_author_first_name", "reply_author_last_name", F.coalesce("knows", F.lit(False)).alias("is_known"))
    return rows.orderBy(F.desc("comment_creation_date"), "reply_author_id", "comment_id")
