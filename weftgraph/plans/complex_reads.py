"""The fourteen complex reads. Each returns a lazy DataFrame; ic1 and the path queries first search level by level.

Every query starts at a bound vertex, filters before it joins, keeps the top rows by a total order and only then looks
up names (rows whose target is missing are dropped after the limit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import add_days, birthday_in_window, in_window, minutes_between, split_list
from ..graph import Graph
from ..operators.aggregates import argmax
from ..operators.closure import tag_class_descendants
from ..operators.expand import friends, friends_of_friends, k_hop, organisations_of, residents
from ..operators.paths import bfs_levels, shortest_path_length, weighted_paths

_NAMES = ("first_name", "last_name")


def _names(g: Graph, rows: DataFrame, key: str = "person_id", prefix: str = "person_", more: tuple[str, ...] = ()) -> DataFrame:
    p = g.person.select(F.col("id").alias(key), *[F.col(c).alias(prefix + c) for c in (*_NAMES, *more)])
    return rows.join(p, key)


def _top(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def _exists(g: Graph, person: int) -> DataFrame:
    return g.person.where(F.col("id") == person).select(F.lit(True).alias("start exists"))


def _guard(g: Graph, person: int, df: DataFrame) -> DataFrame:
    """An unknown start person has no result."""
    return df.join(F.broadcast(_exists(g, person).limit(1)), how="cross").drop("start exists")  # one row


def ic1(g: Graph, person: int, first_name: str, limit: int = 20) -> DataFrame:
    """Persons of a first name within three steps, with their profile."""
    named = g.person.where(F.col("first_name") == first_name)
    levels = bfs_levels(g.knows, person, 3, named.select(F.col("id").alias("v")).where(F.col("v") != person), limit)  # no level after the one that fills the limit
    near = levels.where("depth > 0").withColumnRenamed("depth", "distance").join(named.select(F.col("id").alias("v"), "last_name"), "v")
    near = _top(near, limit, F.col("distance"), F.col("last_name"), F.col("v")).select("v", "distance")
    uni, job = (organisations_of(g, near, r, y).withColumnRenamed("entries", n) for r, y, n in (("study_at", "class_year", "universities"), ("work_at", "work_from", "companies")))
    rows = near.join(named.withColumnRenamed("id", "v"), "v").join(uni, "v").join(job, "v")
    rows = rows.join(g.place.select(F.col("id").alias("place"), F.col("name").alias("city")), "place", "left")
    out = rows.select(
        F.col("v").alias("friend_id"), F.col("last_name").alias("friend_last_name"), F.col("distance").alias("distance_from_person"), F.col("birthday").alias("friend_birthday"), F.col("creation_date").alias("friend_creation_date"),
        F.col("gender").alias("friend_gender"), F.col("browser_used").alias("friend_browser_used"), F.col("location_ip").alias("friend_location_ip"), split_list("email").alias("friend_emails"), split_list("language").alias("friend_languages"),
        F.coalesce("city", F.lit("")).alias("friend_city_name"), F.col("universities").alias("friend_universities"), F.col("companies").alias("friend_companies"),
    )
    return _guard(g, person, out).orderBy("distance_from_person", "friend_last_name", "friend_id")


def _messages(g: Graph, persons: DataFrame, date: Column, limit: int) -> DataFrame:
    m = g.message.where(date).select(F.col("id").alias("message_id"), F.col("content").alias("message_content"), F.col("creation_date").alias("message_creation_date"), F.col("creator").alias("person_id"))
    rows = m.join(persons.select(F.col("v").alias("person_id")), "person_id")
    rows = _top(rows, limit, F.desc("message_creation_date"), F.col("message_id"))
    out = _names(g, rows).select("person_id", "person_first_name", "person_last_name", "message_id", "message_content", "message_creation_date")
    return out.orderBy(F.desc("message_creation_date"), "message_id")


def ic2(g: Graph, person: int, max_date: int, limit: int = 20) -> DataFrame:
    """Latest messages of friends up to and including a date."""
    return _guard(g, person, _messages(g, friends(g, person), F.col("creation_date") <= max_date, limit)).orderBy(F.desc("message_creation_date"), "message_id")


def ic3(g: Graph, person: int, country_x: str, country_y: str, start: int, days: int, limit: int = 20) -> DataFrame:
    """Persons within two steps, living in neither country, who wrote from both in a time window."""
    ids = {r["name"]: r["id"] for r in g.place.where((F.col("type") == "country") & F.col("name").isin(country_x, country_y)).select("id", "name").collect()}  # two rows
    x, y = ids.get(country_x, -1), ids.get(country_y, -1)
    near = k_hop(g, person).join(residents(g, [x, y]), "v", "left_anti")
    m = g.message.where(F.col("place").isin(x, y) & in_window("creation_date", start, days)).select("place", F.col("creator").alias("v"))
    counts = m.join(near, "v", "left_semi").groupBy(F.col("v").alias("person_id")).agg(F.count_if(F.col("place") == x).alias("x_count"), F.count_if(F.col("place") == y).alias("y_count"))
    counts = counts.where("x_count > 0 and y_count > 0").withColumn("count", F.col("x_count") + F.col("y_count"))
    rows = _names(g, _top(counts, limit, F.desc("count"), F.col("person_id")))
    return _guard(g, person, rows.select("person_id", "person_first_name", "person_last_name", "x_count", "y_count", "count")).orderBy(F.desc("count"), "person_id")


def ic4(g: Graph, person: int, start: int, days: int, limit: int = 10) -> DataFrame:
    """Tags that friends' posts had in a window and never before."""
    until = F.greatest(F.lit(start), add_days(F.lit(start), days))
    posts = g.post.where(F.col("creation_date") < until).select("id", "creation_date", F.col("creator").alias("v")).join(friends(g, person), "v", "left_semi")
    tagged = posts.join(g.post_has_tag, posts["id"] == F.col("src")).groupBy("dst").agg(F.min("creation_date").alias("first"), F.count_if(F.col("creation_date") >= start).alias("post_count"))
    rows = tagged.where((F.col("first") >= start) & (F.col("post_count") > 0)).join(g.tag.select(F.col("id").alias("dst"), F.col("name").alias("tag_name")), "dst")
    return _guard(g, person, _top(rows.select("tag_name", "post_count"), limit, F.desc("post_count"), F.col("tag_name"))).orderBy(F.desc("post_count"), "tag_name")


def ic5(g: Graph, person: int, min_date: int, limit: int = 20) -> DataFrame:
    """Forums that persons within two steps joined from a date on, by those members' posts in them (0 counts)."""
    members = g.has_member.where(F.col("join_date") >= min_date).join(k_hop(g, person).withColumnRenamed("v", "dst"), "dst", "left_semi").select(F.col("src").alias("forum"), F.col("dst").alias("creator"))
    posts = g.post.select("forum", "creator", "id")
    counts = members.join(posts, ["forum", "creator"], "left").groupBy("forum").agg(F.count("id").alias("post_count"))
    rows = _top(counts, limit, F.desc("post_count"), F.col("forum")).join(g.forum.select(F.col("id").alias("forum"), F.col("title").alias("forum_title")), "forum")
    return _guard(g, person, rows).orderBy(F.desc("post_count"), "forum").select("forum_title", "post_count")


def ic6(g: Graph, person: int, tag_name: str, limit: int = 10) -> DataFrame:
    """Tags that share posts of persons within two steps with a tag."""
    tag = g.tag.where(F.col("name") == tag_name).select(F.col("id").alias("dst"))
    posts = g.post_has_tag.join(tag, "dst", "left_semi").select(F.col("src").alias("id"))
    posts = g.post.select("id", F.col("creator").alias("v")).join(posts, "id", "left_semi").join(k_hop(g, person), "v", "left_semi")
    other = g.post_has_tag.join(posts.select(F.col("id").alias("src")), "src", "left_semi").join(tag, "dst", "left_anti")
    rows = other.groupBy("dst").agg(F.count("*").alias("post_count")).join(g.tag.select(F.col("id").alias("dst"), F.col("name").alias("tag_name")), "dst")
    return _guard(g, person, _top(rows.select("tag_name", "post_count"), limit, F.desc("post_count"), F.col("tag_name"))).orderBy(F.desc("post_count"), "tag_name")


def likes_of(g: Graph, messages: DataFrame) -> DataFrame:
    """``liker, like_date`` and the message columns."""
    parts = [messages.where(F.col("kind") == kind).join(g.edges[edge].select(F.col("src").alias("liker"), F.col("dst").alias("id"), F.col("creation_date").alias("like_date")), "id") for kind, edge in (("post", "likes_post"), ("comment", "likes_comment"))]
    return parts[0].unionByName(parts[1])


def ic7(g: Graph, person: int, limit: int = 20) -> DataFrame:
    """The latest like of each liker of the person's messages; of equally late ones that of the least message id."""
    mine = g.message.where(F.col("creator") == person).select("kind", "id", "creation_date", "content")
    best = argmax(likes_of(g, mine), ["liker"], [F.desc("like_date"), F.col("id"), F.desc("kind")])
    known = best.join(g.person.select(F.col("id").alias("liker")), "liker", "left_semi")
    rows = _top(known, limit, F.desc("like_date"), F.col("liker")).withColumnRenamed("liker", "person_id")
    rows = _names(g, rows).join(friends(g, person).select(F.col("v").alias("person_id"), F.lit(True).alias("friend")), "person_id", "left")
    out = rows.select(
        "person_id", "person_first_name", "person_last_name", F.col("like_date").alias("like_creation_date"), F.col("id").alias("message_id"), F.col("content").alias("message_content"),
        minutes_between("like_date", "creation_date").alias("minutes_latency"), F.col("friend").isNull().alias("is_new"),
    )
    return _guard(g, person, out).orderBy(F.desc("like_creation_date"), "person_id")


def replies_to(g: Graph, messages: DataFrame) -> DataFrame:
    """Comments that answer the messages (kind, id) directly."""
    c = g.comment.select("id", "creation_date", "content", "creator", "reply_of_post", "reply_of_comment")
    posts = messages.where("kind = 'post'").select(F.col("id").alias("reply_of_post"))
    comments = messages.where("kind = 'comment'").select(F.col("id").alias("reply_of_comment"))
    return c.join(posts, "reply_of_post", "left_semi").unionByName(c.join(comments, "reply_of_comment", "left_semi"))


def ic8(g: Graph, person: int, limit: int = 20) -> DataFrame:
    """Latest replies to the person's messages."""
    rows = replies_to(g, g.message.where(F.col("creator") == person).select("kind", "id"))
    rows = _top(rows, limit, F.desc("creation_date"), F.col("id")).select(F.col("creator").alias("person_id"), F.col("creation_date").alias("comment_creation_date"), F.col("id").alias("comment_id"), F.col("content").alias("comment_content"))
    out = _names(g, rows).select("person_id", "person_first_name", "person_last_name", "comment_creation_date", "comment_id", "comment_content")
    return _guard(g, person, out).orderBy(F.desc("comment_creation_date"), "comment_id")


def ic9(g: Graph, person: int, max_date: int, limit: int = 20) -> DataFrame:
    """Latest messages of persons within two steps before a date."""
    return _guard(g, person, _messages(g, k_hop(g, person), F.col("creation_date") < max_date, limit)).orderBy(F.desc("message_creation_date"), "message_id")


def ic10(g: Graph, person: int, month: int, limit: int = 10) -> DataFrame:
    """Friends of friends born around a month, by posts with a common interest less posts without; nobody for a start without interests."""
    interests = g.has_interest.where(F.col("src") == person).select("dst").distinct()
    born = g.person.where(birthday_in_window("birthday", month)).select(F.col("id").alias("v"))
    candidates = friends_of_friends(g, person).join(born, "v", "left_semi")
    candidates = candidates.join(F.broadcast(interests.limit(1).select(F.lit(True).alias("any"))), how="cross").drop("any")  # one row or none
    posts = g.post.select("id", F.col("creator").alias("v")).join(candidates, "v", "left_semi")
    common = g.post_has_tag.join(interests, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    scored = posts.join(common.withColumn("common", F.lit(1)), "id", "left").groupBy("v").agg((2 * F.count("common") - F.count("*")).alias("score"))
    rows = candidates.join(scored, "v", "left").select(F.col("v").alias("person_id"), F.coalesce("score", F.lit(0)).cast("long").alias("common_interest_score"))
    rows = _names(g, _top(rows, limit, F.desc("common_interest_score"), F.col("person_id")), more=("gender", "place"))
    rows = rows.join(g.place.select(F.col("id").alias("person_place"), F.col("name").alias("city")), "person_place", "left")
    out = rows.select("person_id", "person_first_name", "person_last_name", "common_interest_score", "person_gender", F.coalesce("city", F.lit("")).alias("person_city_name"))
    return _guard(g, person, out).orderBy(F.desc("common_interest_score"), "person_id")


def ic11(g: Graph, person: int, country: str, work_from_year: int, limit: int = 10) -> DataFrame:
    """Persons within two steps who work in a country since before a year."""
    places = g.place.where(F.col("name") == country).select(F.col("id").alias("place"))
    orgs = g.organisation.join(places, "place", "left_semi").select(F.col("id").alias("dst"), F.col("name").alias("organization_name"))
    jobs = g.work_at.where(F.col("work_from") < work_from_year).join(orgs, "dst").join(k_hop(g, person).withColumnRenamed("v", "src"), "src", "left_semi")
    jobs = jobs.select(F.col("src").alias("person_id"), "organization_name", F.col("work_from").alias("organization_work_from_year"))
    order = (F.col("organization_work_from_year"), F.col("person_id"), F.desc("organization_name"))
    out = _names(g, _top(jobs, limit, *order)).select("person_id", "person_first_name", "person_last_name", "organization_name", "organization_work_from_year")
    return _guard(g, person, out).orderBy(*order)


def ic12(g: Graph, person: int, tag_class: str, limit: int = 20) -> DataFrame:
    """Friends by their replies to posts with a tag of the class or below; tag names come in descending order."""
    classes = tag_class_descendants(g, tag_class).select(F.col("id").alias("has_type"))
    tags = g.tag.join(classes, "has_type", "left_semi").select(F.col("id").alias("dst"), "name")
    replies = g.comment.where("reply_of_post is not null").select(F.col("id").alias("comment"), F.col("creator").alias("v"), F.col("reply_of_post").alias("src")).join(friends(g, person), "v", "left_semi")
    replies = replies.join(g.post.select(F.col("id").alias("src")), "src", "left_semi")
    tagged = replies.join(g.post_has_tag, "src").join(tags, "dst")
    counts = tagged.groupBy(F.col("v").alias("person_id")).agg(F.sort_array(F.collect_set("name"), False).alias("tag_names"), F.count_distinct("comment").alias("reply_count"))
    out = _names(g, _top(counts, limit, F.desc("reply_count"), F.col("person_id"))).select("person_id", "person_first_name", "person_last_name", "tag_names", "reply_count")
    return _guard(g, person, out).orderBy(F.desc("reply_count"), "person_id")


def ic13(g: Graph, person1: int, person2: int) -> DataFrame:
    """The length of the shortest path; 0 for equal ids, -1 for none."""
    return g.person.sparkSession.range(1).select(F.lit(shortest_path_length(g, person1, person2)).cast("int").alias("shortest_path_length"))


def ic14(g: Graph, person1: int, person2: int) -> DataFrame:
    """All shortest paths with the weight of their interactions, heaviest first, then by path."""
    return weighted_paths(g, person1, person2).select(F.col("path").alias("person_ids_in_path"), F.col("weight").alias("path_weight")).orderBy(F.desc("path_weight"), "person_ids_in_path")
