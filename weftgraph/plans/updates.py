"""The eight updates as an append-only log of (seq, op, fields) and its application to a graph.

The fields of an operation are strings in the order of the update files. Vertices: the last row of an id wins. Edges: an
edge is there once, with the property of its last insertion. Applying a log is one union and one aggregation a frame.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import id_list, optional_id, org_year_list
from ..graph import Graph
from ..model import EDGES, VERTICES

LOG_SCHEMA = "seq long, op int, fields array<string>"
ADD_PERSON, LIKE_POST, LIKE_COMMENT, ADD_FORUM, ADD_MEMBER, ADD_POST, ADD_COMMENT, ADD_FRIEND = range(1, 9)
#: Fields of each operation in file order; lists end in [].
FIELDS = {
    ADD_PERSON: "personId firstName lastName gender birthday creationDate locationIp browserUsed cityId language email tagIds[] studyAt[] workAt[]",
    LIKE_POST: "personId postId creationDate",
    LIKE_COMMENT: "personId commentId creationDate",
    ADD_FORUM: "forumId forumTitle creationDate moderatorPersonId tagIds[]",
    ADD_MEMBER: "forumId personId joinDate",
    ADD_POST: "postId imageFile creationDate locationIp browserUsed language content length authorPersonId forumId countryId tagIds[]",
    ADD_COMMENT: "commentId creationDate locationIp browserUsed content length authorPersonId countryId replyToPostId replyToCommentId tagIds[]",
    ADD_FRIEND: "person1Id person2Id creationDate",
}


def to_fields(op: int, params: dict) -> list[str]:
    """The fields of a request's parameters; missing strings and lists are empty, missing replies are no id."""
    out = []
    for name in FIELDS[op].split():
        key = name.removesuffix("[]")
        value = params.get(key)
        if name in ("studyAt[]", "workAt[]"):
            year = "classYear" if key == "studyAt" else "workFromYear"
            out.append(";".join(f"{x['organizationId']},{x[year]}" for x in value or []))
        elif name.endswith("[]"):
            out.append(";".join(map(str, value or [])))
        elif key in ("replyToPostId", "replyToCommentId"):
            out.append("" if value is None or int(value) < 0 else str(value))
        else:
            out.append("" if value is None else str(value))
    return out


def log_of(spark: SparkSession, operations: Iterable[tuple[int, dict]], first_seq: int = 0) -> DataFrame:
    """A log of a few requests, in order."""
    return spark.createDataFrame([(first_seq + i, op, to_fields(op, params)) for i, (op, params) in enumerate(operations)], LOG_SCHEMA)


def _field(i: int, kind: str = "string"):
    c = F.get("fields", F.lit(i))
    return c if kind == "string" else F.nullif(F.trim(c), F.lit("")).cast(kind)


def new_vertices(log: DataFrame) -> dict[str, DataFrame]:
    """The rows that the log adds to person, forum, post and comment, with their seq."""
    def rows(op: int, name: str, take: dict) -> DataFrame:
        return log.where(F.col("op") == op).select("seq", *[c.cast(VERTICES[name][n].dataType).alias(n) for n, c in take.items()])

    long = lambda i: _field(i, "long")
    return {
        "person": rows(ADD_PERSON, "person", {"id": long(0), "first_name": _field(1), "last_name": _field(2), "gender": _field(3), "birthday": long(4), "creation_date": long(5), "location_ip": _field(6), "browser_used": _field(7), "place": long(8), "language": _field(9), "email": _field(10)}),
        "forum": rows(ADD_FORUM, "forum", {"id": long(0), "title": _field(1), "creation_date": long(2), "moderator": long(3)}),
        "post": rows(ADD_POST, "post", {"id": long(0), "image_file": _field(1), "creation_date": long(2), "location_ip": _field(3), "browser_used": _field(4), "language": _field(5), "content": _field(6), "length": long(7), "creator": long(8), "forum": long(9), "place": long(10)}),
        "comment": rows(ADD_COMMENT, "comment", {"id": long(0), "creation_date": long(1), "location_ip": _field(2), "browser_used": _field(3), "content": _field(4), "length": long(5), "creator": long(6), "place": long(7), "reply_of_post": optional_id(_field(8)), "reply_of_comment": optional_id(_field(9))}),
    }


def new_edges(log: DataFrame) -> dict[str, DataFrame]:
    """The rows that the log adds to the edge frames, with their seq."""
    def pairs(op: int, prop: str, swapped: bool = False) -> DataFrame:
        one = log.where(F.col("op") == op).select("seq", _field(0, "long").alias("src"), _field(1, "long").alias("dst"), _field(2, "long").alias(prop))
        return one.union(one.select("seq", "dst", "src", prop)) if swapped else one

    def listed(op: int, at: int) -> DataFrame:
        return log.where(F.col("op") == op).select("seq", _field(0, "long").alias("src"), F.explode(id_list(_field(at))).alias("dst"))

    def organisations(at: int, prop: str) -> DataFrame:
        one = log.where(F.col("op") == ADD_PERSON).select("seq", _field(0, "long").alias("src"), F.explode(org_year_list(_field(at))).alias("x"))
        return one.select("seq", "src", F.col("x.org").alias("dst"), F.col("x.year").alias(prop))

    return {
        "knows": pairs(ADD_FRIEND, "creation_date", swapped=True), "likes_post": pairs(LIKE_POST, "creation_date"), "likes_comment": pairs(LIKE_COMMENT, "creation_date"), "has_member": pairs(ADD_MEMBER, "join_date"),
        "has_interest": listed(ADD_PERSON, 11), "forum_has_tag": listed(ADD_FORUM, 4), "post_has_tag": listed(ADD_POST, 11), "comment_has_tag": listed(ADD_COMMENT, 10),
        "study_at": organisations(12, "class_year"), "work_at": organisations(13, "work_from"),
    }


def apply(g: Graph, log: DataFrame) -> Graph:
    """The graph after the log; the order of the log's rows doesn't matter, only their seq."""
    vertices, edges = {}, {}
    for name, fresh in new_vertices(log).items():
        columns = VERTICES[name].names
        both = g.vertices[name].select(*columns, F.lit(-1).cast("long").alias("seq")).unionByName(fresh.where("id is not null"))
        last = both.groupBy("id").agg(F.max_by(F.struct(*columns[1:]), "seq").alias("x"))
        vertices[name] = last.select("id", *[f"x.{c}" for c in columns[1:]])
    for name, fresh in new_edges(log).items():
        prop = EDGES[name]
        both = g.edges[name].withColumn("seq", F.lit(-1).cast("long")).unionByName(fresh.where("src is not null and dst is not null"))
        if prop:
            edges[name] = both.groupBy("src", "dst").agg(F.max_by(prop[0], "seq").cast(prop[1]).alias(prop[0]))
        else:
            edges[name] = both.select("src", "dst").distinct()
    return g.with_frames(vertices, edges)


def touched(log: DataFrame) -> DataFrame:
    """``frame, n``: how many rows the log adds to each frame."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("frame"), "n") for name, df in {**new_vertices(log), **new_edges(log)}.items()]
    return reduce(DataFrame.union, parts)
