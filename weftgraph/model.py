"""Labels, relations and vertex schemas of the property graph."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column, functions as F, types as T


class VertexLabel(IntEnum):
    """The high byte of a vertex id; 0 is an unlabelled id."""

    PERSON = 1
    COMMENT = 2
    POST = 3
    FORUM = 4
    ORGANISATION = 5
    PLACE = 6
    TAG = 7
    TAG_CLASS = 8


class Relation(IntEnum):
    """Edge types; a reverse edge is the same row joined on its other end, never a negative type."""

    KNOWS = 1
    HAS_CREATOR = 2
    HAS_TAG = 3
    HAS_TYPE = 4
    IS_LOCATED_IN = 5
    IS_PART_OF = 6
    LIKES_COMMENT = 7
    LIKES_POST = 8
    REPLY_OF_COMMENT = 9
    REPLY_OF_POST = 10
    CONTAINER_OF = 11
    HAS_MEMBER = 12
    HAS_MODERATOR = 13
    HAS_INTEREST = 14
    STUDY_AT = 15
    WORK_AT = 16
    IS_SUBCLASS_OF = 17


INSERT, DELETE = 0, 1
_ID_MASK = (1 << 56) - 1


def encode_vid(label: int | Column, external_id: str | Column) -> Column:
    """The label in the high byte, the external id in the low 56 bits."""
    label = F.lit(int(label)) if isinstance(label, int) else label
    external_id = F.col(external_id) if isinstance(external_id, str) else external_id
    return F.shiftleft(label.cast("long"), 56).bitwiseOR(external_id.cast("long").bitwiseAND(F.lit(_ID_MASK)))


def external_id(vid: str | Column) -> Column:
    return (F.col(vid) if isinstance(vid, str) else vid).bitwiseAND(F.lit(_ID_MASK))


def vertex_label(vid: str | Column) -> Column:
    """The label number; ids out of the label range count as unlabelled (0)."""
    label = F.shiftrightunsigned(vid, 56).cast("int")
    return F.when(label.between(1, 8), label).otherwise(0)


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"long": T.LongType(), "string": T.StringType(), "int": T.IntegerType()}[k]) for n, k in (x.split(":") for x in text.split())])


PERSON = _schema("id:long first_name:string last_name:string gender:string birthday:long creation_date:long location_ip:string browser_used:string place:long language:string email:string")
PLACE = _schema("id:long name:string type:string is_part_of:long")
ORGANISATION = _schema("id:long type:string name:string place:long")
TAG = _schema("id:long name:string has_type:long")
TAG_CLASS = _schema("id:long name:string is_subclass_of:long")
FORUM = _schema("id:long title:string creation_date:long moderator:long")
POST = _schema("id:long image_file:string creation_date:long location_ip:string browser_used:string language:string content:string length:long creator:long forum:long place:long")
COMMENT = _schema("id:long creation_date:long location_ip:string browser_used:string content:string length:long creator:long place:long reply_of_post:long reply_of_comment:long")
VERTICES = {"person": PERSON, "place": PLACE, "organisation": ORGANISATION, "tag": TAG, "tag_class": TAG_CLASS, "forum": FORUM, "post": POST, "comment": COMMENT}
#: Edge frames that aren't columns of a vertex: property name and type, or None.
EDGES = {
    "knows": ("creation_date", "long"), "likes_post": ("creation_date", "long"), "likes_comment": ("creation_date", "long"), "has_member": ("join_date", "long"),
    "study_at": ("class_year", "int"), "work_at": ("work_from", "int"), "has_interest": None, "post_has_tag": None, "comment_has_tag": None, "forum_has_tag": None,
}


def edge_schema(name: str) -> T.StructType:
    prop = EDGES[name]
    return _schema("src:long dst:long" + (f" {prop[0]}:{prop[1]}" if prop else ""))


#: The edge log of the store.
EDGE_LOG = T.StructType([T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False), T.StructField("edge_type", T.IntegerType(), False), T.StructField("ts", T.LongType(), False), T.StructField("marker", T.ByteType(), False)])
