"""A graph: vertex frames and edge frames, all lazy."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from .model import Relation


@dataclass(frozen=True)
class Graph:
    """Single-valued relations are columns of the vertex frames; the others are (src, dst[, property]) frames.

    ``knows`` holds both directions as forward rows. Reverse expansion joins on ``dst``.
    """

    vertices: dict[str, DataFrame]
    edges: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        for frames in (object.__getattribute__(self, "vertices"), object.__getattribute__(self, "edges")):
            if name in frames:
                return frames[name]
        raise AttributeError(name)

    @property
    def message(self) -> DataFrame:
        """Posts and comments; a post without content shows its image file."""
        none = F.lit(None).cast("long")
        content = F.when(F.coalesce("content", F.lit("")) == "", F.col("image_file")).otherwise(F.col("content"))
        posts = self.post.select(F.lit("post").alias("kind"), "id", "creation_date", F.coalesce(content, F.lit("")).alias("content"), "creator", "place", "forum", none.alias("reply_of_post"), none.alias("reply_of_comment"))
        comments = self.comment.select(F.lit("comment").alias("kind"), "id", "creation_date", F.coalesce("content", F.lit("")).alias("content"), "creator", "place", none.alias("forum"), "reply_of_post", "reply_of_comment")
        return posts.unionByName(comments)

    def relation(self, relation: Relation) -> DataFrame:
        """Any relation as (src, dst) with external ids; message ends keep their own id spaces."""
        def ends(frame: DataFrame, dst: str, src: str = "id") -> DataFrame:
            return frame.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")

        def edge(name: str) -> DataFrame:
            return self.edges[name].select("src", "dst")

        r = Relation
        frames = {
            r.KNOWS: lambda: edge("knows"),
            r.HAS_CREATOR: lambda: ends(self.post, "creator").union(ends(self.comment, "creator")),
            r.HAS_TAG: lambda: edge("forum_has_tag").union(edge("comment_has_tag")).union(edge("post_has_tag")),
            r.HAS_TYPE: lambda: ends(self.tag, "has_type"),
            r.IS_LOCATED_IN: lambda: ends(self.person, "place").union(ends(self.post, "place")).union(ends(self.comment, "place")).union(ends(self.organisation, "place")),
            r.IS_PART_OF: lambda: ends(self.place, "is_part_of"),
            r.LIKES_COMMENT: lambda: edge("likes_comment"),
            r.LIKES_POST: lambda: edge("likes_post"),
            r.REPLY_OF_COMMENT: lambda: ends(self.comment, "reply_of_comment"),
            r.REPLY_OF_POST: lambda: ends(self.comment, "reply_of_post"),
            r.CONTAINER_OF: lambda: ends(self.post, "id", "forum"),
            r.HAS_MEMBER: lambda: edge("has_member"),
            r.HAS_MODERATOR: lambda: ends(self.forum, "moderator"),
            r.HAS_INTEREST: lambda: edge("has_interest"),
            r.STUDY_AT: lambda: edge("study_at"),
            r.WORK_AT: lambda: edge("work_at"),
            r.IS_SUBCLASS_OF: lambda: ends(self.tag_class, "is_subclass_of"),
        }
        return frames[relation]()

    def with_frames(self, vertices: dict[str, DataFrame] | None = None, edges: dict[str, DataFrame] | None = None) -> Graph:
        return replace(self, vertices={**self.vertices, **(vertices or {})}, edges={**self.edges, **(edges or {})})
