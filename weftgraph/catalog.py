"""Every query of the engine over the star tables, by name.

Parameters are chosen from the data the same way at every scale (the best-connected person and so on), so each query is
one or two small jobs for its parameters and then the query itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import scalars
from .functions.scalars import birthday_in_window, in_window, join_list, minutes_between, split_list
from .graph import Graph
from .metrics import histogram
from .model import Relation, encode_vid, external_id, vertex_label
from .operators.aggregates import adjacency, adjacency_to_edges, argmax, segment_stats, zero_preserving_count
from .operators.closure import root_posts, tag_class_descendants
from .operators.expand import distances, friends, friends_of_friends, in_expand, k_hop, organisations_of, out_expand, residents
from .operators.paths import all_shortest_paths, bfs_levels, pair_weights, shortest_path_length
from .oracles import CLASS, COUNTRY, DAYS, END, LARGE_PART, MAX_DATE, MIN_DATE, MONTH, NAME, PROBED, SEGMENT, START, WRITES, X, Y, YEAR
from .plans import complex_reads as ic, dispatch, short_reads as short, updates
from .session import shared_dir
from .sources import snb_csv, star
from .store import adjacency_cache
from .store.compaction import scores
from .store.config import StoreConfig
from .store.edge_store import EdgeStore
from .store.visibility import overlay, visible
from .streaming import replay
from .validate import difference, validate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Graphs imported as tables, by the folder of the star tables they come from; others are projected as they are read.
IMPORTED: dict[str, Graph] = {}
#: The bench sets a dict, so that its warm-up finds the parameters and its timed runs are the queries alone.
PARAMETERS: dict[tuple, object] | None = None


def load(spark: SparkSession, sf: str) -> Graph:
    return IMPORTED[sf] if sf in IMPORTED else star.load(spark, sf)


def query(f: Query) -> Query:
    QUERIES[f.__name__.removesuffix("_query")] = f
    return f


def _first(df: DataFrame, *order: Column) -> int:
    """The first value; a table without rows gives an id that nobody has."""
    row = df.orderBy(*order).first()
    return -1 if row is None else row[0]


def parameter(find: Callable) -> Callable:
    """Searches anew at every call; while ``PARAMETERS`` is a dict, what has been found for an imported graph is kept there."""

    def found(g: Graph, *args):
        if PARAMETERS is None or g not in IMPORTED.values():
            return find(g, *args)
        key = (id(g), find.__name__, *args)
        if key not in PARAMETERS:
            PARAMETERS[key] = find(g, *args)
        return PARAMETERS[key]

    return found


@parameter
def best_connected(g: Graph) -> int:
    return _first(g.knows.groupBy("src").count(), F.desc("count"), F.col("src"))


@parameter
def farthest_id(g: Graph, person: int) -> int:
    rows = g.person.select("id").join(g.knows.select(F.col("src").alias("id")), "id", "left_semi").where(F.col("id") != person)
    return _first(rows, F.desc(F.abs(F.col("id") - person)), F.col("id"))


def edge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge log of the events: every error deletes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("src"), (F.col("event_id") % 97).alias("dst"), F.lit(1).alias("edge_type"), F.col("event_id").alias("ts"), F.when(F.col("event_type") == "error", 1).otherwise(0).cast("byte").alias("marker"))


# -- the graph ---------------------------------------------------------------------------------------------------------


@query
def graph_person(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf).person


@query
def graph_knows(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf).knows


@query
def graph_message(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf).message


@query
def graph_relation_counts(spark: SparkSession, sf: str) -> DataFrame:
    g, out = load(spark, sf), None
    for r in Relation:
        one = g.relation(r).agg(F.count("*").alias("n")).select(F.lit(r.name).alias("relation"), "n")
        out = one if out is None else out.union(one)
    return out


@query
def vid_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    ids = load(spark, sf).person.select("id", encode_vid(1, "id").alias("vid"))
    return ids.select("id", "vid", vertex_label("vid").alias("label"), external_id("vid").alias("external_id"))


# -- operators ---------------------------------------------------------------------------------------------------------


@query
def expand_out_knows(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return out_expand(friends(g, best_connected(g)), g.knows.select("src", "dst")).select("v", "dst")


@query
def expand_in_creator(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    created = g.message.select("kind", F.col("id").alias("src"), F.col("creator").alias("dst"))
    return in_expand(friends(g, best_connected(g)), created).select("v", F.col("src").alias("id"), "kind")


@query
def expand_with_prop(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return g.has_member.where(F.col("dst") == best_connected(g)).select(F.col("src").alias("forum"), F.col("dst").alias("person"), "join_date")


def _entries(column: str) -> Column:
    """``name,year,place`` of each entry in text order, joined by bars."""
    return F.array_join(F.sort_array(F.transform(column, lambda x: F.concat_ws(",", x["name"], F.when(x["name"] == "", "0").otherwise(x["year"].cast("string")), x["place"]))), "|")


@query
def org_entries(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return organisations_of(g, g.person.select(F.col("id").alias("v")), "work_at", "work_from").select(F.col("v").alias("person"), _entries("entries").alias("companies"))


@query
def k_hop_2(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return k_hop(g, best_connected(g), 2)


@query
def fof(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return friends_of_friends(g, best_connected(g))


@query
def bfs_distance(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return distances(g, best_connected(g), 3)


@query
def bfs_levels_query(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return bfs_levels(g.knows, best_connected(g), depth=4).groupBy("depth").agg(F.count("*").alias("n"))


@query
def shortest_path_length_query(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    p = best_connected(g)
    return spark.range(1).select(F.lit(shortest_path_length(g, p, farthest_id(g, p))).cast("int").alias("shortest_path_length"))


@query
def all_shortest_paths_query(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    p = best_connected(g)
    return all_shortest_paths(g, p, farthest_id(g, p)).select(F.array_join("path", ",").alias("path"))


@query
def pair_weight(spark: SparkSession, sf: str) -> DataFrame:
    return pair_weights(load(spark, sf))


@query
def root_post(spark: SparkSession, sf: str) -> DataFrame:
    return root_posts(load(spark, sf))


@query
def tagclass_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return tag_class_descendants(load(spark, sf), "Thing")


@query
def argmax_like(spark: SparkSession, sf: str) -> DataFrame:
    likes = load(spark, sf).likes_post.select(F.col("src").alias("liker"), F.col("dst").alias("post"), F.col("creation_date").alias("like_date"))
    return argmax(likes, ["liker"], [F.desc("like_date"), F.col("post")])


@query
def zero_preserving_forum_count(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    members = g.has_member.select(F.col("src").alias("forum"), F.col("dst").alias("person"))
    return zero_preserving_count(members, g.post.select("forum", F.col("creator").alias("person"), "id"), ["forum", "person"], "id", "post_count")


@query
def conditional_tag_count(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    tagged = g.post_has_tag.join(g.post.select(F.col("id").alias("src"), "creation_date"), "src")
    return tagged.groupBy(F.col("dst").alias("tag")).agg(F.bool_or(F.col("creation_date") < START).alias("existed_before"), F.count_if(in_window("creation_date", START, DAYS)).alias("in_window"))


@query
def distinct_names_desc(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    named = g.has_interest.join(g.tag.select(F.col("id").alias("dst"), F.split("name", "#")[0].alias("name")), "dst")
    return named.groupBy(F.col("src").alias("person")).agg(join_list(F.sort_array(F.collect_set("name"), False)).alias("names"))


@query
def place_incoming_messages(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    country = g.place.where((F.col("name") == X) & (F.col("type") == "country")).select(F.col("id").alias("place"))
    return g.message.where((F.col("creation_date") >= START) & (F.col("creation_date") < END)).join(country, "place", "left_semi").select("id", "creator")


@query
def xy_residents(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    ids = [r["id"] for r in g.place.where((F.col("type") == "country") & F.col("name").isin(X, Y)).select("id").collect()]  # two rows
    return residents(g, ids)


@query
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    k = load(spark, sf).knows
    have, expected = k.where(F.col("creation_date") < END).select("src", "dst"), k.where(F.col("creation_date") >= START).select("src", "dst")
    return expected.exceptAll(have).select(F.lit("missing").alias("side"), "src", "dst").union(have.exceptAll(expected).select(F.lit("extra"), "src", "dst"))


@query
def birthday_window(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf).person.where(birthday_in_window("birthday", MONTH)).select("id", "birthday")


@query
def minutes_latency(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    rows = g.likes_comment.withColumnRenamed("creation_date", "liked").join(g.comment.select(F.col("id").alias("dst"), "creation_date"), "dst")
    return rows.select("src", "dst", minutes_between("liked", "creation_date").alias("minutes"))


@query
def split_list_query(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf).person.select("id", F.size(split_list("email")).alias("emails"), join_list(split_list("email")).alias("joined"))


@query
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return histogram(spark.read.parquet(f"{sf}/events.parquet").select(F.floor(F.col("value") * 1000).alias("us")), "us")


# -- the edge store ----------------------------------------------------------------------------------------------------


@query
def adjacency_build(spark: SparkSession, sf: str) -> DataFrame:
    return adjacency(edge_log(spark, sf)).select("src", "edge_type", F.array_join("neighbors", ",").alias("neighbors"), "records", "duplicates")


@query
def segment_stats_query(spark: SparkSession, sf: str) -> DataFrame:
    return segment_stats(edge_log(spark, sf).withColumn("bucket", F.col("src") % 4), ["bucket"])


@query
def visibility_merge_latest(spark: SparkSession, sf: str) -> DataFrame:
    return visible(edge_log(spark, sf))


@query
def visibility_merge_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    log = edge_log(spark, sf)
    return visible(log, log.agg(F.max("ts")).first()[0] // 2)


def _filled(spark: SparkSession, sf: str, pieces: int = 4, config: StoreConfig | None = None) -> EdgeStore:
    """A store with the log in ``pieces`` segments of level 0."""
    store, log = EdgeStore.create(spark, shared_dir(spark, "store"), config), edge_log(spark, sf)
    for i in range(pieces):
        store._add(log.where(F.col("ts") % pieces == i))
    return store


@query
def typed_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    store = _filled(spark, sf)
    return store.neighbors(_first(store.log().groupBy("src").count(), F.desc("count"), F.col("src")), 1)


@query
def compaction_preserves(spark: SparkSession, sf: str) -> DataFrame:
    store = _filled(spark, sf)
    store.compact()
    return EdgeStore.open(spark, store.path).scan()


@query
def neighbors_overlay(spark: SparkSession, sf: str) -> DataFrame:
    base = load(spark, sf).knows.select("src", F.lit(1).alias("edge_type"), "dst")
    return overlay(base, edge_log(spark, sf))


def labelled_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log with sources of two labels and edges of three types, most of them of the first."""
    kind = F.when(F.col("ts") % 10 < 7, 1).when(F.col("ts") % 10 < 9, 2).otherwise(3)
    return edge_log(spark, sf).select(encode_vid(F.col("src") % 2 + 1, "src").alias("src"), "dst", kind.alias("edge_type"), "ts", "marker")


def _segments(spark: SparkSession, store: EdgeStore) -> DataFrame:
    """The manifest as rows."""
    return spark.createDataFrame([asdict(s) for s in store.segments], "name string, level int, src_label int, edge_type int, min_src long, max_src long, min_ts long, max_ts long, edges long, sources long")


@query
def l0_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """What a graph-aware flush makes of the log: large (label, type) pairs have parts of their own."""
    store = EdgeStore.create(spark, shared_dir(spark, "store"), StoreConfig(graph_aware_l0=True, min_l0_partition_bytes=32 * LARGE_PART, segment_target_bytes=32 * SEGMENT))
    store._add(labelled_log(spark, sf))
    rows = _segments(spark, store).withColumn("part", F.regexp_extract("name", "/part=([0-9]+)/", 1).cast("int"))
    return rows.groupBy(F.col("src_label").alias("label"), "part").agg(F.sum("edges").alias("edges"), F.sum("sources").alias("sources"), F.min("min_src").alias("min_src"), F.max("max_src").alias("max_src"))


@query
def segment_layout(spark: SparkSession, sf: str) -> DataFrame:
    """A bulk append in several files, none of which shares a source with another."""
    store = EdgeStore.create(spark, shared_dir(spark, "store"), StoreConfig(segment_target_bytes=32 * SEGMENT))
    store.append(edge_log(spark, sf).select("src", "dst", "edge_type", "ts"), order=["ts"])
    files = spark.read.parquet(*[f"{store.path}/segments/{s.name}" for s in store.segments]).select("src", F.col("_metadata.file_path").alias("file")).distinct()
    cut = files.groupBy("src").count().where("count > 1").agg(F.count("*").alias("cut_sources"))
    return _segments(spark, store).agg(F.sum("edges").alias("edges"), F.sum("sources").alias("sources"), (F.count("*") > 1).alias("several")).join(cut)


@query
def store_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Single inserts and tombstones, half of them flushed, the rest read from the buffer."""
    store = EdgeStore.create(spark, shared_dir(spark, "store"))
    rows = edge_log(spark, sf).where(F.col("ts") < WRITES).orderBy("ts").collect()  # a fixed number of first writes, one call each
    for i, r in enumerate(rows):
        (store.delete_edge if r["marker"] else store.insert_edge)(r["src"], r["dst"], r["edge_type"])
        if i == WRITES // 2:
            store.flush()
    return store.scan().select("src", "dst", "edge_type", "ts")


@query
def compact_partition(spark: SparkSession, sf: str) -> DataFrame:
    """A targeted compaction: levels afterwards, and that every edge is still seen."""
    store = EdgeStore.create(spark, shared_dir(spark, "store"), StoreConfig(graph_aware_l0=True, min_l0_partition_bytes=0))
    log = labelled_log(spark, sf)
    for i in range(2):
        store._add(log.where(F.col("ts") % 2 == i))
    store.compact_partition(1, 2)
    levels = _segments(spark, store).groupBy(F.col("src_label").alias("label"), "edge_type", "level").agg(F.count("*").alias("segments"))
    seen = store.scan().groupBy(vertex_label("src").alias("label"), "edge_type").agg(F.count("*").alias("edges"))
    return levels.join(seen, ["label", "edge_type"])


@query
def compaction_score(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the ranges of four sources after a lookup of each, over four segments of level 0."""
    store = _filled(spark, sf, 4, StoreConfig(l0_ra_range_bucket_size=4, l0_ra_min_queries=1))
    for src in range(PROBED):
        store.neighbors(src, 1, measure=True)
    found = [(part.range_start, round(value, 6)) for part, value in scores(store.segments, store._probes, store.config)]
    return spark.createDataFrame(found, "range_start long, score double")


@query
def adjacency_cache_query(spark: SparkSession, sf: str) -> DataFrame:
    """The visible edges as lists, built from a store, persisted and read again; and back to edges."""
    store, target = _filled(spark, sf), shared_dir(spark, "lists")
    adjacency_cache.save(store, target)
    return adjacency_to_edges(adjacency_cache.load(spark, target, store)).select("src", "dst", "edge_type", "ts")


@query
def bucket_floor(spark: SparkSession, sf: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("id"), encode_vid(3, F.col("o_orderkey") * 1_000_003).alias("vid"))
    return ids.select("id", scalars.bucket_floor("vid", 1 << 20).alias("bucket"))


def _update_files(spark: SparkSession, sf: str) -> str:
    """Likes as update lines in two files, the second the larger one."""
    folder = shared_dir(spark, "updates")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.concat_ws("|", F.lit("0"), F.lit("0"), F.lit(str(updates.LIKE_POST)), F.col("l_suppkey") % 50, F.col("l_orderkey") % 200, F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("value"))
    for name, part in (("a", F.col("l_linenumber") == 2), ("b", F.col("l_linenumber") != 2)):
        lines.where(part).orderBy("l_orderkey", "l_linenumber").select("value").coalesce(1).write.text(f"{folder}/{name}")  # a test file of a fixed order
    return folder


def _likes(log: DataFrame) -> DataFrame:
    return updates.new_edges(log)["likes_post"].groupBy("src", "dst").agg(F.max_by("creation_date", "seq").alias("creation_date"), F.count("*").alias("n"))


@query
def update_batch(spark: SparkSession, sf: str) -> DataFrame:
    folder = _update_files(spark, sf)
    return _likes(replay.read_batch(spark, f"{folder}/b", f"{folder}/a"))


@query
def update_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the stream, a file a trigger."""
    folder, log = _update_files(spark, sf), shared_dir(spark, "log")
    replay.replay(spark, f"{folder}/*", log, shared_dir(spark, "replay"), 1).awaitTermination()
    return _likes(replay.read_log(spark, log))


@query
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The star graph written as CSV files and imported: rows of each frame, and those that differ."""
    g, root = load(spark, sf), shared_dir(spark, "csv")
    snb_csv.export(g, root)
    again, out = snb_csv.import_full(spark, root, shared_dir(spark, "tables")), None
    for have, want in ((again.vertices, g.vertices), (again.edges, g.edges)):
        for name in have:
            same = F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "extra").alias("extra")
            one = difference(have[name].select(want[name].columns), want[name]).agg(*same).join(have[name].agg(F.count("*").alias("n"))).select(F.lit(name).alias("frame"), "n", "missing", "extra")
            out = one if out is None else out.union(one)
    return out


@query
def dispatch_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Requests by their parameters, answered as JSON rows, and golden lines with an update between them."""
    g = load(spark, sf)
    p = best_connected(g)
    friend = {"personIdSQ3": p}
    rows = dispatch.rows(dispatch.run(g, friend))
    lines = [json.dumps(friend) + "|" + json.dumps(rows), json.dumps({"person1Id": p, "person2Id": NEW, "creationDate": 5}) + '|"-1"', json.dumps(friend) + "|[]", "no bar"]
    report = validate(g, lines)
    return spark.createDataFrame([(p, len(rows), report.checked, report.passed, report.updated, report.failed)], "person long, friends long, checked long, passed long, updated long, failed long")


NEW = 5_000_000_000


@query
def iu_apply_batch(spark: SparkSession, sf: str) -> DataFrame:
    """All eight updates with new ids, some twice: the size of each frame they change, and its new rows."""
    g = load(spark, sf)
    person = {"personId": NEW, "firstName": "A", "lastName": "B", "gender": "female", "birthday": 0, "creationDate": 1, "locationIp": "", "browserUsed": "", "cityId": 1000, "language": "en", "email": "", "tagIds": [1, 2], "studyAt": [{"organizationId": 1, "classYear": 2000}], "workAt": [{"organizationId": 2, "workFromYear": 2001}]}
    post = {"postId": NEW, "imageFile": "", "creationDate": 1, "locationIp": "", "browserUsed": "", "language": "en", "content": "x", "length": 1, "authorPersonId": NEW, "forumId": NEW, "countryId": 1, "tagIds": [1]}
    comment = {"commentId": NEW, "creationDate": 2, "locationIp": "", "browserUsed": "", "content": "y", "length": 1, "authorPersonId": NEW, "countryId": 1, "replyToPostId": NEW, "replyToCommentId": -1, "tagIds": [4]}
    ops = [
        (1, person), (4, {"forumId": NEW, "forumTitle": "F", "creationDate": 1, "moderatorPersonId": NEW, "tagIds": [3]}), (6, post), (7, comment), (2, {"personId": NEW, "postId": NEW, "creationDate": 3}),
        (3, {"personId": NEW, "commentId": NEW, "creationDate": 4}), (5, {"forumId": NEW, "personId": NEW, "joinDate": 5}), (8, {"person1Id": NEW, "person2Id": 1, "creationDate": 6}),
        (1, person | {"lastName": "C"}), (2, {"personId": NEW, "postId": NEW, "creationDate": 2}), (5, {"forumId": NEW, "personId": NEW, "joinDate": 9}),  # the last one wins
    ]
    after, out = updates.apply(g, updates.log_of(spark, ops)), None
    shown = {"person": ["id", "first_name", "last_name", "gender", "birthday", "creation_date", "place", "language"], "post": ["id", "creation_date", "content", "creator", "forum", "place"], "comment": ["id", "creation_date", "content", "creator", "place", "reply_of_post", "reply_of_comment"], "forum": ["id", "title", "moderator"]}
    for name in (*shown, *updates.new_edges(updates.log_of(spark, ops))):
        df = getattr(after, name)
        columns, mine = shown.get(name, df.columns), (F.col("id") == NEW) if name in shown else (F.col("src") == NEW) | (F.col("dst") == NEW)
        row = F.when(mine, F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]))
        one = df.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(row)), ";").alias("new_rows")).select(F.lit(name).alias("frame"), "n", "new_rows")  # a few new rows
        out = one if out is None else out.union(one)
    return out


# -- complex reads -----------------------------------------------------------------------------------------------------


@parameter
def hottest_tag(g: Graph) -> str:
    hot = _first(g.post_has_tag.groupBy("dst").count(), F.desc("count"), F.col("dst"))
    name = g.tag.where(F.col("id") == hot).first()
    return name["name"] if name else ""


@parameter
def most_liked(g: Graph) -> int:
    liked = g.comment.join(g.likes_comment.select(F.col("dst").alias("id")).distinct(), "id", "left_semi").groupBy("creator").count()
    return _first(liked, F.desc("count"), F.col("creator"))


@parameter
def friend_of_writers(g: Graph) -> int:
    written = g.comment.groupBy(F.col("creator").alias("dst")).agg(F.count("*").alias("n"))
    return _first(g.knows.join(written, "dst").groupBy("src").agg(F.sum("n").alias("n")), F.desc("n"), F.col("src"))


@query
def ic1(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    rows = ic.ic1(g, best_connected(g), NAME)
    return rows.withColumns({"friend_emails": join_list("friend_emails"), "friend_languages": join_list("friend_languages"), "friend_universities": _entries("friend_universities"), "friend_companies": _entries("friend_companies")})


@query
def ic2(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return ic.ic2(g, best_connected(g), MAX_DATE)


@query
def ic3(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return ic.ic3(g, best_connected(g), X, Y, START, DAYS)


@query
def ic4(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return ic.ic4(g, best_connected(g), START, DAYS)


@query
def ic5(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return ic.ic5(g, best_connected(g), MIN_DATE)


@query
def ic6(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return ic.ic6(g, best_connected(g), hottest_tag(g))


@query
def ic7(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return ic.ic7(g, most_liked(g))


@query
def ic8(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return ic.ic8(g, best_connected(g))


@query
def ic9(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return ic.ic9(g, best_connected(g), MAX_DATE)


@query
def ic10(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return ic.ic10(g, best_connected(g), MONTH)


@query
def ic11(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return ic.ic11(g, best_connected(g), COUNTRY, YEAR)


@query
def ic12(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return ic.ic12(g, friend_of_writers(g), CLASS).withColumn("tag_names", join_list("tag_names"))


@query
def ic13(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    p = best_connected(g)
    return ic.ic13(g, p, farthest_id(g, p))


@query
def ic14(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    p = best_connected(g)
    return ic.ic14(g, p, farthest_id(g, p)).withColumn("person_ids_in_path", F.array_join("person_ids_in_path", ","))


# -- short reads -------------------------------------------------------------------------------------------------------


@parameter
def first_reply(g: Graph) -> int:
    return _first(g.comment.where("reply_of_comment is not null").select("id"), F.col("id"))


@parameter
def busiest_commenter(g: Graph) -> int:
    return _first(g.comment.groupBy("creator").count(), F.desc("count"), F.col("creator"))


@parameter
def most_answered(g: Graph) -> int:
    return _first(g.comment.where("reply_of_comment is not null").groupBy("reply_of_comment").count(), F.desc("count"), F.col("reply_of_comment"))


@query
def is1(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return short.is1(g, best_connected(g))


@query
def is2(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return short.is2(g, busiest_commenter(g))


@query
def is3(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return short.is3(g, best_connected(g))


@query
def is4(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return short.is4(g, first_reply(g))


@query
def is5(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return short.is5(g, first_reply(g))


@query
def is6(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return short.is6(g, first_reply(g))


@query
def is7(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf)
    return short.is7(g, most_answered(g))
