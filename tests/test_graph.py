import json
import os
import threading
import urllib.request

import pytest
import snb
from pyspark.sql import functions as F

from weftgraph import __main__ as cli, validate
from weftgraph.functions import scalars
from weftgraph.metrics import Metrics, percentile
from weftgraph.model import Relation, encode_vid, vertex_label
from weftgraph.operators.closure import root_posts, tag_class_descendants
from weftgraph.operators.paths import shortest_path_length, weighted_paths
from weftgraph.plans import complex_reads as ic, dispatch, short_reads as short, updates
from weftgraph.server import GraphServer
from weftgraph.sources import snb_csv
from weftgraph.streaming import replay


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return snb.write(str(tmp_path_factory.mktemp("snb")))


@pytest.fixture(scope="module")
def g(spark, root, tmp_path_factory):
    return snb_csv.import_full(spark, root, f"file://{tmp_path_factory.mktemp('tables')}")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_loader(spark, g, root):
    assert sorted(rows(g.knows, "src", "dst")) == [(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3)]  # no self loop
    assert rows(g.person.where("id = 9"), "first_name") == ["New"]  # the last row of an id
    assert sorted(rows(g.comment, "id", "reply_of_post", "reply_of_comment")) == [(11, 1, None), (12, None, 11), (13, None, 12), (14, None, 99)]
    assert rows(g.place.where("id = 10"), "is_part_of") == [None]
    path = f"{root}/dynamic/forum_hasTag_tag_0_0.csv"
    assert snb_csv.import_stats(spark, path) == snb_csv.ImportStats(2, 1)
    assert rows(snb_csv.named_edges(spark, path, "Tag.id", "Forum.id"), "src", "dst") == [(1, 1)]
    assert snb_csv.labelled_edges(g).count() == sum(g.relation(r).count() for r in Relation)
    with pytest.raises(KeyError):
        snb_csv.column(["a"], "b")


def test_missing_required_id_fails(spark, tmp_path):
    where = snb.write(str(tmp_path))
    with open(tmp_path / "static/tag_0_0.csv", "a") as f:
        f.write("|noid|u|1\n")
    with pytest.raises(Exception, match="tag.id is missing"):
        snb_csv.vertices(spark, where, "tag").count()


def test_reads(g):
    first = ic.ic1(g, 1, "Ann").collect()
    assert [(r.friend_id, r.distance_from_person, r.friend_city_name) for r in first] == [(3, 2, "X")]
    assert [tuple(x) for x in first[0].friend_companies] == [("Acme", 2005, "X")] and [tuple(x) for x in first[0].friend_universities] == [("Uni", 2001, "yb")]
    dan = ic.ic1(g, 1, "Dan").collect()[0]
    assert [tuple(x) for x in dan.friend_companies] == [("", 0, "")] and dan.friend_emails == ["d@x"]
    assert ic.ic1(g, 77, "Ann").count() == 0  # unknown start
    assert rows(ic.ic2(g, 1, 4000), "message_id", "message_content") == [(12, "c2"), (1, "pic")]
    assert rows(ic.ic9(g, 1, 4000), "message_id") == [11, 2, 1]
    assert ic.ic3(g, 1, "X", "Y", 0, 1).count() == 0 and rows(ic.ic3(g, 4, "nowhere", "Y", 0, 1), "person_id") == []
    assert rows(ic.ic4(g, 1, 500, 1), "tag_name", "post_count") == [("chess", 1), ("jazz", 1), ("rock", 1)]
    assert rows(ic.ic4(g, 1, 2000, 1), "tag_name") == ["chess"]  # the others were there before
    assert rows(ic.ic5(g, 1, 50), "forum_title", "post_count") == [("F one", 1), ("F two", 0)]
    assert rows(ic.ic6(g, 1, "jazz"), "tag_name", "post_count") == [("rock", 1)]
    assert rows(ic.ic7(g, 2), "person_id", "message_id", "minutes_latency", "is_new") == [(3, 12, 1, False), (1, 1, 0, False)]
    assert rows(ic.ic8(g, 2), "comment_id") == [13, 11]
    assert rows(ic.ic10(g, 1, 1), "person_id", "common_interest_score", "person_city_name") == [(3, 1, "X")]
    assert ic.ic10(g, 4, 1).count() == 0  # no interests
    assert rows(ic.ic11(g, 1, "X", 2005), "person_id", "organization_work_from_year") == [(2, 1999)]
    assert rows(ic.ic12(g, 2, "Thing"), "person_id", "tag_names", "reply_count") == [(3, ["rock", "jazz"], 1)]
    assert rows(ic.ic13(g, 1, 4), "shortest_path_length") == [3] and shortest_path_length(g, 1, 5) == -1 and shortest_path_length(g, 77, 77) == 0
    assert rows(ic.ic14(g, 1, 4), "person_ids_in_path", "path_weight") == [([1, 2, 3, 4], 0.5 + 1.5)]
    assert weighted_paths(g, 1, 5).count() == 0 and rows(weighted_paths(g, 5, 5), "path", "weight") == [([5], 0.0)]
    assert rows(short.is1(g, 2), "city_id") == [12] and short.is1(g, 77).count() == 0
    assert rows(short.is2(g, 1), "message_id", "original_post_id") == [(13, 1)]  # the lost comment has no root
    assert rows(short.is3(g, 2), "person_id") == [3, 1] and rows(short.is4(g, 1), "message_content") == ["pic"]
    assert rows(short.is5(g, 12), "person_id") == [2] and rows(short.is6(g, 13), "forum_id", "moderator_id") == [(1, 1)]
    assert rows(short.is7(g, 11), "comment_id", "is_known") == [(12, True)]


def test_closures(spark, g):
    assert sorted(rows(root_posts(g), "id", "root_post")) == [(11, 1), (12, 1), (13, 1)]
    chain = spark.range(1, 41).selectExpr("id", "if(id = 1, 7, null) as reply_of_post", "if(id > 1, id - 1, null) as reply_of_comment")
    ring = spark.createDataFrame([(100, None, 101), (101, None, 100)], "id long, reply_of_post long, reply_of_comment long")
    found = root_posts(g.with_frames({"comment": chain.union(ring)}))
    assert sorted(rows(found, "id")) == list(range(1, 41))
    assert sorted(rows(tag_class_descendants(g, "Thing"), "id")) == [1, 2, 3]


def test_long_reply_chains(spark, g):
    chain = spark.range(1, 1102).selectExpr("id", "if(id = 1, 7, null) as reply_of_post", "if(id > 1, id - 1, null) as reply_of_comment").coalesce(1)
    found = root_posts(g.with_frames({"comment": chain}), spark.createDataFrame([(1101,), (5,)], "id long").coalesce(1))
    assert sorted(rows(found, "id", "root_post")) == [(5, 7), (1101, 7)]


def test_deep_tag_classes(spark, g):
    ring = spark.range(67).selectExpr("id", "if(id = 0, 'top', 'x') as name", "if(id = 0, 66, id - 1) as is_subclass_of").coalesce(1)
    assert sorted(rows(tag_class_descendants(g.with_frames({"tag_class": ring}), "top"), "id")) == list(range(67))


OPS = [
    (updates.ADD_PERSON, {"personId": 20, "firstName": "Flo", "lastName": "F", "birthday": 0, "creationDate": 5, "cityId": 11, "language": "en", "email": "", "tagIds": [1, 3], "studyAt": [{"organizationId": 2, "classYear": 2010}], "workAt": []}),
    (updates.ADD_FRIEND, {"person1Id": 20, "person2Id": 1, "creationDate": 900}),
    (updates.LIKE_POST, {"personId": 20, "postId": 2, "creationDate": 9}),
    (updates.LIKE_POST, {"personId": 20, "postId": 2, "creationDate": 10}),
    (updates.LIKE_COMMENT, {"personId": 20, "commentId": 11, "creationDate": 11}),
    (updates.ADD_FORUM, {"forumId": 30, "forumTitle": "F new", "creationDate": 3, "moderatorPersonId": 20, "tagIds": []}),
    (updates.ADD_MEMBER, {"forumId": 30, "personId": 20, "joinDate": 12}),
    (updates.ADD_POST, {"postId": 40, "content": "new", "creationDate": 13, "authorPersonId": 20, "forumId": 30, "countryId": 1, "length": 3, "tagIds": [2]}),
    (updates.ADD_COMMENT, {"commentId": 41, "content": "re", "creationDate": 14, "authorPersonId": 1, "countryId": 1, "length": 2, "replyToPostId": 40}),
]


def test_updates(spark, g):
    after = updates.apply(g, updates.log_of(spark, OPS))
    assert rows(after.likes_post.where("src = 20"), "dst", "creation_date") == [(2, 10)]  # once, with the last date
    assert sorted(rows(after.has_interest.where("src = 20"), "dst")) == [1, 3] and rows(after.study_at.where("src = 20"), "class_year") == [2010]
    assert sorted(rows(after.knows.where("src = 20 or dst = 20"), "src", "dst")) == [(1, 20), (20, 1)]
    assert rows(after.comment.where("id = 41"), "reply_of_post", "reply_of_comment") == [(40, None)]
    assert rows(short.is6(after, 41), "forum_id") == [30] and after.person.count() == g.person.count() + 1
    counts = {r["frame"]: r["n"] for r in updates.touched(updates.log_of(spark, OPS)).collect()}
    assert counts["knows"] == 2 and counts["person"] == 1 and counts["post_has_tag"] == 1


def _lines():
    return ["|".join(["0", "0", str(op), *updates.to_fields(op, p)]) for op, p in OPS]


def test_streamed_log_equals_batch(spark, g, tmp_path):
    (tmp_path / "in").mkdir()
    lines = _lines()
    (tmp_path / "in" / "updateStream_0_0_forum.csv").write_text("\n".join(lines[:5]) + "\nshort|line\n")
    (tmp_path / "in" / "updateStream_0_0_person.csv").write_text("\n".join(lines[5:]) + "\n0|0|99|x\n")
    q = replay.replay(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/log", f"file://{tmp_path}/check", 1)
    q.awaitTermination()
    log = replay.read_log(spark, f"file://{tmp_path}/log")
    assert log.count() == len(OPS) == log.select("seq").distinct().count()
    batch = replay.read_batch(spark, f"file://{tmp_path}/in")
    a, b = updates.apply(g, log), updates.apply(g, batch)
    for name in ("person", "post", "comment", "forum", "knows", "has_interest", "has_member"):
        assert sorted(map(str, getattr(a, name).collect())) == sorted(map(str, getattr(b, name).collect()))


def test_dispatch_and_validation(spark, g):
    assert dispatch.read_of({"personIdQ2": 1}) == "ic2" and dispatch.read_of({"person1IdQ13StartNode": 1}) == "ic13"
    assert [dispatch.update_of(p) for _, p in OPS] == [op for op, _ in OPS]
    assert dispatch.parse_query_list("is, ic2,ic2") == [f"is{i}" for i in range(1, 8)] + ["ic2"] and len(dispatch.parse_query_list("read")) == 21
    with pytest.raises(ValueError):
        dispatch.parse_query_list("ic15")
    with pytest.raises(KeyError):
        dispatch.read_of({"x": 1})
    golden = [
        json.dumps({"personIdSQ3": 2}) + "|" + json.dumps([{"personId": 3, "firstName": "Ann", "lastName": "C", "friendshipCreationDate": 200}, {"personId": 1, "firstName": "Ann", "lastName": "A", "friendshipCreationDate": 100}]),
        "no bar here",
        json.dumps({"person1Id": 2, "person2Id": 5, "creationDate": 400}) + '|"-1"',
        json.dumps({"person1IdQ13StartNode": 1, "person2IdQ13EndNode": 5}) + "|" + json.dumps({"shortestPathLength": 2}),
        json.dumps({"messageIdContent": 2}) + "|" + json.dumps({"messageCreationDate": 2000, "messageContent": "wrong"}),
    ]
    report = validate.validate(g, golden)
    assert (report.checked, report.passed, report.updated, report.failed) == (3, 2, 1, 1)
    only = validate.validate(g, golden, ["is3"])
    assert (only.checked, only.skipped) == (1, 2) and (report + only).checked == 4
    assert validate.values_equal("ic14", [{"pathWeight": 1.0, "personIdsInPath": [1, 3]}, {"pathWeight": 1.0, "personIdsInPath": [1, 2]}], [{"pathWeight": 1.0, "personIdsInPath": [1, 2]}, {"pathWeight": 1.0, "personIdsInPath": [1, 3]}])


def test_server(g):
    server = GraphServer(g)
    http = server.serve(port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{http.server_port}"

    def post(path, body):
        return json.load(urllib.request.urlopen(urllib.request.Request(at + path, json.dumps(body).encode(), method="POST")))

    assert post("/query/interactive_complex_read_13", {"person1Id": 1, "person2Id": 4}) == {"shortestPathLength": 3}
    post("/query/interactive_update_8", {"person1Id": 1, "person2Id": 4, "creationDate": 1})
    assert post("/query/interactive_complex_read_13", {"person1Id": 1, "person2Id": 4}) == {"shortestPathLength": 1}
    for path, method, status in (("/query/none", "POST", 500), ("/x", "GET", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(at + path, b"{}" if method == "POST" else None, method=method))
        assert e.value.code == status
    assert json.load(urllib.request.urlopen(at + "/"))["status"] == "ok" and server.metrics.counters["http_error"] == 1
    assert post("/query/interactive_short_read_4", {"messageId": 2}) == {"content": "hello", "creationDate": 2000} and post("/query/interactive_short_read_4", {"messageId": 999}) is None
    assert {"friendId", "firstName", "lastName", "messageId", "content", "creationDate"} == set(post("/query/interactive_complex_read_2", {"personId": 2, "maxDate": 10**12})[0])
    (friend, *_) = post("/query/interactive_complex_read_1", {"personId": 1, "firstName": "Ann"})
    assert set(friend) == {"personId", "lastName", "distance", "birthday", "creationDate", "gender", "browserUsed", "locationIp", "email", "language", "cityName", "universities", "companies"}
    assert isinstance(friend["email"], str) and all(isinstance(x, list) and len(x) == 3 for x in friend["universities"] + friend["companies"])
    http.shutdown()


def test_server_plans_do_not_grow(g, monkeypatch):
    monkeypatch.setattr("weftgraph.server.KEPT_UPDATES", 3)
    server, sizes = GraphServer(g), []
    for i in range(5):
        server.handle("/query/interactive_update_8", {"person1Id": 1, "person2Id": 100 + i, "creationDate": i})
        sizes.append(len(server.graph.knows._jdf.queryExecution().analyzed().toString()))
    assert sizes[1] < 1.2 * sizes[0] and sizes[2] < sizes[0] and server.graph.knows.where("src = 1 and dst >= 100").count() == 5


def test_replay_in_file_order(spark, tmp_path):
    """The name of a file decides, neither its size nor the trigger that reads it."""
    (tmp_path / "in").mkdir()
    like = lambda date: f"0|0|2|1|2|{date}"
    (tmp_path / "in" / "u_a.csv").write_text("\n".join([like(50), like(100)]))
    (tmp_path / "in" / "u_b.csv").write_text("\n".join(["0|0|2|9|9|1"] * 500 + [like(150), like(200)]))
    os.utime(tmp_path / "in" / "u_b.csv", (1e9, 1e9))  # the first name is the newer file
    batch = replay.read_batch(spark, f"file://{tmp_path}/in")
    replay.replay(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/log", f"file://{tmp_path}/cp", 1).awaitTermination()
    log = replay.read_log(spark, f"file://{tmp_path}/log")
    for rows in (batch, log):
        assert rows.count() == rows.select("seq").distinct().count() == 504
        assert rows.where("fields[0] = '1'").orderBy("seq").select(F.col("fields")[2]).toPandas().iloc[:, 0].tolist() == ["50", "100", "150", "200"]


def test_failed_import_leaves_the_graph(spark, g, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/tables"
    with pytest.raises(ValueError):
        snb_csv.open_tables(spark, at)
    snb_csv.save(g, at)
    before = snb_csv.open_tables(spark, at).knows.count()
    broken = g.with_frames({}, {"work_at": g.work_at.select("src", "dst", F.raise_error(F.lit("broken")).cast("int").alias("work_from"))})
    with pytest.raises(Exception, match="broken"):
        snb_csv.save(broken, at)
    snb_csv.save_edge_properties(g, at)
    again = snb_csv.open_tables(spark, at)
    assert again.knows.count() == before and again.work_at.count() == g.work_at.count() and again.person.count() == g.person.count()


def test_metrics():
    m = Metrics()
    for us in (10, 2500, 80_000):
        m.record("q", us)
    m.add("n", 2)
    x = m.latency("q")
    assert (x["count"], x["min_us"], x["max_us"], x["p50_us"], x["p90_us"], x["p99_us"]) == (3, 10, 80_000, 5000, 100_000, 100_000)
    m.reset()
    assert m.summary() == {"counters": {}, "endpoints": {}} and m.latency("q")["count"] == 0 and percentile({}, 0.5) == 0


def test_scalars(spark):
    one = spark.range(1).select(
        scalars.utc_date(F.lit(-1).cast("long")).cast("string").alias("before"), scalars.minutes_between(F.lit(-90_000), F.lit(0)).alias("minutes"), F.size(scalars.split_list(F.lit(""))).alias("none"), scalars.split_list(F.lit("a;b")).alias("two"),
        scalars.id_list(F.lit("1;-1;x;3")).alias("ids"), scalars.org_year_list(F.lit("1,2000;2;x,1")).alias("orgs"), scalars.optional_id(F.lit("-1")).alias("no"), scalars.bucket_floor(F.lit(37), 16).alias("bucket"), scalars.bucket_floor(F.lit((1 << 56) + (1 << 20) - 1), 1 << 20).alias("large"), vertex_label(encode_vid(8, F.lit(5))).alias("label"),
        scalars.birthday_in_window(F.lit(29_462_400_000), 12).alias("dec"), scalars.birthday_in_window(F.lit(0), 12).alias("jan"),
    ).first()
    assert one["before"] == "1969-12-31" and one["minutes"] == -1 and one["none"] == 0 and one["two"] == ["a", "b"] and one["ids"] == [1, 3]
    assert [tuple(x) for x in one["orgs"]] == [(1, 2000)] and one["no"] is None and one["bucket"] == 32 and one["large"] == 1 << 56 and one["label"] == 8 and not one["dec"] and one["jan"]


def test_command_line(spark, root, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    tables, store = f"file://{tmp_path}/tables", f"file://{tmp_path}/store"
    assert cli.main(["import", root, tables])["knows"] == 6
    assert cli.main(["import-edges", tables, store])["edges"] > 30
    assert cli.main(["validate-knows", root, store]) == {}
    assert cli.main(["query", tables, '{"messageIdContent": 2}']) == [{"messageCreationDate": 2000, "messageContent": "hello"}]
    assert [x["dst"] & 255 for x in cli.main(["neighbors", store, str((1 << 56) + 2), "--edge-type", "1"])] == [1, 3]
    assert cli.main(["compact", store]) > 0 and cli.main(["stats", store])["levels"].keys() == {1}
    assert cli.main(["storage-bench", store, "--samples", "2"])["sources"] > 0 and len(cli.main(["scan", store, "--limit", "3"])) == 3
    (tmp_path / "u.csv").write_text("\n".join(_lines()))
    cli.main(["apply-updates", tables, f"file://{tmp_path}/u.csv", f"file://{tmp_path}/after"])
    (tmp_path / "golden").write_text(json.dumps({"person1IdQ13StartNode": 20, "person2IdQ13EndNode": 2}) + '|{"shortestPathLength": 2}')
    assert cli.main(["validate", f"file://{tmp_path}/after", f"file://{tmp_path}/golden"])["passed"] == 1
