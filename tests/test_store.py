import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.aggregates import adjacency, adjacency_to_edges
from weftgraph.store import adjacency_cache
from weftgraph.store.compaction import Partition, Probe, overlaps, pick, score
from weftgraph.store.config import StoreConfig
from weftgraph.store.edge_store import EdgeStore, Segment
from weftgraph.store.visibility import overlay, visible


def pairs(df):
    return [r["dst"] for r in df.collect()]


def test_reopen_and_scan(spark, tmp_path):
    s = EdgeStore.create(spark, f"file://{tmp_path}/s")
    for a, b in ((1, 2), (1, 3), (2, 1)):
        s.insert_edge(a, b, 1)
    s.flush()
    s = EdgeStore.open(spark, f"file://{tmp_path}/s")
    assert pairs(s.neighbors(1)) == [2, 3] and s.scan().count() == 3 and s.snapshot() == 3


def test_tombstone_and_snapshot(spark, tmp_path):
    s = EdgeStore.create(spark, f"file://{tmp_path}/s")
    before = s.insert_edge(1, 2, 1)
    s.delete_edge(1, 2, 1)
    s.delete_edge(8, 9, 1)
    assert pairs(s.neighbors(1)) == []  # of the buffer
    s.flush()
    assert pairs(s.neighbors(1)) == [] and pairs(s.neighbors(1, 1, before)) == [2]


def test_compaction_preserves(spark, tmp_path):
    s = EdgeStore.create(spark, f"file://{tmp_path}/s")
    for i in range(20):
        s.insert_edge(7, i, 1)
        if i % 5 == 4:
            s.flush()
    assert len(pairs(s.neighbors(7))) == 20
    assert s.compact() == 4 and s.stats()["levels"] == {1: 1}
    assert len(pairs(EdgeStore.open(spark, s.path).neighbors(7))) == 20
    assert s.vacuum() == 4 and len(pairs(s.neighbors(7))) == 20


def test_history(spark, tmp_path):
    for retain, expected in ((True, [2]), (False, [])):
        s = EdgeStore.create(spark, f"file://{tmp_path}/{retain}")
        before = s.insert_edge(1, 2, 1)
        s.flush()
        s.delete_edge(1, 2, 1)
        s.compact(retain)
        assert pairs(s.neighbors(1, 1, before)) == expected


def test_layout_and_targeted_compaction(spark, tmp_path):
    s = EdgeStore.create(spark, f"file://{tmp_path}/s", StoreConfig(graph_aware_l0=True, min_l0_partition_bytes=320, l0_ra_min_queries=2, l0_ra_min_score=0.0))
    person, post = 1 << 56, 3 << 56
    for part in range(2):
        rows = [(person + i, i + 100 * part, 1) for i in range(20)] + [(post + i, i, 3) for i in range(20)] + [(person, 5, 14)]
        s.append(spark.createDataFrame(rows, "src long, dst long, edge_type int"), order=["src", "dst"])
    kinds = {(x.src_label, x.edge_type) for x in s.segments}
    assert {(1, 1), (3, 3), (1, 14)} == kinds
    assert pairs(s.neighbors(person, 1)) == [0, 100]
    for _ in range(3):
        s.neighbors(person + 3, 1)
    s.neighbors(post, 3)
    part, value = s.compact_best()
    assert part.src_label == 1 and value > 0
    assert {x.level for x in s.segments if x.src_label == 3} == {0}
    assert pairs(s.neighbors(person + 3, 1)) == [3, 103] and s.scan().count() == 61
    assert s.compact_partition(3, 3) == 2 and pairs(s.neighbors(post + 1, 3)) == [1]


def test_score_and_overlap():
    assert score(10, 4.0, 0.5, 0) == 60.0 and score(10, 0.0, 0.0, 2 << 20) == 5.0
    a = Segment("a", 0, 1, 1, 0, 10, 1, 2, 3, 1)
    assert overlaps(a, Partition(0, 0, None, None)) and overlaps(a, Partition(1, 0, 10, 5)) and not overlaps(a, Partition(2, 1, None, None)) and not overlaps(a, Partition(1, 1, 11, 5))
    assert pick([a], {Partition(1, 1, 0, 16): Probe(20, 20, 0)}, StoreConfig()) is None  # one segment
    b = Segment("b", 0, 1, 1, 0, 10, 1, 2, 3, 1)
    assert pick([a, b], {Partition(1, 1, 0, 16): Probe(20, 40, 10)}, StoreConfig()) == (Partition(1, 1, 0, 16), 50.0)


def test_adjacency(spark):
    log = spark.createDataFrame([(1, 10, 7, 1), (1, 11, 7, 2), (1, 10, 7, 3), (1, 12, -7, 4), (2, 20, 7, 5)], "src long, dst long, edge_type int, ts long")
    rows = {(r["src"], r["edge_type"]): r for r in adjacency(log).collect()}
    assert rows[1, 7]["neighbors"] == [10, 11] and rows[1, -7]["neighbors"] == [12] and len(rows) == 3
    assert sum(r["records"] for r in rows.values()) == 5 and sum(r["duplicates"] for r in rows.values()) == 1
    again = adjacency(adjacency_to_edges(adjacency(log)))
    assert {(r["src"], r["edge_type"]): r["neighbors"] for r in again.collect()} == {k: r["neighbors"] for k, r in rows.items()}


@pytest.mark.parametrize("seed", range(3))
def test_visibility_against_a_dict(spark, seed):
    rng, log, model = random.Random(seed), [], {}
    snapshot, at = 150, {}
    for ts in range(1, 301):
        key, marker = (rng.randrange(5), rng.randrange(2), rng.randrange(6)), int(rng.random() < 0.4)
        log.append((key[0], key[2], key[1], ts, marker))
        model[key] = marker
        if ts <= snapshot:
            at[key] = marker
    df = spark.createDataFrame(log, "src long, dst long, edge_type int, ts long, marker int").repartition(5)
    for s, expected in ((None, model), (snapshot, at)):
        assert {(r["src"], r["edge_type"], r["dst"]) for r in visible(df, s).collect()} == {k for k, m in expected.items() if not m}


def test_overlay_hides_deleted_base_edges(spark):
    base = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 1, 3)], "src long, edge_type int, dst long")
    delta = spark.createDataFrame([(1, 3, 1, 1, 1), (1, 4, 1, 2, 0)], "src long, dst long, edge_type int, ts long, marker int")
    assert sorted(r["dst"] for r in overlay(base, delta).collect()) == [2, 4]
    assert overlay(base, delta.where(F.lit(False))).count() == 2


def test_no_source_is_cut(spark, tmp_path):
    """Ranges of sources, as many files as the target size and the cap ask for."""
    rows = [(1, i, 1) for i in range(3000)] + [(s, 1, 1) for s in range(2, 5000)]
    edges = spark.createDataFrame(rows, "src long, dst long, edge_type int")
    for cap, least, most in ((128, 4, 8), (2, 2, 2)):
        s = EdgeStore.create(spark, f"file://{tmp_path}/{cap}", StoreConfig(segment_target_bytes=1000 * 32, max_l0_segments_per_flush=cap))
        s.append(edges, order=["src", "dst"])
        assert least <= len(s.segments) <= most and sum(x.edges for x in s.segments) == len(rows) and sum(x.sources for x in s.segments) == 4999
        ends = sorted((x.min_src, x.max_src) for x in s.segments)
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
        assert s.neighbors(1).count() == 3000 and s.neighbors(4999).count() == 1
        assert s.compact() == len(ends) and s.scan().count() == len(rows)


def test_parts_are_cut_on_their_own(spark, tmp_path):
    """A part below the target size is one file, however large the flush; larger ones are cut, within the cap on files."""
    sizes = {(1, 1): 900, (1, 2): 700, (3, 3): 800, (3, 4): 2500}
    rows = [((label << 56) + i, i, kind) for (label, kind), n in sizes.items() for i in range(n)]
    edges = spark.createDataFrame(rows, "src long, dst long, edge_type int").repartition(3, "dst")
    for cap, cut in ((128, 3), (5, 2), (4, 1), (1, 1)):
        s = EdgeStore.create(spark, f"file://{tmp_path}/{cap}", StoreConfig(graph_aware_l0=True, min_l0_partition_bytes=0, segment_target_bytes=1000 * 32, max_l0_segments_per_flush=cap))
        s.append(edges)
        found = {k: [x for x in s.segments if (x.src_label, x.edge_type) == k] for k in sizes}
        assert {k: len(v) for k, v in found.items()} == {(1, 1): 1, (1, 2): 1, (3, 3): 1, (3, 4): cut} and len(s.segments) == 3 + cut
        assert all(sum(x.edges for x in v) == sum(x.sources for x in v) == sizes[k] for k, v in found.items())
        ends = sorted((x.min_src, x.max_src) for x in found[3, 4])
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:])) and max(x.edges for x in found[3, 4]) <= 2500 // cut + 3
        assert pairs(s.neighbors((3 << 56) + 1700, 4)) == [1700]
        assert s.compact_partition(3, 4) == cut and {x.level for x in s.segments if x.edge_type != 4} == {0} and s.scan().count() == len(rows)


def test_probes_outlive_the_process(spark, tmp_path):
    config = StoreConfig(l0_ra_min_queries=3, l0_ra_min_score=0.0)
    s = EdgeStore.create(spark, f"file://{tmp_path}/s", config)
    for i in range(3):
        s.append(spark.createDataFrame([(0, i, 1), (9, i, 1)] + [(5, 1, 1)] * (i == 1), "src long, dst long, edge_type int"))
    for _ in range(4):
        assert pairs(s.neighbors(5, 1, measure=True)) == [1]
    s.save_probes()
    again = EdgeStore.open(spark, s.path, config)
    (x,) = again.partition_metrics()
    assert (x["queries"], x["candidates"], x["misses"], x["avg_candidates"]) == (4, 12, 8, 3.0)
    part, value = again.compact_best()
    assert abs(value - 4 * 3 * (1 + 8 / 12)) < 1e-9 and again.stats()["levels"] == {1: 1} and EdgeStore.open(spark, s.path, config).compact_best() is None


def test_adjacency_cache(spark, tmp_path):
    s = EdgeStore.create(spark, f"file://{tmp_path}/s")
    at = f"file://{tmp_path}/lists"
    with pytest.raises(ValueError):
        adjacency_cache.load(spark, at)
    for dst in (7, 8, 7):
        s.insert_edge(1, dst, 2)
    s.delete_edge(1, 8, 2)
    s.flush()
    assert adjacency_cache.save(s, at)["edges"] == 1
    assert [(r["src"], r["edge_type"], r["neighbors"]) for r in adjacency_cache.load(spark, at, s).collect()] == [(1, 2, [7])]
    s.insert_edge(1, 9, 2)
    s.flush()
    with pytest.raises(ValueError):
        adjacency_cache.load(spark, at, s)
    assert adjacency_cache.save(s, at)["groups"] == 1 and adjacency_cache.load(spark, at, s).first()["neighbors"] == [9, 7]


def test_buffer_is_sent_once(spark, tmp_path):
    s = EdgeStore.create(spark, f"file://{tmp_path}/s")
    s.insert_edge(1, 2, 1)
    assert s._buffered() is s._buffered()
    before = s._buffered()
    s.insert_edge(1, 3, 1)
    assert s._buffered() is not before and pairs(s.neighbors(1)) == [2, 3]
