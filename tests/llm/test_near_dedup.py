import os
import random

import pytest
from brute import components, prose, shingles
from pyspark.sql import functions as F

from weftgraph.llm import near_dedup
from weftgraph.llm.common import connected_components
from weftgraph.llm.near_dedup import drop_near_duplicates, minwise, near_duplicates, shingle_sets


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "new" + str(rng.randrange(10**6))
    return " ".join(words)


def corpus(rng):
    docs, i = {}, 0
    for group in (1, 1, 2, 3, 5, 45):
        base = prose(rng, 150)
        for k in range(group):
            docs[i := i + 3] = edited(rng, base, k % 4)
    passage = prose(rng, 40)
    for _ in range(50):  # a passage that many share is no near copy
        docs[i := i + 3] = passage + " " + prose(rng, 120)
    base = prose(rng, 200)
    for k in range(1, 13):  # on both sides of the threshold
        docs[i := i + 3] = edited(rng, base, k)
    docs |= {9000: docs[3], 9001: docs[3].upper().replace(" ", " \t\n"), 9002: "a b", 9003: "A  B", 9004: "a b c", 9005: "", 9006: None, 9007: " \n", 9008: "", 9009: prose(rng, 9000)}
    return docs


@pytest.mark.parametrize(("leaf", "few"), [(4096, 64), (8, 4), (3, 2)])
def test_against_brute_force(spark, monkeypatch, leaf, few):
    monkeypatch.setattr(near_dedup, "LEAF", leaf)  # small leaves send more nodes down the trees
    monkeypatch.setattr(near_dedup, "FEW", few)
    docs = corpus(random.Random(leaf))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").select("*", F.lit(1).alias("n"), F.lit("x").alias("node"), F.lit(2).alias("rep")).repartition(5)
    got = {r["doc_id"]: r for r in near_duplicates(df).collect()}
    expected = components(docs)
    assert {d: r["component_id"] for d, r in got.items()} == expected
    assert all(r["n_shingles"] == len(shingles(docs[d])) and r["kept"] == (expected[d] == d) for d, r in got.items())
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d in docs if expected[d] == d}


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (2, "v w x y z"), (3, "v w x y z"), (3, "k l m n o"), (5, "k l m n o")], df.schema)  # ids with several texts link what these link
    assert {r["component_id"] for r in near_duplicates(two).collect()} == {1}
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_duplicates(df).collect())
    assert got == [(0, 0, True), (0, 0, True), (2, 2, True), (4, 2, False), (4, 2, False)]
    assert near_duplicates(df.where("false")).count() == 0 and drop_near_duplicates(df).count() == 3


def test_forest():
    """A tile gives fewer links than labels, whatever the number of similar pairs, and asks no more of linked pairs."""
    import numpy as np

    tokens, asked = np.zeros((50, 64), "<u2"), []

    def similar(i, others):
        asked.extend((i, j) for j in others.tolist())
        return others % 2 == i % 2

    links = near_dedup.forest(np.arange(50) + 100, np.full(50, 10), tokens, similar)
    assert sorted(links) == sorted((100 + k % 2, 100 + k) for k in range(2, 50)) and len({tuple(sorted(p)) for p in asked}) == len(asked)
    assert near_dedup.forest(np.full(50, 7), np.full(50, 10), tokens, similar) == []
    assert near_dedup.forest(np.arange(2), np.array([10, 20]), tokens[:2], similar) == []  # sizes alone rule it out


def test_one_against_many():
    """The pass over all of a tile finds what pair by pair comparison finds."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.9 + 0.005 * (k % 20), base, rng.integers(0, 1 << 62, 60).astype(np.uint64))) for k in range(40)]
    tile = near_dedup._Tile(lambda k: sets[k], [(k,) for k in range(40)], np.array([len(x) for x in sets]))
    others = np.arange(1, 40)
    one = np.concatenate([tile.similar(0, others[k : k + 1]) for k in range(39)])
    assert tile._mark is None and 0 < one.sum() < 39
    assert (tile.similar(0, others) == one).all() and tile._mark is not None
    x = set(sets[0].tolist())
    assert one.tolist() == [4 * len(x & set(s.tolist())) >= 3 * len(x | set(s.tolist())) for s in sets[1:]]


def test_sets_and_tokens():
    texts = ["The the THE a b c", "x", "", None, "ä Ä b c d e"]
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts] == [2, 1, 0, 0, 2]
    same = shingle_sets(["one two three four five six", "ONE  two\tthree\nfour five six "])
    assert (same[0] == same[1]).all()
    rng = random.Random(1)
    a, b = (prose(rng, 400) for _ in range(2))
    near = edited(rng, a, 8)
    sa, sn, sb = shingle_sets([a, near, b])
    tokens = minwise([sa, sn, sb])
    j = len(set(sa.tolist()) & set(sn.tolist())) / len(set(sa.tolist()) | set(sn.tolist()))
    assert abs((tokens[0] == tokens[1]).mean() - j) < 0.2 and (tokens[0] == tokens[2]).mean() < 0.1


def test_long_text(spark):
    """A text far longer than a chunk, and its near copy."""
    rng = random.Random(3)
    long = prose(rng, 200_000)
    assert len(long) > 4 * near_dedup.CHUNK
    df = spark.createDataFrame([(5, long), (8, edited(rng, long, 100)), (9, prose(rng, 100_000))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()} == {5: 5, 8: 5, 9: 9}


def test_connected_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(500, i) for i in range(501, 560)]
    some = [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    links = chain + star + some + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in chain + star + [(a, b) for a, b in some if a != b]:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact_components(docs):
    """doc_id -> least id reachable, by an exact prefix-filter join: sets that share 75 % share one of their rarest quarter."""
    from collections import Counter, defaultdict

    sets = {d: shingles(t) for d, t in docs.items()}
    classes = defaultdict(list)
    for d in sorted(sets):
        classes[frozenset(sets[d])].append(d)
    often, index, parent = Counter(x for s in classes for x in s), defaultdict(list), {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for s, ids in classes.items():
        for d in ids if s else []:
            parent[find(d)] = ids[0]
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - (3 * len(s) + 3) // 4 + 1]
        for other in {o for x in rare for o in index[x]}:
            both = len(s & other)
            if 100 * both >= 75 * (len(s) + len(other) - both):
                x, y = sorted((find(ids[0]), find(classes[other][0])))
                parent[y] = x
        for x in rare:
            index[x].append(s)
    least = {}
    for d in sorted(docs):
        least.setdefault(find(d), d)
    return {d: least[find(d)] for d in docs}


def test_given_documents(spark):
    """Recall and precision over all 10,000 documents: every component is the exact one."""
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    df = spark.read.parquet(path)
    expected = exact_components({r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()})
    assert sum(d != c for d, c in expected.items()) > 100
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()} == expected
