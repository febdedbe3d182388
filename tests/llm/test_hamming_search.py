import os
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.llm.hamming_search import segments, sign_codes, top_k


def brute(vectors, k, every):
    width = max(len(e) for _, e in vectors if e is not None)
    rows = {v: [x is not None and x >= 0 for x in e + [None] * (width - len(e))] for v, e in vectors if v is not None and e is not None}
    out = {}
    for q in rows:
        if q % every == 0:
            near = sorted((sum(a != b for a, b in zip(rows[q], rows[v])), v) for v in rows if v != q)[:k]
            out[q] = [(i + 1, v, d) for i, (d, v) in enumerate(near)]
    return {q: x for q, x in out.items() if x}


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
    return {q: sorted(x) for q, x in out.items()}


def test_segments_cover_the_code():
    for n in (0, 1, 500, 10**6, 10**12):
        parts = segments(n)
        assert parts[0][:2] == (0, 0) and sum(w for *_, w in parts) == 64 and all(a + w == b for (_, a, w), (_, b, _) in zip(parts, parts[1:]))
        assert len(segments(n, 3)) == 3 * len(parts) and {w for w, *_ in segments(n, 3)} == {0, 1, 2}


@pytest.mark.parametrize("case", ["near", "copies", "few", "wide"])
def test_against_brute_force(spark, case):
    rng = random.Random(case)
    if case == "near":  # neighbours within few bits, so that rounds close before the scan
        base = [[rng.choice((-1.0, 1.0)) for _ in range(64)] for _ in range(20)]
        rows = [(i, [-x if rng.random() < 0.03 else x for x in base[i % 20]]) for i in range(400)]
    elif case == "copies":
        rows = [(i, [1.0] * 64 if i % 3 else [rng.gauss(0, 1) for _ in range(64)]) for i in range(150)]
    elif case == "wide":  # three words, the last not full, and vectors of several lengths
        rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice((130, 130, 64, 20)))]) for i in range(120)]
    else:
        rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(4)]
    rows += [(1000, None), (None, [1.0] * 64), (rows[0][0], rows[0][1]), (1001, [None, -0.0] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("code"), F.lit(2).alias("q"))
    seen = {v: e for v, e in rows if v is not None and e is not None}
    assert result(top_k(df, F.col("vec_id") % 5 == 0, 5)) == brute(list(seen.items()), 5, 5)


def test_queries_close_by_probing(spark):
    """Every round closes what it covers, none compares a query with all codes, and far queries close when they are covered."""
    rng = random.Random(4)
    base = [[rng.choice((-1.0, 1.0)) for _ in range(64)] for _ in range(20)]
    rows = [(i, [-x if rng.random() < 0.02 else x for x in base[i % 20]]) for i in range(400)] + [(1000, [rng.gauss(0, 1) for _ in range(64)])]
    trace = []
    got = result(top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5, trace))
    assert got == brute(rows, 5, 50) and sum(n for _, n in trace) == 9
    assert [r for r, _ in trace] == list(range(len(trace))) and sum(n for _, n in trace[:2]) >= 6 and trace[-1][0] < max(w for *_, w in segments(400))


def test_given_vectors_close_by_probing(spark):
    trace = []
    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    assert top_k(spark.read.parquet(path), F.col("vec_id") % 50 == 0, trace=trace).count() == 100
    assert sum(n for _, n in trace) == 10 and trace[-1][0] < 9  # of nine bits


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert top_k(df, F.lit(True)).count() == 0 and sign_codes(df, 1).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<double>")
    assert top_k(none, F.lit(True)).count() == 0
    two = spark.createDataFrame([(1, [1.0, 1.0]), (1, [-1.0, -1.0]), (2, [1.0, 1.0]), (3, [-1.0, -1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["distance"]) for r in top_k(two, F.col("vec_id") == 1, 2).collect()) == [(2, 0), (2, 2), (3, 0), (3, 2)]  # an id with two vectors
