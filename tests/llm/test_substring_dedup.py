import os
import random

import numpy as np
import pytest
from brute import prose, removed
from pyspark.sql import functions as F

from weftgraph.llm import substring_dedup
from weftgraph.llm.substring_dedup import anchors, cut_documents, dedup_report, keep_bytes, longest_previous_factors, repeated_windows, segments, spans, suffix_order


def corpus(rng):
    passage, line = prose(rng, 25), prose(rng, 6) + " same tail of a line"
    docs = {}
    for i in range(60):
        parts = [prose(rng, rng.randrange(5, 60))]
        if i % 2:
            parts.insert(rng.randrange(2), passage)
        if i % 3 == 0:
            parts += [line] * rng.randrange(1, 4)
        docs[i * 7] = " ".join(parts)
    docs |= {1000: docs[7], 1001: docs[7], 1002: docs[14] + " é" * 40, 1003: "é" * 60, 1004: "é" * 70, 1005: "x" * 49, 1006: "x" * 50, 1007: "x" * 300, 1008: None, 1009: "", 1010: prose(rng, 3000) + docs[21], 1011: "\0" * 60, 1012: "\0" * 80}
    return docs


@pytest.mark.parametrize("hot", [5000, 3])
def test_against_brute_force(spark, hot):
    docs = corpus(random.Random(hot))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").select("*", F.lit(1).alias("file"), F.lit("x").alias("own"), F.lit(2).alias("pos")).repartition(6)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in dedup_report(df, hot=hot).collect()}
    expected = removed(docs)
    assert got == {d: x[:4] for d, x in expected.items()}
    cut = {r["doc_id"]: r for r in cut_documents(df, hot=hot).collect()}
    for d, (n, gone, _, _, rest) in expected.items():
        left = rest.decode(errors="ignore")
        if gone and not left:
            assert d not in cut
        else:
            assert cut[d]["text"] == (docs[d] if docs[d] is None else left) and cut[d]["own"] == "x"
    assert cut_documents(df).columns == df.columns


def test_odd_rows(spark):
    text = "abcdefghij" * 8
    rows = [(None, text), (5, text), (5, text), (6, text + "more"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in dedup_report(df).collect())
    assert got == [(0, 0), (0, 0), (5, 0), (5, 0), (6, 80)]  # equal ids take nothing from each other, no id no part
    assert dedup_report(df.where("false")).count() == 0 and cut_documents(df.where("false")).count() == 0


def test_parts():
    rng = random.Random(5)
    text = prose(rng, 80).encode()
    anchor, starts, ends = segments(text)
    assert starts[0] == 0 and ends[-1] == len(text) - 49 and (starts[1:] == ends[:-1]).all()
    assert len(anchors(text)[0]) == len(text) - 49 and len(segments(b"short")[0]) == 0
    for i in range(0, len(text) - 120, 7):  # equal windows have equal anchors wherever they stand
        a = anchors(text)[0][i]
        assert anchors(b"zz" + text[i : i + 60])[0][2] == a
    pieces, owner = [text[:70], text[10:90], b"\xff" * 60, b"short"], [9, 4, 7, 1]
    table = {}
    for p, o in zip(pieces, owner):
        for i in range(len(p) - 49):
            table[p[i : i + 50]] = min(o, table.get(p[i : i + 50], 99))
    gone = repeated_windows(pieces, np.array(owner))
    assert [g.tolist() for g in gone] == [[table[p[i : i + 50]] < o for i in range(len(p) - 49)] for p, o in zip(pieces, owner)]
    assert any(gone[0]) and not any(gone[1])
    place = np.array([3, 3, 3, 3, 8])
    assert spans(place, np.array([5, 1, 3, 8, 2]), np.array([9, 3, 4, 12, 4])) == {3: [(1, 4), (5, 12)], 8: [(2, 4)]} and keep_bytes(b"0123456789abcd", [(1, 4), (5, 12)]) == b"04cd"


@pytest.mark.parametrize("seed", range(6))
def test_longest_previous_factors(seed):
    """Order, LCP and LPF against their definitions."""
    rng = random.Random(seed)
    length = 16
    pieces = [bytes(rng.choice(b"ab" if seed % 2 else b"abc") for _ in range(rng.randrange(10, 60))) for _ in range(8)] + [b"a" * 40] * 2
    owner = np.array([rng.randrange(5) for _ in pieces])
    piece, order, lcp, counts = suffix_order(pieces, length)
    suffix = [(k, p[i : i + length]) for k, p in enumerate(pieces) for i in range(len(p) - length + 1)]
    assert piece.tolist() == [k for k, _ in suffix] and counts.tolist() == [max(0, len(p) - length + 1) for p in pieces]
    common = lambda x, y: len(os.path.commonprefix([x, y]))
    in_order = [suffix[i] for i in order]
    assert [x for _, x in in_order] == sorted(x for _, x in suffix)
    assert lcp.tolist() == [0] + [common(a[1], b[1]) for a, b in zip(in_order, in_order[1:])]
    expected = [max((common(x, y) for j, y in in_order if owner[j] < owner[k]), default=0) for k, x in in_order]
    assert longest_previous_factors(owner[piece[order]], lcp, 1).tolist() == expected
    assert longest_previous_factors(owner[piece[order]], lcp, length).tolist() == [x if x >= length else 0 for x in expected]


def test_long_text(spark, monkeypatch):
    """A text longer than a batch, whose passages come again; and a hot passage that is dealt by windows."""
    rng = random.Random(8)
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 1 << 16)
    long, passage = prose(rng, 60_000), prose(rng, 12)
    docs = {5: long, 3: long[1000:1400], 9: "x" + long[200_000:203_000] + "y"} | {100 + i: prose(rng, 3) + passage + prose(rng, 2) for i in range(40)}
    assert len(long) > 4 << 16
    got = {r["doc_id"]: r["n_removed"] for r in dedup_report(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), hot=20).collect()}
    assert got == {d: x[1] for d, x in removed(docs).items()} and got[5] and got[9] == 3000
