import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from brute import prose
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftgraph.llm.packing import Encoder, pack_documents, plan_bins, places, rank_merges_agree
from weftgraph.llm.token_counts import TokenCounter, prove_whole_tokens, token_counts

ODD = [
    None, "", " ", "\n\n a", "Hello  world\t\tx", "it's I'm they'll DON'T", "<|endoftext|>", "a<|endoftext|>b<|startoftext|> c", "ΣΑΣ Σ ΟΔΟΣ", "été Å ﬁ", "a b c　d\x1ce\x85f", "日本語のテキスト 123456 ½ ²", "x" * 3000,
    "!!!???...---" * 50, "🙂🙂 🏳️‍🌈", "İstanbul ẞ", "tab\tnl\r\nend ", "word " * 3000, "ñandú̃ ê", "​zero﻿width", "0x1F 3.14 1,000",
]


@pytest.fixture(scope="module")
def word():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    return spec, Tokenizer.from_str(spec), prove_whole_tokens(spec)


@pytest.fixture(scope="module")
def byte():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    return spec, Tokenizer.from_str(spec)


def test_proved_words_are_one_token(word):
    _, t, whole = word
    assert len(whole) > 20_000
    for w in random.Random(1).sample(sorted(whole), 300):
        assert len(t.encode(w, add_special_tokens=False).ids) == 1


def test_counts_of_odd_texts(spark, word):
    rows = list(enumerate(ODD)) + [(99, "twice"), (99, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("n_tokens")).repartition(3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(df, P.path("word_bpe_49k.json")).collect())
    n = lambda t: len(word[1].encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((d if d is not None else -1, len((t or "").encode()), n(t), n(t) > 2048) for d, t in rows)
    assert token_counts(df.where("false"), P.path("word_bpe_49k.json")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_counts_of_any_text(word, text):
    spec, t, whole = word
    counter = test_counts_of_any_text.__dict__.setdefault("counter", TokenCounter(spec, whole))
    assert counter.count(text) == len(t.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(byte, text):
    spec, t = byte
    encoder = test_ids_of_any_text.__dict__.setdefault("encoder", Encoder(spec, True))
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_ids_of_odd_texts(byte):
    spec, t = byte
    assert rank_merges_agree(json.loads(spec))
    for text in ODD:
        expected = t.encode(text or "", add_special_tokens=False).ids
        for by_rank in (True, False):
            assert np.frombuffer(Encoder(spec, by_rank).ids(text or ""), "<u4").tolist() == expected


def test_ids_of_long_blank_runs(byte):
    spec, t = byte
    encoder = Encoder(spec, True)
    for text in (" " * 1_100_000, "a b" + "\n" * 1_100_000 + "c", "<|endoftext|>x" + " \t" * 550_000 + "y", " " * 100_000 + "z", " " * 100_001 + "z"):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_of_long_blank_runs(spark, byte):
    docs = [(1, "a" + " " * 2_000_000 + "b"), (2, "\n" * 2_000_000), (3, "c d"), (4, "x" * 2_000_000), (None, "e f g")]
    rows = pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect()
    for d, text in docs:
        ids = np.array(byte[1].encode(text, add_special_tokens=False).ids + [0], "<u4")
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == d)
        assert sum(n for _, n, _ in mine) == len(ids) and all(crc == zlib.crc32(ids[a : a + n].tobytes()) for a, n, crc in mine)


def test_merges_that_ranks_would_get_wrong():
    vocabulary = {c: i for i, c in enumerate(map(chr, range(256)))}
    split = {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    fine = split | {"model": {"vocab": vocabulary | {"ab": 256, "abc": 257}, "merges": [["a", "b"], ["ab", "c"]]}}
    wrong = split | {"model": {"vocab": vocabulary | {"bc": 256, "ab": 257, "abc": 258}, "merges": [["b", "c"], ["a", "b"], ["ab", "c"]]}}
    assert rank_merges_agree(fine) and not rank_merges_agree(wrong)
    assert not rank_merges_agree(fine | {"normalizer": {"type": "NFC"}}) and not rank_merges_agree(fine | {"pre_tokenizer": {"type": "Whitespace"}})


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(0, 40), max_size=30))
def test_plan(counts):
    bins = plan_bins(counts, 100)
    used = {}
    for n, lengths in bins:
        assert n > 0 and sum(lengths) <= 100 and sum(3 * x > 100 for x in lengths) <= 2
        for x in lengths:
            used[x] = used.get(x, 0) + n
    assert used == {k: v for k, v in counts.items() if v}
    total, bound = sum(n for n, _ in bins), sum(k * v for k, v in counts.items()) / 100
    large = sum(v for k, v in counts.items() if 2 * k > 100)
    assert total <= max(large, 1.7 * bound) + 1
    for k, (first, _, _) in places(bins).items():
        assert first[0] == 0 and first == sorted(first) and first[-1] < used[k]


def test_packing(spark, byte):
    rng = random.Random(7)
    docs = [(i, prose(rng, rng.choice((3, 50, 400, 700)))) for i in range(120)] + [(500, None), (501, ""), (502, prose(rng, 6000)), (503, "<|endoftext|> x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("length"), F.lit(2).alias("offset")).repartition(4)
    rows = pack_documents(df, P.path("byte_bpe_50k.json")).collect()
    ids = {d: np.array(byte[1].encode(t or "", add_special_tokens=False).ids + [0], "<u4") for d, t in docs}
    at, sequences = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        d = r["doc_id"]
        assert r["start"] == at.get(d, 0) and r["ids_crc32"] == zlib.crc32(ids[d][r["start"] : r["start"] + r["length"]].tobytes())
        assert r["length"] == 2048 or r["piece"] == 0
        at[d] = r["start"] + r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {d: len(x) for d, x in ids.items()}
    for x in sequences.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= max(sum(r["length"] > 1024 for r in rows), 1.02 * sum(map(len, ids.values())) / 2048) + 2
    assert pack_documents(df.where("false"), P.path("byte_bpe_50k.json")).count() == 0
    twice = pack_documents(spark.createDataFrame([(1, "a b")] * 3, "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect()
    assert sorted(r["offset"] for r in twice) == [0, 3, 6] and len({r["sequence_id"] for r in twice}) == 1
