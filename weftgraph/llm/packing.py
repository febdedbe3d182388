"""Operator 8: best-fit packing by large-item matching.

Documents become token pieces of at most ``capacity`` tokens; only longer documents are cut, into full pieces after a
shorter first one. Packing works on the *histogram* of piece lengths, at most ``capacity`` counts however many
documents there are, so that one small driver step plans any amount of data:

1. items above a third of the capacity: at most two of them fit one bin. Greedy matching takes the longest one left and
   gives it the longest partner above a third that still fits;
2. the smaller items, longest first, each go to the bin with the least gap that still holds them (best fit), else to
   a new bin.

Equal lengths are planned together, in runs, so the plan is a bounded list of bin patterns with multiplicities.
Pieces are then numbered within their length (a hot length is numbered in many buckets by prefix sums) and looked up
in the plan: piece ``r`` of length ``l`` has one place.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import shuffle_parts, staged, table
from .token_counts import byte_letters

CAPACITY = 2048
#: A fixed value: the split of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of white space in a row up to which texts are split by tiktoken, whose stack ends somewhere above 900,000.
BLANKS = 100_000
_BLANK_RUN = re.compile(r"\s+")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def rank_merges_agree(spec: dict) -> bool:
    """Whether splitting by ``PATTERN`` and merging by least rank gives what the tokenizer gives, on any text.

    Its texts must be split byte-level by the usual pattern, not normalised, and its added tokens found as they stand.
    A token's parts are merged in its context as they are alone. So it is enough that every listed merge is the last
    step of its own token: the bytes of the token, merged by rank but for that step, are the two listed parts.
    """
    split = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["model"].get("ignore_merges"):
        return False
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
        return False
    vocabulary = spec["model"]["vocab"]
    for i, pair in enumerate(spec["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        parts, whole = list(a + b), a + b
        while len(parts) > 2:
            ranks = [(vocabulary.get(x + y, 1 << 60), k) for k, (x, y) in enumerate(zip(parts, parts[1:]))]
            rank, k = min(ranks)
            if rank == 1 << 60:
                return False
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if parts != [a, b] or vocabulary[whole] != i + 256:
            return False
    return True


def long_blank_run(text: str) -> bool:
    """Whether a run of white space is longer than ``BLANKS``; Python's white space includes all of the pattern's."""
    return len(text) > BLANKS and any(m.end() - m.start() > BLANKS for m in _BLANK_RUN.finditer(text))


class Encoder:
    """Whole texts to little-endian ids: by ranks where that is proved to be the same, else by the library itself.

    The library also encodes texts with a run of white space that is too long for the stack of tiktoken's splitter.
    """

    def __init__(self, tokenizer_json: str, by_rank: bool):
        import tiktoken

        spec = json.loads(tokenizer_json)
        self._json, self._library = tokenizer_json, None
        self._special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._cut = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None
        if by_rank:
            letters = byte_letters()
            ranks = {bytes(letters[c] for c in piece): n for piece, n in spec["model"]["vocab"].items() if piece not in self._special}
            by_ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self._encode = lambda text: self._listed(text) if long_blank_run(text) else by_ranks(text)
        else:
            self._encode = self._listed

    def _listed(self, text: str) -> list[int]:
        """By the library, which is only loaded when it's needed."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._json)
        return self._library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        if self._special and any(s in text for s in self._special):
            ids = []
            for part in self._cut.split(text):
                ids += [self._special[part]] if part in self._special else self._encode(part)
        else:
            ids = self._encode(text)
        return np.array(ids, "<u4").tobytes()


_encoders: dict[int, Encoder] = {}


def encoder_of(tokenizer_json: str, by_rank: bool) -> Encoder:
    """One encoder for each Python worker, whatever number of tasks it runs."""
    key = hash((tokenizer_json, by_rank))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json, by_rank)
    return _encoders[key]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of every document with the CRC of their ids; null text: the end id alone."""
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast((text, rank_merges_agree(json.loads(text))))  # bounded by the vocabulary

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(*shipped.value), np.array([end_id], "<u4").tobytes()
        names, types = [x.split()[0] for x in _PIECES.split(", ")], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    stop = at + ((n - at) % capacity or capacity)
                    rows.append((doc_id.as_py(), piece, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                    at, piece = stop, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECES)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """``(how many bins, their lengths in order)`` for a histogram of lengths: large-item matching, then best fit."""
    left = {k: v for k, v in counts.items() if v}
    open_bins: dict[int, list[list]] = defaultdict(list)  # by gap: [bins, lengths]
    gaps: list[int] = []

    def put(n: int, lengths: tuple[int, ...]) -> None:
        gap = capacity - sum(lengths)
        if not open_bins.get(gap):
            insort(gaps, gap)
        open_bins[gap].append([n, lengths])

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1  # the longest partner that still fits
        if i < 0:
            put(left.pop(a), (a,))
            large.pop()
            continue
        b = large[i]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if n == 0:  # the last of its length, no other of it to pair with
            if i > 0:
                b = large[i - 1]
                n = min(left[a], left[b])
            else:
                put(left.pop(a), (a,))
                large.pop()
                continue
        put(n, (a, b))
        for k in (a, b):
            left[k] -= n
        for k in {a, b}:
            if not left[k]:
                del left[k]
                large.remove(k)
    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            j = bisect_left(gaps, k)
            if j == len(gaps):  # new bins, each with as many as it holds
                each = capacity // k
                if full := n // each:
                    put(full, (k,) * each)
                if n % each:
                    put(1, (k,) * (n % each))
                break
            gap = gaps[j]
            bins = open_bins[gap].pop()
            if not open_bins[gap]:
                gaps.pop(j)
                del open_bins[gap]
            each = min(gap // k, max(1, n // bins[0])) if n >= bins[0] else 1
            used = min(bins[0], n // each)
            put(used, bins[1] + (k,) * each)
            n -= used * each
            if used < bins[0]:
                put(bins[0] - used, bins[1])
    return [(n, lengths) for gap in sorted(open_bins) for n, lengths in open_bins[gap]]


def places(bins: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """By length: the first rank of each run of places, the sequence of that rank and the offset within it."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = defaultdict(lambda: ([], [], []))
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for n, lengths in bins:
        at = 0
        for k in lengths:
            for held, x in zip(out[k], (ranks[k], sequence, at)):
                held.append(x)
            ranks[k] += n
            at += k
        sequence += n
    return dict(out)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (doc_id, piece, start, length, ids_crc32, more columns) with ``sequence_id`` and ``offset``; items must be staged.

    Repeated rows are packed one by one; lengths are 1 to ``capacity``; an empty table gives an empty result.
    """
    spark = items.sparkSession
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # at most `capacity` rows
    shipped = spark.sparkContext.broadcast(places(plan_bins(counts, capacity)))  # bounded by patterns of lengths
    n = 4 * shuffle_parts(spark)
    keyed = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(n)))  # rows without id are spread, too
    starts = keyed.groupBy("length", "bucket").count()
    starts = starts.withColumn("first", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.select("length", "bucket", F.coalesce("first", F.lit(0)).alias("first"))
    ranked = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(starts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("nth")).drop("bucket", "first", "nth")
    columns = items.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = {k: tuple(map(np.array, v)) for k, v in shipped.value.items()}
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                mine, (first, base, at) = length == k, plan[int(k)]
                i = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine], offset[mine] = base[i] + rank[mine] - first[i], at[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """All documents cut and packed. Texts are read and encoded once; only piece rows are staged and shuffled.

    A null text is the end id alone, a null id is kept, rows of one id are packed one by one, a very long text is encoded
    as a whole; other columns are not read.
    """
    return pack(staged(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
