"""Operator 1: document fingerprints by a homomorphic multiset hash of paragraphs.

A text is the multiset of its paragraphs (its parts between line feeds, every byte kept). Each paragraph is hashed to
a wide vector and the vectors are added lane by lane modulo a power of two, so that

* texts with the same paragraphs in any order have the same fingerprint (and others differ but for hash collisions);
* inserting or deleting a paragraph adds or subtracts its vector, without the rest of the text.

The vector has two groups of lanes. ``EXACT`` lanes of 16 bits hold SHAKE-128 output and decide equality.
``SKETCH`` lanes, signed modulo 2**16, hold the +-1 votes of the paragraph's overlapping byte grams; being just as
additive, two of them give the cosine of the gram multisets, the likeness of two fingerprints. A gram repeated more
than 32767 times in one lane wraps, which can blur a likeness but never an equality.

Nulls and empty texts are one empty paragraph; a text shorter than a gram votes as one gram.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shuffle_parts, table

EXACT, SKETCH, GRAM = 64, 256, 24
_MULTIPLIERS = [np.uint64(int.from_bytes(hashlib.sha256(b"gram%d" % i).digest()[:8], "little") | 1) for i in range(4)]


def _exact(paragraphs: list[bytes]) -> np.ndarray:
    out = np.zeros(EXACT, np.uint16)
    for p in paragraphs:
        out += np.frombuffer(hashlib.shake_128(p).digest(2 * EXACT), "<u2")
    return out


def _sketch(paragraphs: list[bytes]) -> np.ndarray:
    """The signed votes of all grams inside the paragraphs, modulo 2**16."""
    text, hashes = b"\n".join(paragraphs), []
    n = len(text) - GRAM + 1
    if n > 0:
        word = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
        h = word[:n] * _MULTIPLIERS[0] + word[8 : 8 + n] * _MULTIPLIERS[1] + word[16 : 16 + n] * _MULTIPLIERS[2]
        if len(paragraphs) > 1:  # grams don't cross paragraphs
            breaks = np.cumsum(np.frombuffer(text, np.uint8) == 10)
            h = h[(breaks[GRAM - 1 :] - np.concatenate(([0], breaks[: n - 1]))) == 0]
        hashes.append(h)
    if short := [p for p in paragraphs if 0 < len(p) < GRAM]:
        hashes.append(np.array([int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little") for p in short], np.uint64))
    if not hashes:
        return np.zeros(SKETCH, np.uint16)
    h = np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(32))) * _MULTIPLIERS[3]
    votes = np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=2 * SKETCH).reshape(SKETCH, 2)
    return (votes[:, 0] - votes[:, 1]).astype(np.uint16)


class Fingerprint:
    """The sum of paragraph vectors; ``+`` and ``-`` are the homomorphism."""

    __slots__ = ("lanes",)

    def __init__(self, lanes: np.ndarray | None = None):
        self.lanes = np.zeros(EXACT + SKETCH, np.uint16) if lanes is None else lanes

    @classmethod
    def of_paragraphs(cls, paragraphs: list[bytes]) -> Fingerprint:
        return cls(np.concatenate((_exact(paragraphs), _sketch(paragraphs))))

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        return cls.of_paragraphs((text or "").encode().split(b"\n"))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes + other.lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes - other.lanes)

    def insert(self, paragraph: str) -> Fingerprint:
        return self + Fingerprint.of_paragraphs([paragraph.encode()])

    def delete(self, paragraph: str) -> Fingerprint:
        return self - Fingerprint.of_paragraphs([paragraph.encode()])

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool(np.array_equal(self.lanes, other.lanes))

    __hash__ = None

    def __str__(self) -> str:
        return base64.b64encode(self.lanes.astype("<u2").tobytes()).decode()

    @classmethod
    def parse(cls, s: str) -> Fingerprint:
        return cls(np.frombuffer(base64.b64decode(s), "<u2").copy())

    def likeness(self, other: Fingerprint) -> float:
        """Estimated cosine of the two gram multisets, 0 to 1; 1 for equal fingerprints."""
        if self == other:
            return 1.0
        a, b = (x.lanes[EXACT:].view(np.int16).astype(np.float64) for x in (self, other))
        norm = math.sqrt(float(a @ a) * float(b @ b))
        return min(1.0, max(0.0, float(a @ b) / norm)) if norm else 0.0


def replace_tail(text: str, print_: Fingerprint, keep: int, tail: str) -> tuple[str, Fingerprint]:
    """``text[:keep] + tail`` and its fingerprint, from ``print_`` by deleting and inserting the paragraphs that change."""
    edited = text[:keep] + tail
    start = text.rfind("\n", 0, keep) + 1
    gone, come = (Fingerprint.of_paragraphs(x[start:].encode().split(b"\n")) for x in (text, edited))
    return edited, print_ - gone + come


def with_next(docs: DataFrame) -> DataFrame:
    """Docs dealt in ranges of ``doc_id`` with a copy, marked ``guest``, of the row that follows each range.

    The range bounds come from an approximate quantile of the ids, the guests from the least row of each range: both
    are one number for each partition, and whole texts are shuffled once. Ids may repeat (ties are ordered by the hash of the
    text, then by the text) and a null id sorts first; the row after the last is the first. An id that fills several
    ranges is cut at hashes, so it isn't one task; only rows equal in both stay together.
    """
    spark = docs.sparkSession
    n = shuffle_parts(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"key": F.coalesce("doc_id", F.lit(-(2**63))), "hash": F.xxhash64("text")})
    cuts = d.select(F.percentile_approx("key", [i / (4 * n) for i in range(1, 4 * n)], 40 * n)).first()[0] or []  # quarters of ranges
    hot = {k: times // 2 for k, times in Counter(cuts).items() if times >= 4}  # an id that fills a range: two pieces for each
    bounds = sorted({(int(k), -(2**63)) for k in cuts[3::4]} | {(int(k), -(2**63) + j * (2**64 // m)) for k, m in hot.items() for j in range(m)})
    if hot:
        by, least = ["key", "hash"], F.struct("key", "hash")
        edges = [F.struct(F.lit(k).alias("key"), F.lit(h).alias("hash")) for k, h in bounds]
        reached = lambda b: (b["key"] < F.col("key")) | ((b["key"] == F.col("key")) & (b["hash"] <= F.col("hash")))
    else:  # plain ids are enough
        by, least, edges, reached = ["key"], F.col("key"), [F.lit(k) for k, _ in bounds], lambda b: b <= F.col("key")
    d = d.withColumn("range", F.size(F.filter(F.array(*edges), reached)) if edges else F.lit(0))
    heads = {r["range"]: r["least"] for r in d.groupBy("range").agg(F.min(least).alias("least")).collect()}  # one row for each range
    order = sorted(heads)
    before = [(*(heads[r] if hot else [heads[r]]), order[i - 1]) for i, r in enumerate(order)]  # the first of each range is a guest of the range before
    guests = F.broadcast(spark.createDataFrame(before, ", ".join(f"{c} long" for c in by) + ", host int"))
    dealt = F.filter(F.array(F.struct(F.col("range").alias("to"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("to"), F.lit(True).alias("guest"))), lambda x: x["to"].isNotNull())
    d = d.join(guests, by, "left").select("doc_id", "text", "key", "hash", F.explode(dealt).alias("x")).select("x.to", "x.guest", "key", "hash", "doc_id", "text")
    return d.repartitionById(len(bounds) + 1, "to").sortWithinPartitions("guest", "key", "hash", "text").drop("to", "key", "hash")


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprint_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held: tuple | None = None
    rows: list[tuple] = []

    def one(doc: tuple, following: tuple) -> tuple:
        (doc_id, text, mine), (_, next_text, theirs) = doc, following
        half = len(text) // 2
        edited, edited_print = replace_tail(text, mine, len(text) - half, next_text[:half])
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(mine), str(edited_print), mine.likeness(edited_print), mine.likeness(theirs)

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        rows.clear()
        return out

    done = False
    for batch in batches:
        for i in range(batch.num_rows):
            if done:
                continue
            guest, doc_id, text = (batch.column(c)[i].as_py() for c in range(3))
            doc = (doc_id, text, Fingerprint.of(text))
            if held is not None:
                rows.append(one(held, doc))
            done, held = guest, doc
            if len(rows) >= 512:
                yield flush()
    if rows:
        yield flush()


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness; one row per document.

    Null texts count as empty, a very long text is hashed paragraph by paragraph, repeated rows each get a row, an empty table gives an empty result, other columns of
    any name are not read.
    """
    return with_next(docs).mapInArrow(_fingerprint_partition, _SCHEMA)


def op1_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
