"""Operator 10: substring dedup by longest-previous-factor arrays over bucketed suffix orders.

A byte goes if it lies in a ``LENGTH``-byte string that also starts in a document with a smaller id. Let LPF[p] be the
longest match of the suffix at ``p`` with a suffix of a smaller-id document; the string at ``p`` goes if LPF[p] >= LENGTH.
In suffix order the longest such match is one of two: with the previous or with the next suffix of a smaller owner, and
its length is the least LCP on the way there. Longer matches change nothing, so order and LCP are capped at LENGTH bytes.

To spread the suffixes over many machines:

1. texts are read once and written in compressed batches to the shared folder; later passes read a batch by file and
   offset, so whole texts are never shuffled. Copies of a whole text are one text, that of the least id (the others go
   entirely, if long enough);
2. of each window of LENGTH bytes the *anchor* is its least hashed ``GRAM``-byte gram, so equal windows have equal anchors
   and about every 14th position is an anchor. A batch sends each distinct anchor once with its number of texts, packed,
   to the anchor's bucket, which answers with those that are in more than one text;
3. the consecutive windows of one shared anchor are one short segment. A batch sends each distinct segment once, with the
   least id that has it in the batch, to the anchor's bucket. The segments of a *hot* anchor (in more than ``HOT`` texts)
   are sent as single windows, each to a bucket of its own hash, so that a passage in a third of all documents is dealt
   over all buckets, and costs one row a batch and window. Where a segment occurs in its batch goes to the shared folder;
4. a bucket makes equal segments one of the least id, puts their suffixes in order, and derives LCP, previous and next
   smaller owners and LPF. It answers with the windows of which LPF >= LENGTH;
5. each batch turns the answers into the spans of its texts: what isn't the batch's first occurrence goes, and what is
   goes where the bucket says so.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import BlobReader, BlobWriter, Scratch, bounded, shuffle_parts, table
from .near_dedup import mixed

LENGTH, GRAM, HOT, BUCKET_BYTES = 50, 24, 5000, 8 << 20
BATCH_BYTES, BATCH_DOCS = 4 << 20, 4096
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``length`` bytes: its anchor's hash and a number that changes where the anchor does."""
    n = len(text) - GRAM + 1
    word = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    h = mixed(word[:n] * _C[0] + word[8 : 8 + n] * _C[1] + word[16 : 16 + n] * _C[2])
    wide = length - GRAM + 1
    bits = max(1, (wide - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    best = (h & ~low) | (np.arange(n, dtype=np.uint64) & low)  # the low bits tell the position within any window
    done = 1
    while done < wide:  # least of `done` grams, doubled
        step = min(done, wide - done)
        best = np.minimum(best[:-step], best[step:])
        done += step
    return best & ~low, best & low


def segments(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and end (exclusive) of the runs of windows with one anchor."""
    if len(text) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    anchor, spot = anchors(text, length)
    starts = np.concatenate(([0], np.flatnonzero((anchor[1:] != anchor[:-1]) | (spot[1:] != spot[:-1])) + 1))
    return anchor[starts], starts, np.concatenate((starts[1:], [len(anchor)]))


def suffix_order(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of ``pieces`` that have ``length`` bytes or more, sorted by that many; equal ones as they come.

    Returns the piece of each suffix in text order, the sorted order of the suffixes, the LCP of each sorted one with the
    one before it (capped at ``length``) and the number of suffixes of each piece.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    counts = np.maximum(sizes - length + 1, 0)
    text = b"".join(pieces) + b"\0" * 8
    piece = np.repeat(np.arange(len(pieces)), counts)
    at = np.arange(len(piece)) + (np.cumsum(sizes) - sizes - np.cumsum(counts) + counts)[piece]
    word = np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))
    offsets = [min(k, length - 8) for k in range(0, length, 8)]
    order = np.lexsort([word[at + k].astype(np.uint64) for k in reversed(offsets)])
    at = at[order]
    lcp, equal = np.full(len(order), length, np.int64), np.ones(max(0, len(order) - 1), bool)
    lcp[:1] = 0
    for k in offsets:
        key = word[at + k].astype(np.uint64)
        here = np.flatnonzero(equal & (key[1:] != key[:-1]))
        x = key[here + 1] ^ key[here]
        lcp[here + 1] = k + sum((x < np.uint64(1 << (64 - 8 * i))).astype(np.int64) for i in range(1, 8))
        equal[here] = False
    return piece, order, lcp, counts


def _previous_factor(owner: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For suffixes in order the LCP with the last one before of a smaller owner, 0 where below ``least``.

    Pointers to the last smaller one jump over each other's spans, each with the least LCP of the span it has passed.
    """
    to, passed, open_ = np.arange(len(owner)) - 1, lcp.copy(), np.arange(1, len(owner))
    while True:
        open_ = open_[(to[open_] >= 0) & (passed[open_] >= least)]
        open_ = open_[owner[to[open_]] >= owner[open_]]
        if not len(open_):
            break
        over = to[open_]
        to[open_], passed[open_] = to[over], np.minimum(passed[open_], passed[over])
    return np.where((to >= 0) & (passed >= least), passed, 0)


def longest_previous_factors(owner: np.ndarray, lcp: np.ndarray, least: int = LENGTH) -> np.ndarray:
    """LPF of the suffixes in order: their longest match with a suffix of a smaller owner, 0 where shorter than ``least``."""
    after = np.concatenate((lcp[:1] * 0, lcp[1:][::-1]))
    return np.maximum(_previous_factor(owner, lcp, least), _previous_factor(owner[::-1], after, least)[::-1])


def repeated_windows(pieces: list[bytes], owner: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For every window of every piece whether its LPF reaches ``length``."""
    by = np.argsort(owner, kind="stable")  # equal suffixes come by owner, so that pointers are short
    piece, order, lcp, counts = suffix_order([pieces[k] for k in by.tolist()], length)
    gone = np.empty(len(order), bool)
    gone[order] = longest_previous_factors(owner[by][piece[order]], lcp, length) >= length
    out: list = [None] * len(pieces)
    for k, x in zip(by.tolist(), np.split(gone, np.cumsum(counts)[:-1])):
        out[k] = x
    return out


def reduced(anchor: np.ndarray) -> np.ndarray:
    """Anchors as 40 bits; a bucket of bounded size has few collisions, and those only cost work."""
    return mixed(anchor) >> np.uint64(24)


def _five(a: np.ndarray) -> bytes:
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unfive(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


# -- batches of texts in the shared folder -----------------------------------------------------------------------------


def _write_batches(folder: str, more: bool):
    """Rows (doc_id, text[, more]) to (file, offset, size, pos, at, n_bytes, doc_id, own[, more])."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with BlobWriter(folder) as blobs:
            for batch in batches:
                for part in bounded(batch, 1, BATCH_BYTES):
                    for start in range(0, part.num_rows, BATCH_DOCS):
                        rows = part.slice(start, BATCH_DOCS)
                        texts, k = rows.column(1).to_pylist(), rows.num_rows
                        data = [(t or "").encode() for t in texts]
                        sizes = np.array([len(x) for x in data], np.int64)
                        file, offset, size = blobs.add(b"".join(data))
                        columns = [
                            pa.array([file] * k), pa.array([offset] * k, pa.int64()), pa.array([size] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(np.cumsum(sizes) - sizes), pa.array([None if t is None else int(n) for t, n in zip(texts, sizes)], pa.int64()),
                            rows.column(0), pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()),
                        ]
                        names = ["file", "offset", "size", "pos", "at", "n_bytes", "doc_id", "own"]
                        if more:
                            columns, names = [*columns, rows.column(2)], [*names, "more"]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _live(docs: list[dict]) -> list[dict]:
    return [d for d in docs if d["live"]]


# -- shared anchors ----------------------------------------------------------------------------------------------------

_KEYS = "bucket int, file string, offset long, keys binary, counts binary"


def _send_anchors(folder: str, n: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = BlobReader(folder)
        for batch in batches:
            for file, offset, size, docs in zip(*(_column(batch, c) for c in ("file", "offset", "size", "docs"))):
                if not (docs := _live(docs)):
                    continue
                data, found = texts.read(file, offset, size), []
                for d in docs:
                    found.append(np.unique(reduced(segments(data[d["at"] : d["at"] + d["n_bytes"]], length)[0])))
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                bucket = (keys % np.uint64(n)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                keys, counts, bucket = keys[order], np.minimum(counts[order], 65535).astype("<u2"), bucket[order]
                edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
                rows = [(int(bucket[a]), file, offset, _five(keys[a:b]), counts[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
                types = [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["bucket", "file", "offset", "keys", "counts"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each bucket, which come sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _answer_anchors(limit: int):
    """(file, offset, shared, hot): of a batch's anchors those in several texts, and those in more than ``limit``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            parts = [_unfive(r[3]) for r in held]
            source = np.repeat(np.arange(len(held)), [len(p) for p in parts])
            keys, counts = np.concatenate(parts), np.concatenate([np.frombuffer(r[4], "<u2") for r in held])
            order = np.argsort(keys, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
            total = np.add.reduceat(counts[order].astype(np.int64), starts)
            total = np.repeat(total, np.diff(np.concatenate((starts, [len(keys)]))))
            rows: dict[int, list[bytes]] = {}
            for k, mask in enumerate(((total > 1) & (total <= limit), total > limit)):
                chosen = order[mask]
                chosen = chosen[np.argsort(source[chosen], kind="stable")]
                for i, x in zip(*_split(source[chosen], keys[chosen])):
                    rows.setdefault(i, [b"", b""])[k] = _five(x)
            if rows:
                items = [(held[i][1], held[i][2], *x) for i, x in rows.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*items), (pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["file", "offset", "shared", "hot"])

    return run


def _split(by: np.ndarray, *values: np.ndarray) -> tuple:
    """Runs of equal ``by``: its values, and the pieces of each array."""
    if not len(by):
        return ([], *([] for _ in values))
    edges = np.flatnonzero(by[1:] != by[:-1]) + 1
    return (by[np.concatenate(([0], edges))].tolist(), *(np.split(v, edges) for v in values))


# -- segments and their suffix order -----------------------------------------------------------------------------------


def _chosen(folder: str, length: int):
    """For each batch: file, offset, and of each live text the segments whose anchors are shared, with whether that is hot."""
    def run(batch: pa.RecordBatch, texts: BlobReader) -> Iterator[tuple]:
        for file, offset, size, docs, *named in zip(*(_column(batch, c) for c in ("file", "offset", "size", "docs", "shared", "hot"))):
            parts = [np.concatenate([np.empty(0, np.uint64), *map(_unfive, x)]) for x in named]
            wanted = np.concatenate(parts)
            if not len(wanted):
                continue
            order = np.argsort(wanted)
            wanted, is_hot = wanted[order], (np.arange(len(wanted)) >= len(parts[0]))[order]
            data, out = texts.read(file, offset, size), []
            for d in _live(docs):
                text = data[d["at"] : d["at"] + d["n_bytes"]]
                anchor, starts, ends = segments(text, length)
                keys = reduced(anchor)
                at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                mask = wanted[at] == keys
                if mask.any():
                    out.append((d, text, keys[mask], starts[mask], ends[mask], is_hot[at][mask]))
            yield file, offset, out

    return run


_PAYLOAD = "bucket int, file string, offset long, base long, seen struct<file:string,offset:bigint,size:int>, payload binary"


def _send_segments(folder: str, n: int, length: int):
    """The distinct segments of each batch by bucket, packed: least ids, lengths, bytes.

    ``seen`` names the place of the batch's occurrences: (piece, pos, start, size), 32-bit numbers sorted by piece;
    a bucket's pieces are numbered from ``base``.
    """
    choose = _chosen(folder, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, press = BlobReader(folder), zstandard.ZstdCompressor(level=3)
        with BlobWriter(folder) as blobs:
            for batch in batches:
                for file, offset, found in choose(batch, texts):
                    number: dict[bytes, int] = {}
                    ids, buckets, seen = [], [], []
                    for d, text, keys, starts, ends, hot in found:
                        doc_id, pos = d["doc_id"], d["pos"]
                        for b, a, e, h in zip((keys % np.uint64(n)).tolist(), starts.tolist(), ends.tolist(), hot.tolist()):
                            for start, stop in ((x, x + 1) for x in range(a, e)) if h else ((a, e),):
                                piece = text[start : stop + length - 1]
                                k = number.setdefault(piece, len(ids))
                                if k == len(ids):
                                    ids.append(doc_id)
                                    buckets.append(zlib.crc32(piece) % n if h else b)
                                elif doc_id < ids[k]:
                                    ids[k] = doc_id
                                seen.append((k, pos, start, len(piece)))
                    pieces, bucket, least = list(number), np.array(buckets), np.array(ids, "<i8")
                    order = np.argsort(bucket, kind="stable")
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    places = np.array(seen, np.int64)
                    places[:, 0] = rank[places[:, 0]]
                    place = dict(zip(("file", "offset", "size"), blobs.add(places[np.argsort(places[:, 0], kind="stable")].astype("<u4").tobytes())))
                    rows, base = [], 0
                    for b, some in zip(*_split(bucket[order], order)):
                        parts = [pieces[k] for k in some.tolist()]
                        raw = len(parts).to_bytes(4, "little") + least[some].tobytes() + np.array([len(x) for x in parts], "<u4").tobytes() + b"".join(parts)
                        rows.append((b, file, offset, base, place, press.compress(raw)))
                        base += len(parts)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64(), pa.int64(), _PLACE, pa.binary()))], names=["bucket", "file", "offset", "base", "seen", "payload"])

    return run


_PLACE = pa.struct([("file", pa.string()), ("offset", pa.int64()), ("size", pa.int32())])


def _unpack_segments(payload: bytes, press) -> tuple[np.ndarray, list[bytes]]:
    raw = press.decompress(payload)
    n = int.from_bytes(raw[:4], "little")
    ids, sizes = np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, "<u4", n, 4 + 8 * n)
    at, parts = 4 + 12 * n, []
    for k in sizes.tolist():
        parts.append(raw[at : at + k])
        at += k
    return ids, parts


_ANSWER = "file string, offset long, base long, pieces int, seen struct<file:string,offset:bigint,size:int>, runs binary"


def _lpf(length: int):
    """For each payload the runs (piece, first window, end) that are gone from the batch's first occurrence, three 32-bit numbers each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for held in _by_bucket(batches):
            number: dict[bytes, int] = {}
            entries = []
            for row in held:
                ids, parts = _unpack_segments(row[5], press)
                entries.append((ids, np.array([number.setdefault(p, len(number)) for p in parts], np.int64)))
            pieces = list(number)
            owner = np.full(len(pieces), np.iinfo(np.int64).max)
            for ids, piece in entries:
                np.minimum.at(owner, piece, ids)
            gone = repeated_windows(pieces, owner, length)
            runs = []  # of each piece: (first window, end)
            for x in gone:
                edge = np.flatnonzero(np.diff(np.concatenate(([False], x, [False])).astype(np.int8)))
                runs.append(edge.reshape(-1, 2))
            some = np.array([len(x) > 0 for x in runs])
            rows = []
            for row, (ids, piece) in zip(held, entries):
                out, base = [], row[3]
                every = owner[piece] < ids  # the piece itself is in a document of smaller id
                for k in np.flatnonzero(every | some[piece]).tolist():
                    found = np.array([[0, len(gone[piece[k]])]]) if every[k] else runs[piece[k]]
                    out.append(np.insert(found, 0, base + k, 1))
                rows.append((row[1], row[2], base, len(ids), row[4], np.concatenate(out).astype("<u4").tobytes() if out else b""))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int32(), _PLACE, pa.binary()))], names=["file", "offset", "base", "pieces", "seen", "runs"])

    return run


# -- the texts that are left -------------------------------------------------------------------------------------------


def spans(place: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """By place, the (start, end) merged where they overlap or touch, in order."""
    if not len(place):
        return {}
    high = place.astype(np.int64) << 40
    order = np.argsort(high + start, kind="stable")
    first, last = (high + start)[order], np.maximum.accumulate((high + end)[order])
    at = np.concatenate(([0], np.flatnonzero(first[1:] > last[:-1]) + 1, [len(first)]))
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(first[at[:-1]].tolist(), last[at[1:] - 1].tolist()):
        out.setdefault(a >> 40, []).append((a & (1 << 40) - 1, b & (1 << 40) - 1))
    return out


def _places(answers: list[dict], ids: np.ndarray, texts: BlobReader, length: int) -> dict[int, list[tuple[int, int]]]:
    """The spans that go, by document of the batch."""
    found, seen = [], {}
    for x in answers:
        key = tuple(x["seen"].values())
        if key not in seen:
            seen[key] = np.frombuffer(texts.read(*key), "<u4").reshape(-1, 4).astype(np.int64)
        a, b = np.searchsorted(seen[key][:, 0], (x["base"], x["base"] + x["pieces"]))
        piece, pos, start, size = seen[key][a:b].T
        edges = np.concatenate(([0], np.flatnonzero(np.diff(piece)) + 1))
        least = np.repeat(np.minimum.reduceat(ids[pos], edges), np.diff(np.concatenate((edges, [len(piece)]))))
        later = ids[pos] > least  # not the batch's first
        found.append((pos[later], start[later], (start + size)[later]))
        run, low, high = np.frombuffer(x["runs"], "<u4").reshape(-1, 3).astype(np.int64).T
        first = ~later
        of, pos, start = piece[first], pos[first], start[first]
        left, right = (np.searchsorted(of, run, side) for side in ("left", "right"))
        k = np.repeat(np.arange(len(run)), right - left)  # a run for each first occurrence of its piece
        at = np.arange(len(k)) - np.repeat(np.cumsum(right - left) - (right - left), right - left) + np.repeat(left, right - left)
        found.append((pos[at], start[at] + low[k], start[at] + high[k] + length - 1))
    return spans(*map(np.concatenate, zip(*found))) if found else {}


def keep_bytes(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in gone:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def _finish(folder: str, length: int, emit):
    """Calls ``emit`` with a list of (document, text, spans, rest) for each batch and yields what it makes of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = BlobReader(folder)
        for batch in batches:
            for file, offset, size, docs, answers in zip(*(_column(batch, c) for c in ("file", "offset", "size", "docs", "answers"))):
                ids = np.array([0 if d["doc_id"] is None else d["doc_id"] for d in docs], np.int64)
                docs, ids = (list(x) for x in zip(*sorted(zip(docs, ids.tolist()), key=lambda x: x[0]["pos"])))
                places = _places(answers or [], np.array(ids, np.int64), texts, length)
                data, out = texts.read(file, offset, size), []
                for d in docs:
                    n = d["n_bytes"] or 0
                    text = data[d["at"] : d["at"] + n]
                    gone = [(0, n)] if d["copy"] and n >= length else places.get(d["pos"], [])
                    out.append((d, text, gone, keep_bytes(text, gone) if gone else text))
                yield emit(out)

    return run


def _passes(docs: DataFrame, length: int, hot: int, more: list[str]) -> tuple[DataFrame, str]:
    """``(work, folder)``: a row for each batch with its documents and the buckets' answers."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    staged, folder = scratch.staged, scratch.folder("texts")
    parts = shuffle_parts(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in more]).alias("more")] if more else []))
    fields = [("file", T.StringType()), ("offset", T.LongType()), ("size", T.LongType()), ("pos", T.IntegerType()), ("at", T.LongType()), ("n_bytes", T.LongType()), ("doc_id", T.LongType()), ("own", T.BinaryType())]
    fields += [("more", d.schema["more"].dataType)] if more else []
    index = staged(d.mapInArrow(_write_batches(folder, bool(more)), T.StructType([T.StructField(*f) for f in fields])), "texts-index")
    classes = staged(index.where("doc_id is not null").groupBy("own").agg(F.min("doc_id").alias("rep")), "classes")
    copies = index.select("file", "offset", "pos", "own", "doc_id").join(classes, "own").where("rep < doc_id").select("file", "offset", "pos")
    copies = copies.groupBy("file", "offset").agg(F.collect_set("pos").alias("copies"))  # of one batch
    columns = ["pos", "at", "n_bytes", "doc_id", *(["more"] if more else [])]
    batches = index.groupBy("file", "offset", "size").agg(F.collect_list(F.struct(*columns)).alias("docs"))  # of one batch
    work = batches.join(copies, ["file", "offset"], "left").withColumn("copies", F.coalesce("copies", F.array().cast("array<int>")))
    work = work.withColumn("docs", F.transform("docs", lambda x: F.struct(*[x[c].alias(c) for c in columns], F.array_contains("copies", x["pos"]).alias("copy"), (~F.array_contains("copies", x["pos"]) & x["doc_id"].isNotNull() & (F.coalesce(x["n_bytes"], F.lit(0)) >= length)).alias("live"))))
    work = staged(work.drop("copies"), "work")
    count, total = work.agg(F.count("*"), F.sum(F.aggregate("docs", F.lit(0).cast("long"), lambda s, x: s + F.when(x["live"], x["n_bytes"]).otherwise(0)))).first()
    n, tasks = max(parts, int((total or 0) // BUCKET_BYTES) + 1), max(1, min(count, max(parts, count // 4)))
    lean = work.select("file", "offset", "size", F.transform("docs", lambda x: F.struct(*[x[c].alias(c) for c in ("pos", "at", "n_bytes", "doc_id", "live")])).alias("docs"))
    sent = lean.repartition(tasks).mapInArrow(_send_anchors(folder, n, length), _KEYS)
    answers = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer_anchors(hot), "file string, offset long, shared binary, hot binary")
    answers = staged(answers.groupBy("file", "offset").agg(F.collect_list("shared").alias("shared"), F.collect_list("hot").alias("hot")), "answers")  # of one batch
    dealt = lean.join(answers, ["file", "offset"]).repartition(tasks).mapInArrow(_send_segments(folder, 4 * n, length), _PAYLOAD)
    runs = staged(dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_lpf(length), _ANSWER), "runs")
    scratch.discard(folder, work, runs)
    found = runs.groupBy("file", "offset").agg(F.collect_list(F.struct("base", "pieces", "seen", "runs")).alias("answers"))  # of one batch
    out = work.join(found, ["file", "offset"], "left")
    return out.repartition(tasks), folder


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _report_rows(out: list) -> pa.RecordBatch:
    rows = [(d["doc_id"], len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(rest).hexdigest()) for d, text, gone, rest in out]
    types = [pa.int64()] * 4 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in _REPORT.split(", ")])


def dedup_report(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row for each document.

    Null texts count as empty, texts shorter than ``length`` keep all, a document without id is never matched, repeated
    rows each get a row and take nothing from each other, other columns are not read.
    """
    work, folder = _passes(docs, length, hot, [])
    return work.mapInArrow(_finish(folder, length, _report_rows), _REPORT)


def cut_documents(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``docs`` with all its columns and the spans cut out of ``text``; rows that lose their whole text go.

    A cut can fall inside a character; what is left of it goes too. A null text stays null, an empty one empty.
    """
    more = [c for c in docs.columns if c != "text"]
    work, folder = _passes(docs, length, hot, more)
    kind = T.StructType([docs.schema[c] for c in more])
    arrow = to_arrow_type(kind)

    def rows(out: list) -> pa.RecordBatch:
        kept = [(d["more"], None if d["n_bytes"] is None else rest.decode(errors="ignore")) for d, _, gone, rest in out if not gone or rest.decode(errors="ignore")]
        return pa.RecordBatch.from_arrays([pa.array([m for m, _ in kept], arrow), pa.array([t for _, t in kept], pa.string())], names=["more", "text"])

    cut = work.mapInArrow(_finish(folder, length, rows), T.StructType([T.StructField("more", kind), T.StructField("text", T.StringType())]))
    return cut.select(*[F.col("text") if c == "text" else F.col(f"more.`{c}`") for c in docs.columns])


def op10_lpf_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


#: Every window as hex, its least document, and the islands of those that start earlier elsewhere.
OP10_SQL = f"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS INTEGER), {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE first < doc_id),
o AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM g),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM o),
t AS (SELECT doc_id, span, min(i) AS a, max(i) + {LENGTH} AS b FROM k GROUP BY doc_id, span),
e AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM t),
x AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, CAST(2 * before + 1 AS INTEGER), CAST(2 * (a - before) AS INTEGER)), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS INTEGER)))) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)
"""
