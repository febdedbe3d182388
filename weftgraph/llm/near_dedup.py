"""Operator 7: near duplicates by a chosen-path set similarity join.

A document is the set of its distinct 5-word shingles. Documents with equal sets are one class, represented by its least
id, so copies cost nothing more. Every representative has 64 minwise tokens; ``TREES`` trees own ``EACH`` of these
coordinates, so trees are independent of each other, while the branches of one tree share its coordinates. A node's path
is a set of (coordinate, token) choices; every node chooses two of its tree's coordinates that its path hasn't got, and
a document goes to the children that its own tokens name. Two documents of Jaccard similarity 0.75 share a root's child
in one tree with probability 1 - 0.25**2, so six trees miss them there with probability 6e-8; three levels down, where
the hottest nodes are taken apart, a tree misses them with probability under 0.18 and six with under 4e-5.

At every level

* nodes whose documents are all linked already end;
* nodes of at most ``LEAF`` documents are one tile and compared exhaustively;
* larger nodes are dealt to tiles by a hash of the document, each with the same block of about ``FEW`` of the node's
  strays (documents outside its largest component). A node of no more strays is done, others branch. Where a path has
  no coordinate left, the remaining blocks of strays follow one by one, so nothing is left out.

A tile gives links and not pairs: the labels (components so far) of its documents, found by set sizes (exact) and sketches
(``AGREE`` of 64 tokens of 16 bits), are joined likeliest pair first, each confirmed on the full shingle sets of the whole
texts, and pairs within one label aren't looked at any more. So a tile's rows are a forest, fewer than its documents;
each label is linked with the least one that it meets, so that components need few rounds.
Texts are read from the shared folder by file and offset, only where a tile has a candidate for them.
The first ``FIRST`` trees run before the others, which then meet hardly any node of more than one label.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import BlobReader, BlobWriter, Scratch, bounded, connected_components, staged, table

WORDS, PERCENT, TREES, EACH, FIRST, LEAF, FEW, CHUNK = 5, 75, 6, 10, 2, 4096, 64, 1 << 18
COORDINATES = 64
#: Of COORDINATES tokens at least so many must agree: a pair at 75 % falls short with probability 3e-5.
AGREE = 34
#: Shingles of all sets that a task keeps at a time, besides the two it compares.
SETS = 1 << 21
#: A document with so many candidates in its tile is compared with all of them at once.
MANY = 8

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_A = _RANDOM.integers(0, 2**64, COORDINATES, np.uint64) | np.uint64(1)
_B = _RANDOM.integers(0, 2**64, COORDINATES, np.uint64)
_SALTS = _RANDOM.integers(0, 2**64, COORDINATES, np.uint64)
_powers: dict[int, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; those that usual chunks need are kept, those of a very long text are not."""
    most = 2 * CHUNK
    if n > most or int(base) not in _powers:
        out = np.full(max(n, most), base, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > most:
            return out[:n]
        _powers[int(base)] = out
    return _powers[int(base)][:n]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    A-Z are lower-cased; words are runs of characters other than space, tab, line feed, vertical tab, form feed and
    carriage return. A text of fewer words is one shingle, a text without any is the empty set.
    """
    split = [(t or "").encode().lower().split() for t in texts]
    out = [np.empty(0, np.uint64)] * len(texts)
    full = [i for i, w in enumerate(split) if w]
    if not full:
        return out
    buffer = np.frombuffer(b" ".join(w for i in full for w in split[i]), np.uint8)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buffer] * _power(_BASE, len(buffer)))))
    gaps = np.flatnonzero(buffer == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(buffer)]))
    at, down = 0, _power(_INVERSE, len(buffer) + 1)
    for i in full:
        n = len(split[i])
        s, e = starts[at : at + max(1, n - words + 1)], ends[at + min(n, words) - 1 : at + n]
        out[i] = np.unique(mixed((sums[e] - sums[s]) * down[s]))
        at += n
    return out


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """The 64-bit minwise tokens of non-empty sets: one row for each set, one column for each coordinate."""
    flat, offsets = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.uint64)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(flat * _A[k] + _B[k], offsets)
    return mixed(out)


_PRINT = "doc_id long, n long, k1 long, k2 long, file string, offset long, size int, nodes array<long>, sketch binary"


def _roots(tokens: np.ndarray) -> np.ndarray:
    """The two root nodes of every tree for each row of full tokens."""
    of = np.array([EACH * t + j for t in range(TREES) for j in range(2)])
    return mixed(tokens[:, of] ^ _SALTS[of]).view(np.int64)


def _prints(folder: str):
    """Sizes, keys, root nodes and sketches of the sets; the texts go to the shared folder."""
    names = [x.split()[0] for x in _PRINT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with BlobWriter(folder) as blobs:
            for batch in batches:
                for part in bounded(batch, 1, CHUNK):
                    texts = part.column(1).to_pylist()
                    sets = shingle_sets(texts)
                    k, n = len(texts), np.array([len(s) for s in sets], np.int64)
                    keys, nodes, sketch, place = np.zeros((k, 2), np.uint64), [[]] * k, [b""] * k, [(None, 0, 0)] * k
                    if some := [i for i in range(k) if n[i]]:
                        tokens = minwise([sets[i] for i in some])
                        first = _roots(tokens)
                        for j, i in enumerate(some):
                            keys[i] = sets[i].sum(), mixed(sets[i] ^ _BASE).sum()
                            nodes[i], sketch[i] = first[j], tokens[j].astype("<u2").tobytes()
                            place[i] = blobs.add(texts[i].encode())
                    keys, (file, offset, size) = keys.view(np.int64), zip(*place)
                    columns = [part.column(0), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(size, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(nodes, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=names)

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, COORDINATES)


class _Sets:
    """Full shingle sets by place, the last used ones kept up to ``SETS`` shingles."""

    def __init__(self, folder: str):
        self._blobs, self._kept, self._total = BlobReader(folder), OrderedDict(), 0

    def __call__(self, file: str, offset: int, size: int) -> np.ndarray:
        key = file, offset
        if key in self._kept:
            self._kept.move_to_end(key)
        else:
            self._kept[key] = shingle_sets([self._blobs.read(file, offset, size).decode()])[0]
            self._total += len(self._kept[key])
            while self._total > SETS and len(self._kept) > 2:
                self._total -= len(self._kept.popitem(last=False)[1])
        return self._kept[key]


class _Tile:
    """Exact comparisons within one tile, of documents by position."""

    def __init__(self, sets: _Sets, places: list[tuple], n: np.ndarray):
        self._sets, self._places, self._n = sets, places, n
        self._mark = self._flat = self._starts = None

    def _number(self) -> None:
        """Shingles of all documents as small numbers: where they fit, a document meets all others in one pass."""
        every = [self._sets(*p) for p in self._places]
        names, self._flat = np.unique(np.concatenate(every), return_inverse=True)
        self._starts, self._mark = np.cumsum([0, *map(len, every[:-1])]), np.zeros(len(names), bool)

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` share enough of the union."""
        if len(others) >= MANY and self._mark is None and self._n.sum() <= SETS:
            self._number()
        if len(others) >= MANY and self._mark is not None:
            own = self._flat[self._starts[i] : self._starts[i] + self._n[i]]
            self._mark[own] = True
            both = np.add.reduceat(self._mark[self._flat], self._starts, dtype=np.int64)[others]
            self._mark[own] = False
        else:
            x = self._sets(*self._places[i])
            both = np.array([len(np.intersect1d(x, self._sets(*self._places[j]), assume_unique=True)) for j in others.tolist()])
        return 100 * both >= PERCENT * (self._n[i] + self._n[others] - both)


def forest(label: np.ndarray, n: np.ndarray, tokens: np.ndarray, similar) -> list[tuple[int, int]]:
    """Links between the labels of one tile that join all that candidates join, each label with the least it meets.

    ``similar(i, others)`` confirms candidates of document ``i``.
    """
    names, of = np.unique(label, return_inverse=True)
    root = np.arange(len(names))  # the least label joined with each, as names are sorted
    minor = of != np.bincount(of).argmax()  # holds one side of every pair that isn't linked
    rows, columns = np.flatnonzero(minor), np.ascontiguousarray(tokens.T)
    for block in np.array_split(rows, 1 + len(rows) // 64):
        same = np.zeros((len(block), len(of)), np.uint8)
        for one in columns:
            same += one[block][:, None] == one[None]
        for i, agree in zip(block.tolist(), same):
            j = np.flatnonzero(agree >= AGREE)
            j = j[(~minor[j] | (j > i)) & (root[of[j]] != root[of[i]]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))]
            if len(j) < MANY:  # likeliest first, and no more than are needed
                parts = [j[k : k + 1] for k in np.argsort(-agree[j].astype(np.int16), kind="stable")]
            else:
                parts = [j]
            for part in parts:
                part = part[root[of[part]] != root[of[i]]]
                for r in np.unique(root[of[part[similar(i, part)]]]).tolist() if len(part) else []:
                    low, high = sorted((int(root[of[i]]), r))
                    root[root == high] = low
    return [(int(names[r]), int(name)) for r, name in zip(root, names) if names[r] != name]


_TILE = ["node", "tile", "label", "n", "sketch", "file", "offset", "size"]


def _compared(folder: str):
    """The links of each tile. Rows come sorted by node and tile."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = _Sets(folder), []

        def links() -> list[tuple[int, int]]:
            rows = pa.Table.from_batches(held).combine_chunks()
            label, n = (rows.column(c).to_numpy() for c in ("label", "n"))
            if (label == label[0]).all():
                return []
            places = list(zip(*(rows.column(c).to_pylist() for c in ("file", "offset", "size"))))

            return forest(label, n, _matrix(rows.column("sketch")), _Tile(sets, places, n).similar)

        def out(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            node, tile, found = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            edges = [0, *(np.flatnonzero((node[1:] != node[:-1]) | (tile[1:] != tile[:-1])) + 1).tolist(), len(node)]
            for a, b in zip(edges[:-1], edges[1:]):
                if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (int(node[a]), int(tile[a])):
                    found += links()
                    held = []
                held.append(batch.slice(a, b - a))
            yield out(found)
        if held:
            yield out(links())

    return run


_CHILD = "node long, tree int, used int, rep long"
_FREE = np.array([([c for c in range(EACH) if not mask >> c & 1] + [0] * EACH)[:EACH] for mask in range(1 << EACH)])


def _children(level: int):
    """The children of (node, tree, used, rep, sketch): two, or one where the tree has but one coordinate left."""
    free = EACH - 1 - level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, tokens = batch.column(0).to_numpy().view(np.uint64), _matrix(batch.column(4))
            tree, used = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2))
            h, rows = mixed(node + np.uint64(1)), np.arange(len(node))
            at, nodes, masks = (h % np.uint64(free)).astype(np.int64), [], []
            for _ in range(min(2, free)):
                own = _FREE[used, at]
                c = EACH * tree + own
                nodes.append((node + mixed(_SALTS[c] + tokens[rows, c].astype(np.uint64))).view(np.int64))  # a sum: the order of choices is no matter
                masks.append((used | 1 << own).astype(np.int32))
                at = (at + 1 + ((h >> np.uint64(32)) % np.uint64(max(1, free - 1))).astype(np.int64)) % free
            k = len(nodes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.concat_arrays([batch.column(1)] * k), pa.array(np.concatenate(masks)), pa.concat_arrays([batch.column(3)] * k)], names=["node", "tree", "used", "rep"])

    return run


def _joined(labels: DataFrame | None, links: DataFrame, staged) -> DataFrame:
    """(rep, label) after ``links`` between labels have been added."""
    if labels is not None:
        links = links.union(labels)
    scratch = Scratch(links.sparkSession)
    out = staged(connected_components(links, scratch.staged).select(F.col("node").alias("rep"), F.col("component").alias("label")), "labels")
    scratch.discard()
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each document.

    Rows with the same id are one node, which links what its texts link. A null id is linked with nothing: its component
    is null and it is kept. Null, empty and blank texts have the empty set and are linked with nothing. A very long text
    is one set like any other. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    staged, folder = scratch.staged, scratch.folder("near-texts")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = staged(texts.mapInArrow(_prints(folder), _PRINT), "prints")
    usable = prints.where("n > 0 and doc_id is not null")
    reps = usable.groupBy("n", "k1", "k2").agg(F.min(F.struct("doc_id", "file", "offset", "size")).alias("x"), F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch"))
    reps = staged(reps.select(F.col("x.doc_id").alias("rep"), "n", "k1", "k2", "x.file", "x.offset", "x.size", "nodes", "sketch"), "reps")
    of = staged(usable.select("doc_id", "n", "k1", "k2").hint("merge").join(reps.select("rep", "n", "k1", "k2"), ["n", "k1", "k2"]).select("doc_id", "n", "rep"), "classes")
    several = of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")  # ids with different texts
    links = staged(of.join(several, "doc_id").select("a", F.col("rep").alias("b")).where("a < b"), "links")
    labels = _joined(None, links, staged) if links.limit(1).count() else None
    known = reps.select("rep", "n", "sketch", "file", "offset", "size")
    for first, last in ((0, FIRST), (FIRST, TREES)):
        roots = reps.select("rep", F.slice("nodes", 2 * first + 1, 2 * (last - first)).alias("nodes"))
        roots = roots.join(labels, "rep", "left") if labels else roots.withColumn("label", F.lit(None).cast("long"))
        rows = roots.select("rep", "label", F.posexplode("nodes").alias("turn", "node"))
        rows = rows.select("node", (F.floor(F.col("turn") / 2) + first).cast("int").alias("tree"), (F.col("turn") % 2 + 1).cast("int").alias("used"), "rep", "label")
        inner = known
        for level in range(EACH):
            mine = rows if not level else rows.join(labels, "rep", "left") if labels else rows.withColumn("label", F.lit(None).cast("long"))
            mine = mine.select("node", "tree", "used", "rep", F.coalesce("label", "rep").alias("label"))
            mixed_nodes = mine.groupBy("node").agg(F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("node", "members")
            mixed_nodes = staged(mixed_nodes, "mixed")  # a join with an aggregate is never split where a node is hot, one with a table is
            mine = staged(mine.hint("merge").join(mixed_nodes, "node"), "rows")
            tiles = F.ceil(F.col("members") * 2 / LEAF).cast("int")
            small = mine.where(F.col("members") <= LEAF).select("node", F.lit(0).alias("tile"), "rep", "label")
            large = mine.where(F.col("members") > LEAF)
            by_label = large.groupBy("node", "label").agg(F.count("*").alias("k"), F.first("members").alias("members"))
            most = by_label.groupBy("node").agg(F.max(F.struct("k", "label")).alias("most"), F.first("members").alias("members"))
            most = staged(most.select("node", F.col("most.label").alias("major"), F.ceil((F.col("members") - F.col("most.k")) / FEW).cast("int").alias("blocks")), "majors")
            blocks = most.agg(F.max("blocks")).first()[0] or 0
            large = large.withColumn("tile", F.pmod(F.xxhash64("rep"), tiles).cast("int"))
            strays = large.hint("merge").join(most, "node").where("label <> major").withColumn("block", F.pmod(F.xxhash64("rep", "node"), F.col("blocks")).cast("int"))
            for block in range(blocks if level == EACH - 1 else min(blocks, 1)) or [None]:
                parts = [] if block else [small]
                if block is not None:
                    several = large if not block else large.join(most.where(F.col("blocks") > block).select("node"), "node", "left_semi")
                    few = strays.where(F.col("block") == block).select("node", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), "rep", "label")
                    parts += [several.select("node", "tile", "rep", "label"), few]
                tile = parts[0]
                for part in parts[1:]:
                    tile = tile.union(part)
                dealt = tile.hint("merge").join(inner, "rep").select(*_TILE).repartition("node", "tile").sortWithinPartitions("node", "tile")
                links = staged(dealt.mapInArrow(_compared(folder), "a long, b long"), "links")
                if links.limit(1).count():
                    labels = _joined(labels, links, staged)
            if blocks < 2 or level == EACH - 1:
                break
            open_nodes = large.join(most.where("blocks > 1").select("node"), "node", "left_semi")
            inner = staged(inner.hint("merge").join(open_nodes.select("rep").distinct(), "rep", "left_semi"), "open")
            open_nodes = open_nodes.join(inner, "rep")
            rows = open_nodes.select("node", "tree", "used", "rep", "sketch").mapInArrow(_children(level), _CHILD).distinct()
    scratch.discard(prints, of, labels)
    labels = labels if labels else of.select("rep", F.col("rep").alias("label")).where("false")
    linked = of.join(labels, "rep", "left").select("doc_id", "n", F.coalesce("label", "rep").alias("component"))
    alone = prints.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the documents that aren't the least of their component."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone id")).distinct()
    gone = staged(gone, "gone")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("gone id"), "left_anti")


def op7_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Links by an unnested self join over shingles, components by transitive closure.
OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS x FROM d),
u AS (SELECT doc_id, len(x) AS n, unnest(x) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(least, doc_id)) AS kept FROM s LEFT JOIN c USING (doc_id)
"""
