"""What the operators share: tables, texts in the shared folder, partition counts, file systems and connected components."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import Scratch, shared_dir, staged

__all__ = ["BlobReader", "BlobWriter", "Scratch", "bounded", "connected_components", "shared_dir", "shuffle_parts", "staged", "table", "uri_filesystem"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uri_filesystem(uri: str):
    """The pyarrow filesystem and path of a shared-folder URI, for ranged reads and writes on executors."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def bounded(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``size`` bytes of text in ``column`` (one row at least), so that Python holds few rows at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class BlobWriter:
    """Compressed blobs in one file of a shared folder, of a name that no other task attempt has; the file is begun with the first blob."""

    def __init__(self, folder: str):
        self._fs, self._top = uri_filesystem(folder)
        self._name, self._out, self._offset = f"{uuid.uuid4().hex}.zst", None, 0
        self._press = zstandard.ZstdCompressor(level=3)

    def __enter__(self) -> BlobWriter:
        return self

    def __exit__(self, *_) -> None:
        if self._out is not None:
            self._out.close()

    def add(self, data: bytes) -> tuple[str, int, int]:
        """The file, offset and size of the blob."""
        if self._out is None:
            self._fs.create_dir(self._top, recursive=True)
            self._out = self._fs.open_output_stream(f"{self._top}/{self._name}", compression=None)
        blob = self._press.compress(data)
        self._out.write(blob)
        self._offset += len(blob)
        return self._name, self._offset - len(blob), len(blob)


class BlobReader:
    """Reads blobs back by file, offset and size; a few files stay open."""

    def __init__(self, folder: str, files: int = 16):
        self._fs, self._top = uri_filesystem(folder)
        self._press, self._open, self._files = zstandard.ZstdDecompressor(), OrderedDict(), files

    def read(self, file: str, offset: int, size: int) -> bytes:
        if file in self._open:
            self._open.move_to_end(file)
        else:
            self._open[file] = self._fs.open_input_file(f"{self._top}/{file}")
            if len(self._open) > self._files:
                self._open.popitem(last=False)[1].close()
        return self._press.decompress(self._open[file].read_at(size, offset))


def connected_components(links: DataFrame, staged=staged) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; component = smallest reachable id.

    Alternating large-star and small-star steps to the fixpoint: each round every node hands its smallest neighbour to its
    larger (then its smaller) neighbours, so the edge count never grows and the number of rounds is logarithmic in practice.
    Every round is written to the shared folder, so a lost executor costs at most one round. A hub of millions of
    neighbours is only ever an aggregation key (min with map-side combine) and the skewed side of a join AQE splits.
    Self links are allowed and null ends are ignored.
    """
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    edges = edges.where("a <> b")
    before, now = None, ()
    while now != before:  # an empty table is a fixpoint at once
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = staged(small.where("a <> b").distinct(), "cc")
        # the edges as a set: their number and two sums of hashes, which can't overflow
        before, now = now, tuple(edges.agg(F.count("*"), *[F.sum(F.pmod(F.xxhash64("a", "b", F.lit(k)), F.lit(2147483647)).cast("decimal(38,0)")) for k in (1, 2)]).first())
        if not now[0]:
            break
    return nodes.join(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
