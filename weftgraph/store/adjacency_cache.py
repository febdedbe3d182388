"""The visible edges of a store as adjacency lists, persisted with the version they were built from."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.aggregates import adjacency
from .edge_store import EdgeStore, read_text, write_text

FORMAT, VERSION = "weftgraph-adjacency", 1


def save(store: EdgeStore, target: str) -> dict:
    """Writes the lists of a store's last snapshot, sorted by source, and then the catalogue that names them: a write that fails
    leaves what was there. Buffered edges belong to no version and aren't in it."""
    target, folder = target.rstrip("/"), f"lists-{uuid.uuid4().hex}"
    store = EdgeStore.open(store.spark, store.path, store.config)
    lists = adjacency(store.scan()).select("src", "edge_type", "neighbors")
    lists.repartitionByRange("src").sortWithinPartitions("src", "edge_type").write.parquet(f"{target}/{folder}")
    groups, edges = store.spark.read.parquet(f"{target}/{folder}").agg(F.count("*"), F.sum(F.size("neighbors"))).first()
    entry = {"format": FORMAT, "version": VERSION, "store_version": store.version, "snapshot": store.snapshot(), "lists": folder, "groups": groups, "edges": edges or 0}
    write_text(store.spark, f"{target}/catalog.json", json.dumps(entry), True)
    return entry


def load(spark: SparkSession, target: str, store: EdgeStore | None = None) -> DataFrame:
    """``src, edge_type, neighbors``; an error if it is no such cache, of another format, or older than ``store``."""
    text = read_text(spark, f"{target.rstrip('/')}/catalog.json")
    entry = json.loads(text) if text else {}
    if entry.get("format") != FORMAT or entry.get("version") != VERSION:
        raise ValueError(f"{target} holds no adjacency lists of version {VERSION}")
    if store is not None and entry["store_version"] != store.version:
        raise ValueError(f"{target} was built from version {entry['store_version']} of the store, which is at {store.version}")
    return spark.read.schema("src long, edge_type int, neighbors array<long>").parquet(f"{target.rstrip('/')}/{entry['lists']}")
