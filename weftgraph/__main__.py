"""Command line: python -m weftgraph COMMAND ... over CSV folders, table folders and edge stores."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession, functions as F

from . import validate as v
from .plans import dispatch, updates
from .server import GraphServer
from .sources import snb_csv, star
from .store import adjacency_cache
from .store.config import StoreConfig
from .store.edge_store import EdgeStore
from .streaming.replay import read_batch


def session() -> SparkSession:
    return SparkSession.builder.appName("weftgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def graph_of(spark: SparkSession, where: str):
    """``star:DIR``, ``csv:DIR`` or the folder of imported tables."""
    kind, _, path = where.partition(":")
    return {"star": star.load, "csv": snb_csv.load}[kind](spark, path) if kind in ("star", "csv") else snb_csv.open_tables(spark, where)


def storage_bench(store: EdgeStore, edge_type: int, samples: int) -> dict:
    """Typed neighbours of sources taken at an even stride, one lookup each."""
    log = store.log().where(F.col("edge_type") == edge_type).select("src").distinct()
    total = log.count()
    stride = max(1, total // max(1, samples))
    chosen = [r["src"] for r in log.where(F.pmod(F.xxhash64("src"), F.lit(stride)) == 0).orderBy("src").limit(samples).collect()]
    started, edges = time.perf_counter(), 0
    for src in chosen:
        edges += store.neighbors(src, edge_type).count()
    seconds = time.perf_counter() - started
    return {"sources": len(chosen), "edges": edges, "seconds": round(seconds, 3), "qps": round(len(chosen) / seconds, 2) if seconds else None, **store.stats()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options) -> None:
        c = sub.add_parser(name)
        for x in positional:
            c.add_argument(x)
        for k, default in options.items():
            c.add_argument("--" + k.replace("_", "-"), default=default, type=type(default) if default is not None else int)

    command("import", "csv_root", "target")
    command("import-edges", "graph", "store")
    command("edge-props", "csv_root", "target")
    command("apply-updates", "graph", "files", "target")
    command("query", "graph", "params", query="")
    command("neighbors", "store", "src", edge_type=None, snapshot=None)
    command("scan", "store", snapshot=None, limit=20)
    command("stats", "store")
    command("adjacency", "store", "target")
    command("cached-neighbors", "target", "src", store="", edge_type=None)
    command("compact", "store", src_label=0, edge_type=0, best=0)
    command("validate-knows", "csv_root", "store")
    command("validate", "graph", "lines", queries="", limit=None)
    command("serve", "graph", host="127.0.0.1", port=9000)
    command("storage-bench", "store", edge_type=1, samples=100)
    return p


def main(argv: list[str] | None = None) -> object:
    a = parser().parse_args(argv)
    spark = session()
    out: object = None
    if a.command == "import":
        g = snb_csv.import_full(spark, a.csv_root, a.target)
        out = {n: df.count() for n, df in {**g.vertices, **g.edges}.items()}
    elif a.command == "import-edges":
        store = EdgeStore.create(spark, a.store, StoreConfig(graph_aware_l0=True))
        store.append(snb_csv.labelled_edges(graph_of(spark, a.graph)))
        out = store.stats()
    elif a.command == "edge-props":
        snb_csv.save_edge_properties(snb_csv.load(spark, a.csv_root), a.target)
    elif a.command == "apply-updates":
        snb_csv.save(updates.apply(graph_of(spark, a.graph), read_batch(spark, *a.files.split(","))), a.target)
    elif a.command == "query":
        out = dispatch.rows(dispatch.run(graph_of(spark, a.graph), json.loads(a.params), a.query or None))
    elif a.command == "neighbors":
        store = EdgeStore.open(spark, a.store)
        out = [r.asDict() for r in store.neighbors(int(a.src), a.edge_type, a.snapshot, measure=True).collect()]
        store.save_probes()
    elif a.command == "scan":
        out = [r.asDict() for r in EdgeStore.open(spark, a.store).scan(a.snapshot).orderBy("src", "edge_type", "dst").limit(a.limit).collect()]
    elif a.command == "stats":
        store = EdgeStore.open(spark, a.store)
        out = {**store.stats(), "partitions": store.partition_metrics()}
    elif a.command == "adjacency":
        out = adjacency_cache.save(EdgeStore.open(spark, a.store), a.target)
    elif a.command == "cached-neighbors":
        lists = adjacency_cache.load(spark, a.target, EdgeStore.open(spark, a.store) if a.store else None).where(F.col("src") == int(a.src))
        out = {r["edge_type"]: r["neighbors"] for r in (lists if a.edge_type is None else lists.where(F.col("edge_type") == a.edge_type)).collect()}
    elif a.command == "compact":
        store = EdgeStore.open(spark, a.store)
        out = store.compact_best() if a.best else store.compact_partition(a.src_label, a.edge_type) if a.src_label or a.edge_type else store.compact()
    elif a.command == "validate-knows":
        have = EdgeStore.open(spark, a.store).scan().where("edge_type = 1").select("src", "dst")
        expected = snb_csv.labelled_edges(snb_csv.load(spark, a.csv_root)).where("edge_type = 1").select("src", "dst")
        out = {r["side"]: r["count"] for r in v.difference(have, expected).groupBy("side").count().collect()}
    elif a.command == "validate":
        total = v.Report()
        for path in a.lines.split(","):
            lines = (r["value"] for r in spark.read.text(path).toLocalIterator())
            total += v.validate(graph_of(spark, a.graph), lines, dispatch.parse_query_list(a.queries) or None, a.limit)
        out = {"checked": total.checked, "passed": total.passed, "updated": total.updated, "skipped": total.skipped, "failed": total.failed}
    elif a.command == "serve":
        GraphServer(graph_of(spark, a.graph)).serve(a.host, a.port).serve_forever()
    elif a.command == "storage-bench":
        out = storage_bench(EdgeStore.open(spark, a.store), a.edge_type, a.samples)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
