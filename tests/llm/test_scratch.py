import os

from weftgraph.llm.common import Scratch
from weftgraph.llm.near_dedup import near_duplicates


def folders(spark):
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    return {f.split("-")[0] for f in os.listdir(top)} if os.path.isdir(top) else set()


def test_discard(spark):
    scratch = Scratch(spark)
    kept, gone = (scratch.staged(spark.range(3), name) for name in ("keptframe", "goneframe"))
    folder = scratch.folder("goneplace")
    scratch.discard(kept)
    assert kept.count() == 3 and "keptframe" in folders(spark) and "goneframe" not in folders(spark)
    scratch.discard(folder)
    assert "keptframe" not in folders(spark)


def test_only_what_the_result_reads_stays(spark):
    before = folders(spark)
    out = near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (3, "x")], "doc_id long, text string"))
    assert folders(spark) - before <= {"prints", "classes", "labels"}
    assert sorted((r["doc_id"], r["component_id"]) for r in out.collect()) == [(1, 1), (2, 2), (3, 3)]
