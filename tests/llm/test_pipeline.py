import random

import pytest
from brute import components, prose, removed
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import toxicity as tox
from weftgraph.llm.mixing import mixture


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng, where = random.Random(9), tmp_path_factory.mktemp("sf")
    passage = prose(rng, 30)
    rows = []
    for i in range(300):
        text = prose(rng, rng.randrange(20, 80))
        if i % 9 == 0:
            text = rows[rng.randrange(len(rows))][1] + " x" if rows else text
        if i % 4 == 1:
            text += "\n" + passage
        if i % 10 == 3:
            text += " zorkblat zorkblat"
        rows.append((i, text, "en", f"s{0 if i % 3 else i % 5}", len(text)))
    rows += [(900, None, "en", "s0", None), (901, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 3)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return f"file://{where}"


def test_every_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    clean = stages["toxicity"](spark, docs, sf).cache()
    assert clean.columns == docs.columns
    assert set(texts(clean)) == {r["doc_id"] for r in tox.score(docs, tox.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where("predicted = 0").collect()}
    assert set(texts(clean)) == {d for d, t in texts(docs).items() if "zorkblat" not in (t or "")}  # copies of toxic texts go too

    single = stages["near_dedup"](spark, clean, sf).cache()
    before = texts(clean)
    assert single.columns == docs.columns and texts(single) == {d: before[d] for d, c in components(before).items() if c == d}

    cut = stages["substring_dedup"](spark, single, sf).cache()
    expected = removed(texts(single))
    left = {d: x[4].decode(errors="ignore") for d, x in expected.items() if not x[1] or x[4]}
    assert cut.columns == docs.columns and {d: t or "" for d, t in texts(cut).items()} == left
    assert all(r["n_chars"] is None if r["text"] is None else r["n_chars"] == len(r["text"]) for r in cut.collect())

    mixed = stages["mixing"](spark, cut, sf).cache()
    placed = mixture(cut, budget=None).where("block is not null").groupBy("doc_id").count()
    assert mixed.columns == docs.columns and {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {r["doc_id"]: r["count"] for r in placed.collect()}
    assert set(texts(mixed)) == set(texts(cut))  # no clean document is left out
    often = [r["count"] for r in placed.collect()]
    assert min(often) == 1 and max(often) == 4  # the repetition limit holds the mixture here, as one source has but one document

    packed = stages["packing"](spark, mixed, sf)
    rows = packed.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in mixed.select("doc_id").collect()}
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in used.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 2048


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, sf)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and out.count() > 0
    assert out.agg(F.max("length")).first()[0] <= 2048
