import math
import random

from pyspark.sql import functions as F

from weftgraph.llm.mixing import mix, mixture, source_weights


def weights(spark, totals, **kw):
    return {r["source"]: r for r in source_weights(spark.createDataFrame(list(totals.items()), "source string, tokens long"), **kw).collect()}


def test_entropy_target(spark):
    w = weights(spark, {"a": 9000, "b": 900, "c": 100}, entropy=0.8, repeats=1e9)
    h = -sum(r["weight"] * math.log(r["weight"]) for r in w.values())
    assert abs(sum(r["weight"] for r in w.values()) - 1) < 1e-9 and abs(h - 0.8 * math.log(3)) < 1e-6 and w["a"]["weight"] > w["b"]["weight"] > w["c"]["weight"]
    assert weights(spark, {"a": 10, "b": 10}, entropy=0.9)["a"]["exponent"] == 1.0  # flat enough as it is
    assert weights(spark, {"a": 7}, entropy=0.9)["a"]["weight"] == 1.0


def test_repetition_limit(spark):
    w = weights(spark, {"a": 9000, "b": 900, "c": 100}, entropy=1.0, repeats=2.0)
    assert abs(max(r["weight"] * 10_000 / r["tokens"] for r in w.values()) - 2.0) < 1e-6
    assert all(r["epochs"] <= 2.0 for r in w.values())


def docs(spark, rng, n=600):
    rows = [(i, " ".join(["x"] * rng.randrange(1, 30)), "big" if i % 3 else rng.choice(["s", "t", None]), i) for i in range(n)]
    rows += [(n, None, "s", 0), (n + 1, "", "s", 0), (None, "no id", "t", 0), (5, "x y", "big", 0), (5, "x y", "big", 0), (n + 2, "w " * 5000, "t", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, bucket long").select("*", F.lit("e").alias("group"), F.lit("f").alias("copies")).repartition(5)


def test_blocks_meet_the_quota(spark):
    rows, df = docs(spark, random.Random(3))
    every = mixture(df, 0.95, 4.0).collect()
    out = [r for r in every if not r["block"]]  # a row for each document
    assert len(out) == len(rows) and len(every) == sum(max(1, r["copies"]) for r in out)
    count = lambda t: max(1, len((t or "").split()))
    assert sorted((r["doc_id"] or -1, r["tokens"]) for r in out) == sorted((d if d else -1 if d is None else 0, count(t)) if d else (-1, count(t)) for d, t, *_ in rows)
    totals = {}
    for r in out:
        totals.setdefault(r["source"], []).append(r)
    w = weights(spark, {str(s): sum(r["tokens"] for r in x) for s, x in totals.items()}, entropy=0.95, repeats=4.0)
    for s, x in totals.items():
        assert max(r["copies"] for r in x) - min(r["copies"] for r in x) <= 1
        over = sum(r["copies"] * r["tokens"] for r in x) - w[str(s)]["quota"]
        assert 0 <= over <= max(r["tokens"] for r in x)


def test_blocks_are_fresh_permutations(spark):
    """Every block has an order of its own, blocks follow each other, and the cut takes the first of the last block."""
    df = spark.createDataFrame([(i, "w", "big" if i < 300 else "small") for i in range(360)], "doc_id long, text string, source string")
    out = [r for r in mixture(df, 1.0, 8.0).collect() if r["source"] == "small"]
    blocks = {}
    for r in sorted(out, key=lambda r: r["place"]):
        blocks.setdefault(r["block"], []).append(r["doc_id"])
    assert list(blocks) == [0, 1, 2] and [len(x) for x in blocks.values()][:2] == [60, 60] and len(blocks[2]) >= 59 and len({tuple(x) for x in blocks.values()}) == 3
    assert set(blocks[1]) == set(blocks[0]) >= set(blocks[2]) and 0 <= min(r["place"] for r in out) and max(r["place"] for r in out) < 1
    places = [r["place"] for r in mixture(df, 1.0, 8.0).orderBy("place").where("block is not null and source = 'small'").collect()]
    assert all(abs(sum(p < x for p in places) / 180 - x) < 0.1 for x in (0.1, 0.3, 0.5, 0.9))  # any stretch holds the share


def test_hot_ids_and_no_ids_are_cut_too(spark):
    """1000 rows without id and 1000 of one id: still at most one document over."""
    rows = [(None, "a b", "one")] * 1000 + [(7, "a b", "two")] * 1000 + [(i, "a", "three") for i in range(10, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mixture(df, 1.0, 4.0).where("block is not null").groupBy("source").agg(F.sum("tokens").alias("t")).collect()
    w = weights(spark, {"one": 2000, "two": 2000, "three": 290}, entropy=1.0, repeats=4.0)
    assert all(0 <= r["t"] - w[r["source"]]["quota"] <= 1 for r in out) and len(out) == 3


def test_whole_sources(spark):
    """Without a budget every source is written whole at least once, the least favoured one exactly once."""
    rows, df = docs(spark, random.Random(6))
    out = mixture(df, budget=None).where("block is null or block = 0").collect()
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r["copies"])
    assert set(by["big"]) == {1} and all(1 <= min(x) and max(x) <= 4 for x in by.values())


def test_mix_keeps_columns_and_repeats_rows(spark):
    rows, df = docs(spark, random.Random(4), 90)
    mixed, placed = mix(df), mixture(df).where("block is not null")
    assert mixed.columns == df.columns
    assert mixed.count() == placed.count()
    assert mix(df.where("false")).count() == 0 and mixture(df.where("false")).count() == 0
    unique = df.where("doc_id is not null and doc_id <> 5")
    assert [r["doc_id"] for r in mix(unique).collect()] == [r["doc_id"] for r in mixture(unique).where("block is not null").orderBy("place").collect()]
    for out in (mixed, placed):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
