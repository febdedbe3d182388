import random
import zlib

from brute import prose
from pyspark.sql import functions as F

from weftgraph.llm import toxicity as tox


def test_composed_grammar():
    fst = tox.grammar()
    cases = {
        "I": "I", "PI": "PA", "POOOOI": "POOOOA", "POOOOOI": "POOOOOI", "IOP": "AOP", "IOOOP": "AOOOP", "IOOOOP": "IOOOOP", "NI": "Ni", "NOOI": "NOOi", "NOOOI": "NOOOI", "RPOI": "RPOJ", "TP": "KP", "TOOP": "KOOP", "TOOOP": "TOOOP",
        "NTP": "NtP", "RTP": "RUP", "OOO": "OOO", "IIP": "AAP", "TIP": "KAP",
    }
    assert {tags: fst.best(tags)[1] for tags in cases} == cases


def test_best_path_against_all_paths():
    """The heaviest path by dynamic programming, against an enumeration of every path of short clauses."""
    fst = tox.grammar()

    def paths(state, tags):
        if not tags:
            return [(0.0, "")] if state in fst.finals else []
        return [(w + v, out + rest) for out, w, to in fst.arcs.get((state, tags[0]), []) for v, rest in paths(to, tags[1:])]

    rng = random.Random(2)
    for _ in range(400):
        tags = "".join(rng.choice("ITPNRO") for _ in range(rng.randrange(0, 8)))
        every = paths(fst.start, tags)
        weight, out = fst.best(tags)
        assert (weight, out) in every and weight == max(w for w, _ in every)


def test_clauses_and_features():
    lexicon = tox.Lexicon({"blub*": 5.0, "zork": 4.0})
    plain, aimed, negated, reported = (lexicon.features(t) for t in ("a zork b", "you are a zork", "that is not a zork", "she said it was a zork"))
    assert aimed[-1] > plain[-1] > reported[-1] > negated[-1] > 0
    assert lexicon.features("BLUBBERING on")[-1] == lexicon.features("blubx on")[-1] > 0
    for clean in ("xblubber", "zorked", "", None, "nothing here. at all"):
        assert lexicon.features(clean) == [0.0] * 9
    assert list(lexicon.clauses("fine. you zork, x! zork zork\nend")) == [" you zork", " zork zork"]
    assert lexicon.features("well. " * 20_000 + "zork")[-1] > 0


def labelled(rng, n=1500):
    stems, docs, labels = ["grobul", "vexi"], [], []
    for i in range(n):
        toxic = i % 7 == 0
        words = prose(rng, rng.randrange(5, 60), 400).split()
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "na", "ta", "res"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled(random.Random(1))
    extra = [(9000, None), (9001, ""), (None, "you grobulna"), (9002, "zz " * 50_000 + "grobulta")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string").select("*", F.lit(1).alias("toxic"), F.lit("x").alias("score")).repartition(4)
    gold = spark.createDataFrame([(d, t, 1) for d, t in labels] + [(None, 1, 1), (3, None, 1), (5, 0, 1)], "doc_id long, toxic int, quality int")
    model = tox.fit(df, gold)
    assert {"grobul*", "vexi*"} <= set(model.lexicon)
    got = {r["doc_id"]: r for r in tox.score(df, model).collect()}
    assert len(got) == len(docs) + len(extra)
    truth = dict(labels)
    for d, r in got.items():
        assert r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [d for d in truth if got[d]["held_out"]]
    assert sum(got[d]["predicted"] == truth[d] for d in held) >= 0.98 * len(held)
    assert got[9000]["predicted"] == got[9001]["predicted"] == 0 and got[None]["predicted"] == got[9002]["predicted"] == 1
    kept = tox.drop_toxic(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if not r["predicted"]}
    # held-out labels are never learned from
    flipped = gold.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tox.fit(df, flipped).lexicon == model.lexicon


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "you are an idiot"), (2, "fine words")], "doc_id long, text string")
    model = tox.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in tox.score(df, model).collect()}
    assert got == {1: 1, 2: 0} and tox.score(df.where("false"), model).count() == 0


def test_chosen_stems():
    counts = {"path*": (40, 0), "pathetic": (40, 0), "pathe*": (40, 0), "lowe*": (30, 0), "lowei*": (30, 0), "loweix": (9, 0), "common": (50, 200)}
    kept = tox.choose_stems(counts, 100, 400, 10.0)
    assert set(kept) == {"pathetic", "lowei*"}
