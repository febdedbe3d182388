import random

from brute import prose
from pyspark.sql import functions as F

from weftgraph.llm import weak_quality as w


def sentences(rng, n):
    return " ".join(prose(rng, rng.randrange(6, 15)).capitalize().replace("w1", "the ") + "." for _ in range(n))


def junk(rng, kind):
    words = prose(rng, 60).split()
    if kind == 0:
        return " ".join(x + rng.choice(["###", "%%%", "&&&"]) for x in words)
    if kind == 1:
        return " | ".join(words)
    return " ".join(x for x in words[:12] for _ in range(9))


def test_em_finds_the_accuracies():
    rng, counts = random.Random(1), {}
    accuracy = (0.95, 0.8, 0.65, 0.9)
    for _ in range(8000):
        good = rng.random() < 0.7
        p = "".join("-" if rng.random() < 0.2 else "gb"[(rng.random() < a) != good] for a in accuracy)
        counts[p] = counts.get(p, 0) + 1
    posterior, vote = w.expectation_maximisation(counts)
    for k, a in enumerate(accuracy):
        assert abs(vote[k, 1, 0] / (vote[k, 1, 0] + vote[k, 1, 1]) - a) < 0.05 and abs(vote[k, 0, 1] / (vote[k, 0, 0] + vote[k, 0, 1]) - a) < 0.08
    assert posterior["gggg"] > 0.99 and posterior["bbbb"] < 0.01 and w.expectation_maximisation({})[0] == {}


def test_em_against_plain_loops():
    """One document at a time, vote by vote."""
    rng, docs = random.Random(3), []
    for _ in range(300):
        good = rng.random() < 0.6
        docs.append("".join("-" if rng.random() < 0.3 else "gb"[(rng.random() < a) != good] for a in (0.9, 0.7, 0.8)))
    counts = {p: docs.count(p) for p in docs}
    posterior, vote = w.expectation_maximisation(counts, rounds=7)
    share = {p: (p.count("g") + 1) / (p.count("g") + p.count("b") + 2) for p in counts}
    good = {p: min(0.98, max(0.02, share[p] - 0.6 * ("b" in p))) for p in counts}
    for _ in range(7):
        table = {(k, c, v): 0.5 + sum(good[p] if c else 1 - good[p] for p in docs if p[k] == v) for k in range(3) for c in (0, 1) for v in "gb"}
        table = {(k, c, v): x / (table[k, c, "g"] + table[k, c, "b"]) for (k, c, v), x in table.items()}
        prior = [(sum(1 - good[p] for p in docs) + 1) / (len(docs) + 2), (sum(good[p] for p in docs) + 1) / (len(docs) + 2)]
        for p in counts:
            like = list(prior)
            for k, v in enumerate(p):
                like = [x * (table[k, c, v] if v != "-" else 1) for c, x in enumerate(like)]
            good[p] = like[1] / (like[0] + like[1])
    assert all(abs(posterior[p] - good[p]) < 1e-9 for p in counts) and abs(vote[1, 1, 0] - table[1, 1, "g"]) < 1e-9


def test_classifier(spark):
    rng = random.Random(2)
    docs = [(i, junk(rng, i % 3) if i % 5 == 0 else sentences(rng, rng.randrange(3, 12))) for i in range(400)]
    extra = [(1000, None), (1001, ""), (None, sentences(rng, 5)), (1002, sentences(rng, 2000))]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string").select("*", F.lit(1).alias("votes"), F.lit(2).alias("bins")).repartition(4)
    rows = w.classify(df, 300).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs) + len(extra)
    assert sum(got[i]["predicted"] == int(i % 5 != 0) for i, _ in docs) >= 0.95 * len(docs)
    assert sum(got[i]["predicted"] for i, _ in docs if i % 5) >= 0.97 * sum(i % 5 != 0 for i, _ in docs)
    assert got[1000]["score"] == got[1001]["score"] and got[None]["predicted"] == got[1002]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 and len(r["votes"]) == len(w.LABELLERS) for r in rows)
    assert w.classify(df.where("false")).count() == 0


def test_scores_do_not_hang_on_row_order(spark):
    rng = random.Random(3)
    docs = [(i, junk(rng, i % 3) if i % 5 == 0 else sentences(rng, 6)) for i in range(40)] + [(7, junk(rng, i % 3) if i % 2 else sentences(rng, 4)) for i in range(400)]
    scores = []
    for rows in (docs, docs[::-1]):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        scores.append(sorted((r["doc_id"], r["votes"], r["score"]) for r in w.classify(df, 40).collect()))
    assert len(scores[0]) == len(docs) and scores[0] == scores[1]
