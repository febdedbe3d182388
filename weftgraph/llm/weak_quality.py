"""Operator 9: a quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or abstain. Expectation-maximisation estimates how often each votes
what on good and on bad documents, from the counts of vote patterns alone (at most 3 ** labellers of them, however many
documents there are), and so gives every pattern a posterior. The posteriors, not gold labels, then train a hashed
linear scorer: hashed grams of character classes and bucketed text statistics, logistic loss with soft targets, on the
first ``SAMPLE`` documents in hash order, one row of each id. Votes, pattern counts and scores cover all documents and whole texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import staged, table

SAMPLE, BINS, STEPS, RIDGE, CUT = 6000, 1 << 12, 300, 1e-4, 0.5
GOOD, BAD, ABSTAIN = "gb-"
#: Frequent short words of the four languages.
STOPS = frozenset("the of and to in is that it for was on with as de la el que y en los se del las por un una le les et des du est pour dans der die und den von zu das mit sich des auf".split())
_CLASS = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else 32 if b in (9, 32) else 10 if b in (10, 11, 12, 13) else b if b > 32 else ord("?") for b in range(256))


def statistics(text: str) -> dict[str, float]:
    """The shares the labellers look at; 0 for what an empty text hasn't got."""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, chars = max(1, len(words)), max(1, len(text))
    shape = text.encode().translate(_CLASS)
    letters = sum(map(shape.count, (b"a", b"A")))
    spaces = sum(map(shape.count, (b" ", b"\n")))
    digits = shape.count(b"0")
    low = [w.lower().strip(".,;:!?") for w in words]
    return {
        "words": float(len(words)),
        "symbols": 1 - (letters + spaces + digits) / max(1, len(shape)),
        "digits": digits / max(1, len(shape)),
        "stutter": sum(a == b for a, b in zip(words, words[1:])) / n,
        "distinct": len(set(low)) / n,
        "pipes": sum(w == "|" for w in words) / n,
        "trailing": sum(len(w) > 3 and not w[-3:-1].isalnum() and not w[-1].isalnum() for w in words) / n,
        "stops": sum(w in STOPS for w in low) / n,
        "same_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "letters_a_word": (chars - spaces) / n,
        "sentences": sum(w[-1] in ".!?" for w in words) / n,
    }


def _vote(good: bool, bad: bool) -> str:
    return BAD if bad else GOOD if good else ABSTAIN


#: Name and vote of each labeller, from the statistics.
LABELLERS = {
    "symbols": lambda s: _vote(s["symbols"] < 0.06, s["symbols"] > 0.12),
    "stutter": lambda s: ABSTAIN if s["words"] < 10 else _vote(s["stutter"] < 0.03, s["stutter"] > 0.2),
    "distinct": lambda s: ABSTAIN if not 40 <= s["words"] <= 2000 else _vote(s["distinct"] > 0.35, s["distinct"] < 0.2),
    "table": lambda s: ABSTAIN if s["words"] < 10 else _vote(s["pipes"] == 0, s["pipes"] > 0.1),
    "trailing": lambda s: ABSTAIN if s["words"] < 5 else _vote(s["trailing"] < 0.01, s["trailing"] > 0.1),
    "stops": lambda s: ABSTAIN if s["words"] < 30 else _vote(s["stops"] > 0.08, s["stops"] < 0.02),
    "lines": lambda s: _vote(s["same_lines"] < 0.1, s["same_lines"] > 0.5),
    "words": lambda s: _vote(3 <= s["letters_a_word"] <= 12 and s["words"] >= 5, s["words"] < 1 or s["letters_a_word"] > 25),
    "prose": lambda s: ABSTAIN if s["words"] < 20 else _vote(0.03 <= s["sentences"] <= 0.5, s["sentences"] < 0.005 or s["sentences"] > 0.8),
}


def votes(text: str | None) -> str:
    """One letter for each labeller."""
    s = statistics(text or "")
    return "".join(f(s) for f in LABELLERS.values())


def expectation_maximisation(counts: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """The posterior of good by pattern, and the estimated P(vote | class) of those who vote: labeller, class (bad, good), vote (good, bad)."""
    patterns = sorted(counts)
    if not patterns:
        return {}, np.zeros((0, 2, 2))
    weight = np.array([counts[p] for p in patterns], float)
    code = np.array([[(GOOD + BAD + ABSTAIN).index(c) for c in p] for p in patterns])
    one_hot = np.eye(3)[code][:, :, :2]  # to abstain says nothing
    share = (one_hot[:, :, 0].sum(1) + 1) / (one_hot.sum((1, 2)) + 2)
    good = np.clip(share - 0.6 * one_hot[:, :, 1].max(1), 0.02, 0.98)  # to start with, any bad vote weighs a lot
    for _ in range(rounds):
        both = np.stack([1 - good, good]) * weight
        vote = np.einsum("cp,plv->lcv", both, one_hot) + 0.5
        vote /= vote.sum(2, keepdims=True)
        prior = (both.sum(1) + 1) / (both.sum() + 2)
        log = np.einsum("plv,lcv->cp", one_hot, np.log(vote)) + np.log(prior)[:, None]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            good = new
            break
        good = new
    return dict(zip(patterns, good.tolist())), vote


def hashed_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bins and values of one text: class grams of four bytes (log counts, unit length) and bucketed statistics."""
    shape = (text or "").encode().translate(_CLASS)
    bins, values = np.empty(0, np.int64), np.empty(0)
    if len(shape) >= 4:
        grams = np.ndarray((len(shape) - 3,), "<u4", shape, 0, (1,))
        counted = np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - 11), minlength=BINS // 2)
        bins = np.flatnonzero(counted)
        values = np.log1p(counted[bins])
        values = values / np.sqrt((values**2).sum())
    s = statistics(text or "")
    extra = [BINS // 2 + zlib.crc32(f"{k}:{min(20, int(20 * v)) if v <= 1 else 20 + int(math.log2(v))}".encode()) % (BINS // 2) for k, v in s.items()]
    return np.concatenate((bins, extra)).astype(np.int64), np.concatenate((values, np.full(len(extra), 0.5)))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights of the bins and, last, the intercept, by accelerated gradient steps on soft targets."""
    x = np.zeros((len(rows), BINS + 1), np.float32)
    for i, (bins, values, _) in enumerate(rows):
        np.add.at(x[i], bins, values)
    x[:, -1] = 1
    y = np.array([r[2] for r in rows], np.float32)
    w, before = np.zeros(BINS + 1, np.float32), np.zeros(BINS + 1, np.float32)
    rate = 4 / max(1.0, float(np.einsum("ij,ij->i", x, x).max(initial=1.0)))
    for t in range(1, STEPS + 1):
        ahead = w + (t - 1) / (t + 2) * (w - before)
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        before, w = w, ahead - rate * (x.T @ (p - y) / max(1, len(y)) + RIDGE * ahead)
    return w


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, votes, posterior, score, predicted`` of every document.

    Null texts count as empty, which the labellers call bad; repeated rows each get a row; other columns are not read.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([votes(t.as_py()) for t in batch.column(1)], pa.string())], names=["doc_id", "votes"])

    seen = staged(d.mapInArrow(voted, "doc_id long, votes string"), "votes")
    counts = {r["votes"]: r["count"] for r in seen.groupBy("votes").count().collect()}  # 3 ** 9 rows at most
    posterior, _ = expectation_maximisation(counts)
    chosen = seen.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*hashed_features(t), posterior[votes(t)]) for t in batch.column(1).to_pylist()]
            if rows:
                types = [pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=["doc_id", "bins", "values", "target"])

    # of a repeated id the text of the least hash, whatever order the rows come in
    single = d.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("x")).select("doc_id", "x.text")
    rows = single.mapInArrow(described, "doc_id long, bins array<long>, values array<double>, target double").collect()  # bounded by `sample`
    w = train([(np.array(r["bins"], np.int64), np.array(r["values"]), r["target"]) for r in sorted(rows, key=lambda r: r["doc_id"])])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for t in batch.column(1).to_pylist():
                bins, values = hashed_features(t)
                names.append(votes(t))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[bins] @ values + w[-1]))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array([posterior.get(v, 0.5) for v in names], pa.float64()), pa.array(scores, pa.float64())], names=["doc_id", "votes", "posterior", "score"])

    return d.mapInArrow(scored, "doc_id long, votes string, posterior double, score double").withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
