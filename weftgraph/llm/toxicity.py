"""Operator 4: toxicity by a weighted finite-state pattern grammar.

Words are tagged (insult, threat, target, negation, reporting, other); a clause is its string of tags. Four small
transducers are composed into one machine that rewrites the tags of a clause and adds weights:

* negation: an insult or threat within three words after a negation is weakened;
* reported speech: after a reporting word the rest of the clause is someone else's;
* target: an insult with a person within five words before it or four after it is aimed;
* threat: a threat is directed if a person follows within three words.

The best path through the composed machine says which pattern each insult or threat of the clause matched. A document's
features are the weighted sums of its matched patterns, not of its words; a logistic model turns them into a score.

Insult stems are learned: whole words and word beginnings that labelled toxic documents hold far more often than clean
ones (a likelihood ratio test whose level falls with the number of features tested; ``STEMS`` at most are kept). Stems
and model are fitted on a bounded sample of labelled rows (``TOXIC_ROWS`` and ``CLEAN_ROWS``, taken in hash order of
their ids); the intercept is corrected to the label rates over all labelled rows.
Only rows whose crc32(doc_id as text) mod 4 is not 2 are ever learned from; language, source and ids are no inputs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, shuffle_parts, table

TOXIC_ROWS, CLEAN_ROWS, STEMS, STEM_TEST, CUT = 1500, 3000, 20_000, 5.0, 0.3
SHORTEST, LONGEST = 4, 7
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ITPNRO"
#: Seed words of the closed classes; insults come from the labels and from these.
WORDS = {
    INSULT: "idiot idiots moron morons stupid imbecile scum bastard bastards pathetic worthless disgusting dumbass retard",
    THREAT: "kill murder strangle shoot stab slaughter exterminate lynch",
    TARGET: "you your yours yourself he him his she her they them their these those everyone people du dich dir ihr euch sie tu te toi vous tes tú te ti usted ustedes ellos",
    NEGATION: "not never no isn't aren't wasn't don't doesn't won't cannot nicht kein keine nie ne pas jamais nunca jamás",
    REPORT: "said says say wrote writes called calls claimed claims quoted quote allegedly according sagte schrieb nannte dit disait écrit appelé dijo escribió llamó",
}
_WORD = re.compile(r"\w+(?:'\w+)?")
_CLAUSE_END = re.compile(r"[.!?;\n]+|, ")


@dataclass
class Fst:
    """Arcs by state and input tag: (output, weight, next state). Paths must end in a final state."""

    start: object
    finals: set
    arcs: dict = field(default_factory=dict)

    def add(self, state, tag: str, out: str, weight: float, to) -> None:
        self.arcs.setdefault((state, tag), []).append((out, weight, to))

    def compose(self, other: Fst) -> Fst:
        """First this machine, then ``other`` on what it puts out."""
        out, todo, seen = Fst((self.start, other.start), set()), [(self.start, other.start)], set()
        inputs = {}
        for state, tag in self.arcs:
            inputs.setdefault(state, []).append(tag)
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            a, b = state
            if a in self.finals and b in other.finals:
                out.finals.add(state)
            for tag in inputs.get(a, []):
                for middle, w, a2 in self.arcs[a, tag]:
                    for last, v, b2 in other.arcs.get((b, middle), []):
                        out.add(state, tag, last, w + v, (a2, b2))
                        todo.append((a2, b2))
        return out

    def best(self, tags: str) -> tuple[float, str]:
        """The weight and output of the heaviest accepted path."""
        paths = {self.start: (0.0, "")}
        for tag in tags:
            ahead: dict = {}
            for state, (w, done) in paths.items():
                for out, v, to in self.arcs.get((state, tag), []):
                    if to not in ahead or ahead[to][0] < w + v:
                        ahead[to] = (w + v, done + out)
            paths = ahead
        return max((p for s, p in paths.items() if s in self.finals), default=(0.0, tags))


#: Pattern symbols put out: aimed, plain, reported and negated insults; directed, plain, reported and negated threats.
AIMED, PLAIN, REPORTED, NEGATED, DIRECTED, PLAIN_THREAT, REPORTED_THREAT, NEGATED_THREAT = "AIJiKTUt"
PATTERN_WEIGHT = {AIMED: 2.0, PLAIN: 1.0, REPORTED: 0.5, NEGATED: 0.2, DIRECTED: 2.0, PLAIN_THREAT: 0.3, REPORTED_THREAT: 0.2, NEGATED_THREAT: 0.1}


def grammar() -> Fst:
    """The composed machine."""
    tags = INSULT + THREAT + TARGET + NEGATION + REPORT + OTHER
    negation = Fst(0, set(range(4)))
    for s in range(4):
        for tag in tags:
            out = {INSULT: NEGATED, THREAT: NEGATED_THREAT}.get(tag, tag) if s else tag
            negation.add(s, tag, out, 0.0, 3 if tag == NEGATION else max(0, s - 1))
    known = tags + NEGATED + NEGATED_THREAT
    report = Fst(0, {0, 1})
    for s in range(2):
        for tag in known:
            report.add(s, tag, {INSULT: REPORTED, THREAT: REPORTED_THREAT}.get(tag, tag) if s else tag, 0.0, 1 if s or tag == REPORT else 0)
    known += REPORTED + REPORTED_THREAT
    # (words for which a person before still counts, words left in which a promised person must come)
    target = Fst((0, 0), {(s, 0) for s in range(6)})
    for near in range(6):
        for due in range(5):
            for tag in known:
                after = (5, 0) if tag == TARGET else (max(0, near - 1), due - 1)
                if tag != TARGET and due == 1:
                    continue  # the promised person didn't come
                after = after if tag == TARGET or due else (after[0], 0)
                if tag == INSULT:
                    if near:
                        target.add((near, due), tag, AIMED, 1.0, after)
                    else:
                        target.add((near, due), tag, PLAIN, 0.0, after)
                        target.add((near, due), tag, AIMED, 1.0, (after[0], after[1] or 4))
                else:
                    target.add((near, due), tag, tag, 0.0, after)
    threat = Fst(0, {0})
    for due in range(4):
        for tag in known + AIMED:
            if tag != TARGET and due == 1:
                continue
            after = 0 if tag == TARGET or not due else due - 1
            if tag == THREAT:
                threat.add(due, tag, PLAIN_THREAT, 0.0, after)
                threat.add(due, tag, DIRECTED, 1.5, after or 3)
            else:
                threat.add(due, tag, tag, 0.0, after)
    return negation.compose(report).compose(target).compose(threat)


@dataclass
class Lexicon:
    """Weights of whole words and, ending in ``*``, of word beginnings."""

    weights: dict[str, float]

    def __post_init__(self) -> None:
        import ahocorasick

        self._tags = {w: tag for tag, words in WORDS.items() for w in words.split()}
        self._words = {k: v for k, v in self.weights.items() if not k.endswith("*")}
        self._stems = {k[:-1]: v for k, v in self.weights.items() if k.endswith("*")}
        for w in WORDS[INSULT].split():
            self._words.setdefault(w, 4.0)
        self._machine, self._fst, self._memo = ahocorasick.Automaton(), grammar(), {}
        for w in {*self._words, *self._stems, *WORDS[THREAT].split()}:
            self._machine.add_word(w, len(w))
        self._machine.make_automaton()

    def tag(self, word: str) -> tuple[str, float]:
        if (w := self._words.get(word)) is not None:
            return INSULT, w
        for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
            if (w := self._stems.get(word[:n])) is not None:
                return INSULT, w
        return self._tags.get(word, OTHER), 1.0

    def clauses(self, low: str) -> Iterator[str]:
        """The clauses that hold the beginning of an insult or threat."""
        done = -1
        for end, n in self._machine.iter(low):
            start = end - n + 1
            if start < done or start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                continue
            ends = _CLAUSE_END.search(low, end)
            done = ends.start() if ends else len(low)
            at = max(p + len(c) if (p := low.rfind(c, 0, start)) >= 0 else 0 for c in (".", "!", "?", ";", "\n", ", "))
            yield low[min(at, start) : done]

    def features(self, text: str | None) -> list[float]:
        """Logs of the summed weights of each pattern, and the heaviest clause."""
        sums, heaviest = dict.fromkeys(PATTERN_WEIGHT, 0.0), 0.0
        for clause in self.clauses((text or "").lower()):
            tags, weights, gap = [], [], 0
            for word in _WORD.findall(clause):
                tag, w = self.tag(word)
                gap = gap + 1 if tag == OTHER else 0
                if gap <= 6:  # longer gaps act alike
                    tags.append(tag)
                    weights.append(w)
            key = "".join(tags)
            if (out := self._memo.get(key)) is None:
                out = self._fst.best(key)[1]
                if len(self._memo) < 100_000:
                    self._memo[key] = out
            score = 0.0
            for symbol, w in zip(out, weights):
                if symbol in sums:
                    sums[symbol] += w
                    score += w * PATTERN_WEIGHT[symbol]
            heaviest = max(heaviest, score)
        return [*map(math.log1p, sums.values()), math.log1p(heaviest)]


def ratio_test(t: float, c: float, toxic: int, clean: int) -> float:
    """Signed G-squared of a feature in t of ``toxic`` and c of ``clean`` documents."""
    def part(x: float, n: float, p: float) -> float:
        return (x * math.log(x / (n * p)) if x else 0.0) + ((n - x) * math.log((n - x) / (n * (1 - p))) if n > x else 0.0)

    p = (t + c) / (toxic + clean)
    if not 0 < p < 1:
        return 0.0
    g = 2 * (part(t, toxic, p) + part(c, clean, p))
    return g if t * clean > c * toxic else -g


def choose_stems(counts: dict[str, tuple[int, int]], toxic: int, clean: int, least: float) -> dict[str, float]:
    """Features that pass the test, without those that a longer or shorter one of the same word stands for."""
    odds = {f: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for f, (t, c) in counts.items() if ratio_test(t, c, toxic, clean) >= least}
    odds = {f: w for f, w in odds.items() if w >= 2.0}
    kept: dict[str, float] = {}
    body = {f: f.rstrip("*") for f in odds}
    by_prefix: dict[str, list[str]] = {}
    for f, b in body.items():
        for n in range(SHORTEST, len(b) + 1):
            by_prefix.setdefault(b[:n], []).append(f)
    for f in sorted(odds, key=lambda f: (len(body[f]), f)):
        longer = [g for g in by_prefix.get(body[f], []) if g != f and (len(body[g]) > len(body[f]) or not g.endswith("*"))]
        if f.endswith("*") and any(counts[g][0] >= 0.98 * counts[f][0] for g in longer):
            continue
        if any(kept.get(body[f][:n] + "*", -9.0) >= odds[f] - 1 for n in range(SHORTEST, len(body[f]) + 1)):
            continue
        kept[f] = min(odds[f], 8.0)
    return kept


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: Counter) -> pa.RecordBatch:
        names = sorted({f for f, _ in held})
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([held[f, k] for f in names], pa.int64()) for k in (1, 0))], names=["feature", "toxic", "clean"])

    held: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1)):
            words = set(_WORD.findall((text.as_py() or "").lower()))
            found = {w for w in words if len(w) <= 30} | {w[:n] + "*" for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}
            held.update((f, toxic.as_py()) for f in found)
            if len(held) > 200_000:
                yield out(held)
                held = Counter()
    if held:
        yield out(held)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 60) -> np.ndarray:
    """Weights, the intercept last, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step if np.abs(step).max() < 5 else step * (5 / np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: list[float]

    def scorer(self):
        lexicon, w = Lexicon(self.lexicon), np.array(self.weights)

        def score(text: str | None) -> float:
            z = float(np.dot(lexicon.features(text), w[:-1]) + w[-1])
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """Learns stems and weights. Without usable labels the model knows the seed words alone.

    Of a label's repeated rows the larger counts, of a document's the text with the least hash. Words of more than 30
    letters count by their beginnings only, and no more than ``STEMS`` candidate features are tested for stems, those in most
    toxic texts first: both bound the model, not the documents scored.
    """
    gold = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    gold = gold.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rates = {r["toxic"]: r["count"] for r in gold.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    chosen = gold.where("toxic = 1").orderBy(order).limit(toxic_rows).union(gold.where("toxic = 0").orderBy(order).limit(clean_rows))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # of a repeated id the text of the least hash, so the two row limits bound the sample; staged, as it is read four times
    single = sample.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("x"))
    scratch = Scratch(docs.sparkSession)
    sample = scratch.staged(single.repartition(shuffle_parts(docs.sparkSession), "doc_id").select("x.text", "toxic"), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    base = rates.get(1, 0) + 0.5, rates.get(0, 0) + 0.5
    if not toxic or not clean:
        return Model({}, [1.0] * 9 + [math.log(base[0] / base[1]) if rates else -4.0])
    counted = sample.mapInArrow(_count_features, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = counted.where(F.col("toxic") >= 4).cache()
    tested = max(10, counted.count())
    odd = counted.where((F.col("toxic") + 0.5) / (toxic + 1) >= 7.3 * (F.col("clean") + 0.5) / (clean + 1)).orderBy(F.desc("toxic"), "feature").limit(STEMS)
    counts = {r["feature"]: (r["toxic"], r["clean"]) for r in odd.collect()}
    counted.unpersist()
    stems = choose_stems(counts, toxic, clean, 2 * math.log(tested) + STEM_TEST)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.features(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    rows = sample.mapInArrow(describe, "x array<double>, toxic int").collect()  # bounded by the two row limits
    scratch.discard()
    w = fit_logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    w[-1] += math.log(base[0] / base[1]) - math.log(toxic / clean)
    return Model(stems, w.tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; null and empty texts match nothing and get the base score."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([one(t.as_py()) for t in batch.column(2)], pa.float64())], names=["doc_id", "held_out", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(scored, "doc_id long, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all its columns, without the documents that the model rejects."""
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()  # once for each task
        for texts in batches:
            yield texts.map(lambda t: one(t if isinstance(t, str) else None)).astype(float)

    return docs.where(scores(F.col("text").cast("string")) < CUT)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels))
