"""Latency histograms and counters; the same histogram over a DataFrame."""

from __future__ import annotations

import math
import threading
from collections import Counter

from pyspark.sql import DataFrame, functions as F

#: Upper bounds of the buckets in microseconds; the last bucket has none.
BUCKETS_US = (100, 250, 500, 1_000, 2_000, 5_000, 10_000, 20_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 5_000_000, 30_000_000, 2**63 - 1)


def bucket_of(us: int) -> int:
    return next(b for b in BUCKETS_US if us <= b)


def percentile(counts: dict[int, int], share: float) -> int:
    """The upper bound of the bucket that holds the given share; 0 without samples."""
    target, seen = max(1, math.ceil(sum(counts.values()) * share)), 0
    for bound in BUCKETS_US if counts else ():
        seen += counts.get(bound, 0)
        if seen >= target:
            return bound
    return 0


class Metrics:
    """Counters and one histogram an endpoint."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.reset()

    def reset(self) -> None:
        with self._lock:
            self.counters: Counter = Counter()
            self.latencies: dict[str, dict] = {}  # of each endpoint the extremes, the sum and a count for each bucket

    def add(self, name: str, n: int = 1) -> None:
        with self._lock:
            self.counters[name] += n

    def record(self, endpoint: str, us: int) -> None:
        with self._lock:
            x = self.latencies.setdefault(endpoint, {"min": us, "max": us, "sum": 0, "counts": Counter()})
            x["min"], x["max"], x["sum"] = min(x["min"], us), max(x["max"], us), x["sum"] + us
            x["counts"][bucket_of(us)] += 1

    def latency(self, endpoint: str) -> dict:
        x = self.latencies.get(endpoint, {"min": 0, "max": 0, "sum": 0, "counts": Counter()})
        n = x["counts"].total()
        out = {"count": n, "min_us": x["min"], "max_us": x["max"], "avg_us": x["sum"] / n if n else 0.0}
        return out | {f"p{round(100 * q)}_us": percentile(x["counts"], q) for q in (0.5, 0.9, 0.99)}

    def summary(self) -> dict:
        return {"counters": dict(self.counters), "endpoints": {e: self.latency(e) for e in sorted(self.latencies)}}


def histogram(df: DataFrame, us: str) -> DataFrame:
    """``upper_bound_us, n, seen``: counts by bucket and their running sum, over the few buckets there are."""
    bound = F.element_at(F.filter(F.array(*[F.lit(b) for b in BUCKETS_US]), lambda b: F.col(us) <= b), 1)
    counts = df.groupBy(bound.alias("upper_bound_us")).agg(F.count("*").alias("n"))
    rows = counts.agg(F.sort_array(F.collect_list(F.struct("upper_bound_us", "n"))).alias("x"))
    rows = rows.select(F.expr("transform(x, (e, i) -> struct(e.upper_bound_us as upper_bound_us, e.n as n, aggregate(slice(x, 1, i + 1), 0L, (s, y) -> s + y.n) as seen))").alias("x"))
    return rows.select(F.explode("x").alias("x")).select("x.*")
