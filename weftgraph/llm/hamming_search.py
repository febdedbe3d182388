"""Operator 2: exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has bit i set where component i is not negative, in as many 64-bit words as the widest vector needs.
Codes are cut in segments of about log2(codes) bits, each segment indexed by its value. In round ``s`` the queries still
open probe, in every segment, all values that differ from theirs in exactly ``s`` bits: each is a value of the round before with
one more, higher bit flipped. A code within Hamming distance m(s+1)-1 of the query agrees to ``s`` bits in one of the m segments
at least, so after the round everything that near has been found. A query is closed when the distance of its last
wanted row is covered in that sense, at the latest when a segment has no more bits to flip. Found codes are verified on all bits.

Rows with equal codes are one code with a count and its least ids, so a group of copies costs one code. Codes and queries
are named by the least id of the code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch, table

K, EVERY, WORD = 10, 50, 64


def sign_codes(vectors: DataFrame, words: int) -> DataFrame:
    """``vec_id, code`` (``words`` longs), repeated rows once; rows without id or vector have no code.

    Null and missing components count as negative.
    """
    word = f"aggregate(transform(slice(embedding, {WORD} * w + 1, {WORD}), (x, i) -> if(coalesce(x, -1) >= 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"
    bits = f"transform(sequence(0, {words - 1}), w -> {word})"
    return vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(bits).alias("code")).distinct()


def segments(codes: int, words: int = 1) -> list[tuple[int, int, int]]:
    """(word, first bit, width) of each segment: the widths are as near log2(codes) as equal parts of a word allow."""
    m = max(1, round(WORD / max(1.0, math.log2(max(2, codes)))))
    edges = [round(i * WORD / m) for i in range(m + 1)]
    return [(w, a, b - a) for w in range(words) for a, b in zip(edges, edges[1:])]


def _values(code: str, parts: list[tuple[int, int, int]]) -> Column:
    """The segments of a code with their values; a segment of 64 bits is the word itself."""
    def value(word: int, first: int, width: int) -> Column:
        whole = F.col(code)[word]
        return whole if width == WORD else F.shiftrightunsigned(whole, first).bitwiseAND(F.lit((1 << width) - 1))

    return F.array(*[F.struct(F.lit(i).alias("segment"), F.lit(x[2]).alias("width"), value(*x).alias("value")) for i, x in enumerate(parts)])


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _flipped(probes: DataFrame) -> DataFrame:
    """The probes with one bit more flipped, above the last one."""
    more = probes.where(F.col("last") < F.col("width") - 1).select("q", "qcode", "segment", "width", "value", F.explode(F.sequence(F.col("last") + 1, F.col("width") - 1)).alias("last"))
    return more.withColumn("value", F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("last"))))


def _nearest(found: DataFrame, k: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("q").orderBy("distance", "least"))
    return found.withColumn("nth", best).where(F.col("nth") <= k).drop("nth")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, trace: list | None = None) -> DataFrame:
    """``query_id, rank, vec_id, distance``: for every query the ``k`` other rows least in (distance, vec_id).

    Exact. A vec_id with several vectors is near a query as its nearest one, and a query with each of them: it has its own ``k``
    rows for each distinct code. A table of no more than ``k`` other rows gives them all; an empty table
    gives an empty result. ``trace`` gets (radius, queries closed) of every round.
    """
    scratch = Scratch(vectors.sparkSession)
    staged = scratch.staged
    widest = vectors.where("vec_id is not null").agg(F.max(F.size("embedding"))).first()[0] or 0
    words = max(1, -(-widest // WORD))
    rows = staged(sign_codes(vectors, words), "codes")
    salted = Window.partitionBy("code", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    least = rows.withColumn("nth", F.row_number().over(salted)).where(F.col("nth") <= k + 1)  # of a hot code in many tasks
    least = least.withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    ids = least.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    codes = staged(rows.groupBy("code").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).join(ids, "code").withColumn("name", F.monotonically_increasing_id()), "codes")
    parts = segments(codes.count(), words)
    index = staged(codes.select("name", "code", "n", "least", F.explode(_values("code", parts)).alias("x")).select("x.segment", "x.value", "name", "code", "n", "least"), "index")
    queries = staged(rows.where(is_query).join(codes.select("code", "name"), "code").select("vec_id", F.col("name").alias("q"), "code"), "queries")
    still = staged(queries.select("q", F.col("code").alias("qcode")).distinct(), "open")
    probes = still.select("q", "qcode", F.explode(_values("qcode", parts)).alias("x")).select("q", "qcode", "x.segment", "x.width", "x.value", F.lit(-1).alias("last"))
    done, best, radius, last = None, None, 0, max(w for _, _, w in parts)
    while open_count := still.count():
        probes = staged(probes, "probes")
        found = probes.hint("merge").join(index, ["segment", "value"])  # far more rows than their few queries let Spark expect
        found = found.select("q", "name", "n", "least", _distance("qcode", "code").alias("distance")).distinct()
        covered = len(parts) * (radius + 1) - 1 if radius < last else words * WORD
        if best is not None:
            found = found.union(best.select(found.columns)).distinct()
        best = staged(_nearest(found, k + 1), "best")
        enough = best.withColumn("seen", F.sum("n").over(Window.partitionBy("q").orderBy("distance", "least")))
        closed = enough.where((F.col("seen") > k) & (F.col("distance") <= covered)).select("q").distinct() if radius < last else still.select("q")
        ready = staged(best.join(closed, "q", "left_semi"), "done")
        done = ready if done is None else done.union(ready)
        still = staged(still.join(ready.select("q").distinct(), "q", "left_anti") if radius < last else still.where("false"), "open")
        if trace is not None:
            trace.append((radius, open_count - still.count()))
        best = best.join(still, "q", "left_semi")
        probes = _flipped(probes.join(still.select("q"), "q", "left_semi"))
        radius += 1
    if done is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).alias("distance")).where("false")
    near = done.select("q", "name", "distance").join(codes.select("name", "ids"), "name").select("q", "distance", F.explode("ids").alias("vec_id"))
    near = near.groupBy("q", "vec_id").agg(F.min("distance").alias("distance"))
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec_id"))).where(F.col("nth") <= k + 1)
    near = staged(near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))).alias("near")), "near")  # k + 1 at most
    scratch.discard(near, queries)
    hits = queries.select(F.col("vec_id").alias("query_id"), "q").join(near, "q")
    hits = hits.select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return hits.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.distance")


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP2_SQL = f"""
WITH c AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: coalesce(x, -1) >= 0) AS b FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
     r AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.b, c.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS distance
           FROM c q JOIN c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
     n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM r)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance FROM n WHERE rank <= {K}
"""
