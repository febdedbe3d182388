"""Operator 3: mixing sources to target weights, with DataFrame and SQL functions only.

1. Token shares ``p`` of the sources (tokens: runs of characters other than white space; a text without any counts one).
2. Temperature: weights are ``p ** a`` normalised. ``a`` = 1 keeps the shares, 0 makes them uniform. The exponent is
   bisected (``STEPS`` halvings) to the largest ``a`` whose entropy reaches ``entropy`` times that of uniform weights,
   and to the least ``a`` at which no source repeats more than ``repeats`` times; the larger of the two holds.
   It is one expression over one row that lists the sources, not a loop of jobs.
3. Realisation: the budget is ``budget`` times the tokens there are (None: the least at which every source is written
   whole once). Every source writes *blocks*, each a fresh permutation of all its documents, hashed from the block's
   number and the id, and a last block cut where its quota is spent. A document of block ``b`` at the fraction ``u`` of its
   permutation has the place ``(b + u) / epochs``, so in the order of places every stretch holds the target weights.

The cut needs no sort: tokens are summed by the first ten bits of the last block's order, then by the next ten within the
one bucket of each source where the cut falls, and so on. A hot source is 1024 sums a round, like any other, and rows with
equal or no ids are told apart by the number that they get when the rows are staged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import shuffle_parts, staged, table

ENTROPY, REPEATS, BUDGET, STEPS, SEED = 0.97, 4.0, 1.0, 50, 7
#: A mixture is specified by one row that lists its sources; more of them than this are an error.
SOURCES = 100_000
_BITS, _DIGIT = 60, 10
_BLANK = r"[^ \t\n\r\f\x0B]+"


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(_BLANK))).cast("long")


def _order(block: Column) -> Column:
    """60 bits by which a source's documents are permuted in a block: of the id, or of the row's number where there is none."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string")))
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), block.cast("string"), name).cast("binary")), 1, 15), 16, 10).cast("long")


def _second(block: Column) -> Column:
    """60 bits that order rows of equal ids."""
    return F.shiftrightunsigned(F.xxhash64("row", block), 64 - _BITS)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _weights(shares: Column, a: Column) -> Column:
    powers = F.transform(shares, lambda p: F.pow(p, a))
    return F.transform(powers, lambda x: x / _total(powers))


def _halved(found: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), lambda s, _: found(s, (s["low"] + s["high"]) / 2))


def source_weights(totals: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = BUDGET) -> DataFrame:
    """``totals`` (source, tokens, one row each) with ``share``, ``exponent``, ``weight`` and ``epochs``.

    The number of sources is the size of the mixture's specification, which one row holds.
    """
    one = totals.agg(F.sort_array(F.collect_list(F.struct(F.col("tokens").cast("double").alias("tokens"), "source"))).alias("s"))
    one = one.withColumn("total", _total(F.transform("s", lambda x: x["tokens"])))
    one = one.withColumn("p", F.transform("s", lambda x: x["tokens"] / F.col("total")))

    def entropy_of(a: Column) -> Column:
        powers = F.transform("p", lambda p: F.pow(p, a))  # H = log Z - sum(x log x) / Z
        return F.log(_total(powers)) - _total(F.transform(powers, lambda x: x * F.log(x))) / _total(powers)

    def repeated(a: Column) -> Column:
        raised = F.transform("p", lambda p: F.pow(p, a - 1))
        if budget is None:
            return F.array_max(raised) / F.array_min(raised)
        return F.array_max(raised) / _total(F.transform("p", lambda p: F.pow(p, a))) * F.lit(float(budget))

    def halve(meets) -> Column:  # low always meets the entropy, high always meets the limit
        return lambda s, mid: F.struct(F.when(meets(mid), mid).otherwise(s["low"]).alias("low"), F.when(meets(mid), s["high"]).otherwise(mid).alias("high"))

    goal = F.log(F.size("s").cast("double")) * entropy
    one = one.withColumn("flat", F.when(entropy_of(F.lit(1.0)) >= goal, F.lit(1.0)).otherwise(_halved(halve(lambda a: entropy_of(a) >= goal))["low"]))
    one = one.withColumn("least", F.when(repeated(F.lit(0.0)) <= repeats, F.lit(0.0)).otherwise(_halved(halve(lambda a: repeated(a) > repeats))["high"]))
    one = one.withColumn("exponent", F.greatest("flat", "least")).withColumn("w", _weights(F.col("p"), F.col("exponent")))
    whole = F.array_max(F.transform(F.arrays_zip("p", "w"), lambda x: x["p"] / x["w"])) if budget is None else F.lit(float(budget))
    out = one.select("total", "exponent", whole.alias("budget"), F.explode(F.arrays_zip("s", "p", "w")).alias("x"))
    quota = F.round(F.col("x.w") * F.col("total") * F.col("budget")).cast("long")  # rounded, as sums of floats differ in their last bits
    out = out.select(
        F.col("x.s.source").alias("source"), F.col("x.s.tokens").cast("long").alias("tokens"), F.col("x.p").alias("share"), "exponent", F.col("x.w").alias("weight"),
        (F.greatest(quota, F.col("x.s.tokens").cast("long")) if budget is None else quota).alias("quota"),
    )
    return out.withColumn("epochs", F.col("quota") / F.col("tokens"))


def _ends(rows: DataFrame, entropy: float, repeats: float, budget: float | None) -> DataFrame:
    """For each group its whole blocks, its epochs and the last (order, second) of the block after them, -1 if that is empty."""
    totals = staged(rows.groupBy("group").agg(F.sum("tokens").alias("tokens")).select(F.col("group").alias("source"), "tokens"), "mixture")
    if (count := totals.count()) > SOURCES:
        raise ValueError(f"a mixture of {count} sources; at most {SOURCES} can be listed")
    whole = F.floor("epochs").cast("int")
    weights = staged(source_weights(totals, entropy, repeats, budget).select(F.col("source").alias("group"), "epochs", whole.alias("whole"), (F.col("quota") - whole * F.col("tokens")).alias("left")), "mixture")
    cuts = weights.where("left <= 0").select("group", F.lit(-1).cast("long").alias("last"), F.lit(-1).cast("long").alias("last2"))
    at = weights.where("left > 0").select("group", "whole", "left", F.lit(0).cast("long").alias("prefix"), F.lit(-1).cast("long").alias("fixed"))
    levels = 2 * _BITS // _DIGIT
    for level in range(levels):
        mine = rows.join(F.broadcast(at), "group")  # a row for each source
        key, down = (_order, _BITS - _DIGIT * (level + 1)) if level < levels // 2 else (_second, 2 * _BITS - _DIGIT * (level + 1))
        if level >= levels // 2:
            mine = mine.where(_order(F.col("whole")) == F.col("fixed"))
        mine = mine.withColumn("next", F.shiftright(key(F.col("whole")), down)).where(F.shiftright("next", _DIGIT) == F.col("prefix"))
        sums = mine.groupBy("group", "next").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("whole", "left", "fixed")])
        before = F.coalesce(F.sum("tokens").over(Window.partitionBy("group").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over 1024 rows of a source at most
        falls = sums.withColumn("before", before).where((F.col("before") < F.col("left")) & (F.col("before") + F.col("tokens") >= F.col("left")))
        falls = staged(falls.withColumn("left", F.col("left") - F.col("before")).withColumn("over", (F.col("n") == 1) | (F.col("tokens") == F.col("left")) | F.lit(level == levels - 1)), "mixture")
        upto = F.shiftleft(F.col("next") + 1, down) - 1
        cuts = cuts.union(falls.where("over").select("group", *((upto, F.lit((1 << _BITS) - 1)) if level < levels // 2 else (F.col("fixed"), upto))))
        at = falls.where("not over").select("group", "whole", "left", (F.lit(0).cast("long") if level == levels // 2 - 1 else F.col("next")).alias("prefix"), (F.col("next") if level == levels // 2 - 1 else F.col("fixed")).alias("fixed"))
        if not at.limit(1).count():
            break
    return weights.select("group", "whole", "epochs").join(cuts, "group")


def _placed(docs: DataFrame, more: list[str], entropy: float, repeats: float, budget: float | None) -> DataFrame:
    """``doc_id, source, tokens, copies, block, place`` and the columns ``more`` as one struct."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in more]).alias("more") if more else F.lit(0).alias("more"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), tokens(F.col("text")).alias("tokens"))
    rows = rows.withColumn("group", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).withColumn("row", F.monotonically_increasing_id())
    rows = staged(rows, "mixture-rows")  # so that a row keeps its number
    out = rows.join(F.broadcast(_ends(rows, entropy, repeats, budget)), "group")  # a row for each source
    order = _order(F.col("whole"))
    taken = (F.col("last") >= 0) & ((order < F.col("last")) | ((order == F.col("last")) & (_second(F.col("whole")) <= F.col("last2"))))
    out = out.withColumn("copies", F.col("whole") + F.when(taken, 1).otherwise(0))
    out = out.withColumn("block", F.explode_outer(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1))))
    return out.withColumn("place", (F.col("block") + _order(F.col("block")).cast("double") / float(1 << _BITS)) / F.col("epochs"))


def mixture(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = BUDGET) -> DataFrame:
    """``doc_id, source, tokens, copies, block, place``: a row for every time that a document is in the mixture.

    ``copies`` is how often that is; a document that isn't in it has one row without block and place. A document enters the last
    block if the tokens before it in the block's order are less than what is left of the quota, so a source is at most one
    document over, null and repeated ids and repeated rows included: rows of one id stand together in a block, in an order
    of their own. Null sources are one source, null texts count one token; a very long text is one document. An empty table
    gives an empty result. Other columns are not read.
    """
    return _placed(docs, [], entropy, repeats, budget).select("doc_id", "source", "tokens", "copies", "block", "place")


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = BUDGET) -> DataFrame:
    """The mixture itself: ``docs`` with all its columns, each row as often as its source's blocks hold it, in the order of places.

    Partitions are ranges of places, each sorted.
    """
    out = _placed(docs, docs.columns, entropy, repeats, budget).where("copies > 0").select("more", "place", "row", "block")
    out = out.repartitionByRange(4 * shuffle_parts(docs.sparkSession), "place").sortWithinPartitions("place", "row", "block")
    return out.select(*[F.col(f"more.`{c}`") for c in docs.columns])


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


_H = "ln(list_sum(list_transform(p, lambda x: pow(x, {a})))) - list_sum(list_transform(p, lambda x: pow(x, {a}) * ln(pow(x, {a})))) / list_sum(list_transform(p, lambda x: pow(x, {a})))"
_R = f"{BUDGET} * list_max(list_transform(p, lambda x: pow(x, {{a}} - 1))) / list_sum(list_transform(p, lambda x: pow(x, {{a}})))"
_MID = "(low + high) / 2"
_SQL_ORDER = f"CAST('0x' || substr(md5('{SEED}:' || {{block}} || ':' || doc_id), 1, 15) AS BIGINT)"
OP3_SQL = f"""
WITH RECURSIVE d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, coalesce('=' || source, 'null') AS g,
         greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+'))) AS tokens
  FROM documents),
t AS (SELECT g, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY g),
l AS (SELECT list(tokens / (SELECT sum(tokens) FROM t) ORDER BY tokens) AS p, count(*) AS n FROM t),
flat AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high, p, n FROM l UNION ALL
  SELECT step + 1, CASE WHEN {_H.format(a=_MID)} >= ln(n) * {ENTROPY} THEN {_MID} ELSE low END,
         CASE WHEN {_H.format(a=_MID)} >= ln(n) * {ENTROPY} THEN high ELSE {_MID} END, p, n FROM flat WHERE step < {STEPS}),
most AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high, p FROM l UNION ALL
  SELECT step + 1, CASE WHEN {_R.format(a=_MID)} > {REPEATS} THEN {_MID} ELSE low END,
         CASE WHEN {_R.format(a=_MID)} > {REPEATS} THEN high ELSE {_MID} END, p FROM most WHERE step < {STEPS}),
e AS (SELECT greatest(
  (SELECT CASE WHEN {_H.format(a="1.0")} >= ln(n) * {ENTROPY} THEN 1.0 ELSE (SELECT low FROM flat WHERE step = {STEPS}) END FROM l),
  (SELECT CASE WHEN {_R.format(a="0.0")} <= {REPEATS} THEN 0.0 ELSE (SELECT high FROM most WHERE step = {STEPS}) END FROM l)) AS a),
w AS (SELECT g, tokens, round(pow(tokens / (SELECT sum(tokens) FROM t), a) / (SELECT sum(pow(tokens / (SELECT sum(tokens) FROM t), a)) FROM t) * (SELECT sum(tokens) FROM t) * {BUDGET}) AS quota FROM t, e),
b AS (SELECT d.*, w.quota, CAST(floor(w.quota / w.tokens) AS BIGINT) AS whole, w.quota - floor(w.quota / w.tokens) * w.tokens AS rest, w.quota / w.tokens AS epochs FROM d JOIN w USING (g)),
o AS (SELECT *, {_SQL_ORDER.format(block="whole")} AS o FROM b),
s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY g ORDER BY o RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS start FROM o),
c AS (SELECT doc_id, source, tokens, epochs, CAST(whole + CASE WHEN start < rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM s),
x AS (SELECT *, unnest(CASE WHEN copies > 0 THEN range(copies) ELSE [NULL] END) AS block FROM c)
SELECT doc_id, source, CAST(tokens AS BIGINT) AS tokens, copies, CAST(block AS INTEGER) AS block,
       (block + CAST({_SQL_ORDER.format(block="block")} AS DOUBLE) / CAST({1 << _BITS} AS DOUBLE)) / epochs AS place
FROM x
"""
