"""The graph of a star schema: customers are persons, orders posts, events comments, suppliers forums, parts tags.

Only the tables a query needs are read, and of those only the columns it needs. The one global order (friends are the
customers of consecutive orders) is cut in days: neighbours within a day by a window over the day, and each day's
first order with the last one of the day before over a table of one row a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..graph import Graph
from ..model import VERTICES, edge_schema

COMMENT_BASE = 1_000_000_000


def _ms(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def _typed(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def _knows(orders: DataFrame) -> DataFrame:
    o = orders.select("o_custkey", "o_orderdate", "o_orderkey")
    day = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    within = o.select(F.lag("o_custkey").over(day).alias("a"), F.col("o_custkey").alias("b"), "o_orderdate")
    ends = o.groupBy("o_orderdate").agg(F.min_by("o_custkey", "o_orderkey").alias("b"), F.max_by("o_custkey", "o_orderkey").alias("last"))
    across = ends.select(F.lag("last").over(Window.orderBy("o_orderdate")).alias("a"), "b", "o_orderdate")  # one row a day
    pairs = within.union(across).where("a is not null and a <> b").select("a", "b", _ms("o_orderdate").alias("ms"))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "ms"))
    return both.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min("ms").alias("creation_date"))


def load(spark: SparkSession, sf_dir: str) -> Graph:
    """The projected graph; nothing is read before a query runs."""
    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    customer, supplier, part, nation, region, orders, events = map(t, ("customer", "supplier", "part", "nation", "region", "orders", "events"))
    lines = t("lineitem")
    n_orders, n_events, n_parts = (df.agg(F.count("*").alias("n")) for df in (orders, events, part))
    k = F.col("c_custkey")
    person = customer.select(
        k.alias("id"), F.col("c_mktsegment").alias("first_name"), F.col("c_name").alias("last_name"), F.when(k % 2 == 0, "female").otherwise("male").alias("gender"),
        (k * 37 % 12000 * 86_400_000).alias("birthday"), (k * 1000).alias("creation_date"), F.concat(F.lit("10.0.0."), k % 256).alias("location_ip"),
        F.when(k % 3 == 0, "Firefox").otherwise("Chrome").alias("browser_used"), (F.col("c_nationkey") + 1000).alias("place"),
        F.when(k % 2 == 0, "en;de").otherwise("en").alias("language"), F.when(k % 5 == 0, "").otherwise(F.concat("c_name", F.lit("@a.org;"), "c_name", F.lit("@b.org"))).alias("email"),
    )
    countries = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("country").alias("type"), (F.col("n_regionkey") + 100).alias("is_part_of"))
    continents = region.select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name"), F.lit("continent").alias("type"), F.lit(None).alias("is_part_of"))
    cities = nation.select((F.col("n_nationkey") + 1000).alias("id"), F.concat("n_name", F.lit("_CITY")).alias("name"), F.lit("city").alias("type"), F.col("n_nationkey").alias("is_part_of"))
    organisation = supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "company").otherwise("university").alias("type"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("place"))
    brand = F.expr("cast(substr(p_brand, 7) as bigint)")
    tag = part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("#"), "p_partkey").alias("name"), brand.alias("has_type"))
    brands = part.select(brand.alias("bn"), F.col("p_brand").alias("name")).distinct()
    groups = spark.range(5).select((F.col("id") + 100).alias("id"), F.concat(F.lit("Group#"), "id").alias("name"), F.lit(0).alias("is_subclass_of"))
    thing = spark.range(1).select(F.lit(0).alias("id"), F.lit("Thing").alias("name"), F.lit(None).alias("is_subclass_of"))
    tag_class = brands.select(F.col("bn").alias("id"), "name", (F.col("bn") % 5 + 100).alias("is_subclass_of")).union(groups).union(thing)
    forum = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit(0).alias("creation_date"), F.col("s_suppkey").alias("moderator"))
    first = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("forum"))
    post = orders.join(first, "o_orderkey").join(supplier.select(F.col("s_suppkey").alias("forum"), F.col("s_nationkey").alias("place")), "forum").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("img"), "o_orderkey").alias("image_file"), _ms("o_orderdate").alias("creation_date"), F.lit("10.0.0.1").alias("location_ip"), F.lit("Chrome").alias("browser_used"), F.lit("en").alias("language"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("content"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(F.length("o_orderpriority")).alias("length"), F.col("o_custkey").alias("creator"), "forum", "place",
    )
    e = F.col("event_id")
    comment = events.crossJoin(F.broadcast(n_orders)).select(  # one row
        (e + COMMENT_BASE).alias("id"), _ms("ts").alias("creation_date"), F.lit("10.0.0.2").alias("location_ip"), F.lit("Firefox").alias("browser_used"), F.col("event_type").alias("content"), F.length("event_type").alias("length"), F.col("user_id").alias("creator"), (e % 25).alias("place"),
        F.when(e % 3 == 0, e * 7 % F.col("n")).alias("reply_of_post"), F.when(e % 3 != 0, e + (COMMENT_BASE - 1)).alias("reply_of_comment"),
    )
    vertices = {"person": person, "place": countries.union(continents).union(cities), "organisation": organisation, "tag": tag, "tag_class": tag_class, "forum": forum, "post": post, "comment": comment}

    at_orders = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), "l_orderkey")
    src, dst = F.col("src"), F.col("dst")

    def years(line: int, name: str) -> DataFrame:
        return at_orders.where(F.col("l_linenumber") == line).groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.min(F.year("o_orderdate")).alias(name))

    def likes(kind: str, n: DataFrame, target) -> DataFrame:
        liked = events.where(F.col("event_type") == kind).crossJoin(F.broadcast(n)).select(F.col("user_id").alias("src"), target.alias("dst"), _ms("ts").alias("ms"))
        return liked.groupBy(src, dst).agg(F.min("ms").alias("creation_date"))

    edges = {
        "knows": _knows(orders),
        "likes_post": likes("click", n_orders, e % F.col("n")),
        "likes_comment": likes("view", n_events, e * 13 % F.col("n") + COMMENT_BASE),
        "has_member": at_orders.groupBy(F.col("l_suppkey").alias("src"), F.col("o_custkey").alias("dst")).agg(F.min(_ms("o_orderdate")).alias("join_date")),
        "study_at": years(3, "class_year"),
        "work_at": years(2, "work_from"),
        "has_interest": at_orders.where("l_linenumber = 1").select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")).distinct(),
        "post_has_tag": lines.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct(),
        "comment_has_tag": events.crossJoin(F.broadcast(n_parts)).select((e + COMMENT_BASE).alias("src"), (e * 11 % F.col("n")).alias("dst")),
        "forum_has_tag": supplier.crossJoin(F.broadcast(n_parts)).select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") % F.col("n")).alias("dst")),
    }
    return Graph({n: _typed(df, VERTICES[n]) for n, df in vertices.items()}, {n: _typed(df, edge_schema(n)) for n, df in edges.items()})
