"""Driver tables and the stand-in views built from them.

The reference reads an event store and a few files; the driver ships TPC-H-ish
tables plus an ``events`` log.  Each view below is derived from those tables
by Spark over the whole tables (no id subsets), so the work grows with the
data; joins with the event log align on the ids the log uses.  ``VIEW_SQL`` holds the same views
as DuckDB text for the oracle (only the raw tables are registered there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed parameters shared by the registered queries and their oracles.
POP_END = "2024-01-31 00:00:00"
SHORT_DURATION = 259200
LONG_DURATION = 2592000
PRIMARY = "purchase"
SECONDARY = ("view", "click")
SEED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def inter(spark, sf_dir) -> DataFrame:
    """Actions: (user, action, item, value, ts, event_id); item is props.k."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("user"),
        F.col("event_type").alias("action"),
        F.get_json_object("props", "$.k").cast("bigint").alias("item"),
        "value", "ts", "event_id")


def rated(spark, sf_dir) -> DataFrame:
    i = inter(spark, sf_dir)
    return i.select("user", "item",
                    (F.lit(1) + F.floor("value").cast("bigint") % 5).alias("rating"),
                    "ts", "event_id")


def orders_inter(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return (j.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"),
                      F.col("o_orderkey").alias("order_id"))
            .agg(F.max("l_quantity").alias("qty"), F.min("o_orderdate").alias("ts")))


def order_baskets(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("item")).distinct()


def items(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    avail = F.when(F.col("p_size") % 7 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("p_size")))
    return p.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), "p_brand",
                    "p_type", "p_size", "p_retailprice", avail.alias("available_date"))


def users(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("occupation"),
                    "c_nationkey", "c_acctbal")


def ctr(spark, sf_dir) -> DataFrame:
    # well-packed files of users or items look small enough to be broadcast, but
    # their rows, which grow with the data, would all pass through the driver
    e, u, i = inter(spark, sf_dir), users(spark, sf_dir).hint("merge"), items(spark, sf_dir).hint("merge")
    j = e.alias("e").join(u.alias("u"), F.col("e.user") == F.col("u.user")).join(
        i.alias("i"), F.col("e.item") == F.col("i.item"))
    return j.select(
        F.col("e.event_id").alias("id"),
        F.when(F.col("e.action") == "purchase", 1).otherwise(0).alias("target"),
        F.col("u.occupation").alias("f_seg_cat"),
        F.col("i.p_brand").alias("f_brand_cat"),
        F.col("i.p_type").alias("f_type_cat"),
        F.col("e.value").alias("f_value"),
        F.col("i.p_retailprice").alias("f_price"),
        F.when(F.col("i.p_size") > 40, -1).otherwise(F.col("i.p_size")).alias("f_size"))


def reward_log(spark, sf_dir) -> DataFrame:
    i = inter(spark, sf_dir)
    return i.select("event_id", (F.col("item") % 10).alias("arm"),
                    F.when(F.col("action") == "purchase", 1).when(F.col("action") == "error", -1)
                    .otherwise(0).alias("reward"), "ts")


def user_factors(spark, sf_dir) -> DataFrame:
    """Even rows are users (so only even user ids have factors), odd rows are
    items: both sides grow with the table."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 2 == 0)
    return e.select(F.col("vec_id").alias("user"), "embedding")


def item_factors(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 2 == 1)
    return e.select(F.expr("vec_id div 2").alias("item"), "embedding",
                    F.col("label").alias("category"),
                    (F.lit(1.0) + F.col("label") / 10.0).cast("double").alias("weight"))


def scored(spark, sf_dir) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"),
                      ((F.col("doc_id") * 7919 % 101) / 100.0).cast("double").alias("score"))


VIEWS = {
    "inter": inter, "rated": rated, "orders_inter": orders_inter, "order_baskets": order_baskets,
    "items": items, "users": users, "ctr": ctr, "reward_log": reward_log,
    "user_factors": user_factors, "item_factors": item_factors, "scored": scored,
}

# DuckDB text of the same views, in dependency order.
VIEW_SQL = {
    "inter": "select user_id as user, event_type as action, "
             "cast(json_extract_string(props, '$.k') as bigint) as item, value, ts, event_id from events",
    "rated": "select user, item, 1 + cast(floor(value) as bigint) % 5 as rating, ts, event_id from inter",
    "orders_inter": "select o_custkey as user, l_partkey as item, o_orderkey as order_id, "
                    "max(l_quantity) as qty, min(o_orderdate) as ts from lineitem join orders "
                    "on l_orderkey = o_orderkey group by o_custkey, l_partkey, o_orderkey",
    "order_baskets": "select distinct l_orderkey as basket_id, l_partkey as item from lineitem",
    "items": "select p_partkey as item, p_name as title, p_brand, p_type, p_size, p_retailprice, "
             "case when p_size % 7 = 0 then null else timestamp '2024-01-01 00:00:00' "
             "+ p_size * interval '1' day end as available_date from part",
    "users": "select c_custkey as user, c_mktsegment as occupation, c_nationkey, c_acctbal from customer",
    "ctr": "select e.event_id as id, case when e.action = 'purchase' then 1 else 0 end as target, "
           "u.occupation as f_seg_cat, i.p_brand as f_brand_cat, i.p_type as f_type_cat, "
           "e.value as f_value, i.p_retailprice as f_price, "
           "case when i.p_size > 40 then -1 else i.p_size end as f_size "
           "from inter e join users u on e.user = u.user join items i on e.item = i.item",
    "reward_log": "select event_id, item % 10 as arm, case action when 'purchase' then 1 "
                  "when 'error' then -1 else 0 end as reward, ts from inter",
    "user_factors": "select vec_id as user, embedding from embeddings where vec_id % 2 = 0",
    "item_factors": "select vec_id // 2 as item, embedding, label as category, "
                    "cast(1.0 + label / 10.0 as double) as weight from embeddings where vec_id % 2 = 1",
    "scored": "select doc_id as id, quality as label, "
              "cast((doc_id * 7919 % 101) / 100.0 as double) as score from labels",
}

_DEPS = {"rated": ["inter"], "ctr": ["inter", "users", "items"], "reward_log": ["inter"]}


def with_views(*names: str) -> str:
    """``WITH`` prefix for DuckDB holding the named views and their inputs."""
    order: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in order) + "\n"
