"""Interaction tables: action split, id checks, pairs, caps, histories, counts.

INTERACTION = (user, action, item, value, ts, event_id).  Ids may be strings
or longs; nothing here depends on the id type.  Every ordering ends with a
unique key so results never depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recoflow.functions.scalar import md5_rank_key


def action_split(events: DataFrame, names, action_col: str = "action") -> DataFrame:
    """Keep the chosen actions only; one frame for all of them (never one per name)."""
    return events.where(F.col(action_col).isin(list(names)))


def valid_ids(inter: DataFrame, strict: bool = False, cols=("user", "item")) -> DataFrame:
    """Drop rows with a null or empty user/item id; strict mode raises instead."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & (F.length(F.col(c).cast("string")) > 0)
    if strict:
        return inter.withColumn(
            "_ok", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("empty entity id")))
        ).where("_ok").drop("_ok")
    return inter.where(ok)


def distinct_pairs(inter: DataFrame) -> DataFrame:
    """Binary (user, action, item) matrix in long form; keeps the newest time
    and the newest event id of each pair for later caps."""
    return inter.groupBy("user", "action", "item").agg(
        F.max("ts").alias("ts"), F.max("event_id").alias("event_id"))


def interaction_cap(pairs: DataFrame, per_user: int = 500, per_item: int = 500, seed: int = 7) -> DataFrame:
    """At most ``per_item`` users per (action, item), then at most ``per_user``
    items per (action, user): a seeded draw (md5 order of seed, user, item), so
    the sample is unbiased and the same at every run."""
    key = md5_rank_key(seed, "user", "item")
    wi = Window.partitionBy("action", "item").orderBy(key, F.col("user"))
    wu = Window.partitionBy("action", "user").orderBy(key, F.col("item"))
    out = pairs.withColumn("_ri", F.row_number().over(wi)).where(F.col("_ri") <= per_item).drop("_ri")
    return out.withColumn("_ru", F.row_number().over(wu)).where(F.col("_ru") <= per_user).drop("_ru")


def recent_n_per_user(inter: DataFrame, n: int = 10, actions=None) -> DataFrame:
    """Last ``n`` events per user (optionally of some actions), newest first."""
    df = inter if actions is None else action_split(inter, actions)
    w = Window.partitionBy("user").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return (df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
            .select("user", "item", "action", "ts", "event_id", "pos"))


def history_cap(inter: DataFrame, per_action: int = 100, actions=None) -> DataFrame:
    """Newest ``per_action`` events per (user, action), then distinct items."""
    df = inter if actions is None else action_split(inter, actions)
    w = Window.partitionBy("user", "action").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return (df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_action)
            .select("user", "action", "item").distinct())


def entity_latest_events(events: DataFrame, n: int = 10, entity_col: str = "user") -> DataFrame:
    """Latest ``n`` events of every entity at once (the batch form of a live lookup)."""
    w = Window.partitionBy(entity_col).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return events.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def user_item_lists(inter: DataFrame) -> DataFrame:
    """Distinct items of each user in order of first interaction (ts,
    event_id).  Pairs are reduced first (partial aggregation), so a list is
    bounded by the catalog, not by how many events a hot user logged."""
    first = inter.groupBy("user", "item").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    s = F.sort_array(F.collect_list(F.struct(F.col("f.ts"), F.col("f.event_id"), F.col("item"))))
    return first.groupBy("user").agg(F.transform(s, lambda x: x["item"]).alias("items"))


def user_activity(inter: DataFrame) -> DataFrame:
    return inter.groupBy("user").agg(F.count(F.lit(1)).alias("n_events"))


def item_buy_count(inter: DataFrame, action: str = "purchase") -> DataFrame:
    return inter.where(F.col("action") == action).groupBy("item").agg(F.count(F.lit(1)).alias("n_buys"))


def action_summary(inter: DataFrame) -> DataFrame:
    return inter.groupBy("action").agg(
        F.count_distinct("user").alias("n_users"),
        F.count_distinct("item").alias("n_items"),
        F.count(F.lit(1)).alias("n_events"))


def dataset_cardinality(inter: DataFrame, approx: bool = False) -> DataFrame:
    cd = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    return inter.agg(cd("user").alias("n_users"), cd("item").alias("n_items"),
                     cd("action").alias("n_actions"), F.count(F.lit(1)).alias("n_examples"))


def ratings_by_user(rated: DataFrame) -> DataFrame:
    """Truth lists per user: (item, latest rating) ordered by item; repeated
    ratings of a pair are reduced first, so a list is bounded by the catalog."""
    latest = rated.groupBy("user", "item").agg(F.max_by("rating", F.struct("ts", "event_id")).alias("rating"))
    return latest.groupBy("user").agg(F.sort_array(F.collect_list(F.struct("item", "rating"))).alias("truth"))


def known_pairs(inter: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Drop interactions whose user or item is not registered (two semi joins)."""
    return (inter.join(users.select("user").distinct(), "user", "left_semi")
            .join(items.select("item").distinct(), "item", "left_semi"))


def rating_events(events: DataFrame) -> DataFrame:
    """Rating property of 'rate' events as a double, time as epoch millis."""
    r = events.where(F.col("event") == "rate")
    return r.select(F.col("entity_id").alias("user"), F.col("target_id").alias("item"),
                    F.get_json_object("properties", "$.rating").cast("double").alias("rating"),
                    F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"))


def buy_events(events: DataFrame) -> DataFrame:
    b = events.where(F.col("event") == "buy")
    return b.select(F.col("entity_id").alias("user"), F.col("target_id").alias("item"),
                    F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"))
