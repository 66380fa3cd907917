"""Filters, joins, aggregates, windows, set operations and scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from recoflow.functions.scalar import epoch_seconds_to_ts, iso_time, map_merge, ucb_delta
from recoflow.operators import filters as FL
from recoflow.operators import interactions as I
from recoflow.operators import retrieval as R
from recoflow.operators.ranking import topn_per_group
from recoflow.operators import sketches as SK
from recoflow.plans.registry import register
from recoflow.plans.sqlparts import ctes
from recoflow.sources import io as IO
from recoflow.session import cut_lineage
from recoflow.sources import tables as T
from recoflow.sources.tables import PRIMARY


def _txt(c):
    return F.concat_ws(",", F.transform(F.col(c), lambda x: x.cast("string")))


def _items_g(spark, sf):
    return T.items(spark, sf).withColumn("genres", F.array("p_type", "p_brand"))


# --------------------------------------------------------------------------- filters
@register("candidate_filter", ctes(("inter", "items")) + """
SELECT item, title FROM items WHERE item IN (SELECT item FROM items WHERE p_size > 10)
AND item NOT IN (SELECT item FROM inter WHERE action = 'error' AND ts >= TIMESTAMP '2024-01-28 00:00:00')
AND list_has_all([p_type, p_brand], ['SMALL'])""")
def q_candidate_filter(spark, sf):
    it = _items_g(spark, sf)
    wl = it.where("p_size > 10").select("item")
    bl = T.inter(spark, sf).where("action = 'error' and ts >= timestamp_ntz'2024-01-28 00:00:00'").select("item")
    return FL.candidate_filter(it, wl, bl, ["SMALL"]).select("item", "title")


@register("date_range_filter", ctes(("items",)) + """
SELECT item, available_date FROM items WHERE available_date > TIMESTAMP '2024-01-10 00:00:00'
AND available_date < TIMESTAMP '2024-02-10 00:00:00'""")
def q_date_range_filter(spark, sf):
    return FL.date_range_filter(T.items(spark, sf), "available_date", "2024-01-10 00:00:00",
                                "2024-02-10 00:00:00").select("item", "available_date")


@register("availability_filter", ctes(("items",)) + """
SELECT item, available_date FROM items WHERE available_date <= TIMESTAMP '2024-01-20 00:00:00'
AND available_date + INTERVAL 25 DAY > TIMESTAMP '2024-01-20 00:00:00'""")
def q_availability_filter(spark, sf):
    it = T.items(spark, sf).withColumn("expire_date", F.col("available_date") + F.make_dt_interval(F.lit(25)))
    return FL.availability_filter(it, "2024-01-20 00:00:00").select("item", "available_date")


@register("field_filter", ctes(("items",)) + """
SELECT item, p_brand FROM items WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')""")
def q_field_filter(spark, sf):
    it = T.items(spark, sf).withColumn("brand", F.array("p_brand"))
    return FL.field_filter(it, "brand", ["Brand#1", "Brand#2", "Brand#3"]).select("item", "p_brand")


@register("boosted_fields", ctes(("inter", "items")) + """,
vb AS (SELECT DISTINCT i.user, it.p_brand FROM inter i JOIN items it ON it.item = i.item WHERE i.action = 'view')
SELECT query_id, item, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS r
  FROM (SELECT v.user AS query_id, it.item, CAST(2.0 * count(*) AS DOUBLE) AS score FROM vb v
  JOIN items it ON it.p_brand = v.p_brand GROUP BY v.user, it.item)) WHERE r <= 20""")
def q_boosted_fields(spark, sf):
    it = T.items(spark, sf)
    viewed = (T.inter(spark, sf).where("action = 'view'").join(it.select("item", "p_brand"), "item")
              .groupBy("user").agg(F.collect_set("p_brand").alias("vals")))
    q = viewed.select(F.col("user").alias("query_id"),
                      F.array(F.struct(F.lit("brand").alias("name"), F.array_sort("vals").alias("values"),
                                       F.lit(2.0).alias("bias"))).alias("fields"))
    docs = it.select("item", F.create_map(F.lit("brand"), F.array("p_brand"), F.lit("type"),
                                          F.array("p_type")).alias("fields"))
    return R.boosted_fields(q, docs, 20)


# --------------------------------------------------------------------------- joins
@register("meta_semi", ctes(("rated", "items")) + "SELECT item, title FROM items WHERE item IN (SELECT item FROM rated)")
def q_meta_semi(spark, sf):
    return T.items(spark, sf).join(T.rated(spark, sf).select("item"), "item", "left_semi").select("item", "title")


@register("item_category_join", ctes(("inter", "item_factors")) + """
SELECT i.event_id, i.item, f.category FROM inter i JOIN item_factors f ON f.item = i.item""")
def q_item_category_join(spark, sf):
    cats = T.item_factors(spark, sf).select("item", "category")
    return T.inter(spark, sf).select("event_id", "item").join(cats, "item")



# --------------------------------------------------------------------------- aggregates
@register("item_buy_count", ctes(("inter",)) + f"""
SELECT item, count(*) AS n_buys FROM inter WHERE action = '{PRIMARY}' GROUP BY item""")
def q_item_buy_count(spark, sf):
    return I.item_buy_count(T.inter(spark, sf), PRIMARY)


@register("user_item_lists", ctes(("inter",)) + """
SELECT user, array_to_string(list(item ORDER BY ts, event_id), ',') AS items FROM (
  SELECT *, row_number() OVER (PARTITION BY user, item ORDER BY ts, event_id) AS r FROM inter) WHERE r = 1
GROUP BY user""")
def q_user_item_lists(spark, sf):
    return I.user_item_lists(T.inter(spark, sf)).select("user", _txt("items").alias("items"))


@register("user_activity", ctes(("inter",)) + "SELECT user, count(*) AS n_events FROM inter GROUP BY user")
def q_user_activity(spark, sf):
    return I.user_activity(T.inter(spark, sf))


@register("dataset_cardinality", ctes(("inter",)) + """
SELECT count(DISTINCT user) AS n_users, count(DISTINCT item) AS n_items, count(DISTINCT action) AS n_actions,
  count(*) AS n_examples FROM inter""")
def q_dataset_cardinality(spark, sf):
    return I.dataset_cardinality(T.inter(spark, sf))


WEEKS = [("w1", "2024-01-01", "2024-01-07"), ("w2", "2024-01-08", "2024-01-14"), ("half", "2024-01-01", "2024-01-15"),
         ("all", "2024-01-01", "2024-01-31")]


@register("cardinality_ranges", ctes(("inter",)) + """
SELECT period, action, count(*) AS events, true AS users_ok, true AS items_ok FROM inter JOIN (VALUES """ + ", ".join(
    f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in WEEKS) + """) p(period, a, b)
ON CAST(ts AS DATE) BETWEEN a AND b GROUP BY period, action""")
def q_cardinality_ranges(spark, sf):
    """Distinct users and items of four ranges from daily sketches, each within
    3 % of the exact count (which alone reads the events again)."""
    inter = T.inter(spark, sf)
    sketches = cut_lineage(SK.daily_sketches(inter))
    periods = spark.createDataFrame(WEEKS, "period string, first string, last string").select(
        "period", *[F.col(c).cast("date").alias(c) for c in ("first", "last")])
    got = SK.range_cardinality(sketches, periods)
    days = periods.select("period", F.explode(F.sequence("first", "last")).alias("day"))
    exact = inter.withColumn("day", F.to_date("ts")).join(F.broadcast(days), "day").groupBy("period", "action").agg(
        F.count_distinct("user").alias("u"), F.count_distinct("item").alias("i"))

    def near(est, true):
        return F.abs(F.col(est) - F.col(true)) <= 0.03 * F.col(true)
    return got.join(exact, ["period", "action"]).select(
        "period", "action", "events", near("users", "u").alias("users_ok"), near("items", "i").alias("items_ok"))


@register("ratings_by_user", ctes(("inter", "rated")) + """
SELECT user, array_to_string(list(item || ':' || rating ORDER BY item), ',') AS truth FROM (
  SELECT user, item, arg_max(rating, (ts, event_id)) AS rating FROM rated GROUP BY user, item) GROUP BY user""")
def q_ratings_by_user(spark, sf):
    r = I.ratings_by_user(T.rated(spark, sf))
    return r.select("user", F.concat_ws(",", F.transform("truth", lambda t: F.concat(
        t["item"].cast("string"), F.lit(":"), t["rating"].cast("string")))).alias("truth"))


@register("action_summary", ctes(("inter",)) + """
SELECT action, count(DISTINCT user) AS n_users, count(DISTINCT item) AS n_items, count(*) AS n_events
FROM inter GROUP BY action""")
def q_action_summary(spark, sf):
    return I.action_summary(T.inter(spark, sf))


# --------------------------------------------------------------------------- windows
@register("topn_per_query", ctes(("inter",)) + """
SELECT user, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT user, item, value,
  row_number() OVER (PARTITION BY user ORDER BY value DESC, event_id) AS rank FROM inter) WHERE rank <= 5""")
def q_topn_per_query(spark, sf):
    t = topn_per_group(T.inter(spark, sf), ["user"], [F.col("value").desc(), F.col("event_id").asc()], 5)
    return t.select("user", "item", "value", F.col("rank").cast("int").alias("rank"))


@register("recent_n_per_user", ctes(("inter",)) + """
SELECT user, item, action, event_id, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user
  ORDER BY ts DESC, event_id DESC) AS pos FROM inter) WHERE pos <= 10""")
def q_recent_n_per_user(spark, sf):
    return I.recent_n_per_user(T.inter(spark, sf), 10).select("user", "item", "action", "event_id", "pos")


@register("entity_latest_events", ctes(("inter",)) + """
SELECT user, event_id, action, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY user
  ORDER BY ts DESC, event_id DESC) AS pos FROM inter) WHERE pos <= 3""")
def q_entity_latest_events(spark, sf):
    return I.entity_latest_events(T.inter(spark, sf), 3).select("user", "event_id", "action", "pos")


@register("two_level_sort", ctes(("inter",)) + f""",
pop AS (SELECT item, CAST(count(*) AS DOUBLE) AS pop FROM inter WHERE action = '{PRIMARY}' GROUP BY item),
sc AS (SELECT user, item, count(*) AS score FROM inter WHERE action = 'view' GROUP BY user, item)
SELECT user, item, score, pop, CAST(rank AS INTEGER) AS rank FROM (SELECT sc.*, pop.pop,
  row_number() OVER (PARTITION BY user ORDER BY score DESC, pop DESC NULLS LAST, sc.item) AS rank
  FROM sc LEFT JOIN pop ON pop.item = sc.item) WHERE rank <= 5""")
def q_two_level_sort(spark, sf):
    i = T.inter(spark, sf)
    pop = i.where(F.col("action") == PRIMARY).groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("pop"))
    sc = i.where("action = 'view'").groupBy("user", "item").agg(F.count(F.lit(1)).alias("score"))
    order = [F.col("score").desc(), F.col("pop").desc_nulls_last(), F.col("item").asc()]
    t = topn_per_group(sc.join(pop, "item", "left"), ["user"], order, 5)
    return t.select("user", "item", "score", "pop", F.col("rank").cast("int").alias("rank"))


# --------------------------------------------------------------------------- set operations
@register("train_test_concat", ctes(("rated",)) + """
SELECT user, item, CAST(rating AS DOUBLE) AS rating, 'train' AS _set FROM rated WHERE ts < TIMESTAMP '2024-01-20 00:00:00'
UNION ALL SELECT user, item, CAST(NULL AS DOUBLE) AS rating, 'test' FROM rated WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'""")
def q_train_test_concat(spark, sf):
    r = T.rated(spark, sf)
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    tr = r.where(F.col("ts") < cut).select("user", "item", F.col("rating").cast("double").alias("rating"))
    te = r.where(F.col("ts") >= cut).select("user", "item")
    return FL.train_test_concat(tr, te)


@register("item_set_minus", ctes(("inter",)) + f"""
SELECT DISTINCT user, item FROM inter WHERE action = 'view'
EXCEPT SELECT user, item FROM inter WHERE action = '{PRIMARY}'""")
def q_item_set_minus(spark, sf):
    i = T.inter(spark, sf)
    return FL.item_set_minus(i.where("action = 'view'"), i.where(F.col("action") == PRIMARY))


@register("boost_distinct", ctes(("inter",)) + """
SELECT user, array_to_string(list_sort(list_distinct(list_concat(
  coalesce(list(item) FILTER (WHERE action = 'view'), []), coalesce(list(item) FILTER (WHERE action = 'click'), [])))),
  ',') AS items FROM inter WHERE action IN ('view', 'click') GROUP BY user""")
def q_boost_distinct(spark, sf):
    i = T.inter(spark, sf).where(F.col("action").isin("view", "click"))
    g = i.groupBy("user").agg(F.collect_set(F.when(F.col("action") == "view", F.col("item"))).alias("v"),
                              F.collect_set(F.when(F.col("action") == "click", F.col("item"))).alias("c"))
    return g.select("user", F.concat_ws(",", F.transform(F.array_sort(FL.boost_distinct("v", "c")),
                                                         lambda x: x.cast("string"))).alias("items"))


# --------------------------------------------------------------------------- scalars
@register("iso_time", ctes(("inter",)) + """
SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN 'not a date'
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP), TIMESTAMP '2024-01-31 00:00:00') AS parsed FROM inter""")
def q_iso_time(spark, sf):
    i = T.inter(spark, sf)
    txt = F.when(F.col("event_id") % 3 == 0, F.lit("not a date")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return i.select("event_id", iso_time(txt, F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("parsed"))


@register("epoch_time", ctes(("inter",)) + """
SELECT event_id, epoch_us(ts) // 1000000 AS secs, make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS back FROM inter""")
def q_epoch_time(spark, sf):
    i = T.inter(spark, sf)
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    return i.select("event_id", secs.alias("secs"), epoch_seconds_to_ts(secs).alias("back"))


@register("array_merge_map", ctes(("users",)) + """
SELECT user, 'nation=' || CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE CAST(c_nationkey AS VARCHAR) END
  || ';occupation=' || occupation AS props FROM users""")
def q_array_merge_map(spark, sf):
    u = T.users(spark, sf)
    m1 = F.create_map(F.lit("occupation"), F.col("occupation"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    m2 = F.when(F.col("c_acctbal") > 5000, F.create_map(F.lit("nation"), F.lit("rich"))).otherwise(
        F.create_map().cast("map<string,string>"))
    merged = map_merge(m1, m2)
    txt = F.concat_ws(";", F.transform(F.array_sort(F.map_entries(merged)),
                                       lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return u.select("user", txt.alias("props"))


@register("ucb_delta", ctes(("reward_log",)) + """
SELECT arm, pulls, round(CASE WHEN pulls = 0 THEN 1.0 ELSE sqrt(2 * ln(t) / pulls) END, 6) AS delta
FROM (SELECT arm, count(*) AS pulls FROM reward_log GROUP BY arm), (SELECT count(*) AS t FROM reward_log)""")
def q_ucb_delta(spark, sf):
    log = T.reward_log(spark, sf)
    t = log.select(F.count(F.lit(1))).scalar()
    per = log.groupBy("arm").agg(F.count(F.lit(1)).alias("pulls"))
    return per.select("arm", "pulls", F.round(ucb_delta(t, F.col("pulls")), 6).alias("delta"))
