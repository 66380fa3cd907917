"""Event log, property fold, constraints, typed entities, event projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from recoflow.operators import entities as E
from recoflow.operators import interactions as I
from recoflow.plans.registry import register
from recoflow.plans.sqlparts import ctes
from recoflow.sources import io as IO
from recoflow.sources import tables as T

# Stand-in genre flags: one flag per part type word; LARGE is left out on
# purpose so the "missing flag counts as 0" rule is exercised.
TYPE_WORDS = ["ECONOMY", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
GENRE_NAMES = TYPE_WORDS + ["LARGE"]


def event_log(spark, sf):
    """EVENT log derived from the tables: user and item ``$set``s, ratings,
    and a later ``$set`` of ``last_value`` for every signup event."""
    items = T.items(spark, sf)
    for w in TYPE_WORDS:
        items = items.withColumn(w, F.when(F.col("p_type") == w, "1").otherwise("0"))
    base = IO.to_event_log(T.users(spark, sf), items, T.rated(spark, sf))
    signup = T.inter(spark, sf).where(F.col("action") == "signup").select(
        "event_id", F.lit("$set").alias("event"), F.lit("user").alias("entity_type"),
        F.col("user").cast("string").alias("entity_id"), F.lit(None).cast("string").alias("target_type"),
        F.lit(None).cast("string").alias("target_id"),
        F.to_json(F.struct(F.col("value").cast("string").alias("last_value"))).alias("properties"), "ts")
    errors = T.inter(spark, sf).where(F.col("action") == "error")
    daily = errors.groupBy(F.to_date("ts").alias("d")).agg(
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"),
        F.max("event_id").alias("event_id"), F.max("ts").alias("ts"))
    constraint = daily.select(
        (F.lit(3_000_000_000_000) + F.col("event_id")).alias("event_id"), F.lit("$set").alias("event"),
        F.lit("constraint").alias("entity_type"), F.lit("unavailableItems").alias("entity_id"),
        F.lit(None).cast("string").alias("target_type"), F.lit(None).cast("string").alias("target_id"),
        F.to_json(F.struct("items")).alias("properties"), "ts")
    return base.unionByName(signup).unionByName(constraint)


_FLAGS = ", ".join(f"'{w}', CASE WHEN p_type = '{w}' THEN '1' ELSE '0' END" for w in TYPE_WORDS)
EVENT_LOG = f"""
ev AS (
 SELECT 1000000000000 + user AS event_id, '$set' AS event, 'user' AS entity_type, CAST(user AS VARCHAR) AS entity_id,
   CAST(NULL AS VARCHAR) AS target_type, CAST(NULL AS VARCHAR) AS target_id,
   CAST(json_object('occupation', occupation, 'c_nationkey', CAST(c_nationkey AS VARCHAR),
     'c_acctbal', CAST(c_acctbal AS VARCHAR)) AS VARCHAR) AS properties, TIMESTAMP '2024-01-01 00:00:00' AS ts FROM users
 UNION ALL
 SELECT 2000000000000 + item, '$set', 'item', CAST(item AS VARCHAR), NULL, NULL,
   CAST(json_object('title', title, 'p_brand', p_brand, 'p_type', p_type, 'p_size', CAST(p_size AS VARCHAR),
     'p_retailprice', CAST(p_retailprice AS VARCHAR), 'available_date', CAST(available_date AS VARCHAR), {_FLAGS})
     AS VARCHAR), TIMESTAMP '2024-01-01 00:00:00' FROM items
 UNION ALL
 SELECT event_id, 'rate', 'user', CAST(user AS VARCHAR), 'item', CAST(item AS VARCHAR),
   CAST(json_object('rating', CAST(rating AS VARCHAR)) AS VARCHAR), ts FROM rated
 UNION ALL
 SELECT event_id, '$set', 'user', CAST(user AS VARCHAR), NULL, NULL,
   CAST(json_object('last_value', CAST(value AS VARCHAR)) AS VARCHAR), ts FROM inter WHERE action = 'signup'
 UNION ALL
 SELECT 3000000000000 + max(event_id), '$set', 'constraint', 'unavailableItems', NULL, NULL,
   CAST(json_object('items', list_sort(list(DISTINCT CAST(item AS VARCHAR)))) AS VARCHAR), max(ts)
   FROM inter WHERE action = 'error' GROUP BY CAST(ts AS DATE)),
prow AS (SELECT entity_type, entity_id, ts, event_id, k AS key, json_extract_string(properties, '$."' || k || '"') AS value
   FROM (SELECT *, unnest(json_keys(properties)) AS k FROM ev WHERE event = '$set')),
prow_nn AS (SELECT * FROM prow WHERE value IS NOT NULL)"""

EV_VIEWS = ("inter", "rated", "users", "items")


def _ev_sql(select):
    return ctes(EV_VIEWS, EVENT_LOG) + select


@register("to_event_log", _ev_sql("SELECT event_id, event, entity_type, entity_id, target_type, target_id, ts FROM ev"))
def q_to_event_log(spark, sf):
    return event_log(spark, sf).drop("properties")


def _props_txt(c="props"):
    return F.concat_ws(";", F.transform(F.map_entries(F.col(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


_AGG = """
agg AS (SELECT entity_id, key, arg_max(value, (ts, event_id)) AS value, min(ts) AS t0, max(ts) AS t1
        FROM prow_nn WHERE entity_type = '{et}' GROUP BY entity_id, key),
props AS (SELECT entity_id, string_agg(key || '=' || value, ';' ORDER BY key) AS props, min(t0) AS first_updated,
          max(t1) AS last_updated FROM agg GROUP BY entity_id)"""


@register("aggregate_properties", ctes(EV_VIEWS, EVENT_LOG, _AGG.format(et="user")) + "SELECT * FROM props")
def q_aggregate_properties(spark, sf):
    p = E.aggregate_properties(event_log(spark, sf), "user")
    return p.select("entity_id", _props_txt().alias("props"), "first_updated", "last_updated")


@register("latest_constraint", _ev_sql("""
SELECT unnest(from_json(json_extract(arg_max(properties, (ts, event_id)), '$.items'), '["VARCHAR"]')) AS item
FROM ev WHERE event = '$set' AND entity_type = 'constraint' AND entity_id = 'unavailableItems'"""))
def q_latest_constraint(spark, sf):
    return E.latest_constraint(event_log(spark, sf), "unavailableItems", "items")


@register("typed_users", ctes(EV_VIEWS, EVENT_LOG, _AGG.format(et="user")) + """
SELECT entity_id AS user, max(value) FILTER (WHERE key = 'occupation') AS occupation,
  CAST(max(value) FILTER (WHERE key = 'c_nationkey') AS INTEGER) AS nation,
  CAST(max(value) FILTER (WHERE key = 'c_acctbal') AS DOUBLE) AS acctbal FROM agg GROUP BY entity_id""")
def q_typed_users(spark, sf):
    return E.typed_users(E.aggregate_properties(event_log(spark, sf), "user"), strict=True)


@register("typed_items", ctes(EV_VIEWS, EVENT_LOG, _AGG.format(et="item")) + """
SELECT entity_id AS item, max(value) FILTER (WHERE key = 'title') AS title,
  coalesce(string_agg(key, ',' ORDER BY pos) FILTER (WHERE pos IS NOT NULL AND value = '1'), '') AS genres
FROM (SELECT a.*, list_position(['""" + "', '".join(GENRE_NAMES) + """'], key) AS pos FROM agg a) GROUP BY entity_id""")
def q_typed_items(spark, sf):
    t = E.typed_items(E.aggregate_properties(event_log(spark, sf), "item"), GENRE_NAMES)
    return t.select("item", "title", F.array_join("genres", ",").alias("genres"))


@register("normalize_props", ctes(EV_VIEWS, EVENT_LOG) + """
SELECT entity_id, key, kind, value FROM (
 SELECT entity_id, key,
  CASE WHEN starts_with(value, '[') THEN 'array'
       WHEN key IN ('available_date') AND try_cast(value AS TIMESTAMP) IS NOT NULL THEN 'date'
       WHEN regexp_matches(value, '^-?[0-9]{1,18}$') THEN 'int'
       WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN 'double' END AS kind,
  CASE WHEN starts_with(value, '[') THEN array_to_string(from_json(value, '["VARCHAR"]'), ',')
       WHEN key IN ('available_date') AND try_cast(value AS TIMESTAMP) IS NOT NULL
         THEN strftime(CAST(value AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')
       WHEN regexp_matches(value, '^-?[0-9]{1,18}$') THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
       WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN CAST(CAST(value AS DOUBLE) AS VARCHAR) END AS value
 FROM prow_nn WHERE entity_type = 'item') WHERE kind IS NOT NULL""")
def q_normalize_props(spark, sf):
    return E.normalize_props(E.property_rows(event_log(spark, sf), "item"), ["available_date"])


@register("prop_keys", _ev_sql(" SELECT DISTINCT key FROM prow_nn WHERE entity_type = 'item'"))
def q_prop_keys(spark, sf):
    return E.prop_keys(E.aggregate_properties(event_log(spark, sf), "item"))


@register("item_weights", ctes(("items", "item_factors")) + """
SELECT i.item, coalesce(w.weight, 1.0) AS weight FROM items i
LEFT JOIN item_factors w ON i.item = w.item""")
def q_item_weights(spark, sf):
    w = T.item_factors(spark, sf).select("item", "weight")
    return E.item_weights(T.items(spark, sf), w)


@register("rating_events", _ev_sql("""
SELECT entity_id AS user, target_id AS item, CAST(json_extract_string(properties, '$.rating') AS DOUBLE) AS rating,
  CAST(epoch_us(ts) // 1000 AS BIGINT) AS t_ms FROM ev WHERE event = 'rate'"""))
def q_rating_events(spark, sf):
    return I.rating_events(event_log(spark, sf))


@register("buy_events", ctes(("inter",)) + """
SELECT CAST(user AS VARCHAR) AS user, CAST(item AS VARCHAR) AS item, CAST(epoch_us(ts) // 1000 AS BIGINT) AS t_ms FROM inter WHERE action = 'purchase'""")
def q_buy_events(spark, sf):
    i = T.inter(spark, sf).where(F.col("action") == "purchase")
    ev = i.select(F.lit("buy").alias("event"), F.col("user").cast("string").alias("entity_id"),
                  F.col("item").cast("string").alias("target_id"), "ts")
    return I.buy_events(ev)


@register("event_scan", """
SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_type IN ('purchase', 'view')""")
def q_event_scan(spark, sf):
    return IO.read_events(spark, f"{sf}/events.parquet", events=["purchase", "view"],
                          cols={"event": "event_type"}).select("event_id", "ts", "user_id", "event_type", "value")


@register("event_scan_range", """
SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_type IN ('purchase', 'view')
AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'""")
def q_event_scan_range(spark, sf):
    return IO.read_events(spark, f"{sf}/events.parquet", events=["purchase", "view"], start="2024-01-10 00:00:00",
                          end="2024-01-20 00:00:00", cols={"event": "event_type"}).select(
        "event_id", "ts", "user_id", "event_type", "value")


@register("action_split", ctes(("inter",)) + "SELECT user, item, value, ts FROM inter WHERE action IN ('purchase', 'view')")
def q_action_split(spark, sf):
    return I.action_split(T.inter(spark, sf), ["purchase", "view"]).select("user", "item", "value", "ts")


@register("valid_ids", ctes(("inter",)) + """
SELECT user, action, item FROM inter WHERE user IS NOT NULL AND item IS NOT NULL
AND length(CAST(user AS VARCHAR)) > 0 AND length(CAST(item AS VARCHAR)) > 0""")
def q_valid_ids(spark, sf):
    return I.valid_ids(T.inter(spark, sf)).select("user", "action", "item")


@register("known_pairs", ctes(("inter", "users", "items")) + """
SELECT user, action, item FROM inter WHERE user IN (SELECT user FROM users) AND item IN (SELECT item FROM items)""")
def q_known_pairs(spark, sf):
    return I.known_pairs(T.inter(spark, sf), T.users(spark, sf), T.items(spark, sf)).select("user", "action", "item")
