"""Session baskets, itemsets and association rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from recoflow.operators import basket as B
from recoflow.plans.registry import register
from recoflow.plans.sqlparts import ctes
from recoflow.sources import tables as T
from recoflow.sources.tables import LONG_DURATION, POP_END, PRIMARY

GAP = 21600          # 6 h session gap
MAX_LEN, MIN_SUPPORT, MIN_CONF, MIN_LIFT, MAX_RULES = 3, 1e-4, 0.1, 1.0, 5


def _txt(c):
    return F.concat_ws(",", F.transform(F.col(c), lambda x: x.cast("string")))


def order_items(spark, sf):
    """(basket, item) rows of the orders."""
    return T.order_baskets(spark, sf).select(F.col("basket_id").alias("basket"), "item")


SESS_SQL = f"""
s AS (SELECT user, item, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL
  OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > {GAP * 1000000} THEN 1 ELSE 0 END AS st
  FROM inter WINDOW w AS (PARTITION BY user ORDER BY ts, event_id)),
g AS (SELECT *, sum(st) OVER (PARTITION BY user ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM s),
sb AS (SELECT user, min(ts) AS session_start, max(ts) AS last_time, list_sort(list(DISTINCT item)) AS items
  FROM g GROUP BY user, sid)"""


@register("basket_sessions", ctes(("inter",), SESS_SQL) + """
SELECT user, session_start, last_time, array_to_string(items, ',') AS items, CAST(len(items) AS INTEGER) AS n_items
FROM sb WHERE len(items) >= 2""")
def q_basket_sessions(spark, sf):
    b = B.basket_sessions(T.inter(spark, sf), GAP, min_size=2)
    return b.select("user", "session_start", "last_time", _txt("items").alias("items"), "n_items")


@register("transaction_total", ctes(("inter",), SESS_SQL) + "SELECT count(*) AS n_baskets FROM sb WHERE len(items) >= 2")
def q_transaction_total(spark, sf):
    return B.transaction_total(B.basket_sessions(T.inter(spark, sf), GAP, min_size=2))


ITEMSETS_SQL = f"""
tot AS MATERIALIZED (SELECT count(DISTINCT basket_id) AS n, count(DISTINCT basket_id) * {MIN_SUPPORT} AS least FROM order_baskets),
ob AS MATERIALIZED (SELECT * FROM order_baskets),
i1 AS MATERIALIZED (SELECT CAST(item AS VARCHAR) AS s, [item] AS l, count(*) AS c FROM ob GROUP BY item
  HAVING count(*) >= (SELECT least FROM tot)),
i2 AS MATERIALIZED (SELECT a.item || ',' || b.item AS s, [a.item, b.item] AS l, count(*) AS c FROM ob a JOIN ob b
  ON a.basket_id = b.basket_id AND a.item < b.item GROUP BY a.item, b.item HAVING count(*) >= (SELECT least FROM tot)),
i3 AS MATERIALIZED (SELECT a.item || ',' || b.item || ',' || d.item AS s, [a.item, b.item, d.item] AS l, count(*) AS c
  FROM ob a JOIN ob b ON a.basket_id = b.basket_id AND a.item < b.item
  JOIN ob d ON d.basket_id = a.basket_id AND b.item < d.item
  GROUP BY a.item, b.item, d.item HAVING count(*) >= (SELECT least FROM tot)),
its AS MATERIALIZED (SELECT * FROM i1 UNION ALL SELECT * FROM i2 UNION ALL SELECT * FROM i3),
r AS (SELECT l, c AS rule_cnt, unnest(l) AS conseq FROM its WHERE len(l) >= 2),
r2 AS MATERIALIZED (SELECT array_to_string(list_filter(l, lambda x: x <> conseq), ',') AS cond, len(l) - 1 AS n_cond,
  list_filter(l, lambda x: x <> conseq) AS cl, conseq, CAST(conseq AS VARCHAR) AS ctext, rule_cnt FROM r),
rj AS MATERIALIZED (SELECT r2.cond, r2.cl, r2.n_cond, r2.conseq, r2.rule_cnt, a.c AS cond_cnt, b.c AS conseq_cnt,
  r2.rule_cnt / tot.n AS support, r2.rule_cnt / a.c AS confidence,
  CAST(r2.rule_cnt AS DOUBLE) * tot.n / (CAST(a.c AS DOUBLE) * b.c) AS lift
  FROM r2 JOIN its a ON a.s = r2.cond JOIN i1 b ON b.s = r2.ctext CROSS JOIN tot),
rules AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY confidence DESC, conseq)
  AS rank FROM rj WHERE n_cond <= {MAX_LEN - 1} AND confidence >= {MIN_CONF} AND lift >= {MIN_LIFT})
  WHERE rank <= {MAX_RULES})"""
_IV = ("order_baskets",)


def itemsets(spark, sf):
    return B.itemset_count(order_items(spark, sf), MAX_LEN, MIN_SUPPORT)


@register("itemset_count", ctes(_IV, ITEMSETS_SQL) + """
SELECT s AS itemset, CAST(len(l) AS INTEGER) AS size, c AS count FROM its""")
def q_itemset_count(spark, sf):
    return itemsets(spark, sf).select(_txt("itemset").alias("itemset"), "size", "count")


def _all_rules(spark, sf):
    rows = order_items(spark, sf)
    total = rows.select(F.count_distinct("basket").cast("double")).scalar()
    return B.rule_self_join(B.itemset_count(rows, MAX_LEN, MIN_SUPPORT), total)


@register("rule_self_join", ctes(_IV, ITEMSETS_SQL) + """
SELECT cond, conseq, rule_cnt, cond_cnt, conseq_cnt, round(support, 6) AS support,
  round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM rj""")
def q_rule_self_join(spark, sf):
    return _all_rules(spark, sf).select(_txt("cond").alias("cond"), "conseq", "rule_cnt", "cond_cnt", "conseq_cnt",
                                        *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])


def rules(spark, sf):
    return B.association_rules(order_items(spark, sf), MAX_LEN, MIN_SUPPORT, MIN_CONF, MIN_LIFT, MAX_RULES)


_RULE_OUT = """
SELECT cond, conseq, round(support, 6) AS support, round(confidence, 6) AS confidence,
  round(lift, 6) AS lift, CAST(rank AS INTEGER) AS rank FROM rules"""


@register("association_rules", ctes(_IV, ITEMSETS_SQL) + _RULE_OUT)
def q_association_rules(spark, sf):
    r = rules(spark, sf)
    return r.select(_txt("cond").alias("cond"), "conseq", *[F.round(c, 6).alias(c) for c in
                                                             ("support", "confidence", "lift")], "rank")


@register("rule_topk", ctes(_IV, ITEMSETS_SQL) + _RULE_OUT)
def q_rule_topk(spark, sf):
    r = _all_rules(spark, sf)
    r = r.where((F.size("cond") <= MAX_LEN - 1) & (F.col("confidence") >= MIN_CONF) & (F.col("lift") >= MIN_LIFT))
    r = B.rule_topk(r, MAX_RULES)
    return r.select(_txt("cond").alias("cond"), "conseq", *[F.round(c, 6).alias(c) for c in
                                                             ("support", "confidence", "lift")], "rank")


@register("rule_lookup", ctes(("order_baskets", "orders_inter"), ITEMSETS_SQL) + """,
bk AS MATERIALIZED (SELECT DISTINCT user AS basket_id, item FROM orders_inter),
m AS (SELECT b.basket_id, r.conseq, max({'c': r.confidence, 'l': r.lift}) AS m FROM rules r JOIN bk b ON b.item = r.cl[1]
  WHERE (r.n_cond < 2 OR EXISTS (SELECT 1 FROM bk x WHERE x.basket_id = b.basket_id AND x.item = r.cl[2]))
  AND NOT EXISTS (SELECT 1 FROM bk x WHERE x.basket_id = b.basket_id AND x.item = r.conseq)
  GROUP BY b.basket_id, r.conseq)
SELECT basket_id, conseq, round(m.c, 6) AS confidence, round(m.l, 6) AS lift, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY m.c DESC, m.l DESC, conseq) AS rank FROM m)
WHERE rank <= 3""")
def q_rule_lookup(spark, sf):
    """Rules learned on orders, applied to each customer's whole purchase set."""
    cust = T.orders_inter(spark, sf).select(F.col("user").alias("basket"), "item").distinct()
    r = B.rule_lookup(cust, rules(spark, sf), 3, MAX_LEN - 1)
    return r.select(F.col("basket").alias("basket_id"), "conseq", F.round("confidence", 6).alias("confidence"),
                    F.round("lift", 6).alias("lift"), "rank")


@register("itemset_subsets", ctes(_IV, ITEMSETS_SQL) + """
SELECT b.basket_id, i.s AS itemset FROM ob b JOIN its i ON b.item = i.l[1] WHERE len(i.l) >= 2
AND EXISTS (SELECT 1 FROM ob x WHERE x.basket_id = b.basket_id AND x.item = i.l[2])
AND (len(i.l) < 3 OR EXISTS (SELECT 1 FROM ob x WHERE x.basket_id = b.basket_id AND x.item = i.l[3]))""")
def q_itemset_subsets(spark, sf):
    its = itemsets(spark, sf).where(F.col("size") >= 2)
    r = B.itemset_subsets(order_items(spark, sf), its, MAX_LEN)
    return r.select(F.col("basket").alias("basket_id"), _txt("itemset").alias("itemset"))


LONG_LEN, LONG_SUPPORT = 5, 8e-4


def _long_sql() -> str:
    """Itemsets of 1..LONG_LEN items of the session baskets, by self joins."""
    parts = []
    for n in range(1, LONG_LEN + 1):
        joins = "".join(f" JOIN lb b{i} ON b{i}.basket = b0.basket AND b{i}.item > b{i - 1}.item" for i in range(1, n))
        cols = " || ',' || ".join(f"b{i}.item" for i in range(n))
        parts.append(f"SELECT CAST({cols} AS VARCHAR) AS itemset, {n} AS size, count(*) AS count FROM lb b0{joins} GROUP BY ALL "
                     f"HAVING count(*) >= {LONG_SUPPORT} * (SELECT count(DISTINCT basket) FROM lb)")
    return ctes(("inter",), SESS_SQL, """
lb AS (SELECT user || '/' || epoch_us(session_start) AS basket, unnest(items) AS item FROM sb WHERE len(items) >= 2)""") \
        + " UNION ALL ".join(parts)


@register("itemset_count_long", _long_sql())
def q_itemset_count_long(spark, sf):
    """Frequent sets of up to five items in session baskets."""
    b = B.basket_sessions(T.inter(spark, sf), GAP, min_size=2)
    rows = b.select(F.concat_ws("/", "user", F.unix_micros(F.col("session_start").cast("timestamp"))).alias("basket"),
                    F.explode("items").alias("item"))
    return B.itemset_count(rows, LONG_LEN, LONG_SUPPORT).select(_txt("itemset").alias("itemset"), "size", "count")


@register("pop_period_join", ctes(("inter",)) + f"""
SELECT item, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16 00:00:00') AS older,
  count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16 00:00:00') AS newer
FROM inter WHERE action = '{PRIMARY}' AND ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '{POP_END}'
GROUP BY item HAVING older > 0 AND newer > 0""")
def q_pop_period_join(spark, sf):
    """The inner join of two periods' counts, as conditional counts in one pass."""
    from recoflow.operators.popularity import period_bounds
    b = period_bounds(POP_END, LONG_DURATION, 2)
    i = T.inter(spark, sf).where(F.col("action") == PRIMARY)
    t = F.col("ts")
    lo, mid, hi = (F.lit(x).cast("timestamp_ntz") for x in b)
    agg = i.where((t >= lo) & (t < hi)).groupBy("item").agg(
        F.count_if(t < mid).alias("older"), F.count_if(t >= mid).alias("newer"))
    return agg.where("older > 0 and newer > 0")
