"""Streaming jobs driven to completion over the events table, with exact oracles
for the rows the watermark has released."""

from __future__ import annotations

from pyspark.sql import functions as F

from recoflow.operators import bandit as BA
from recoflow.plans.q_models import LINUCB_SQL, features
from recoflow.plans.registry import register
from recoflow.plans.sqlparts import ctes
from recoflow.sources import tables as T
from recoflow.streaming import jobs as J
from recoflow.streaming import panes as P

# Append mode emits a window once the watermark (max event time - delay)
# reaches its end; the oracle keeps exactly those windows.
_WM = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


PARTS = 4


def _feed(spark, sf):
    """The event log in four micro-batches that repeat some rows of the one before."""
    folder, files = J.split_feed(T.table(spark, sf, "events"), PARTS)
    return J.read_event_stream(spark, folder, "*.parquet", max_files=files)


@register("stream_popularity", ctes(("inter",)) + f"""
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, item,
  count(*) AS n FROM inter WHERE action = 'purchase' GROUP BY 1, 2, 3
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_WM}""")
def q_stream_popularity(spark, sf):
    ev = _feed(spark, sf)
    return J.run_to_table(J.stream_popularity(ev, "1 day", None, "1 day", actions=["purchase"]), "popularity")


@register("stream_baskets", ctes(("inter",)) + f""",
s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000
  THEN 1 ELSE 0 END AS st FROM inter WINDOW w AS (PARTITION BY user ORDER BY ts, event_id)),
g AS (SELECT *, sum(st) OVER (PARTITION BY user ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM s),
sb AS (SELECT user, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end,
  list_sort(list(DISTINCT item)) AS items FROM g GROUP BY user, sid)
SELECT user, session_start, session_end, array_to_string(items, ',') AS items, CAST(len(items) AS INTEGER) AS n_items
FROM sb WHERE len(items) >= 2 AND session_end <= {_WM}""")
def q_stream_baskets(spark, sf):
    ev = _feed(spark, sf)
    out = J.run_to_table(J.stream_baskets(ev, "6 hours", "1 day", 2), "baskets")
    return out.select("user", "session_start", "session_end",
                      F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).alias("items"), "n_items")


@register("stream_bandit", ctes(("reward_log",)) + """
SELECT arm, count(*) AS pulls, CAST(sum(reward) AS BIGINT) AS reward_sum FROM reward_log GROUP BY arm""")
def q_stream_bandit(spark, sf):
    ev = _feed(spark, sf).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    log = ev.select("event_id", (F.col("item") % 10).alias("arm"),
                    F.when(F.col("action") == "purchase", 1).when(F.col("action") == "error", -1)
                    .otherwise(0).alias("reward"))
    return J.run_to_table(J.stream_bandit(log), "bandit", mode="update", keys=["arm"])


# sums that end in a 5 round alike whatever the order of their addends
@register("stream_linucb", LINUCB_SQL.replace("round(a, 6)", "round(a + 1e-9, 6)"))
def q_stream_linucb(spark, sf):
    """A and b of every arm, added up micro-batch by micro-batch."""
    ev = _feed(spark, sf).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    log = ev.select((F.col("item") % 10).alias("arm"), F.when(F.col("action") == "purchase", 1)
                    .when(F.col("action") == "error", -1).otherwise(0).alias("reward"), features().alias("x"))
    sums = J.run_sums(log, "linucb", lambda b: BA.linucb_sums(b, "arm", "x", "reward"), ["arm", "i", "j"], "a")
    return BA.with_identity(sums).select("arm", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"),
                                         F.round(F.col("a") + 1e-9, 6).alias("a"))


DAY = 86400


def _trend_sql(kind: str, days: int) -> str:
    parts = P.PARTS[kind]
    counts = ", ".join(f"count(*) FILTER (WHERE epoch(ts) >= epoch(e) - {days * DAY * (parts - i) // parts} AND "
                       f"epoch(ts) < epoch(e) - {days * DAY * (parts - i - 1) // parts}) AS c{i}" for i in range(parts))
    score = {"popular": "c0", "trending": "c1 - c0", "hot": "(c2 - c1) - (c1 - c0)"}[kind]
    some = " AND ".join(f"c{i} > 0" for i in range(parts))
    return ctes(("inter",), f"""
lim AS (SELECT min(ts) FILTER (WHERE action = 'purchase') AS first, max(ts) - INTERVAL 1 DAY AS last FROM inter),
ends AS (SELECT unnest(generate_series(date_trunc('day', first) + INTERVAL {days} DAY, last, INTERVAL 1 DAY)) AS e FROM lim),
cnt AS (SELECT e AS period_end, item, {counts} FROM ends JOIN inter ON action = 'purchase'
  AND ts >= e - INTERVAL {days} DAY AND ts < e GROUP BY e, item)""") + f"""
SELECT period_end, item, CAST({score} AS DOUBLE) AS score FROM cnt WHERE {some}"""


def _trends(kind: str, days: int):
    def run(spark, sf):
        progress: dict = {}
        counts = P.pane_counts(_feed(spark, sf), "1 day", "1 day", ["purchase"])
        panes = J.run_to_table(counts, "panes", mode="update", keys=["pane_start", "item"], progress=progress)
        until = F.to_timestamp(F.lit(progress.get("watermark")))
        return P.trends_from_panes(panes, kind, DAY, days * DAY, until)
    return run


for _kind, _days in (("popular", 3), ("trending", 6), ("hot", 9)):
    register(f"stream_{_kind}_panes", _trend_sql(_kind, _days))(_trends(_kind, _days))
