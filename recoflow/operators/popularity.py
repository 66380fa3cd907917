"""Popularity models over a time range: popular, trending, hot.

All three read the interactions once and count per item with conditional
aggregates (partial aggregation before the shuffle), instead of one scan and
one join per period.  Ranges are half-open [start, end).

- popular:  events in [end - d, end)
- trending: newer half minus older half; items present in both halves
- hot:      (newer - middle) - (middle - older) over thirds; items in all three
            (the middle third ends at start + 2d/3)
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("popular", "trending", "hot")


def _ts(df: DataFrame, value) -> F.Column:
    return F.lit(value).cast(df.schema["ts"].dataType)


def period_bounds(end: str, duration: int, parts: int) -> list[datetime]:
    """parts+1 boundaries; integer milliseconds as in the reference."""
    e = datetime.fromisoformat(end)
    s = e - timedelta(seconds=duration)
    step_ms = (duration * 1000) // parts
    return [s + timedelta(milliseconds=step_ms * i) for i in range(parts)] + [e]


def popularity(inter: DataFrame, kind: str = "popular", events=None, end: str | None = None,
               duration: int = 259200, action_col: str = "action") -> DataFrame:
    """POPULARITY (item, score double) for ``kind`` in popular/trending/hot."""
    if kind not in KINDS:
        raise ValueError(f"unknown popularity model {kind!r}; use one of {KINDS}")
    if end is None:
        raise ValueError("end is required (no wall-clock default in batch jobs)")
    parts = {"popular": 1, "trending": 2, "hot": 3}[kind]
    b = period_bounds(end, duration, parts)
    df = inter
    if events:
        df = df.where(F.col(action_col).isin(list(events)))
    df = df.where((F.col("ts") >= _ts(df, b[0])) & (F.col("ts") < _ts(df, b[-1])))
    if kind == "popular":
        return df.groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("score"))
    cnt = [F.count_if((F.col("ts") >= _ts(df, b[i])) & (F.col("ts") < _ts(df, b[i + 1]))).alias(f"c{i}")
           for i in range(parts)]
    agg = df.groupBy("item").agg(*cnt)
    if kind == "trending":
        return agg.where("c0 > 0 and c1 > 0").select("item", (F.col("c1") - F.col("c0")).cast("double").alias("score"))
    return agg.where("c0 > 0 and c1 > 0 and c2 > 0").select(
        "item", ((F.col("c2") - F.col("c1")) - (F.col("c1") - F.col("c0"))).cast("double").alias("score"))


def pop_dispatch(inter: DataFrame, name: str | None, events, end: str | None, duration: int):
    """Choose the model by name; None or an unknown name gives no model (None)."""
    if name not in KINDS:
        return None
    return popularity(inter, name, events, end, duration)
