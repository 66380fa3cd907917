"""Trends of a stream from panes: event counts per item and short pane, kept in
a table that late and repeated rows correct, from which the popularity models
of any period made of whole panes are composed without the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.streaming.jobs import stream_popularity

PARTS = {"popular": 1, "trending": 2, "hot": 3}


def pane_counts(events: DataFrame, pane: str, watermark: str, actions=None) -> DataFrame:
    """Streaming (pane_start, item, n).  In update mode a pane is sent again
    whenever a late row changes it, until the watermark passes; repeated event
    ids count once."""
    w = stream_popularity(events, pane, None, watermark, actions)
    return w.select(F.col("window_start").alias("pane_start"), "item", "n")


def trends_from_panes(panes: DataFrame, kind: str, pane_seconds: int, duration_seconds: int, until) -> DataFrame:
    """(period_end, item, score) of a popularity model for every period of
    ``duration_seconds`` that ends at a pane's end up to ``until`` (a column)
    and begins at the first pane or later.

    A pane is copied to the duration / pane periods that hold it, and counted
    in its part of each: the periods share the panes, not the events.  The
    duration must be whole panes in each of its parts."""
    parts = PARTS[kind]
    if duration_seconds % (parts * pane_seconds):
        raise ValueError(f"{duration_seconds} s is not {parts} parts of whole panes of {pane_seconds} s")
    held = duration_seconds // pane_seconds
    start = F.unix_timestamp(F.col("pane_start"))
    first = panes.select(F.min(start)).scalar()
    d = panes.select("item", "n", start.alias("s"), F.explode(F.sequence(F.lit(1), F.lit(held))).alias("ahead"))
    d = d.withColumn("e", F.col("s") + F.col("ahead") * pane_seconds)
    d = d.where((F.col("e") - duration_seconds >= first) & (F.timestamp_seconds("e") <= until))
    # ahead = held: the pane is the period's oldest
    part = F.floor((held - F.col("ahead")) * parts / held)
    counts = [F.sum(F.when(part == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(parts)]
    agg = d.groupBy("e", "item").agg(*counts)
    for i in range(parts):
        agg = agg.where(F.col(f"c{i}") > 0)
    c = [F.col(f"c{i}") for i in range(parts)]
    score = c[0] if parts == 1 else c[1] - c[0] if parts == 2 else (c[2] - c[1]) - (c[1] - c[0])
    return agg.select(F.timestamp_seconds("e").alias("period_end"), "item", score.cast("double").alias("score"))
