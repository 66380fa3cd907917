"""The event log by day and event type, and scans that open only the days a
table of periods asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_event_days(events: DataFrame, path: str, files: int = 1, mode: str = "overwrite") -> None:
    """Write events (event_id, ts, action, ...) with one folder a day and
    action.  ``files`` deals each folder to that many tasks, for logs in which
    one day and action is too much for one."""
    day = F.to_date("ts")
    deal = F.pmod(F.xxhash64("event_id"), F.lit(files))
    (events.withColumn("day", day).repartition("day", "action", deal)
     .write.mode(mode).partitionBy("day", "action").parquet(path))


def events_in_periods(spark: SparkSession, path: str, periods: DataFrame, actions=None) -> DataFrame:
    """The events of every row of ``periods`` (period, start, end; half-open),
    once for each period that holds them.

    The periods' days meet the day folders in a broadcast join, so Spark reads
    the folders of those days only (dynamic partition pruning), and ``actions``
    prune the rest.  Periods are a parameter table, not data."""
    e = spark.read.parquet(path)
    if actions is not None:
        e = e.where(F.col("action").isin(list(actions)))
    # the last moment of a half-open period lies on the day before an end at midnight
    last = F.to_date(F.col("end") - F.expr("INTERVAL 1 MICROSECOND"))
    days = periods.where("start < end").select("*", F.explode(F.sequence(F.to_date("start"), last)).alias("day"))
    j = e.join(F.broadcast(days.where(F.col("day").isNotNull())), "day")
    return j.where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))).drop("day", "start", "end")
