"""Structured Streaming forms of popularity, session baskets and bandit stats.

Each builder takes a streaming DataFrame and returns a streaming DataFrame;
``run_to_table`` drives one to completion with an ``availableNow`` trigger
into a Parquet table, with the checkpoint under ``spark.checkpoint.dir``.
Late rows (past the watermark) are dropped; duplicates by event id are
dropped within the watermark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.session import table_folder

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_event_stream(spark: SparkSession, folder: str, file_glob: str = "events.parquet",
                      max_files: int | None = None) -> DataFrame:
    """Events as a stream, ``ts`` cast to a zoned timestamp (watermarks need it)."""
    r = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", file_glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.parquet(folder)
    return s.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("user"),
                    F.col("event_type").alias("action"),
                    F.get_json_object("props", "$.k").cast("bigint").alias("item"), "value")


def stream_popularity(events: DataFrame, window: str, slide: str | None = None, watermark: str = "1 day",
                      actions=None) -> DataFrame:
    """Event counts per (window, item), appended once the watermark passes."""
    e = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    if actions:
        e = e.where(F.col("action").isin(list(actions)))
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return e.groupBy(w.alias("w"), "item").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "item", "n")


def stream_baskets(events: DataFrame, gap: str, watermark: str = "1 day", min_size: int = 2) -> DataFrame:
    """Session baskets: session_window per user, distinct items."""
    e = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    b = e.groupBy("user", F.session_window("ts", gap).alias("s")).agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    return b.select("user", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "items", F.size("items").alias("n_items")).where(F.col("n_items") >= min_size)


def stream_bandit(log: DataFrame, arm: str = "arm", reward: str = "reward") -> DataFrame:
    """Running per-arm pulls and reward sums (update mode / foreachBatch merge)."""
    return log.groupBy(arm).agg(F.count(F.lit(1)).alias("pulls"), F.sum(reward).alias("reward_sum"))


def split_feed(events: DataFrame, parts: int, order: str = "ts") -> tuple[str, int]:
    """Write a table as ``parts`` groups of files, consecutive in ``order``
    (file times follow), and return the folder and the number of files a group:
    a stream with that ``max_files`` reads one group a micro-batch.  Every part
    but the first repeats the rows of the part before whose key is a multiple
    of 10, as an at-least-once feed would."""
    spark = events.sparkSession
    out = f"{table_folder(spark)}/feed-{uuid.uuid4().hex}"
    t = F.col(order).cast("timestamp").cast("double")
    cuts, rows = events.select(F.percentile_approx(t, [i / parts for i in range(1, parts)], 10_000), F.count(F.lit(1))).first()
    cuts = cuts or []
    # every file of a group holds rows, so that all groups have equally many files
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // (100 * parts)))
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < t)) if cuts else F.lit(0)
    dealt = events.withColumn("_part", part)
    for i in range(parts):
        again = (F.col("_part") == i - 1) & (F.col("event_id") % 10 == 0)
        dealt.where((F.col("_part") == i) | again).drop("_part").repartition(files).write.mode("append").parquet(out)
    return out, files


def run_to_table(df: DataFrame, name: str, mode: str = "append", keys=(), progress: dict | None = None) -> DataFrame:
    """Run a streaming query to completion (availableNow) and read its result.
    Append mode writes to a Parquet sink.  Update and complete mode keep a
    table by ``keys``: every micro-batch's rows replace the rows of their keys,
    as a new version beside the one before (a retried batch writes its version
    again, so restarts are safe).  ``progress`` takes the last watermark."""
    def merged(batch: DataFrame, old: DataFrame | None) -> DataFrame:
        if old is None or mode != "update":
            return batch
        return batch.unionByName(old.join(batch.select(*keys), list(keys), "left_anti"))
    if mode == "append":
        out, ckpt = _places(df, name)
        q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        return df.sparkSession.read.parquet(out)
    return _run_versions(df, name, mode, merged, df.schema, progress)


def run_sums(df: DataFrame, name: str, per_batch, keys, value: str) -> DataFrame:
    """Run an append stream to completion and keep running sums:
    ``per_batch(batch)`` gives rows (*keys, value), which are added to the sums
    of the version before.  A batch that is tried again starts from that same
    version and writes its own once more, so nothing is counted twice."""
    schema = per_batch(df.sparkSession.createDataFrame([], df.schema)).schema
    return _run_versions(df, name, "append", lambda b, old: added(per_batch(b), old, keys, value), schema)


def added(new: DataFrame, old: DataFrame | None, keys, value: str) -> DataFrame:
    both = new if old is None else old.unionByName(new)
    return both.groupBy(*keys).agg(F.sum(value).alias(value))


def write_version(out: str, epoch: int, batch: DataFrame, merged) -> None:
    """Version ``epoch`` of a table from the version before and a micro-batch."""
    old = batch.sparkSession.read.parquet(f"{out}/version={epoch - 1}") if epoch else None
    merged(batch, old).write.mode("overwrite").parquet(f"{out}/version={epoch}")


def _places(df: DataFrame, name: str) -> tuple[str, str]:
    base = f"{table_folder(df.sparkSession)}/streams/{name}-{uuid.uuid4().hex[:8]}"
    return f"{base}/data", f"{base}/_checkpoint"


def _run_versions(df: DataFrame, name: str, mode: str, merged, schema, progress: dict | None = None) -> DataFrame:
    out, ckpt = _places(df, name)
    done: list[int] = []

    def merge(batch: DataFrame, epoch: int) -> None:
        write_version(out, epoch, batch, merged)
        done.append(epoch)
    q = (df.writeStream.foreachBatch(merge).option("checkpointLocation", ckpt)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    if progress is not None and q.lastProgress:
        progress["watermark"] = q.lastProgress["eventTime"].get("watermark")
    if not done:
        return df.sparkSession.createDataFrame([], schema)
    return df.sparkSession.read.parquet(f"{out}/version={max(done)}")
