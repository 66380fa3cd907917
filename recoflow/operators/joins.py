"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds over 1/HOT_KEYS of the left rows, so there are at
#: most HOT_KEYS of them whatever the data: their broadcast is bounded.
HOT_KEYS = 1000
#: Rows that one task makes and groups, and rows of a right table that is copied to all tasks.
OUT_ROWS, SMALL_RIGHT = 4_000_000, 500_000


def owned_join(left: DataFrame, right: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Inner join on ``keys`` (not null) that multiplies the left rows, to be
    grouped by ``owner`` and more.

    Tasks are as many as the rows made ask for, so what one of them groups does
    not grow with the data.  Copied to all tasks when it is small, the right
    table meets left rows dealt by owner, and the rows made are grouped where
    they are.  ``left`` is read twice."""
    made = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l")).join(
        right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r")), keys).agg(F.sum(F.col("_l") * F.col("_r"))).first()[0] or 0
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-made // OUT_ROWS))
    if right.limit(SMALL_RIGHT + 1).count() <= SMALL_RIGHT:
        return left.repartition(parts, owner).join(F.broadcast(right), keys)
    return blocked_join(left, right, keys, owner, parts=parts)


def blocked_join(left: DataFrame, right: DataFrame, keys: list[str], deal: str, hot_keys: int = HOT_KEYS,
                 parts: int | None = None) -> DataFrame:
    """Inner join on ``keys`` (not null) whose output may multiply, in ``parts``
    tasks when given.

    A hot key's left rows are dealt to blocks by a hash of the column ``deal``
    and its right rows are copied to each block, so no task holds more than
    about 1/hot_keys of the left rows of one key.  ``left`` is read twice."""
    n = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = n.select(F.sum("_n")).scalar()
    hot = n.where(F.col("_n") * hot_keys > total).select(
        *keys, F.ceil(F.col("_n") * hot_keys / total).cast("int").alias("_blocks"))
    hot = F.broadcast(hot)
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("_block", F.pmod(F.xxhash64(F.col(deal)), blocks).cast("int"))
    copied = right.join(hot, keys, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt, copied = dealt.drop("_blocks"), copied.drop("_blocks")
    if parts is not None:
        dealt, copied = (x.repartition(parts, *keys, "_block") for x in (dealt, copied))
    return dealt.join(copied, [*keys, "_block"]).drop("_block")
