"""Top-k per group and global ranks without a single-partition window.

Global positions take one shuffle: rows are range-partitioned on the sort key
and sorted inside each partition, their local position is the row part of
``monotonically_increasing_id``, and the result is written once (range
boundaries are sampled with a seed that changes per evaluation).  Offsets come
from a tiny aggregate of one row per partition, so broadcasting it is bounded
by the partition count, not by the data.  The order must end with a unique key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from recoflow.session import cut_lineage


def topn_per_group(df: DataFrame, keys, order: list[Column], n, rank_col: str = "rank") -> DataFrame:
    """``row_number`` over (keys, order) <= n; Spark plans a partial window
    group limit before the shuffle, the bounded heap of the reference.
    ``n`` may be an int or a column (per-query limits)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    lim = n if isinstance(n, Column) else F.lit(n)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= lim)


def _ranged(df: DataFrame, order: list[Column], num_partitions: int | None) -> DataFrame:
    """``df`` in global order with _pid (partition) and _lrn (1-based local position)."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    r = r.withColumn("_mid", F.monotonically_increasing_id())
    return (r.withColumn("_pid", F.shiftright("_mid", 33))
            .withColumn("_lrn", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_mid"))


def _with_offsets(local: DataFrame, total: Column) -> DataFrame:
    """``local`` with _off: the sum of ``total`` over the partitions before."""
    sums = local.groupBy("_pid").agg(total.alias("_n"))
    offs = sums.select("_pid", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    return local.join(F.broadcast(offs), "_pid")


def global_row_number(df: DataFrame, order: list[Column], name: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    local = cut_lineage(_ranged(df, order, num_partitions))
    return (_with_offsets(local, F.count(F.lit(1)))
            .withColumn(name, (F.col("_lrn") + F.col("_off")).cast("bigint"))
            .drop("_pid", "_lrn", "_off"))


def _running(value: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = 0
        for b in batches:
            if not b.num_rows:
                continue
            sums = pc.cumulative_sum(pc.fill_null(b.column(value), 0))
            sums = pc.add(sums, pa.scalar(carry, sums.type))
            carry = sums[-1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, sums], names=[*b.schema.names, "_ls"])
    return run


def global_running_sum(df: DataFrame, order: list[Column], value: str, name: str,
                       inclusive: bool = True, num_partitions: int | None = None,
                       position: str | None = None) -> DataFrame:
    """Running sum of the whole number ``value`` in a global order: local sums
    of the sorted partitions (streamed in Arrow batches, so the sort is not
    repeated by a window) plus the sums of the partitions before.  ``position``
    also asks for the 1-based global position under that name."""
    ranged = _ranged(df.withColumn(value, F.col(value).cast("bigint")), order, num_partitions)
    schema = StructType([*ranged.schema.fields, StructField("_ls", LongType())])
    local = cut_lineage(ranged.mapInArrow(_running(value), schema))
    out = _with_offsets(local, F.sum(value)).withColumn(name, F.col("_ls") + F.col("_off"))
    if not inclusive:
        out = out.withColumn(name, F.col(name) - F.col(value))
    if position:
        out = _with_offsets(out.drop("_off"), F.count(F.lit(1))).withColumn(position, F.col("_lrn") + F.col("_off"))
    return out.drop("_pid", "_lrn", "_ls", "_off")
