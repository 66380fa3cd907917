"""Helpers shared by the training-data operators.

Row identity: documents may repeat an id, so a row is known by
(doc_id, row_key(text)); rows equal in both are interchangeable.
Inputs are narrowed to the columns an operator reads, or packed in one column
(``whole_rows``) where whole rows are returned, so extra or clashing columns of
the input do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds over 1/HOT_KEYS of all rows, so at most HOT_KEYS
#: keys are hot whatever the input: the broadcast of hot keys is bounded.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_key(text: str = "text") -> Column:
    """64-bit identity of a row's text; null and empty differ."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def whole_rows(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` packed in one column ``row``: whatever an operator
    adds beside it cannot clash with a column of the input.  ``row.*`` unpacks."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def skew_lookup(left: DataFrame, right: DataFrame, key: str, weight: str, values: list[str],
                spread: str) -> DataFrame:
    """``left`` left-joined with ``right`` (one row per ``key``), safe for hot keys.

    ``right[weight]`` says how many left rows a key has.  Keys over 1/HOT_KEYS
    of the total weight (at most HOT_KEYS of them) are broadcast; their left
    rows, and rows with a null key, are spread by the ``spread`` column in the
    shuffle join that serves all other keys.  ``right`` is read three times,
    so pass a written table."""
    total = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_KEYS > total
    packed = F.struct(*values)
    hot = right.where(is_hot).select(F.col(key).alias("_xhk"), packed.alias("_xhv"))
    cold = right.where(~is_hot).select(F.col(key).alias("_xck"), packed.alias("_xcv"))
    kind = left.schema[key].dataType
    j = left.join(F.broadcast(hot), F.col(key) == F.col("_xhk"), "left")
    apart = F.col("_xhk").isNotNull() | F.col(key).isNull()
    j = j.withColumn("_xjk", F.when(apart, F.xxhash64(F.lit(7), F.col(spread)).cast(kind)).otherwise(F.col(key)))
    j = j.join(cold, F.col("_xjk") == F.col("_xck"), "left")
    got = F.when(F.col(key).isNull(), None).when(F.col("_xhk").isNotNull(), F.col("_xhv")).otherwise(F.col("_xcv"))
    return j.withColumn("_xgot", got).select(*left.columns, *[F.col("_xgot")[v].alias(v) for v in values])
