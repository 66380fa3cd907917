"""Sharding by Hilbert-curve order of several metadata dimensions.

Each dimension is quantised to ``bits`` bits, rows are sorted by their index
on the Hilbert curve through that grid, and the order is cut into runs of
equal row counts.  Rows near each other on the curve are near in every
dimension, so a run's minima and maxima prune it for filters on any of them.

The sort is one range shuffle on (index, id, text checksum): a hot cell is cut
like any other, as the sort key goes on below the cell.  The sorted rows are
written once (range boundaries come from a sample), global positions are local
positions plus the counts of the partitions before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import partitions
from recoflow.session import cut_lineage

BITS = 6


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of grid points (rows x dimensions, integers
    below 2**bits).  The transpose form: undo the excess rotations bit by bit
    from the top, Gray-encode, then interleave the bits."""
    x = [cells[:, d].astype(np.int64).copy() for d in range(cells.shape[1])]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for d in range(n):
            flip = (x[d] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, n):
        x[d] = x[d] ^ x[d - 1]
    carry = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        carry = np.where((x[n - 1] & (1 << b)) != 0, carry ^ ((1 << b) - 1), carry)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            out = (out << 1) | (((x[d] ^ carry) >> b) & 1)
    return out


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    if not 0 < bits * len(cells) < 63:
        raise ValueError("bits times dimensions must be 1 to 62")

    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([p.to_numpy() for p in parts]), bits))
    return F.pandas_udf(run, "long")(*[c.cast("long") for c in cells])


def by_name(col: Column, bits: int = BITS) -> Column:
    """Cell of a text dimension by hash: equal names share a cell; null is cell 0."""
    return F.when(col.isNull(), 0).otherwise(F.pmod(F.xxhash64(col.cast("string")), F.lit(1 << bits)))


def by_log(col: Column, bits: int = BITS, step: float = 0.35) -> Column:
    """Cell of a nonnegative number on a log scale; null counts as 0."""
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log(F.greatest(F.coalesce(col, F.lit(0)), F.lit(0)) + 1) / step))


def by_rank(col: Column, cuts: list[float]) -> Column:
    """Cell of a number by sorted cut points (its quantiles); null is cell 0."""
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(float(c)) for c in cuts])
    return F.coalesce(F.size(F.filter(bounds, lambda c: c < col.cast("double"))), F.lit(0))


def quantile_cuts(df: DataFrame, name: str, bits: int = BITS) -> list[float]:
    """At most 2**bits - 1 approximate quantiles of a number column."""
    n = 1 << bits
    got = df.select(F.percentile_approx(F.col(name).cast("double"), [i / n for i in range(1, n)], 10_000)).first()[0]
    return sorted(set(got or []))


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``_xpos`` (0-based position in the global order) and the row
    count.  One range shuffle, one written table, offsets of one row per
    partition (so the broadcast is bounded by the partition count)."""
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    local = cut_lineage(ranged.withColumn("_xid", F.monotonically_increasing_id()))
    local = local.withColumn("_xpart", F.shiftright("_xid", 33))
    counts = {r["_xpart"]: r["n"] for r in local.groupBy("_xpart").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    spark = df.sparkSession
    off = spark.createDataFrame(offsets, "_xpart long, _xoff long")
    out = local.join(F.broadcast(off), "_xpart").withColumn(
        "_xpos", F.col("_xoff") + F.col("_xid").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_xpart", "_xoff", "_xid"), total


def shard_rows(docs: DataFrame, shards: int = 8, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text",
               keep: bool = False) -> DataFrame:
    """Rows of ``docs`` in Hilbert order of (source, lang, size, id), cut into
    ``shards`` runs whose counts differ by at most one (law ``rows``).

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot and
    grown_shard (null: the law is not ``key``); with ``keep`` the columns of
    ``docs`` (but for those of these names) followed by shard and slot.  Null
    texts have size 1 and checksum 0; null ids, sources and languages fall in
    cell 0 and sort first; repeated rows each get a slot; missing source or
    lang columns count as null; an empty table gives no rows."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    names = set(docs.columns)
    cell = lambda c: by_name(F.col(c), bits) if c in names else F.lit(0)
    cuts = quantile_cuts(docs, id_col, bits)
    curve = curve_index([cell("source"), cell("lang"), by_log(size, bits), by_rank(F.col(id_col), cuts)], bits)
    added = [size.alias("_xsize"), crc.alias("_xcrc"), curve.alias("_xcurve")]
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    out, total = numbered(docs.select(F.col(id_col).alias("_xdoc"), *rest, *added), ["_xcurve", "_xdoc", "_xcrc", "_xsize"])
    out = out.withColumn("_xshard", F.expr(f"cast(_xpos * {shards} div {max(total, 1)} as int)"))
    slot = F.col("_xpos") - F.expr(f"(_xshard * {total}L + {shards - 1}) div {shards}")
    if keep:
        return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("shard", "slot")],
                          F.col("_xshard").alias("shard"), slot.alias("slot"))
    return out.select(F.col("_xdoc").alias("doc_id"), F.col("_xsize").alias("size"), F.col("_xcrc").alias("text_crc32"),
                      F.lit("rows").alias("law"), F.col("_xshard").alias("shard"), slot.alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; its files hold consecutive runs of slots in order."""
    runs = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    runs.write.partitionBy("shard").parquet(path)


def manifest(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """(shard, n_rows, min and max of each dimension): what a reader prunes by."""
    aggs = [f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
