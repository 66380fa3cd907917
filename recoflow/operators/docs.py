"""Item documents: fields + correlator lists + popularity, one row per item.

``group_all`` merges keyed maps with one shuffle: union the (id, key, value,
priority) rows of every input and keep, per (id, key), the value of the
highest priority (the right-most input wins), instead of N cogroups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.operators.correlators import correlator_maps

MODELS = ("all", "collabFiltering", "backfill")


def group_all(*keyed: DataFrame, id_col: str = "id") -> DataFrame:
    """Each input is (id, props map<string, V>); returns (id, props) where a
    later input's value wins for a repeated key."""
    parts = []
    for prio, df in enumerate(keyed):
        parts.append(df.select(F.col(id_col), F.explode(F.col("props")).alias("key", "value"))
                     .withColumn("_prio", F.lit(prio)))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    latest = u.groupBy(id_col, "key").agg(F.max_by("value", "_prio").alias("value"))
    return latest.groupBy(id_col).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"))


def item_docs(fields: DataFrame | None, correlators: DataFrame | None, pop: DataFrame | None,
              model: str = "all") -> DataFrame:
    """ITEM_DOC (item, fields, correlators, pop_rank).

    fields: (item, fields map<string, array<string>>) or None
    correlators: CORRELATOR rows or None; pop: (item, score) or None.
    model 'all' uses all three, 'collabFiltering' drops popularity,
    'backfill' keeps fields and popularity only.  An item with fields but no
    popularity keeps its fields (pop_rank null); a ranked item without a
    document gets a new one with popularity only.
    """
    if model not in MODELS:
        raise ValueError(f"bad recsModel {model!r}")
    cm = correlator_maps(correlators) if correlators is not None and model != "backfill" else None
    ctype = cm.schema["correlators"].dataType.simpleString() if cm is not None else "map<string,array<string>>"
    none_f = F.lit(None).cast("map<string,array<string>>").alias("fields")
    none_c = F.lit(None).cast(ctype).alias("correlators")
    none_p = F.lit(None).cast("double").alias("pop_rank")
    parts = []
    if fields is not None:
        parts.append(fields.select("item", "fields", none_c, none_p))
    if cm is not None:
        parts.append(cm.select("item", none_f, "correlators", none_p))
    if pop is not None and model != "collabFiltering":
        parts.append(pop.select("item", none_f, none_c, F.col("score").cast("double").alias("pop_rank")))
    if not parts:
        raise ValueError("item_docs needs at least one input")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("item").agg(
        F.first("fields", ignorenulls=True).alias("fields"),
        F.first("correlators", ignorenulls=True).alias("correlators"),
        F.max("pop_rank").alias("pop_rank"))


def docs_refresh_pop(docs: DataFrame, pop: DataFrame) -> DataFrame:
    """Replace the popularity of existing documents; new ranked items get a
    popularity-only document; documents no longer ranked get null."""
    d = docs.drop("pop_rank")
    p = pop.select("item", F.col("score").cast("double").alias("pop_rank"))
    return d.join(p, "item", "full")


def item_pop_full(fields: DataFrame, pop: DataFrame) -> DataFrame:
    """Item fields FULL OUTER popularity, keyed by item."""
    return fields.join(pop.select("item", F.col("score").alias("pop_rank")), "item", "full")
