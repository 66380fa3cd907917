"""Entities folded from the event log: properties, constraints, typed rows.

EVENT = (event_id, event, entity_type, entity_id, target_type, target_id,
properties json text, ts).  A ``$set`` event sets the properties it carries;
the newest event wins per (entity, property), ties broken by event id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROPS_T = "map<string,string>"
EVENTS_PER_TASK = 100_000       # ``$set`` events exploded by one task


def props_map(col="properties"):
    return F.from_json(F.col(col), PROPS_T)


def property_rows(events: DataFrame, entity_type: str) -> DataFrame:
    """Long form (entity_id, key, value, ts, event_id) of every ``$set`` value."""
    s = events.where((F.col("event") == "$set") & (F.col("entity_type") == entity_type))
    return s.select("entity_id", "ts", "event_id", F.explode(props_map()).alias("key", "value"))


def _dealt(events: DataFrame, entity_type: str) -> DataFrame:
    """The ``$set`` events of the type in equal shares, also of one entity's."""
    s = events.where((F.col("event") == "$set") & (F.col("entity_type") == entity_type))
    s = s.select("event", "entity_type", "entity_id", "properties", "ts", "event_id")
    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return s.repartition(max(parts, -(-s.count() // EVENTS_PER_TASK)), "entity_id", "event_id", "ts")


def aggregate_properties(events: DataFrame, entity_type: str) -> DataFrame:
    """ENTITY_PROPS (entity_id, props map, first_updated, last_updated).
    One shuffle on (entity, key) with partial max_by, then one on entity.

    The partial step sorts a task's exploded rows, and a few megabytes of a
    well-packed file explode to a task's whole memory: the events are dealt out
    first, ``EVENTS_PER_TASK`` at most to a task, however they are stored."""
    rows = property_rows(_dealt(events, entity_type), entity_type)
    latest = rows.groupBy("entity_id", "key").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value"),
        F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    return latest.groupBy("entity_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"),
        F.min("t0").alias("first_updated"), F.max("t1").alias("last_updated"))


def latest_constraint(events: DataFrame, name: str, key: str = "items") -> DataFrame:
    """Newest ``$set`` of a constraint entity (entity_type 'constraint',
    entity_id ``name``), its ``key`` array exploded: (item) rows."""
    c = events.where((F.col("event") == "$set") & (F.col("entity_type") == "constraint")
                     & (F.col("entity_id") == name))
    newest = c.groupBy("entity_id").agg(F.max_by("properties", F.struct("ts", "event_id")).alias("p"))
    return newest.select(F.explode(F.from_json(F.get_json_object("p", f"$.{key}"), "array<string>")).alias("item"))


def latest_weights(events: DataFrame, name: str = "weightedItems") -> DataFrame:
    """(item, weight) from the newest ``$set`` of a weights constraint whose
    property is ``weights: [{items: [...], weight: w}, ...]``; an item named
    in several groups keeps the last group's weight."""
    c = events.where((F.col("event") == "$set") & (F.col("entity_type") == "constraint")
                     & (F.col("entity_id") == name))
    newest = c.groupBy("entity_id").agg(F.max_by("properties", F.struct("ts", "event_id")).alias("p"))
    groups = newest.select(F.posexplode(F.from_json(F.get_json_object("p", "$.weights"),
                                                    "array<struct<items:array<string>,weight:double>>")).alias("g", "w"))
    rows = groups.select("g", F.explode("w.items").alias("item"), F.col("w.weight").alias("weight"))
    return rows.groupBy("item").agg(F.max_by("weight", "g").alias("weight"))


def item_weights(items: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(item, weight) for every item; items without a weight get 1.0."""
    if weights is None:
        return items.select("item", F.lit(1.0).alias("weight"))
    w = weights.select("item", F.col("weight").cast("double").alias("w"))
    return items.select("item").join(w, "item", "left").select(
        "item", F.coalesce("w", F.lit(1.0)).alias("weight"))


def typed_users(props: DataFrame, strict: bool = True) -> DataFrame:
    """Properties to typed user columns; strict mode raises on a missing one."""
    p = F.col("props")

    def need(k):
        v = p[k]
        return F.when(v.isNull(), F.raise_error(F.lit(f"user property {k} missing"))).otherwise(v) if strict else v

    return props.select(F.col("entity_id").alias("user"),
                        need("occupation").alias("occupation"),
                        need("c_nationkey").cast("int").alias("nation"),
                        need("c_acctbal").cast("double").alias("acctbal"))


def typed_items(props: DataFrame, genre_names) -> DataFrame:
    """Properties to (item, title, genres): genres = names whose flag is '1';
    a missing flag counts as '0'."""
    p = F.col("props")
    flags = [F.when(F.coalesce(p[g], F.lit("0")) == "1", F.lit(g)) for g in genre_names]
    genres = F.filter(F.array(*flags), lambda x: x.isNotNull())
    return props.select(F.col("entity_id").alias("item"), p["title"].alias("title"), genres.alias("genres"))


def normalize_props(props_rows: DataFrame, date_names) -> DataFrame:
    """Keep typed values only: JSON string arrays, dates (declared names only),
    ints and doubles; other strings are dropped.  Input is the long form of
    ``property_rows``; output (entity_id, key, kind, value)."""
    v = F.col("value")
    is_arr = v.startswith("[")
    as_int = F.when(v.rlike("^-?[0-9]{1,18}$"), v.cast("bigint"))
    as_dbl = v.try_cast("double")
    as_date = F.try_to_timestamp(v)
    kind = (F.when(is_arr, "array")
            .when(F.col("key").isin(list(date_names)) & as_date.isNotNull(), "date")
            .when(as_int.isNotNull(), "int")
            .when(as_dbl.isNotNull(), "double"))
    val = (F.when(kind == "array", F.array_join(F.from_json(v, "array<string>"), ","))
           .when(kind == "date", F.date_format(as_date, "yyyy-MM-dd HH:mm:ss"))
           .when(kind == "int", as_int.cast("string"))
           .when(kind == "double", as_dbl.cast("string")))
    return props_rows.select("entity_id", "key", kind.alias("kind"), val.alias("value")).where(F.col("kind").isNotNull())


def prop_keys(props: DataFrame) -> DataFrame:
    """Distinct property names over all entities."""
    return props.select(F.explode(F.map_keys("props")).alias("key")).distinct()
