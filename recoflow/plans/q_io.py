"""Readers and writers as round trips: a table derived from the driver data is
written in the reference's file format (under the shared checkpoint folder),
then read back with the reader under test."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recoflow.operators.popularity import pop_dispatch
from recoflow.plans.q_core import ITEM_DOCS_SQL, all_docs, docs_text
from recoflow.plans.registry import register
from recoflow.plans.sqlparts import ctes, pop_cte
from recoflow.session import cut_lineage, table_folder
from recoflow.sources import docstore as DS
from recoflow.sources import eventdays as ED
from recoflow.sources import io as IO
from recoflow.sources import tables as T
from recoflow.sources.tables import LONG_DURATION, POP_END, PRIMARY


def _scratch(spark, name):
    return f"{table_folder(spark)}/io/{name}-{uuid.uuid4().hex[:8]}"


def _users_src(spark, sf):
    u = T.users(spark, sf)
    return u.select(F.col("user").cast("string").alias("id"), (F.col("c_nationkey") + 18).alias("age"),
                    F.when(F.col("user") % 2 == 0, "F").otherwise("M").alias("gender"), "occupation",
                    F.lpad(F.col("user").cast("string"), 5, "0").alias("zipcode"))


@register("read_users_pipe", ctes(("users",)) + """
SELECT CAST(user AS VARCHAR) AS id, c_nationkey + 18 AS age, CASE WHEN user % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
  occupation, lpad(CAST(user AS VARCHAR), 5, '0') AS zipcode FROM users""")
def q_read_users_pipe(spark, sf):
    p = _scratch(spark, "users")
    _users_src(spark, sf).write.csv(p, sep="|")
    return IO.read_users_pipe(spark, p)


@register("read_items_pipe", ctes(("items",)) + f"""
SELECT CAST(item AS VARCHAR) AS id, title, ['{"', '".join(IO.GENRES)}'][p_size % 18 + 1] AS genres FROM items""")
def q_read_items_pipe(spark, sf):
    it = T.items(spark, sf)
    flags = [F.when(F.col("p_size") % 18 == i, "1").otherwise("0").alias(f"g{i}") for i in range(18)]
    src = it.select(F.col("item").cast("string").alias("id"), "title", F.lit("01-Jan-1995").alias("release"),
                    F.lit("").alias("video"), F.lit("http://example.invalid").alias("url"), F.lit("0").alias("unknown"),
                    *flags)
    p = _scratch(spark, "items")
    src.write.csv(p, sep="|", encoding="ISO-8859-1")
    r = IO.read_items_pipe(spark, p)
    return r.select("id", "title", F.array_join("genres", ",").alias("genres"))


@register("read_ratings_tsv", ctes(("inter", "rated")) + """
SELECT CAST(user AS VARCHAR) AS user, CAST(item AS VARCHAR) AS item, CAST(rating AS DOUBLE) AS rating,
  make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS ts FROM rated""")
def q_read_ratings_tsv(spark, sf):
    r = T.rated(spark, sf).select("user", "item", "rating", F.unix_seconds(F.col("ts").cast("timestamp")).alias("e"))
    p = _scratch(spark, "ratings_tsv")
    r.write.csv(p, sep="\t")
    return IO.read_ratings_tsv(spark, p)


@register("read_ratings_colons", ctes(("inter", "rated")) + """
SELECT CAST(user AS INTEGER) AS user, CAST(item AS INTEGER) AS item FROM rated""")
def q_read_ratings_colons(spark, sf):
    r = T.rated(spark, sf).select(F.concat_ws("::", "user", "item", "rating",
                                              F.unix_seconds(F.col("ts").cast("timestamp"))).alias("value"))
    p = _scratch(spark, "ratings_colons")
    r.write.text(p)
    return IO.read_ratings_colons(spark, p)


CTR_SCHEMA = ("id long, target int, f_seg_cat string, f_brand_cat string, f_type_cat string, f_value double, "
              "f_price double, f_size int")


@register("read_ctr_csv", ctes(("ctr",)) + "SELECT * FROM ctr")
def q_read_ctr_csv(spark, sf):
    p = _scratch(spark, "ctr")
    T.ctr(spark, sf).write.csv(p, header=True)
    return IO.read_ctr_csv(spark, p, CTR_SCHEMA)


@register("read_reviews_json", ctes(("inter",)) + """
SELECT CAST(user AS VARCHAR) AS reviewerID, CAST(item AS VARCHAR) AS asin, epoch_us(ts) // 1000000 AS unixReviewTime,
  CAST(NULL AS VARCHAR) AS _corrupt_record FROM inter WHERE action = 'view'""")
def q_read_reviews_json(spark, sf):
    v = T.inter(spark, sf).where("action = 'view'")
    lit = F.concat(F.lit("{'reviewerID': '"), F.col("user").cast("string"), F.lit("', 'asin': '"),
                   F.col("item").cast("string"), F.lit("', 'unixReviewTime': "),
                   F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit("}"))
    p = _scratch(spark, "reviews")
    v.select(lit.alias("value")).write.text(p)
    return IO.read_reviews_json(spark, p, "reviewerID string, asin string, unixReviewTime long")


@register("read_libsvm", ctes(("ctr",)) + """
SELECT CAST(target AS DOUBLE) AS label, round(f_value, 6) AS x1, round(f_price, 6) AS x2,
  CAST(f_size AS DOUBLE) AS x3 FROM ctr""")
def q_read_libsvm(spark, sf):
    c = T.ctr(spark, sf)
    line = F.concat_ws(" ", F.col("target").cast("string"),
                       *[F.concat(F.lit(f"{i + 1}:"), F.col(n).cast("string")) for i, n in
                         enumerate(["f_value", "f_price", "f_size"])])
    p = _scratch(spark, "libsvm")
    c.select(line.alias("value")).write.text(p)
    from pyspark.ml.functions import vector_to_array
    r = IO.read_libsvm(spark, p, 3)
    a = vector_to_array("features")
    return r.select("label", F.round(a[0], 6).alias("x1"), F.round(a[1], 6).alias("x2"), a[2].alias("x3"))


@register("write_item_docs", ITEM_DOCS_SQL)
def q_write_item_docs(spark, sf):
    """Two versions of the documents published in turn (the first with an older
    popularity); readers get the newest complete one."""
    new = cut_lineage(all_docs(spark, sf))
    p = _scratch(spark, "docs")
    IO.write_item_docs(new.withColumn("pop_rank", F.lit(0.0)), p, 1)
    IO.write_item_docs(new, p, 2)
    return docs_text(IO.read_item_docs(spark, p))


@register("read_item_docs", ITEM_DOCS_SQL)
def q_read_item_docs(spark, sf):
    p = _scratch(spark, "docs_read")
    IO.write_item_docs(all_docs(spark, sf), p, 7)
    return docs_text(IO.read_item_docs(spark, p))


@register("lookup_item_doc", ITEM_DOCS_SQL + " WHERE it.item IS NOT NULL")
def q_lookup_item_doc(spark, sf):
    """Published documents by id: every item of the catalogue is asked for."""
    p = _scratch(spark, "docs_lookup")
    IO.write_item_docs(all_docs(spark, sf), p, 1)
    ids = T.items(spark, sf).select("item")
    return docs_text(IO.lookup_item_doc(IO.read_item_docs(spark, p), ids))


@register("doc_store_lookup", ITEM_DOCS_SQL + " WHERE it.item IS NOT NULL")
def q_doc_store_lookup(spark, sf):
    """Documents by key: a first version without popularity, then one that
    holds the folds of the items whose popularity came; the whole catalogue is
    looked up in it."""
    p = _scratch(spark, "docstore")
    docs = cut_lineage(all_docs(spark, sf))
    first = DS.publish(spark, p, docs.withColumn("pop_rank", F.lit(None).cast("double")))
    second = DS.publish(spark, p, docs.where("pop_rank IS NOT NULL"), before=first)
    return docs_text(DS.lookup(spark, p, T.items(spark, sf).select("item"), second))


PERIODS = [("a", "2024-01-03 06:00:00", "2024-01-05 18:30:00"), ("b", "2024-01-05 00:00:00", "2024-01-06 00:00:00"),
           ("c", "2024-01-20 12:00:00", "2024-01-20 12:30:00")]


@register("event_days_scan", ctes(("inter",)) + """
SELECT p.period, i.event_id, i.user, i.item, i.action FROM inter i JOIN (VALUES """ + ", ".join(
    f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in PERIODS) + """) p(period, s, e)
ON i.ts >= p.s AND i.ts < p.e WHERE i.action IN ('purchase', 'view')""")
def q_event_days_scan(spark, sf):
    """Events of three periods from the log written by day and action."""
    p = _scratch(spark, "event_days")
    ED.write_event_days(T.inter(spark, sf), p)
    periods = spark.createDataFrame(PERIODS, "period string, start string, end string").select(
        "period", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")])
    return ED.events_in_periods(spark, p, periods, ["purchase", "view"]).select("period", "event_id", "user", "item", "action")


@register("write_scores_csv", ctes(("scored",)) + """
SELECT CAST(id AS VARCHAR) AS id, printf('%.5f', score) AS target FROM scored""")
def q_write_scores_csv(spark, sf):
    s = T.scored(spark, sf).select("id", F.col("score").alias("target"))
    p = _scratch(spark, "scores")
    IO.write_scores_csv(s, p, "id", "target")
    return spark.read.csv(p, header=True, schema="id string, target string")


@register("save_model", ctes(("ctr",)) + """,
ix AS (SELECT f_brand_cat, CAST(row_number() OVER (ORDER BY count(*) DESC, f_brand_cat) - 1 AS DOUBLE) AS brand_ix
  FROM ctr GROUP BY f_brand_cat)
SELECT c.id, ix.brand_ix, true AS same_trees FROM ctr c JOIN ix ON ix.f_brand_cat = c.f_brand_cat""")
def q_save_model(spark, sf):
    """A fitted pipeline (indexer and regression tree) saved, loaded and
    applied: the index is by frequency, then text, and the loaded tree predicts
    what the saved one did."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor
    c = T.ctr(spark, sf)
    stages = [StringIndexer(inputCol="f_brand_cat", outputCol="brand_ix", stringOrderType="frequencyDesc"),
              VectorAssembler(inputCols=["brand_ix", "f_value", "f_price"], outputCol="x"),
              DecisionTreeRegressor(featuresCol="x", labelCol="target", maxDepth=3, seed=1)]
    m = Pipeline(stages=stages).fit(c)
    p = _scratch(spark, "model")
    IO.save_model(m, p)
    again = PipelineModel.load(p).transform(c).select("id", "brand_ix", F.col("prediction").alias("p2"))
    return m.transform(c).select("id", "prediction").join(again, "id").select(
        "id", "brand_ix", (F.col("prediction") == F.col("p2")).alias("same_trees"))


@register("pop_dispatch", ctes(("inter",), pop_cte("pop", "trending", (PRIMARY,), POP_END, LONG_DURATION)) +
          "SELECT item, score FROM pop")
def q_pop_dispatch(spark, sf):
    return pop_dispatch(T.inter(spark, sf), "trending", [PRIMARY], POP_END, LONG_DURATION)
