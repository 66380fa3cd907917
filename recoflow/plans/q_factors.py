"""Vector scores, ALS and the cold-start cascade, on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from recoflow.functions.scalar import vec_cosine, vec_dot
from recoflow.operators import factors as FA
from recoflow.operators import interactions as I
from recoflow.plans.registry import register
from recoflow.plans.sqlparts import ctes
from recoflow.session import cut_lineage
from recoflow.sources import tables as T
from recoflow.sources.tables import PRIMARY

N = 10
_FV = ("inter", "user_factors", "item_factors")

_DOT = "list_dot_product(CAST(u.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[]))"
_NU = "sqrt(list_dot_product(CAST(u.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[])))"
_NI = "sqrt(list_dot_product(CAST(i.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])))"
_COS = f"(CASE WHEN {_NU} * {_NI} = 0 THEN 0.0 ELSE {_DOT} / ({_NU} * {_NI}) END)"


def _round(df):
    return df.withColumn("score", F.round("score", 6))


def _seen(spark, sf):
    """(user, item) rows the user already bought: excluded from the results."""
    return T.inter(spark, sf).where(F.col("action") == PRIMARY).select("user", "item")


def _recent(spark, sf):
    return I.recent_n_per_user(T.inter(spark, sf), 10, actions=["view"])


_SEEN_SQL = f"seen AS (SELECT DISTINCT user, item FROM inter WHERE action = '{PRIMARY}')"
_RECENT_SQL = """recent AS (SELECT DISTINCT user, item FROM (SELECT *, row_number() OVER (PARTITION BY user
  ORDER BY ts DESC, event_id DESC) AS r FROM inter WHERE action = 'view') WHERE r <= 10)"""


@register("vec_dot", ctes(_FV) + f"""
SELECT DISTINCT x.user, x.item, round({_DOT}, 6) AS dot FROM inter x JOIN user_factors u ON u.user = x.user
JOIN item_factors i ON i.item = x.item""")
def q_vec_dot(spark, sf):
    x = T.inter(spark, sf).select("user", "item").distinct()
    u = T.user_factors(spark, sf).select("user", F.col("embedding").alias("eu"))
    i = T.item_factors(spark, sf).select("item", F.col("embedding").alias("ei"))
    return x.join(u, "user").join(i, "item").select("user", "item", F.round(vec_dot("eu", "ei"), 6).alias("dot"))


@register("vec_cosine", ctes(_FV) + f"""
SELECT DISTINCT x.user, x.item, round({_COS}, 6) AS cosine FROM inter x JOIN user_factors u ON u.user = x.user
JOIN item_factors i ON i.item = x.item""")
def q_vec_cosine(spark, sf):
    x = T.inter(spark, sf).select("user", "item").distinct()
    u = T.user_factors(spark, sf).select("user", F.col("embedding").alias("eu"))
    i = T.item_factors(spark, sf).select("item", F.col("embedding").alias("ei"))
    return x.join(u, "user").join(i, "item").select("user", "item", F.round(vec_cosine("eu", "ei"), 6).alias("cosine"))


@register("user_item_cross", ctes(_FV) + f"""
SELECT user, CAST(rank AS INTEGER) AS rank, item, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank FROM (
    SELECT u.user, i.item, {_DOT} AS score FROM user_factors u CROSS JOIN item_factors i) WHERE score > 0)
WHERE rank <= {N}""")
def q_user_item_cross(spark, sf):
    """Every factor user against every item, scored without materializing pairs."""
    u = T.user_factors(spark, sf).select("user")
    it = T.item_factors(spark, sf).select("item", "embedding")
    return _round(FA.als_known_user(u, T.user_factors(spark, sf), it, None, N))


_KNOWN_SQL = ctes(_FV) + f"""
SELECT user, CAST(rank AS INTEGER) AS rank, item, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank FROM (
    SELECT u.user, i.item, {_DOT} * i.weight AS score FROM user_factors u CROSS JOIN item_factors i
    WHERE NOT EXISTS (SELECT 1 FROM inter x WHERE x.user = u.user AND x.item = i.item AND x.action = '{PRIMARY}'))
  WHERE score > 0) WHERE rank <= {N}"""


@register("als_known_user", _KNOWN_SQL)
def q_als_known_user(spark, sf):
    q = T.user_factors(spark, sf).select("user")
    return _round(FA.als_known_user(q, T.user_factors(spark, sf), T.item_factors(spark, sf), None, N,
                                    exclusions=_seen(spark, sf)))


_SIMILAR_SQL = ctes(_FV, _RECENT_SQL) + f"""
SELECT user, CAST(rank AS INTEGER) AS rank, item, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank FROM (
    SELECT r.user, i.item, sum({_COS.replace('u.embedding', 'ri.embedding')}) * max(i.weight) AS score
    FROM recent r JOIN item_factors ri ON ri.item = r.item CROSS JOIN item_factors i
    WHERE r.user NOT IN (SELECT user FROM user_factors)
      AND NOT EXISTS (SELECT 1 FROM inter x WHERE x.user = r.user AND x.item = i.item AND x.action = '{PRIMARY}')
    GROUP BY r.user, i.item) WHERE score > 0) WHERE rank <= {N}"""


@register("als_similar", _SIMILAR_SQL)
def q_als_similar(spark, sf):
    users = T.inter(spark, sf).select("user").distinct().join(T.user_factors(spark, sf).select("user"), "user",
                                                             "left_anti")
    return _round(FA.als_similar(users, _recent(spark, sf), T.item_factors(spark, sf), None, N,
                                 exclusions=_seen(spark, sf)))


_DEFAULT_SQL = ctes(_FV) + f"""
SELECT user, CAST(rank AS INTEGER) AS rank, item, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank FROM (
    SELECT q.user, i.item, coalesce(c.n, 0) * i.weight AS score
    FROM (SELECT DISTINCT user FROM inter) q CROSS JOIN item_factors i
    LEFT JOIN (SELECT item, count(*) AS n FROM inter WHERE action = '{PRIMARY}' GROUP BY item) c ON c.item = i.item
    WHERE NOT EXISTS (SELECT 1 FROM inter x WHERE x.user = q.user AND x.item = i.item AND x.action = '{PRIMARY}')))
WHERE rank <= {N}"""


@register("als_default", _DEFAULT_SQL)
def q_als_default(spark, sf):
    q = T.inter(spark, sf).select("user").distinct()
    it = T.item_factors(spark, sf)
    counts = I.item_buy_count(T.inter(spark, sf), PRIMARY)
    return _round(FA.als_default(q, counts, it, it.select("item", "weight"), N, exclusions=_seen(spark, sf)))


@register("cascade_recommend", ctes(_FV, _RECENT_SQL) + f""",
known AS (SELECT u.user, i.item, {_DOT} * i.weight AS score, 'known' AS path FROM user_factors u
  JOIN (SELECT DISTINCT user FROM inter) q ON q.user = u.user CROSS JOIN item_factors i
  WHERE NOT EXISTS (SELECT 1 FROM inter x WHERE x.user = u.user AND x.item = i.item AND x.action = '{PRIMARY}')),
warm_users AS (SELECT DISTINCT r.user FROM recent r JOIN item_factors f ON f.item = r.item
  WHERE r.user NOT IN (SELECT user FROM user_factors)),
sim AS (SELECT r.user, i.item, sum({_COS.replace('u.embedding', 'ri.embedding')}) * max(i.weight) AS score,
  'similar' AS path FROM recent r JOIN warm_users w ON w.user = r.user JOIN item_factors ri ON ri.item = r.item
  CROSS JOIN item_factors i
  WHERE NOT EXISTS (SELECT 1 FROM inter x WHERE x.user = r.user AND x.item = i.item AND x.action = '{PRIMARY}')
  GROUP BY r.user, i.item),
cold AS (SELECT q.user, i.item, coalesce(c.n, 0) * i.weight AS score, 'default' AS path
  FROM (SELECT DISTINCT user FROM inter) q CROSS JOIN item_factors i
  LEFT JOIN (SELECT item, count(*) AS n FROM inter WHERE action = '{PRIMARY}' GROUP BY item) c ON c.item = i.item
  WHERE q.user NOT IN (SELECT user FROM user_factors) AND q.user NOT IN (SELECT user FROM warm_users)
  AND NOT EXISTS (SELECT 1 FROM inter x WHERE x.user = q.user AND x.item = i.item AND x.action = '{PRIMARY}')),
s AS (SELECT * FROM known WHERE score > 0 UNION ALL SELECT * FROM sim WHERE score > 0 UNION ALL SELECT * FROM cold)
SELECT user, CAST(rank AS INTEGER) AS rank, item, round(score, 6) AS score, path FROM (
  SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank FROM s) WHERE rank <= {N}""")
def q_cascade_recommend(spark, sf):
    q = T.inter(spark, sf).select("user").distinct()
    it = T.item_factors(spark, sf)
    counts = I.item_buy_count(T.inter(spark, sf), PRIMARY)
    return _round(FA.cascade_recommend(q, T.user_factors(spark, sf), it, _recent(spark, sf), counts,
                                       it.select("item", "weight"), N, exclusions=_seen(spark, sf)))


def _filtered_queries(spark, sf):
    """A whitelist for a third of the users, a genre for another third."""
    u = F.col("user")
    return T.inter(spark, sf).select("user").distinct().select(
        "user", F.when(u % 3 == 0, F.sequence(u % 20, u % 20 + 30)).alias("whitelist"),
        F.when(u % 3 == 1, F.array(F.concat(F.lit("g"), (u % 2).cast("string")))).alias("genres"))


def _genre_items(spark, sf):
    it = T.item_factors(spark, sf)
    return it.withColumn("genres", F.array(F.concat(F.lit("g"), (F.col("item") % 2).cast("string")), F.lit("all")))


_OK = """((q.user % 3 <> 0 OR (i.item >= q.user % 20 AND i.item <= q.user % 20 + 30))
  AND (q.user % 3 <> 1 OR i.item % 2 = q.user % 2)
  AND NOT EXISTS (SELECT 1 FROM inter x WHERE x.user = q.user AND x.item = i.item AND x.action = 'purchase'))"""


@register("cascade_filtered", ctes(_FV, _RECENT_SQL) + f""",
q AS (SELECT DISTINCT user FROM inter),
known AS (SELECT q.user, i.item, {_DOT} * i.weight AS score, 'known' AS path FROM q JOIN user_factors u ON u.user = q.user
  CROSS JOIN item_factors i WHERE {_OK}),
warm_users AS (SELECT DISTINCT r.user FROM recent r JOIN item_factors f ON f.item = r.item
  WHERE r.user NOT IN (SELECT user FROM user_factors)),
sim AS (SELECT q.user, i.item, sum({_COS.replace('u.embedding', 'ri.embedding')}) * max(i.weight) AS score,
  'similar' AS path FROM recent q JOIN warm_users w ON w.user = q.user JOIN item_factors ri ON ri.item = q.item
  CROSS JOIN item_factors i WHERE {_OK} GROUP BY q.user, i.item),
cold AS (SELECT q.user, i.item, coalesce(c.n, 0) * i.weight AS score, 'default' AS path FROM q CROSS JOIN item_factors i
  LEFT JOIN (SELECT item, count(*) AS n FROM inter WHERE action = '{PRIMARY}' GROUP BY item) c ON c.item = i.item
  WHERE q.user NOT IN (SELECT user FROM user_factors) AND q.user NOT IN (SELECT user FROM warm_users) AND {_OK}),
s AS (SELECT * FROM known WHERE score > 0 UNION ALL SELECT * FROM sim WHERE score > 0 UNION ALL SELECT * FROM cold)
SELECT user, CAST(rank AS INTEGER) AS rank, item, round(score, 6) AS score, path FROM (
  SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank FROM s) WHERE rank <= {N}""")
def q_cascade_filtered(spark, sf):
    """The cascade with whitelists and genres on all three paths."""
    it = _genre_items(spark, sf)
    counts = I.item_buy_count(T.inter(spark, sf), PRIMARY)
    return _round(FA.cascade_recommend(_filtered_queries(spark, sf), T.user_factors(spark, sf), it, _recent(spark, sf),
                                       counts, it.select("item", "weight"), N, exclusions=_seen(spark, sf)))


@register("als_default_filtered", ctes(_FV) + f"""
SELECT user, CAST(rank AS INTEGER) AS rank, item, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank FROM (
    SELECT q.user, i.item, coalesce(c.n, 0) * i.weight AS score
    FROM (SELECT DISTINCT user FROM inter) q CROSS JOIN item_factors i
    LEFT JOIN (SELECT item, count(*) AS n FROM inter WHERE action = '{PRIMARY}' GROUP BY item) c ON c.item = i.item
    WHERE {_OK})) WHERE rank <= {N}""")
def q_als_default_filtered(spark, sf):
    it = _genre_items(spark, sf)
    counts = I.item_buy_count(T.inter(spark, sf), PRIMARY)
    return _round(FA.als_default(_filtered_queries(spark, sf), counts, it, it.select("item", "weight"), N,
                                 exclusions=_seen(spark, sf)))


@register("positive_scores", ctes(_FV) + f"""
SELECT DISTINCT x.user, x.item, round({_DOT}, 6) AS score FROM inter x JOIN user_factors u ON u.user = x.user
JOIN item_factors i ON i.item = x.item WHERE {_DOT} > 0""")
def q_positive_scores(spark, sf):
    x = T.inter(spark, sf).select("user", "item").distinct()
    u = T.user_factors(spark, sf).select("user", F.col("embedding").alias("eu"))
    i = T.item_factors(spark, sf).select("item", F.col("embedding").alias("ei"))
    s = x.join(u, "user").join(i, "item").select("user", "item", vec_dot("eu", "ei").alias("score"))
    return s.where(F.col("score") > 0).withColumn("score", F.round("score", 6))


@register("item_factors_left", ctes(("items", "item_factors")) + """
SELECT i.item, i.title, CAST(f.category AS DOUBLE) AS category, f.weight FROM items i LEFT JOIN item_factors f ON f.item = i.item + 100""")
def q_item_factors_left(spark, sf):
    """Items LEFT OUTER factors (ids shifted so part of the items has no factor row)."""
    f = T.item_factors(spark, sf).select((F.col("item") - 100).alias("item"),
                                        F.col("category").cast("double").alias("category"), "weight")
    return T.items(spark, sf).select("item", "title").join(f, "item", "left")


# --------------------------------------------------------------------------- ALS (row facts and a stated error bound)
def _als_ratings(spark, sf):
    r = FA.latest_ratings(T.rated(spark, sf).select("user", "item", "rating", "ts", "event_id"))
    return r.select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item"), "rating")


@register("als_fit", ctes(("inter", "rated")) + """
SELECT CAST(user AS INTEGER) AS user, CAST(item AS INTEGER) AS item,
  CAST(arg_max(rating, (ts, event_id)) AS DOUBLE) AS rating, true AS bound_ok FROM rated GROUP BY user, item""")
def q_als_fit(spark, sf):
    """A prediction per rated pair; on its training pairs the model's RMSE is
    at most nine tenths of that of the mean rating."""
    r = _als_ratings(spark, sf)
    out = cut_lineage(FA.als_fit(r, rank=10, iterations=20, reg=0.01, seed=3).transform(r))
    rmse = F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2)))
    ok = out.select(rmse < 0.9 * F.stddev_pop("rating")).scalar()
    return out.select("user", "item", "rating", ok.alias("bound_ok"))


@register("param_grid", """
SELECT r AS rank, m AS max_iter, true AS rmse_ok FROM (VALUES (10), (20)) a(r) CROSS JOIN (VALUES (10), (15)) b(m)""")
def q_param_grid(spark, sf):
    """One validation RMSE per grid point (four, whatever the data), on
    ratings made of a user and an item part for the rated pairs: each point must come
    under the error of the mean rating."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.recommendation import ALS
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
    als = ALS(userCol="user", itemCol="item", ratingCol="rating", coldStartStrategy="drop", seed=3, regParam=0.1)
    grid = ParamGridBuilder().addGrid(als.rank, [10, 20]).addGrid(als.maxIter, [10, 15]).build()
    tvs = TrainValidationSplit(estimator=als, estimatorParamMaps=grid, trainRatio=0.8, seed=3, parallelism=2,
                               evaluator=RegressionEvaluator(labelCol="rating", metricName="rmse"))
    rated = _als_ratings(spark, sf).withColumn("rating", (1 + F.col("user") % 3 + F.col("item") % 3).cast("double"))
    spread = rated.agg(F.stddev_pop("rating")).first()[0]
    m = tvs.fit(rated)
    rows = [(int(p[als.rank]), int(p[als.maxIter]), float(v) < 0.95 * spread) for p, v in zip(grid, m.validationMetrics)]
    return spark.createDataFrame(rows, "rank int, max_iter int, rmse_ok boolean")
