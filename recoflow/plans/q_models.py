"""pyspark.ml models (row facts and a stated error bound) and bandit statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from recoflow.operators import bandit as BA
from recoflow.operators import ctr as C
from recoflow.plans.registry import register
from recoflow.plans.sqlparts import ctes
from recoflow.session import cut_lineage
from recoflow.sources import tables as T

NUM = ["f_value", "f_price", "f_size"]


def _assembled(spark, sf):
    """Three numeric features and a label that they tell: whether the size is over 20.
    Written once: every pass of a fit would join the tables again."""
    from pyspark.ml.feature import VectorAssembler
    d = T.ctr(spark, sf).withColumn("fold", F.pmod(F.col("id") * 7919, F.lit(5)).cast("int"))
    d = d.withColumn("label", (F.col("f_size") > 20).cast("double"))
    d = VectorAssembler(inputCols=NUM, outputCol="features").transform(d)
    return cut_lineage(d.select("id", "fold", "label", "features"))


_LABEL = "CAST(CASE WHEN f_size > 20 THEN 1 ELSE 0 END AS DOUBLE) AS label"
_TEST = ctes(("ctr",)) + f"SELECT id, {_LABEL}, true AS bound_ok FROM ctr WHERE ((id * 7919) % 5 + 5) % 5 = 4"


def _bounded(out, err, share, keys=("id",), label="label"):
    """(*keys, label, bound_ok): one row per scored row; bound_ok says that the
    mean of ``err`` over them is at most ``share`` of the label's variance,
    the squared error of the best constant."""
    out = cut_lineage(out.select(*keys, label, err.alias("e")))
    ok = out.select(F.avg("e") <= share * F.var_pop(label)).scalar()
    return out.select(*keys, label, ok.alias("bound_ok"))


_SQ = lambda c, label="label": F.pow(F.col(label) - c, 2)


@register("fm_fit", ctes(("inter", "rated")) + "SELECT event_id, CAST(rating AS DOUBLE) AS rating, true AS bound_ok FROM rated")
def q_fm_fit(spark, sf):
    """Ratings by one-hot user and item; on the rows it was fitted on the model
    does better than their mean."""
    from recoflow.operators.features import one_hot_pairs
    d = T.rated(spark, sf).withColumn("rating", F.col("rating").cast("double")).withColumn("label", F.col("rating"))
    d, _ = one_hot_pairs(d, d, ["user", "item"])
    d = cut_lineage(d.select("event_id", "rating", "label", "features"))
    m = C.fm_fit(d, "regression", factor_size=8, seed=1, max_iter=60)
    return _bounded(m.transform(d), _SQ(F.col("prediction"), "rating"), 0.99, ["event_id"], "rating")


@register("gbdt_leaves", ctes(("ctr",)) + "SELECT id, CAST(5 AS INTEGER) AS n_trees, true AS leaves_ok FROM ctr")
def q_gbdt_leaves(spark, sf):
    """One leaf per tree; depth 3 has leaf numbers 0 to 7."""
    from pyspark.ml.functions import vector_to_array
    _, out = C.gbdt_leaves(_assembled(spark, sf), "features", "label", trees=5, depth=3, seed=1)
    leaves = vector_to_array("leaves")
    return out.select("id", F.size(leaves).alias("n_trees"),
                      F.forall(leaves, lambda x: (x >= 0) & (x < 8) & (x == F.floor(x))).alias("leaves_ok"))


@register("gbdt_lr", _TEST)
def q_gbdt_lr(spark, sf):
    from pyspark.ml.functions import vector_to_array
    d = _assembled(spark, sf)
    out = C.gbdt_lr(d.where("fold != 4"), d.where("fold = 4"), "features", "label", trees=5, depth=3, seed=1)
    return _bounded(out, _SQ(vector_to_array("probability")[1]), 0.5)


@register("rf_regression", _TEST)
def q_rf_regression(spark, sf):
    d = _assembled(spark, sf)
    out = C.rf_regression(d.where("fold != 4"), d.where("fold = 4"), "features", "label")
    return _bounded(out, _SQ(F.col("prediction")), 0.5)


@register("fold_average", ctes(("ctr",)) + f"SELECT id, {_LABEL}, true AS bound_ok FROM ctr")
def q_fold_average(spark, sf):
    """Out-of-fold and mean predictions for every row."""
    from pyspark.ml.classification import LogisticRegression
    d = _assembled(spark, sf).withColumn("fold", F.pmod(F.col("id") * 7919, F.lit(3)).cast("int"))
    out = C.fold_average(d, 3, lambda: LogisticRegression(featuresCol="features", labelCol="label", maxIter=20), id_col="id")
    out = out.join(d.select("id", "label"), "id")
    return _bounded(out, F.greatest(_SQ(F.col("oof")), _SQ(F.col("mean_pred"))), 0.5)


# --------------------------------------------------------------------------- bandits
@register("ucb_arms", ctes(("reward_log",)) + """,
per AS (SELECT arm, count(*) AS pulls, avg(reward) AS mean_reward FROM reward_log GROUP BY arm),
t AS (SELECT count(*) AS t FROM reward_log),
u AS (SELECT per.*, mean_reward + CASE WHEN pulls = 0 THEN 1.0 ELSE sqrt(2 * ln(t) / pulls) END AS ucb FROM per, t)
SELECT arm, pulls, round(mean_reward, 6) AS mean_reward, round(ucb, 6) AS ucb,
  arm = (SELECT arm FROM u ORDER BY ucb DESC, arm LIMIT 1) AS is_best FROM u""")
def q_ucb_arms(spark, sf):
    u = BA.ucb_arms(T.reward_log(spark, sf), "arm", "reward")
    return u.select("arm", "pulls", F.round("mean_reward", 6).alias("mean_reward"), F.round("ucb", 6).alias("ucb"),
                    "is_best")


def features():
    """Six context features of a logged event (user, item, value, ts)."""
    return F.array(F.lit(1.0), F.col("value") / 100.0, (F.col("user") % 7) / 7.0, (F.col("item") % 5) / 5.0,
                   F.hour("ts") / 24.0, F.minute("ts") / 60.0)


def contexts(spark, sf):
    """Context features per logged event."""
    r = T.reward_log(spark, sf)
    i = T.inter(spark, sf).select("event_id", "user", "item", "value")
    return r.join(i, "event_id").select("event_id", "arm", "reward", features().alias("x"))


_CTX = """
ctx AS (SELECT r.event_id, r.arm, r.reward, [1.0, i.value / 100.0, CAST(i.user % 7 AS DOUBLE) / 7.0,
  CAST(i.item % 5 AS DOUBLE) / 5.0, CAST(hour(r.ts) AS DOUBLE) / 24.0, CAST(minute(r.ts) AS DOUBLE) / 60.0]::DOUBLE[] AS x
  FROM reward_log r JOIN inter i ON i.event_id = r.event_id)"""


LINUCB_SQL = ctes(("inter", "reward_log"), _CTX) + """,
m AS (SELECT *, CASE WHEN reward = 1 THEN 0.6 ELSE -16.0 END AS rr FROM ctx WHERE reward <> -1),
xi AS (SELECT arm, rr, x, unnest(x) AS xi, unnest(generate_series(0, len(x) - 1)) AS i FROM m),
xij AS (SELECT arm, i, xi, unnest(x) AS xj, unnest(generate_series(0, len(x) - 1)) AS j FROM xi),
a AS (SELECT arm, i, j, sum(xi * xj) + CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS a FROM xij GROUP BY arm, i, j),
b AS (SELECT arm, i, -1 AS j, sum(rr * xi) AS a FROM xi GROUP BY arm, i)
SELECT arm, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(a, 6) AS a FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""


@register("linucb_stats", LINUCB_SQL)
def q_linucb_stats(spark, sf):
    s = BA.linucb_stats(contexts(spark, sf), "arm", "x", "reward")
    return s.select("arm", "i", F.col("j").cast("int").alias("j"), F.round("a", 6).alias("a"))


@register("linucb_params", ctes(("inter", "reward_log"), _CTX) + """
SELECT arm, CAST(i AS INTEGER) AS i, true AS solved FROM (SELECT DISTINCT arm FROM ctx WHERE reward <> -1)
CROSS JOIN range(6) t(i)""")
def q_linucb_params(spark, sf):
    """theta of every arm, checked by the residual A theta - b."""
    stats = cut_lineage(BA.linucb_stats(contexts(spark, sf), "arm", "x", "reward"))
    theta = BA.linucb_params(stats).select("arm", F.posexplode("theta").alias("j", "t"))
    at = stats.where("j >= 0").join(theta, ["arm", "j"]).groupBy("arm", "i").agg(F.sum(F.col("a") * F.col("t")).alias("at"))
    b = stats.where("j = -1").select("arm", "i", F.col("a").alias("b"))
    return at.join(b, ["arm", "i"]).select("arm", "i", (F.abs(F.col("at") - F.col("b")) <= 1e-6 * (1 + F.abs(F.col("b")))).alias("solved"))


@register("linucb_recommend", ctes(("inter", "reward_log"), _CTX) + """
SELECT event_id AS ctx_id, true AS arm_known, true AS is_best FROM ctx""")
def q_linucb_recommend(spark, sf):
    """The arm of every context; its score is at least that of each arm's plain
    estimate x.theta (the bonus is not negative)."""
    ctx = cut_lineage(contexts(spark, sf).select(F.col("event_id").alias("ctx_id"), "x"))
    params = cut_lineage(BA.linucb_params(BA.linucb_stats(contexts(spark, sf), "arm", "x", "reward")))
    arms = params.select(F.array_agg(F.struct("arm", "theta"))).scalar()
    rec = BA.linucb_recommend(ctx, params, 0.25).join(ctx, "ctx_id").withColumn("arms", arms)
    plain = F.array_max(F.transform("arms", lambda p: F.aggregate(
        F.zip_with("x", p["theta"], lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)))
    return rec.select("ctx_id", F.exists("arms", lambda p: p["arm"] == F.col("arm")).alias("arm_known"),
                      (F.col("score") >= plain - 1e-9).alias("is_best"))
