"""Ranking and classification metrics as aggregates over tables.

Every metric is one or two aggregations; metrics that need a global order
(AUC, Gini, cumulative sums) use the two-level range-partitioned plan in
``ranking`` instead of a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.operators.ranking import global_row_number, global_running_sum


def _hits(recs: DataFrame, truth: DataFrame, k: int, threshold: float) -> DataFrame:
    """Per user: hits in the first k, number of positives (users with no
    positive are skipped)."""
    pos = truth.where(F.col("rating") >= threshold).select("user", "item").distinct()
    npos = pos.groupBy("user").agg(F.count(F.lit(1)).alias("n_pos"))
    top = recs.where(F.col("rank") <= k).select("user", "item")
    hits = top.join(pos, ["user", "item"]).groupBy("user").agg(F.count(F.lit(1)).alias("hits"))
    return npos.join(hits, "user", "left").select("user", "n_pos", F.coalesce("hits", F.lit(0)).alias("hits"))


def precision_at_k(recs: DataFrame, truth: DataFrame, k: int, threshold: float) -> DataFrame:
    h = _hits(recs, truth, k, threshold)
    return h.agg(F.avg(F.col("hits") / F.lit(float(k))).alias("precision"), F.count(F.lit(1)).alias("n_users"))


def recall_at_k(recs: DataFrame, truth: DataFrame, k: int, threshold: float) -> DataFrame:
    h = _hits(recs, truth, k, threshold)
    return h.agg(F.avg(F.col("hits") / F.col("n_pos")).alias("recall"), F.count(F.lit(1)).alias("n_users"))


def positive_count(truth: DataFrame, threshold: float) -> DataFrame:
    """Mean number of positives per truth user (users with none count 0)."""
    per = truth.groupBy("user").agg(F.sum(F.when(F.col("rating") >= threshold, 1).otherwise(0)).alias("n_pos"))
    return per.agg(F.avg("n_pos").alias("positive_count"))


def metric_grid(recs: DataFrame, truth: DataFrame, ks, thresholds) -> DataFrame:
    """Precision and recall for every (threshold, k) in one pass: the
    parameter pairs are exploded onto the joined rows, not cross joined."""
    params = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(int(k)).alias("k"))
                       for t in thresholds for k in ks])
    t = truth.select("user", "item", "rating").withColumn("p", F.explode(params)).select(
        "user", "item", "rating", "p.threshold", "p.k")
    pos = t.where(F.col("rating") >= F.col("threshold")).select("user", "item", "threshold", "k").distinct()
    npos = pos.groupBy("threshold", "k", "user").agg(F.count(F.lit(1)).alias("n_pos"))
    top = recs.select("user", "item", "rank")
    hits = (pos.join(top, ["user", "item"]).where(F.col("rank") <= F.col("k"))
            .groupBy("threshold", "k", "user").agg(F.count(F.lit(1)).alias("hits")))
    per = npos.join(hits, ["threshold", "k", "user"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return per.groupBy("threshold", "k").agg(
        F.avg(F.col("hits") / F.col("k")).alias("precision"),
        F.avg(F.col("hits") / F.col("n_pos")).alias("recall"),
        F.count(F.lit(1)).alias("n_users"))


def ranking_metrics(scores: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Hit rate, MRR and NDCG at k.  scores: (user, item, score) of every
    candidate (the true item included); truth: (user, item) one per user.
    The true item's position counts candidates with a higher score, ties
    broken by item id."""
    t = truth.select("user", F.col("item").alias("t_item"))
    ts = scores.join(t, "user").where(F.col("item") == F.col("t_item")).select(
        "user", "t_item", F.col("score").alias("t_score"))
    j = scores.join(ts, "user")
    beats = (F.col("score") > F.col("t_score")) | ((F.col("score") == F.col("t_score")) & (F.col("item") < F.col("t_item")))
    pos = j.groupBy("user").agg(F.sum(F.when(beats, 1).otherwise(0)).alias("pos"))
    hit = F.col("pos") < k
    return pos.agg(
        F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.avg(F.when(hit, 1.0 / (F.col("pos") + 1)).otherwise(0.0)).alias("mrr"),
        F.avg(F.when(hit, 1.0 / F.log2(F.col("pos") + 2)).otherwise(0.0)).alias("ndcg"),
        F.count(F.lit(1)).alias("n_users"))


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC AUC by the rank-sum rule with average ranks for ties: distinct
    scores first (positives and negatives per score), then a global running
    count of negatives below each score."""
    agg = df.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n"))
    cum = global_running_sum(agg, [F.col("s").asc()], "n", "n_below", inclusive=False)
    return cum.agg(
        (F.sum(F.col("p") * (F.col("n_below") + 0.5 * F.col("n"))) /
         (F.sum("p").cast("double") * F.sum("n"))).alias("auc"))


def pairwise_auc(df: DataFrame, pos: str = "pos_score", neg: str = "neg_score") -> DataFrame:
    return df.agg(F.avg(F.when(F.col(pos) > F.col(neg), 1.0).otherwise(0.0)).alias("pairwise_auc"))


def gini_norm(df: DataFrame, label: str = "label", score: str = "score", id_col: str = "id") -> DataFrame:
    """Normalized Gini: gini(label, score) / gini(label, label), rows sorted
    by the second argument desc, then row id; the sum of cumulative label
    sums is sum(label * (n - pos + 1))."""
    n = df.select(F.count(F.lit(1)).cast("double")).scalar()
    tot = df.select(F.sum(label).cast("double")).scalar()

    def g(order_col):
        cols = [id_col, label] + ([order_col] if order_col != label else [])
        r = global_row_number(df.select(*cols), [F.col(order_col).desc(), F.col(id_col).asc()], "pos")
        return r.agg(((F.sum(F.col(label) * (n - F.col("pos") + 1)) / tot - (n + 1) / 2.0) / n).alias("g"))

    g_label = g(label).scalar()
    return g(score).select(F.col("g").alias("gini_pred"), g_label.alias("gini_label"),
                           (F.col("g") / g_label).alias("gini_norm"))


def cumulative_gini(df: DataFrame, label: str = "label", score: str = "score", id_col: str = "id") -> DataFrame:
    """Running sum of labels in (score desc, id asc) order, with positions;
    both come from one range shuffle (a position is a running sum of ones)."""
    return global_running_sum(df.select(id_col, label, score), [F.col(score).desc(), F.col(id_col).asc()], label,
                              "cum_label", position="pos")


def rmse(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col(pred), 2))).alias("rmse"))


def normalized_entropy(df: DataFrame, label: str = "label", prob: str = "prob", eps: float = 1e-15) -> DataFrame:
    """Mean 0/1 log loss, and the same divided by the entropy of the base rate."""
    p = F.least(F.greatest(F.col(prob).cast("double"), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    ll = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    agg = df.agg(F.avg(ll).alias("logloss"), F.avg(y).alias("b"))
    b = F.col("b")
    base = -(b * F.log(b) + (1 - b) * F.log(1 - b))
    return agg.select("logloss", (F.col("logloss") / base).alias("normalized_entropy"))
