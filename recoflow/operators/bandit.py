"""Bandit statistics from reward logs: UCB per arm, LinUCB per arm.

LinUCB keeps, per arm, A = I + sum x x^T and b = sum r' x, where the logged
reward maps 1 -> 0.6, 0 -> -16 and -1 is ignored.  The sums are one
``groupBy`` on (arm, i, j); only the d x d inverse per arm runs in pandas
(``applyInPandas``, one small group per arm), and contexts meet the arm
parameters through an exploded array (the arm count bounds it), not a join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.functions.scalar import ucb_delta

# The logged-reward mapping of the linear bandit.
REWARD_MAP = {1: 0.6, 0: -16.0}

MAX_ARMS = 10_000


def ucb_arms(log: DataFrame, arm: str = "arm", reward: str = "reward") -> DataFrame:
    """(arm, pulls, mean_reward, ucb, is_best): t = all pulls, ucb = mean +
    sqrt(2 ln t / pulls); the best arm has the highest ucb (ties: lower arm)."""
    per = log.groupBy(arm).agg(F.count(F.lit(1)).alias("pulls"), F.avg(reward).alias("mean_reward"))
    t = log.select(F.count(F.lit(1))).scalar()
    per = per.withColumn("ucb", F.col("mean_reward") + ucb_delta(t, F.col("pulls")))
    best = per.select(F.max_by(arm, F.struct(F.col("ucb"), -F.col(arm)))).scalar()
    return per.withColumn("is_best", F.col(arm) == best)


def _mapped(log: DataFrame, reward: str) -> DataFrame:
    m = F.when(F.col(reward) == 1, REWARD_MAP[1]).when(F.col(reward) == 0, REWARD_MAP[0])
    return log.where(F.col(reward) != -1).withColumn("_r", m)


def linucb_sums(log: DataFrame, arm: str, features: str, reward: str) -> DataFrame:
    """Long form (arm, i, j, a) of sum x x^T and (arm, i, -1, a) of sum r' x:
    sums over disjoint logs add up (``features``: array<double> of length d)."""
    m = _mapped(log, reward)
    d = m.select(F.posexplode(features).alias("i", "xi"), arm, "_r", features)
    outer = d.select(arm, "i", "xi", "_r", F.posexplode(features).alias("j", "xj"))
    a = outer.groupBy(arm, "i", "j").agg(F.sum(F.col("xi") * F.col("xj")).alias("a"))
    b = d.groupBy(arm, "i").agg(F.sum(F.col("_r") * F.col("xi")).alias("a")).withColumn("j", F.lit(-1))
    return a.unionByName(b.select(arm, "i", "j", "a"))


def with_identity(sums: DataFrame) -> DataFrame:
    """A = I + sum x x^T; b stays."""
    return sums.withColumn("a", F.col("a") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))


def linucb_stats(log: DataFrame, arm: str, features: str, reward: str) -> DataFrame:
    """Long form (arm, i, j, a) of A and (arm, i, -1, b) of b per arm;
    ``features`` is an array<double> column of a fixed length d."""
    return with_identity(linucb_sums(log, arm, features, reward))


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    arm = pdf["arm"].iloc[0]
    dim = int(pdf.loc[pdf["j"] >= 0, "i"].max()) + 1
    A = np.eye(dim)
    b = np.zeros(dim)
    for r in pdf.itertuples(index=False):
        if r.j >= 0:
            A[int(r.i), int(r.j)] = r.a
        else:
            b[int(r.i)] = r.a
    inv = np.linalg.inv(A)
    theta = inv @ b
    return pd.DataFrame({"arm": [arm], "theta": [theta.tolist()], "a_inv": [inv.reshape(-1).tolist()]})


def linucb_params(stats: DataFrame, arm: str = "arm") -> DataFrame:
    """(arm, theta, a_inv flattened) via a per-arm pandas solve (d x d)."""
    s = stats.withColumnRenamed(arm, "arm")
    return s.groupBy("arm").applyInPandas(_solve, "arm long, theta array<double>, a_inv array<double>")


def linucb_recommend(contexts: DataFrame, params: DataFrame, alpha: float = 0.25, features: str = "x",
                     id_col: str = "ctx_id") -> DataFrame:
    """Best arm per context by x.theta + alpha * sqrt(x^T A^-1 x).

    The arms are a model, one row each; every context must be scored against
    all of them, so they are held as one list, and over ``MAX_ARMS`` raise."""
    n = params.select(F.count(F.lit(1))).scalar()
    params = params.where(F.when(n > MAX_ARMS, F.raise_error(F.lit(f"over {MAX_ARMS} arms")).cast("boolean")).otherwise(F.lit(True)))
    arms = params.agg(F.collect_list(F.struct("arm", "theta", "a_inv")).alias("p")).scalar()
    c = contexts.select(id_col, features, F.explode(arms).alias("p"))
    x = F.col(features)
    d = F.size(x)
    dot = F.aggregate(F.zip_with(x, F.col("p.theta"), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    # x^T M x with M flattened row-major: sum_i sum_j x_i M_ij x_j
    quad = F.aggregate(
        F.transform(F.sequence(F.lit(0), d * d - 1),
                    lambda k: x[(k / d).cast("int")] * F.col("p.a_inv")[k] * x[k % d]),
        F.lit(0.0), lambda s, v: s + v)
    scored = c.select(id_col, F.col("p.arm").alias("arm"), (dot + alpha * F.sqrt(quad)).alias("score"))
    best = scored.groupBy(id_col).agg(F.max_by(F.struct("arm", "score"), F.struct("score", -F.col("arm"))).alias("b"))
    return best.select(id_col, "b.arm", "b.score")
