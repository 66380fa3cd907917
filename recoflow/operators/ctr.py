"""CTR models: FM / FFM scoring from weight tables, and pyspark.ml models.

fm_score:  w0 + sum_i w_i x_i + 0.5 * sum_k ((sum_i v_ik x_i)^2 - sum_i v_ik^2 x_i^2)
ffm_score: w0 + sum_i w_i x_i + sum_{i<j} <v_{i, field(j)}, v_{j, field(i)}> x_i x_j
Both join the SAMPLE long form to the weights once and sum per row; pairs are
formed inside a row (its fields are bounded by the schema width, not the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fm_score(samples: DataFrame, bias: float, weights: DataFrame, factors: int) -> DataFrame:
    """samples: (row_id, feat_index, feat_value); weights: (feat_index, w, v
    array<double> of ``factors``).  One join and one aggregate."""
    j = samples.join(weights, "feat_index")
    x = F.col("feat_value")
    vx = [F.col("v")[k] * x for k in range(factors)]
    sums = j.groupBy("row_id").agg(F.sum(F.col("w") * x).alias("lin"), *[F.sum(t).alias(f"s{k}") for k, t in enumerate(vx)],
                                   *[F.sum(t * t).alias(f"q{k}") for k, t in enumerate(vx)])
    pair = sum((F.col(f"s{k}") * F.col(f"s{k}") - F.col(f"q{k}") for k in range(factors)), F.lit(0.0))
    return sums.select("row_id", (F.lit(bias) + F.col("lin") + 0.5 * pair).alias("score"))


def _row_features(samples: DataFrame, cols) -> DataFrame:
    """(row_id, fs): the row's features; bounded by the schema's width."""
    return samples.groupBy("row_id").agg(F.collect_list(F.struct("fpos", *cols)).alias("fs"))


def feature_pair_join(samples: DataFrame) -> DataFrame:
    """Pairs (a, b) of one row's features with a.fpos < b.fpos, formed inside
    the row.  samples: (row_id, field, fpos, feat_index, feat_value)."""
    names = ("fpos", "field", "feat_index", "feat_value")
    rows = _row_features(samples, names[1:])
    pairs = F.flatten(F.transform("fs", lambda a: F.transform(
        F.filter("fs", lambda b: b["fpos"] > a["fpos"]),
        lambda b: F.struct(*[x[c].alias(f"{t}_{c}") for t, x in (("a", a), ("b", b)) for c in names]))))
    return rows.select("row_id", F.inline(pairs))


def ffm_score(samples: DataFrame, bias: float, linear: DataFrame, latent: DataFrame) -> DataFrame:
    """linear: (feat_index, w); latent: (feat_index, field, v array<double>):
    v of a feature toward the other feature's field.  A feature's vectors are
    one map (bounded by the number of fields), so a sample joins once and the
    pairs are formed inside the row."""
    model = latent.groupBy("feat_index").agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("vs"))
    j = samples.join(linear.join(model, "feat_index"), "feat_index")
    rows = _row_features(j, ("field", "feat_value", "w", "vs"))
    lin = F.aggregate("fs", F.lit(0.0), lambda s, a: s + a["w"] * a["feat_value"])

    def dot(u, v):
        return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pair = F.aggregate("fs", F.lit(0.0), lambda s, a: s + F.aggregate(
        F.filter("fs", lambda b: b["fpos"] > a["fpos"]), F.lit(0.0),
        lambda t, b: t + dot(a["vs"][b["field"]], b["vs"][a["field"]]) * a["feat_value"] * b["feat_value"]))
    return rows.select("row_id", (F.lit(bias) + lin + pair).alias("score"))


def fm_fit(df: DataFrame, task: str = "regression", factor_size: int = 8, seed: int = 1,
           features: str = "features", label: str = "label", max_iter: int = 50):
    """Factorization machine with Spark ML's optimizer; its parameters stay on
    the executors (see ``fm``), whose driver would get a dense gradient of all
    features in each iteration."""
    from recoflow.operators import fm
    return fm.fit(df, task, factor_size, seed, features, label, max_iter)


def gbdt_leaves(df: DataFrame, features: str, label: str, trees: int = 10, depth: int = 3, seed: int = 1):
    """GBT classifier with one leaf index per tree (``leafCol``)."""
    from pyspark.ml.classification import GBTClassifier
    m = GBTClassifier(featuresCol=features, labelCol=label, maxIter=trees, maxDepth=depth, seed=seed,
                      leafCol="leaves").fit(df)
    return m, m.transform(df)


def gbdt_lr(train: DataFrame, test: DataFrame, features: str, label: str, trees: int = 10, depth: int = 3,
            seed: int = 1, reg: float = 0.01):
    """GBT leaves -> one-hot per tree (offset tree * leaves) -> L2 logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    gbt, tr = gbdt_leaves(train, features, label, trees, depth, seed)
    te = gbt.transform(test)

    def leaves_cols(d):
        arr = vector_to_array("leaves")
        return d.select("*", *[arr[i].cast("double").alias(f"leaf_{i}") for i in range(trees)])
    tr, te = leaves_cols(tr.drop("prediction", "probability", "rawPrediction")), \
        leaves_cols(te.drop("prediction", "probability", "rawPrediction"))
    cols = [f"leaf_{i}" for i in range(trees)]
    oh = OneHotEncoder(inputCols=cols, outputCols=[f"{c}_oh" for c in cols], handleInvalid="keep").fit(tr)
    va = VectorAssembler(inputCols=[f"{c}_oh" for c in cols], outputCol="leaf_vec")
    tr2, te2 = va.transform(oh.transform(tr)), va.transform(oh.transform(te))
    lr = LogisticRegression(featuresCol="leaf_vec", labelCol=label, regParam=reg, elasticNetParam=0.0).fit(tr2)
    return lr.transform(te2)


def rf_regression(train: DataFrame, test: DataFrame, features: str, label: str, max_categories: int = 4,
                  seed: int = 1):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorIndexer
    from pyspark.ml.regression import RandomForestRegressor
    p = Pipeline(stages=[VectorIndexer(inputCol=features, outputCol="idx_features", maxCategories=max_categories),
                         RandomForestRegressor(featuresCol="idx_features", labelCol=label, seed=seed)])
    return p.fit(train).transform(test)


def fold_average(df: DataFrame, k: int, make_estimator, id_col: str = "id", fold_col: str = "fold",
                 pred_col: str = "prediction"):
    """One model per fold: out-of-fold predictions for training rows, and the
    mean prediction of the k models for every row."""
    parts = None
    for f in range(k):
        m = make_estimator().fit(df.where(F.col(fold_col) != f))
        p = m.transform(df).select(id_col, F.col(pred_col).cast("double").alias("_p"), (F.col(fold_col) == f).alias("_own"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy(id_col).agg(F.max(F.when(F.col("_own"), F.col("_p"))).alias("oof"), F.avg("_p").alias("mean_pred"))
