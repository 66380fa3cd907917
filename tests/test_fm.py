"""The factorization machine with distributed parameters against Spark ML's."""

import math
import random

import pytest
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import FMRegressor
from pyspark.sql import functions as F

from recoflow.operators import ctr as C
from recoflow.operators import fm

K = 3


def _rows(spark, classes=False):
    """Sparse and dense vectors, one hot first feature, a row without features,
    rows that come twice, values other than 1."""
    rng = random.Random(5)
    rows = [(float(i % 2) if classes else 2.0, Vectors.sparse(12, [], [])) for i in range(2)]
    for i in range(120):
        a, b = (0 if i % 2 else rng.randrange(6)), 6 + rng.randrange(4)
        v = Vectors.sparse(12, [a, b], [1.0, rng.choice([1.0, 0.5, -2.0])])
        y = 1.0 + a % 3 + b % 2
        rows.append((float(y > 2) if classes else y, Vectors.dense(v.toArray()) if i % 10 == 0 else v))
    return spark.createDataFrame(rows + rows[:5], ["label", "features"])


def _first(spark, seed):
    """What Spark ML starts from: java.util.Random's normal draws, in order."""
    r = spark._jvm.java.util.Random(seed)
    rows = [(i, *[r.nextGaussian() * 0.01 for _ in range(K)], 0.0) for i in range(12)]
    names = ", ".join(f"t{i} double" for i in range(K + 1))
    return spark.createDataFrame([*rows, (fm.INTERCEPT, *[0.0] * (K + 1))], f"feature int, {names}")


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_fit_equals_spark_ml(spark, monkeypatch, task):
    """From the same start: parameters, scores and classes, over many blocks."""
    monkeypatch.setattr(fm, "BLOCK_CELLS", 60)
    monkeypatch.setattr(fm, "CHUNK_CELLS", 25)
    d = _rows(spark, task == "classification").cache()
    est = FMRegressor if task == "regression" else FMClassifier
    want = est(factorSize=K, seed=4, maxIter=7).fit(d)
    got = fm.fit(d, task, K, 4, "features", "label", 7, _first(spark, 4))
    assert got.intercept == pytest.approx(want.intercept, abs=1e-8)
    for r in got.weights.where("feature >= 0").collect():
        assert r[f"t{K}"] == pytest.approx(want.linear[r.feature], abs=1e-6)
        assert [r[f"t{i}"] for i in range(K)] == pytest.approx(list(want.factors.toArray()[r.feature]), abs=1e-6)
    cols = ["label", "features", *(["rawPrediction", "probability"] if task == "classification" else []), "prediction"]
    a, b = (sorted(m.transform(d).select(*cols).collect(), key=str) for m in (got, want))
    assert got.transform(d).columns == cols and len(a) == len(b) == 127

    def numbers(rows):
        return sorted([round(x, 5) + 0.0 for v in r[2:] for x in (v.toArray() if hasattr(v, "toArray") else [v])] + [r.label]
                      for r in rows)
    assert all(x == pytest.approx(y, abs=1e-4) for x, y in zip(numbers(a), numbers(b), strict=True))


def test_driver_gets_no_gradient(spark):
    """No Spark ML optimizer runs, and what the fit reads back does not follow
    the size of the feature space: a billion features, of which few occur."""
    size = 1_000_000_000
    d = spark.createDataFrame([(float(i % 3), Vectors.sparse(size, [i % 5, size - 1 - i % 7], [1.0, 1.0]))
                               for i in range(60)], ["label", "features"])
    m = C.fm_fit(d, "regression", factor_size=2, seed=1, max_iter=3)
    assert m.weights.count() == 5 + 7 + 1
    assert m.transform(d).where("prediction is null").count() == 0


def test_unseen_features_keep_their_first_draw(spark):
    d = spark.createDataFrame([(float(i % 3), Vectors.sparse(9, [i % 3], [1.0])) for i in range(30)], ["label", "features"])
    m = C.fm_fit(d, "regression", factor_size=2, seed=1, max_iter=2)
    new = spark.createDataFrame([(Vectors.sparse(9, [7, 8], [1.0, 2.0]),)], ["features"])
    v = spark.createDataFrame([(7,), (8,)], "feature int").select(*[c.alias(f"t{i}") for i, c in enumerate(fm._start(2, 1))]).collect()
    want = m.intercept + 2.0 * sum(v[0][i] * v[1][i] for i in range(2))
    assert m.transform(new).first().prediction == pytest.approx(want, abs=1e-12)
    draws = spark.range(20_000).select(F.col("id").cast("int").alias("feature")).select(
        fm._start(1, 3)[0].alias("v")).agg(F.avg("v"), F.stddev("v"), F.avg((F.abs("v") < 0.01).cast("int"))).first()
    assert abs(draws[0]) < 3e-4 and abs(draws[1] - 0.01) < 3e-4 and abs(draws[2] - math.erf(math.sqrt(0.5))) < 0.02


def test_labels_and_vectors_are_checked(spark):
    v = Vectors.sparse(2, [0], [1.0])
    for task, rows in (("regression", [(None, v), (1.0, v)]), ("regression", [(math.nan, v)]), ("classification", [(2.0, v)]),
                       ("regression", [(1.0, Vectors.dense([math.nan, 1.0]))])):
        d = spark.createDataFrame(rows[::-1], ["label", "features"])
        with pytest.raises(Exception, match="labels must be|vectors must not"):
            C.fm_fit(d, task, 2, 1, max_iter=1)
