"""Second-order factorization machine whose parameters are a distributed table.

    raw = w0 + sum_i w_i x_i + 0.5 * sum_k ((sum_i v_ik x_i)^2 - sum_i v_ik^2 x_i^2)

The fit is Spark ML's own (full-batch AdamW: step 1, no regularization, starts
of deviation 0.01, the same stop test), but no vector as long as the feature
space is ever made.  Rows are dealt to blocks once, neighbours by their first
feature.  An iteration is two shuffles: the parameters of a block's features
meet the block in a cogroup, which returns the block's part of the gradient;
the parts are summed per feature and step that feature's parameters.  So the
driver gets one norm per iteration, and what is shuffled follows the (feature,
block) pairs, at most the non-zero cells.  The intercept is feature
``INTERCEPT``, with factors of zero.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.session import cut_lineage, discard

BLOCK_CELLS, CHUNK_CELLS = 4_000_000, 50_000   # cells of a block (48 MB), and of those computed at a time
LEAST_ROWS = 10_000                             # fewer rows are no block of their own
INTERCEPT = -1
STEP, BETA1, BETA2, EPS, START, TOL = 1.0, 0.9, 0.999, 1e-8, 0.01, 1e-6
PACKED = "_block int, ids binary, ends binary, at binary, x binary, y binary, feats array<int>"


def _cells(features: str) -> tuple[Column, Column]:
    """Indices and values of a vector column, sparse or dense."""
    v = F.unwrap_udt(features)
    values = F.when(F.forall(v["values"], lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), v["values"]).otherwise(
        F.raise_error(F.lit("vectors must not be null or hold NaN or infinity")))
    return F.when(v["type"] == 0, v["indices"]).otherwise(F.transform(v["values"], lambda x, i: i)), values


def _label(label: str, task: str) -> Column:
    y = F.col(label).cast("double")
    good = y.isin(0.0, 1.0) if task == "classification" else y.isNotNull() & ~F.isnan(y)
    said = "0 or 1" if task == "classification" else "numbers, neither null nor NaN"
    return F.when(good, y).otherwise(F.raise_error(F.lit(f"labels must be {said}")))


def _block_ids(spark: SparkSession, n: int) -> list[int]:
    """Ids for n blocks that a hash of the id deals to n partitions evenly."""
    part = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    ids = [r[0] for r in spark.range(32 * n).groupBy(part).agg(F.min("id")).collect()]
    return ids + list(range(32 * n, 33 * n - len(ids)))


def _pack(ids: list[int]):
    """A partition's rows as one block: chunks of plain arrays, in which ``at``
    is a cell's place among the block's features (the intercept's is 0).  The
    first chunk names them."""
    def fn(batches):
        return _packed(batches, ids[TaskContext.get().partitionId()])
    return fn


def _packed(batches, block: int):
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    idx, x = (t[c].combine_chunks() for c in ("_idx", "_x"))
    ends = np.concatenate([[0], np.cumsum(idx.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    idx, x = idx.flatten().to_numpy(), np.asarray(x.flatten(), dtype=np.float64)
    ids, y = (np.ascontiguousarray(t[c].to_numpy()) for c in ("_row", "_y"))
    feats, at = np.unique(idx, return_inverse=True)
    at = (at + 1).astype(np.int32)
    cost = ends + np.arange(len(ends))
    cuts = np.unique(np.append(np.searchsorted(cost, np.arange(0, cost[-1], CHUNK_CELLS)), len(ids)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        a, b = ends[lo], ends[hi]
        arrays = (ids[lo:hi], ends[lo:hi + 1] - a, at[a:b], x[a:b], y[lo:hi])
        names = np.append(INTERCEPT, feats) if lo == 0 else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in arrays],
             pa.array([names], pa.list_(pa.int32()))], names=["_block", "ids", "ends", "at", "x", "y", "feats"])


def _blocks(rows: DataFrame, features: str, y: Column) -> tuple[DataFrame, int, int]:
    """(packed blocks, their number, rows).  ``rows``: with ``_row``; read three times."""
    idx, x = _cells(features)
    rows = rows.select("_row", y.alias("_y"), idx.alias("_idx"), x.alias("_x"))
    n, cells = rows.agg(F.count(F.lit(1)), F.sum(F.size("_idx"))).first()
    spark = rows.sparkSession
    parts = max(1, -(-(n + (cells or 0)) // BLOCK_CELLS), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    dealt = rows.repartitionByRange(parts, F.get("_idx", F.lit(0)), "_row")
    return cut_lineage(dealt.mapInArrow(_pack(_block_ids(spark, parts)), PACKED)), parts, n


def _routes(packed: DataFrame) -> DataFrame:
    """(feature, _to): the blocks that need a feature's parameters."""
    return packed.select(F.explode("feats").alias("feature"), F.col("_block").alias("_to"))


def _by_block(msgs: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block's features in order, and their parameters: k rows of factors, a row of weights."""
    feats = msgs["feature"].to_numpy()
    o = np.argsort(feats)
    return feats[o], np.stack([msgs[f"t{i}"].to_numpy()[o] for i in range(k + 1)])


def _chunks(rows: pa.Table):
    for r in rows.select(["ids", "ends", "at", "x", "y"]).to_pylist():
        ends = np.frombuffer(r["ends"], np.int64)
        yield (np.frombuffer(r["ids"], np.int64), np.repeat(np.arange(len(ends) - 1), np.diff(ends)),
               np.frombuffer(r["at"], np.int32).astype(np.intp), np.frombuffer(r["x"]), np.frombuffer(r["y"]))


def _raw(theta: np.ndarray, n: int, row: np.ndarray, at: np.ndarray, x: np.ndarray):
    """Scores of a chunk's n rows, v * x of its cells, and their sums by row."""
    w, V = theta[-1], theta[:-1]
    vx = [v[at] * x for v in V]
    sums = [np.bincount(row, c, n) for c in vx]
    own = np.bincount(row, w[at] * x - 0.5 * sum((c * c for c in vx), np.zeros(len(x))), n)
    return w[0] + own + 0.5 * sum((s * s for s in sums), np.zeros(n)), vx, sums


def _sigmoid(raw: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * raw))


def _gradient(k: int, task: str):
    """Per block: its part of the loss gradient, summed over its rows."""
    def fn(rows: pa.Table, msgs: pa.Table) -> pa.Table:
        feats, theta = _by_block(msgs, k)
        g = np.zeros_like(theta)
        for _, row, at, x, y in _chunks(rows):
            raw, vx, sums = _raw(theta, len(y), row, at, x)
            off = _sigmoid(raw) - y if task == "classification" else 2.0 * (raw - y)
            ox = off[row] * x
            for i in range(k):
                g[i] += np.bincount(at, ox * (sums[i][row] - vx[i]), len(feats))
            g[k] += np.bincount(at, ox, len(feats))
            g[k, 0] += off.sum()
        return pa.table({"feature": feats, **{f"g{i}": g[i] for i in range(k + 1)}})
    return fn


def _scores(k: int):
    def fn(rows: pa.Table, msgs: pa.Table) -> pa.Table:
        _, theta = _by_block(msgs, k)
        got = [(ids, _raw(theta, len(ids), row, at, x)[0]) for ids, row, at, x, _ in _chunks(rows)]
        return pa.table({"_row": np.concatenate([a for a, _ in got] or [np.empty(0, np.int64)]),
                         "_raw": np.concatenate([b for _, b in got] or [np.empty(0)])})
    return fn


def _start(k: int, seed: int) -> list[Column]:
    """First parameters of a feature: normal factors drawn by its id and the
    seed (the same wherever they are drawn), weight 0."""
    def even(i):
        return (F.pmod(F.xxhash64("feature", F.lit(i), F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)

    def normal(i):
        z = F.sqrt(-2.0 * F.ln(even(2 * i))) * F.cos(2.0 * math.pi * even(2 * i + 1))
        return F.when(F.col("feature") == INTERCEPT, 0.0).otherwise(START * z)
    return [*[normal(i) for i in range(k)], F.lit(0.0)]


def _stepped(state: DataFrame, grads: DataFrame, k: int, rows: int) -> DataFrame:
    """The parameters after one more step of AdamW.  ``moved`` is the step's
    square; ``b1`` and ``b2`` are the powers of BETA1 and BETA2 (as columns, so
    that every iteration has the same code to compile)."""
    ids = range(k + 1)
    j = state.join(grads.hint("merge"), "feature").selectExpr(
        "feature", f"b1 * {BETA1}D AS b1", f"b2 * {BETA2}D AS b2", *[f"t{i} AS o{i}" for i in ids],
        *[f"{BETA1}D * m{i} + {1 - BETA1}D * (g{i} / {rows}D) AS m{i}" for i in ids],
        *[f"{BETA2}D * s{i} + {1 - BETA2}D * (g{i} / {rows}D) * (g{i} / {rows}D) AS s{i}" for i in ids])
    j = j.selectExpr("*", *[f"{STEP}D * (m{i} / (1 - b1)) / (sqrt(s{i} / (1 - b2)) + {EPS}D) AS d{i}" for i in ids])
    return j.selectExpr("feature", "b1", "b2", *[c for i in ids for c in (f"o{i} - d{i} AS t{i}", f"m{i}", f"s{i}")],
                        " + ".join(f"d{i} * d{i}" for i in ids) + " AS moved")


@contextmanager
def _shuffles_deleted(spark):
    """An iteration's shuffle files go when it ends, not when the driver
    happens to collect garbage: their sum would follow the iterations."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def fit(df: DataFrame, task: str, factor_size: int, seed: int, features: str, label: str, max_iter: int,
        start: DataFrame | None = None) -> FMModel:
    """``start``: first parameters (feature, t0 .. tk) of every feature and the
    intercept, instead of drawn ones."""
    spark, k = df.sparkSession, factor_size
    t_cols = [f"t{i}" for i in range(k + 1)]
    square = " + ".join(f"{c} * {c}" for c in t_cols)
    packed, n, rows = _blocks(df.withColumn("_row", F.monotonically_increasing_id()), features, _label(label, task))
    if not rows:
        raise ValueError("no rows to fit")
    routes = _routes(packed).repartition(n, "feature").persist()
    blocks = packed.select("_block", "ids", "ends", "at", "x", "y").repartition(n, "_block").persist()
    zeros = [f"0D AS {c}{i}" for i in range(k + 1) for c in "ms"]
    known = routes.select("feature").distinct()
    known = known.select("feature", *[c.alias(t) for c, t in zip(_start(k, seed), t_cols, strict=True)]) if start is None \
        else known.join(start.hint("merge"), "feature")
    state = cut_lineage(known.selectExpr("feature", "1D AS b1", "1D AS b2", *t_cols, *zeros))
    schema = "feature int, " + ", ".join(f"g{i} double" for i in range(k + 1))
    try:
        with _shuffles_deleted(spark):
            for t in range(1, max_iter + 1):
                msgs = state.select("feature", *t_cols).repartition(n, "feature").join(routes.hint("merge"), "feature")
                parts = blocks.groupBy("_block").cogroup(msgs.repartition(n, "_to").groupBy("_to")) \
                    .applyInArrow(_gradient(k, task), schema)
                grads = parts.repartition(n, "feature").groupBy("feature").agg(
                    *[F.sum(f"g{i}").alias(f"g{i}") for i in range(k + 1)])
                old, state = state, cut_lineage(_stepped(state.repartition(n, "feature"), grads, k, rows))
                discard(old)
                if t > 1:
                    moved, size = state.selectExpr("sum(moved)", f"sum({square})").first()
                    if math.sqrt(moved) < TOL * max(math.sqrt(size), 1.0):
                        break
    finally:
        routes.unpersist()
        blocks.unpersist()
    return FMModel(task, k, seed, features, state.select("feature", *t_cols))


class FMModel:
    """``weights``: (feature, t0 .. tk): k factors and the linear weight of
    every feature of the fitted rows, and of the intercept."""

    def __init__(self, task: str, factor_size: int, seed: int, features: str, weights: DataFrame):
        self.task, self.factor_size, self.seed, self.features, self.weights = task, factor_size, seed, features, weights

    @property
    def intercept(self) -> float:
        return self.weights.where(F.col("feature") == INTERCEPT).select(f"t{self.factor_size}").first()[0]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` (a classifier's also with ``rawPrediction``
        and ``probability``).  Features that no fitted row had keep their first
        parameters, as in Spark ML."""
        k = self.factor_size
        rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        packed, n, _ = _blocks(rows, self.features, F.lit(0.0))
        msgs = _routes(packed).repartition(n, "feature").join(
            self.weights.repartition(n, "feature").hint("merge"), "feature", "left")
        msgs = msgs.select("_to", "feature", *[
            F.coalesce(f"t{i}", c).alias(f"t{i}") for i, c in enumerate(_start(k, self.seed))])
        raw = packed.repartition(n, "_block").groupBy("_block").cogroup(
            msgs.repartition(n, "_to").groupBy("_to")).applyInArrow(_scores(k), "_row long, _raw double")
        out = rows.join(raw.hint("merge"), "_row")
        if self.task == "regression":
            return out.select(*df.columns, F.col("_raw").alias("prediction"))
        from pyspark.ml.functions import array_to_vector
        p = 1.0 / (1.0 + F.exp(-F.col("_raw")))
        return out.select(*df.columns, array_to_vector(F.array(-F.col("_raw"), F.col("_raw"))).alias("rawPrediction"),
                          array_to_vector(F.array(1.0 - p, p)).alias("probability"),
                          F.when(p > 0.5, 1.0).otherwise(0.0).alias("prediction"))
