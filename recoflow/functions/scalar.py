"""Column -> Column helpers.  All are built-in expressions (JVM, codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def xlogx(x) -> Column:
    x = _c(x).cast("double")
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(x))


def llr(k11, k12, k21, k22) -> Column:
    """Log-likelihood ratio of a 2x2 contingency table (Dunning 1993).

    2 * (H(rows) + H(cols) - H(matrix)) with H(k...) = xlogx(sum k) - sum xlogx(k);
    a negative result is round-off and becomes 0.  Results below 1e-9 are
    treated as round-off too, so engines with different ``log`` agree.
    """
    k11, k12, k21, k22 = (_c(k).cast("double") for k in (k11, k12, k21, k22))
    row = xlogx(k11 + k12 + k21 + k22) - xlogx(k11 + k12) - xlogx(k21 + k22)
    col = xlogx(k11 + k12 + k21 + k22) - xlogx(k11 + k21) - xlogx(k12 + k22)
    mat = xlogx(k11 + k12 + k21 + k22) - xlogx(k11) - xlogx(k12) - xlogx(k21) - xlogx(k22)
    raw = 2.0 * (row + col - mat)
    return F.when(raw < 1e-9, F.lit(0.0)).otherwise(raw)


def with_llr(df, k11, n_a, n_b, n_users, name: str = "llr"):
    """Adds ``name`` = llr of the table k11, n_a - k11, n_b - k11,
    U - n_a - n_b + k11, computed in steps: each entropy term is its own
    column, so the optimizer keeps them apart instead of inlining copies of
    one large expression into the next (same values as ``llr``).  Counts are
    non-negative integers, so x*ln(x) is x * ln(max(x, 1))."""
    def xl(c):
        return c * F.log(F.greatest(c, F.lit(1.0)))
    a, b, c, d = (F.col(x) for x in ("_a", "_b", "_c", "_d"))
    k = df.select("*", _c(k11).cast("double").alias("_a"), (_c(n_a) - _c(k11)).cast("double").alias("_b"),
                  (_c(n_b) - _c(k11)).cast("double").alias("_c"),
                  (_c(n_users) - _c(n_a) - _c(n_b) + _c(k11)).cast("double").alias("_d"))
    h = k.select("*", xl(a + b + c + d).alias("_xt"), xl(a + b).alias("_r1"), xl(c + d).alias("_r2"),
                 xl(a + c).alias("_c1"), xl(b + d).alias("_c2"), (xl(a) + xl(b) + xl(c) + xl(d)).alias("_m"))
    raw = h.select("*", (2.0 * (F.col("_xt") - F.col("_r1") - F.col("_r2") - F.col("_c1") - F.col("_c2")
                                + F.col("_m"))).alias("_raw"))
    out = raw.withColumn(name, F.when(F.col("_raw") < 1e-9, F.lit(0.0)).otherwise(F.col("_raw")))
    return out.drop("_a", "_b", "_c", "_d", "_xt", "_r1", "_r2", "_c1", "_c2", "_m", "_raw")


def vec_dot(a, b) -> Column:
    """Dot product of two numeric arrays, in double.  Higher-order functions
    run interpreted, so this uses two array passes, not four."""
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def vec_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def vec_cosine(a, b) -> Column:
    """Cosine similarity; 0 when either norm is 0."""
    den = vec_norm(a) * vec_norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(vec_dot(a, b) / den)


def ucb_delta(t, n) -> Column:
    """Upper-confidence width sqrt(2 ln t / n); 1 when the arm was never pulled."""
    t, n = _c(t).cast("double"), _c(n).cast("double")
    return F.when((n == 0) | n.isNull(), F.lit(1.0)).otherwise(F.sqrt(2.0 * F.log(t) / n))


def iso_time(text, default) -> Column:
    """Parse ISO-8601 text; bad or missing text falls back to ``default``
    (a literal or column, never the wall clock)."""
    d = default if isinstance(default, Column) else F.lit(default).cast("timestamp")
    return F.coalesce(F.try_to_timestamp(_c(text)), d)


def epoch_seconds_to_ts(c) -> Column:
    return F.timestamp_seconds(_c(c))


def ts_to_epoch_millis(c) -> Column:
    return F.unix_millis(_c(c).cast("timestamp"))


def last_category(c) -> Column:
    """Last element of the last list of a nested list column."""
    return F.element_at(F.element_at(_c(c), -1), -1)


def md5_rank_key(seed, *cols) -> Column:
    """Deterministic pseudo-random key: md5 of 'seed|c1|c2...'.  Same text in
    every engine, so sampled output can be compared exactly."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(c).cast("string") for c in cols]))


def map_merge(*maps) -> Column:
    """Map union where the right-most map wins on repeated keys
    (needs spark.sql.mapKeyDedupPolicy=LAST_WIN, set by get_spark)."""
    return F.map_concat(*[_c(m) for m in maps])
