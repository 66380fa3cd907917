"""Feature dictionaries, sample encoding, id remapping and small column ops.

Feature dictionary: columns are walked in order; a numeric column takes one
slot, a categorical column one slot per distinct value (values in ascending
text order).  That is one global row number over (column position, value)
pairs, with a numeric column contributing a single pair; it runs on the
two-level range plan, so a column with many values is spread over tasks.
Values unseen when the dictionary was built map to the reserved index
``size`` (one past the last slot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.operators.ranking import global_row_number


def feature_dictionary(df: DataFrame, numeric, ignore=(), cats=None) -> DataFrame:
    """(field, value, feat_index, is_numeric); value is '' for numeric fields.
    ``cats`` restricts the categorical columns (numeric ones are then dropped),
    the categorical-only dictionary."""
    numeric = list(numeric)
    cols = [c for c in df.columns if c not in set(ignore)]
    if cats is not None:
        cols = [c for c in cols if c in set(cats)]
        numeric = []
    pos = {c: i for i, c in enumerate(cols)}
    cat_cols = [c for c in cols if c not in numeric]
    parts = []
    if cat_cols:
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("field"), F.lit(pos[c]).alias("fpos"), F.col(c).cast("string").alias("value"))
            for c in cat_cols])).alias("kv")).select("kv.*").distinct()
        parts.append(long.withColumn("is_numeric", F.lit(False)))
    for c in cols:
        if c in numeric:
            parts.append(df.sparkSession.range(1).select(
                F.lit(c).alias("field"), F.lit(pos[c]).alias("fpos"), F.lit("").alias("value"),
                F.lit(True).alias("is_numeric")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    r = global_row_number(u, [F.col("fpos").asc(), F.col("value").asc_nulls_first()], "rn")
    return r.select("field", "value", (F.col("rn") - 1).alias("feat_index"), "is_numeric")


def encode_samples(df: DataFrame, dictionary: DataFrame, id_col: str, label_col: str | None = None) -> DataFrame:
    """SAMPLE long form (row_id, field, feat_index, feat_value[, label]):
    categorical value -> its slot with value 1.0 (a null value has its own
    slot), numeric -> its slot with the number; categories unseen when the
    dictionary was built get the reserved index ``size``.

    Numeric fields (at most one per column) take their slot from literals, so
    no join key holds a row of every sample; only categorical values join."""
    size = dictionary.count()
    slots = {r["field"]: r["feat_index"] for r in
             dictionary.where("is_numeric").select("field", "feat_index").collect()}     # one per numeric column
    known = {r["field"] for r in dictionary.select("field").distinct().collect()}        # one per column
    keep = ["row_id"] + (["label"] if label_col else [])
    base = [F.col(id_col).alias("row_id"), *([F.col(label_col).alias("label")] if label_col else [])]
    names = [c for c in df.columns if c not in (id_col, label_col) and c in known]
    nums, cats = [c for c in names if c in slots], [c for c in names if c not in slots]
    parts = []
    if nums:
        rows = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.lit(slots[c]).cast("bigint").alias("feat_index"),
                                           F.col(c).cast("double").alias("feat_value")) for c in nums]))
        parts.append(df.select(*base, rows))
    if cats:
        long = df.select(*base, F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
                                                   for c in cats])))
        d = dictionary.where(~F.col("is_numeric")).select(F.col("field").alias("_f"), F.col("value").alias("_v"), "feat_index")
        j = long.join(d, (F.col("field") == F.col("_f")) & F.col("value").eqNullSafe(F.col("_v")), "left")
        parts.append(j.select(*keep, "field", F.coalesce("feat_index", F.lit(size).cast("bigint")).alias("feat_index"),
                              F.lit(1.0).alias("feat_value")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def remap_ids(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Sorted distinct keys -> 0..n-1 as long (two-level global rank of the
    distinct keys only), joined back to every row.  A null key is no key: its
    rows stay, with a null index."""
    name = name or f"{col}_idx"
    known = F.col(col).isNotNull()
    keys = df.where(known).select(col).distinct()
    r = global_row_number(keys, [F.col(col).asc()], "_rn").select(col, (F.col("_rn") - 1).alias(name))
    out = df.where(known).join(r, col)
    return out.unionByName(df.where(~known).withColumn(name, F.lit(None).cast("long")))


def missing_feat(df: DataFrame, cols, marker=-1, name: str = "missing_feat") -> DataFrame:
    return df.withColumn(name, sum((F.when(F.col(c) == marker, 1).otherwise(0) for c in cols), F.lit(0)))


def feature_cross(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(a) * F.col(b))


def column_prune(df: DataFrame, ignore) -> DataFrame:
    drop = set(ignore)
    return df.select(*[c for c in df.columns if c not in drop])


def hash_feature(df: DataFrame, cols, size: int = 1 << 20, out: str = "features") -> DataFrame:
    """Hash 'column=value' pairs into ``size`` slots (FeatureHasher)."""
    from pyspark.ml.feature import FeatureHasher
    return FeatureHasher(inputCols=list(cols), outputCol=out, numFeatures=size).transform(df)


def one_hot_pairs(train: DataFrame, test: DataFrame, cols, out: str = "features"):
    """Index on train, one-hot, assemble; test rows with ids unseen in train
    are dropped (handleInvalid='skip')."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    idx = [f"{c}_i" for c in cols]
    oh = [f"{c}_oh" for c in cols]
    p = Pipeline(stages=[StringIndexer(inputCols=list(cols), outputCols=idx, handleInvalid="skip"),
                         OneHotEncoder(inputCols=idx, outputCols=oh), VectorAssembler(inputCols=oh, outputCol=out)])
    m = p.fit(train)
    return m.transform(train), m.transform(test)
