"""Candidate filters and small set operations (column predicates, semi/anti joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidate_filter(df: DataFrame, whitelist: DataFrame | None = None, blacklist: DataFrame | None = None,
                     genres=None, item_col: str = "item", genres_col: str = "genres") -> DataFrame:
    """Whitelist (when given) AND NOT blacklist AND the item has every asked
    genre; an unknown genre matches nothing."""
    out = df
    if whitelist is not None:
        out = out.join(whitelist.select(item_col).distinct(), item_col, "left_semi")
    if blacklist is not None:
        out = out.join(blacklist.select(item_col).distinct(), item_col, "left_anti")
    if genres:
        asked = F.array(*[F.lit(g) for g in genres])
        out = out.where(F.forall(asked, lambda g: F.array_contains(F.col(genres_col), g)))
    return out


def date_range_filter(df: DataFrame, date_col: str, after=None, before=None) -> DataFrame:
    """Item date strictly after ``after`` and strictly before ``before``;
    a null date fails any bound."""
    t = df.schema[date_col].dataType
    out = df
    if after is not None:
        out = out.where(F.col(date_col) > F.lit(after).cast(t))
    if before is not None:
        out = out.where(F.col(date_col) < F.lit(before).cast(t))
    return out


def availability_filter(df: DataFrame, now, available_col: str = "available_date",
                        expire_col: str = "expire_date") -> DataFrame:
    """available <= now < expire; nulls fail, as range filters do."""
    t = df.schema[available_col].dataType
    n = F.lit(now).cast(t)
    return df.where((F.col(available_col) <= n) & (F.col(expire_col) > n))


def field_filter(df: DataFrame, field_col: str, values) -> DataFrame:
    """Must match one of the values (array field)."""
    return df.where(F.arrays_overlap(F.col(field_col), F.array(*[F.lit(v) for v in values])))


def positive_scores(df: DataFrame, score_col: str = "score") -> DataFrame:
    return df.where(F.col(score_col) > 0)


def boost_distinct(*cols) -> F.Column:
    """Distinct union of several list columns, first occurrence order."""
    return F.array_distinct(F.concat(*[F.coalesce(F.col(c), F.array()) if isinstance(c, str) else c for c in cols]))


def item_set_minus(a: DataFrame, b: DataFrame, keys=("user", "item")) -> DataFrame:
    """Distinct keys of a that are not in b (EXCEPT DISTINCT, as an anti join)."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def train_test_concat(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both sets in one frame for a shared vocabulary; missing columns null."""
    return (train.withColumn("_set", F.lit("train"))
            .unionByName(test.withColumn("_set", F.lit("test")), allowMissingColumns=True))
