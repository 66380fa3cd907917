"""Correlators kept up to date batch by batch.

State is a folder of tables, each a log of batches (``<table>/batch=<k>``):
the distinct (user, action, item) pairs that a batch brought, dealt to folds by
user; the co-occurrence counts and marginals that it added; its new users; and
the ranked correlators after it.  A batch joins its new pairs with the old ones
of the same users only (new x old, old x new, new x new), from the folds that
hold those users.  A batch writes only its own folders, so one that is tried
again writes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.functions.scalar import with_llr
from recoflow.operators.correlators import action_pairs, correlator_topk
from recoflow.operators.joins import blocked_join
from recoflow.session import cut_lineage

FOLDS = 64
TABLES = {"pairs": "user long, action string, item long, fold int",
          "cooc": "action string, item long, other long, k11 long",
          "items": "item long, n_a long",
          "others": "action string, other long, n_b long",
          "users": "n long",
          "ranked": "action string, item long, other long, llr double, rank int"}


def _fold(folds: int):
    return F.pmod(F.xxhash64("user"), F.lit(folds)).cast("int")


def log_of(spark: SparkSession, folder: str, name: str, batches: int) -> DataFrame:
    """The rows of the first ``batches`` batches of a table."""
    if not batches:
        return spark.createDataFrame([], TABLES[name])
    paths = [f"{folder}/{name}/batch={k}" for k in range(batches)]
    return spark.read.schema(TABLES[name]).option("basePath", f"{folder}/{name}").parquet(*paths).drop("batch")


def _write(df: DataFrame, folder: str, name: str, batch: int, by: str | None = None) -> DataFrame:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(f"{folder}/{name}/batch={batch}")
    return df.sparkSession.read.schema(TABLES[name]).parquet(f"{folder}/{name}/batch={batch}")


def pairs_of_users(spark: SparkSession, folder: str, batches: int, new: DataFrame) -> DataFrame:
    """Stored pairs of the users of ``new``; only their folds are read."""
    folds = [r.fold for r in new.select("fold").distinct().collect()]      # at most FOLDS numbers
    old = log_of(spark, folder, "pairs", batches).where(F.col("fold").isin(folds))
    return old.join(new.select("user").distinct(), "user", "left_semi")


def _pairs_on_user(a: DataFrame, b: DataFrame, primary: str) -> DataFrame:
    a = a.where(F.col("action") == primary).select("user", "item")
    b = b.select("user", "action", F.col("item").alias("other"))
    j = blocked_join(a, b, ["user"], "item").where((F.col("action") != primary) | (F.col("item") != F.col("other")))
    return j.select("action", "item", "other")


def add_batch(spark: SparkSession, folder: str, batch: int, inter: DataFrame, primary: str = "purchase", secondaries=(),
              top_k: int = 50, folds: int = FOLDS) -> DataFrame:
    """Take in batch number ``batch`` (0, 1, ...) of interactions and return the
    correlators (action, item, other, llr, rank) after it, equal to those of
    one run over all batches.  Pairs that came before are left out, whichever
    batch they came in.

    An item is ranked again when its co-occurrence or marginal counts or those
    of an item it co-occurs with have changed; new users change the scores of
    all items, which are then all ranked again from the stored counts."""
    actions = [primary] + [a for a in secondaries if a != primary]
    got = cut_lineage(action_pairs(inter, actions).withColumn("fold", _fold(folds)))
    old = cut_lineage(pairs_of_users(spark, folder, batch, got))
    new = got.join(old.select("user", "action", "item"), ["user", "action", "item"], "left_anti")
    new = _write(new.select("user", "action", "item", "fold"), folder, "pairs", batch, "fold")

    both = old.unionByName(new)
    more = _pairs_on_user(new, both, primary).unionByName(_pairs_on_user(old, new, primary))
    cooc = _write(more.groupBy("action", "item", "other").agg(F.count(F.lit(1)).alias("k11")), folder, "cooc", batch)
    items = _write(new.where(F.col("action") == primary).groupBy("item").agg(F.count(F.lit(1)).alias("n_a")),
                   folder, "items", batch)
    others = _write(new.groupBy("action", F.col("item").alias("other")).agg(F.count(F.lit(1)).alias("n_b")),
                    folder, "others", batch)
    fresh = new.select("user").distinct().join(old.select("user").distinct(), "user", "left_anti")
    users = _write(fresh.agg(F.count(F.lit(1)).alias("n")), folder, "users", batch)

    k = log_of(spark, folder, "cooc", batch + 1)
    before = log_of(spark, folder, "ranked", 0)
    if batch:
        before = spark.read.schema(TABLES["ranked"]).parquet(f"{folder}/ranked/batch={batch - 1}")
    keep = before.limit(0)
    if not users.first()[0]:
        met = k.join(others.select("action", "other"), ["action", "other"], "left_semi")
        touched = met.select("item").unionByName(items.select("item")).unionByName(cooc.select("item")).distinct()
        touched = cut_lineage(touched)
        k = k.join(touched, "item", "left_semi")
        keep = before.join(touched, "item", "left_anti")
    k = k.groupBy("action", "item", "other").agg(F.sum("k11").alias("k11"))
    n_a = log_of(spark, folder, "items", batch + 1).groupBy("item").agg(F.sum("n_a").alias("n_a"))
    n_b = log_of(spark, folder, "others", batch + 1).groupBy("action", "other").agg(F.sum("n_b").alias("n_b"))
    total = log_of(spark, folder, "users", batch + 1).agg(F.sum("n")).first()[0]
    scores = with_llr(k.join(n_a, "item").join(n_b, ["action", "other"]), "k11", "n_a", "n_b", F.lit(total))
    ranked = correlator_topk(scores.where(F.col("llr") > 0), top_k)
    ranked = keep.unionByName(ranked.select("action", "item", "other", "llr", F.col("rank").cast("int").alias("rank")))
    return _write(ranked, folder, "ranked", batch)
