"""Item documents by key: dealt to folds by a hash of the id, in versions that
hold only the folds that changed.

``data/version=<v>/fold=<f>`` holds the whole fold f as of version v;
``manifest/version=<v>`` names, for every fold, the version that holds it.  The
manifest is written last, in one small file, so readers find a version whole
or not at all.  A lookup opens the folds of the ids it is asked for; publishing
a change reads and writes the folds of the changed ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.session import cut_lineage

FOLDS = 64


def _fold(col: str, folds: int):
    return F.pmod(F.xxhash64(F.col(col)), F.lit(folds)).cast("int")


def manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """fold -> version that holds it (folds without documents are left out)."""
    rows = spark.read.schema("fold int, held int").parquet(f"{path}/manifest/version={version}").collect()
    return {r.fold: r.held for r in rows}


def latest_version(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/manifest").agg(F.max("version")).first()[0]


def _folds(spark: SparkSession, path: str, held: dict[int, int], folds) -> DataFrame | None:
    paths = [f"{path}/data/version={held[f]}/fold={f}" for f in sorted(set(folds) & set(held))]
    if not paths:
        return None
    return spark.read.option("basePath", f"{path}/data").parquet(*paths).drop("version", "fold")


def publish(spark: SparkSession, path: str, docs: DataFrame, before: int | None = None, deleted: DataFrame | None = None,
            id_col: str = "item", folds: int = FOLDS) -> int:
    """Publish changed or new documents (one row an id) and the ids in
    ``deleted``, on top of version ``before`` (None: an empty store); returns
    the new version's number.  Publishing the same again writes the same."""
    held = manifest(spark, path, before) if before is not None else {}
    version = 1 if before is None else before + 1
    changed = cut_lineage(docs.withColumn("fold", _fold(id_col, folds)))
    ids = changed.select(id_col, "fold")
    if deleted is not None:
        ids = ids.unionByName(deleted.select(id_col).withColumn("fold", _fold(id_col, folds)))
    ids = cut_lineage(ids.distinct())
    touched = [r.fold for r in ids.select("fold").distinct().collect()]      # at most ``folds`` numbers
    old = _folds(spark, path, held, touched)
    rows = changed
    if old is not None:
        kept = old.join(ids.select(id_col), id_col, "left_anti")
        rows = rows.unionByName(kept.withColumn("fold", _fold(id_col, folds)))
    target = f"{path}/data/version={version}"
    rows.repartition("fold").write.mode("overwrite").partitionBy("fold").parquet(target)
    filled = {r.fold for r in spark.read.schema(rows.schema).parquet(target).select("fold").distinct().collect()}
    held = {f: v for f, v in held.items() if f not in touched} | {f: version for f in filled}
    names = spark.createDataFrame(sorted(held.items()), "fold int, held int").coalesce(1)
    names.write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    return version


def read_all(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    held = manifest(spark, path, version)
    return _folds(spark, path, held, held)


def lookup(spark: SparkSession, path: str, ids: DataFrame, version: int, id_col: str = "item", folds: int = FOLDS) -> DataFrame | None:
    """Documents of the asked ids, from their folds alone (None: none of those
    folds holds a document)."""
    asked = ids.select(id_col).distinct().withColumn("fold", _fold(id_col, folds))
    need = [r.fold for r in asked.select("fold").distinct().collect()]      # at most ``folds`` numbers
    docs = _folds(spark, path, manifest(spark, path, version), need)
    return docs if docs is None else docs.join(asked.select(id_col), id_col, "left_semi")


def unreferenced(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Fold folders that none of the newest ``keep`` versions names: what a
    clean-up may delete."""
    last = latest_version(spark, path)
    named = {(v, f) for k in range(max(1, last - keep + 1), last + 1) for f, v in manifest(spark, path, k).items()}
    there = spark.read.parquet(f"{path}/manifest").select(F.col("held").alias("v"), "fold").distinct().collect()
    return [f"{path}/data/version={r.v}/fold={r.fold}" for r in sorted(there) if (r.v, r.fold) not in named]
