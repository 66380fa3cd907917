"""Session construction and lineage helpers.

On a cluster the session is built by the caller; ``get_spark`` is for tests,
the bench and local runs.  ``checkpoint_dir`` reads ``spark.checkpoint.dir``
from the session; only a local session may leave it unset (it then gets a
scratch folder): on a cluster that setting must name a shared folder.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # map_concat / map_from_entries with repeated keys: the right side wins
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "recoflow", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SCRATCH: str | None = None
_USED: dict[str, SparkSession] = {}     # table folders of this process, to be deleted at its end


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder from ``spark.checkpoint.dir`` (or the
    context's checkpoint folder).  When neither is set, a local session gets a
    scratch folder; any other master raises, since executors on other machines
    could not read a folder of the driver's machine."""
    global _SCRATCH
    cur = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not cur:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _SCRATCH is None:
            _SCRATCH = tempfile.mkdtemp(prefix="recoflow-ckpt-", dir="/tmp")
        cur = _SCRATCH
        try:
            spark.conf.set("spark.checkpoint.dir", cur)
        except Exception:  # some sessions refuse runtime changes of core settings
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(cur)
    return cur


def table_folder(spark: SparkSession) -> str:
    """This application's folder for written intermediate tables; it is
    deleted when the process ends (or by ``release``)."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"
    if folder not in _USED:
        if not _USED:
            atexit.register(release)
        _USED[folder] = spark
    return folder


def release() -> None:
    """Delete the intermediate tables of this process.  Frames that still read
    them must have been acted on or written before."""
    while _USED:
        folder, spark = _USED.popitem()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone: its folder stays for the cluster's own clean-up
            pass


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` once in the shared checkpoint folder and read it back.

    Re-reads prune columns, push filters down and give the planner file
    statistics; the table survives the loss of executors (a machine-local
    checkpoint is never used)."""
    spark = df.sparkSession
    path = f"{table_folder(spark)}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``cut_lineage`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().toUri().getPath().endswith(f"/tables/{spark.sparkContext.applicationId}"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
