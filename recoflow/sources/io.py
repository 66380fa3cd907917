"""Readers and writers: event log, delimited files, JSON lines, libsvm,
versioned item documents, score files and models.  Explicit schemas, never
inference."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("event", T.StringType()),
    T.StructField("entity_type", T.StringType()), T.StructField("entity_id", T.StringType()),
    T.StructField("target_type", T.StringType()), T.StructField("target_id", T.StringType()),
    T.StructField("properties", T.StringType()), T.StructField("ts", T.TimestampType())])

USER_SCHEMA = "id string, age int, gender string, occupation string, zipcode string"
RATING_SCHEMA = "user string, item string, rating double, epoch long"

# The 18 genre property names, in file order (flag columns 6..23).
GENRES = ["action", "adventure", "animation", "child", "comedy", "crime", "documentary", "drama",
          "fantasy", "film_noir", "horror", "musical", "mystery", "romance", "sci_fi", "thriller",
          "war", "western"]


def read_events(spark_or_df, path: str | None = None, *, entity_type=None, events=None, target_type=None,
                start=None, end=None, cols=None) -> DataFrame:
    """Scan an event table with filters on raw columns, so Parquet gets them
    pushed down.  ``cols`` maps logical names (event, entity_type,
    target_type, ts) to the table's column names."""
    df = spark_or_df.read.parquet(path) if isinstance(spark_or_df, SparkSession) else spark_or_df
    c = {"event": "event", "entity_type": "entity_type", "target_type": "target_type", "ts": "ts"}
    c.update(cols or {})
    if entity_type is not None:
        df = df.where(F.col(c["entity_type"]) == entity_type)
    if events is not None:
        df = df.where(F.col(c["event"]).isin(list(events)))
    if target_type is not None:
        df = df.where(F.col(c["target_type"]) == target_type)
    ts_t = df.schema[c["ts"]].dataType
    if start is not None:
        df = df.where(F.col(c["ts"]) >= F.lit(start).cast(ts_t))
    if end is not None:
        df = df.where(F.col(c["ts"]) < F.lit(end).cast(ts_t))
    return df


def to_event_log(users: DataFrame | None, items: DataFrame | None, ratings: DataFrame | None,
                 set_time: str = "2024-01-01 00:00:00", user_id="user", item_id="item") -> DataFrame:
    """One EVENT log from user, item and rating tables: ``$set`` events for
    users and items (all other columns as JSON text properties) and ``rate``
    events for ratings.  Event ids: ratings keep theirs; users and items get
    1e12 + id and 2e12 + id."""
    parts = []
    ts_set = F.lit(set_time).cast("timestamp_ntz")

    def set_events(df, id_col, etype, base):
        props = [c for c in df.columns if c != id_col]
        return df.select(
            (F.lit(base) + F.col(id_col).cast("bigint")).alias("event_id"), F.lit("$set").alias("event"),
            F.lit(etype).alias("entity_type"), F.col(id_col).cast("string").alias("entity_id"),
            F.lit(None).cast("string").alias("target_type"), F.lit(None).cast("string").alias("target_id"),
            F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in props])).alias("properties"),
            ts_set.alias("ts"))

    if users is not None:
        parts.append(set_events(users, user_id, "user", 1_000_000_000_000))
    if items is not None:
        parts.append(set_events(items, item_id, "item", 2_000_000_000_000))
    if ratings is not None:
        parts.append(ratings.select(
            "event_id", F.lit("rate").alias("event"), F.lit("user").alias("entity_type"),
            F.col("user").cast("string").alias("entity_id"), F.lit("item").alias("target_type"),
            F.col("item").cast("string").alias("target_id"),
            F.to_json(F.struct(F.col("rating").cast("string").alias("rating"))).alias("properties"),
            F.col("ts").cast("timestamp_ntz").alias("ts")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_users_pipe(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="|", schema=USER_SCHEMA)


def read_items_pipe(spark: SparkSession, path: str) -> DataFrame:
    """id|title|release|video release|url|unknown|18 genre flags -> (id,
    title, release_date, genres array of the names whose flag is 1)."""
    flag_cols = [f"g{i}" for i in range(len(GENRES))]
    schema = ", ".join(["id string", "title string", "release_date string", "video_date string", "url string",
                        "unknown string"] + [f"{c} string" for c in flag_cols])
    raw = spark.read.csv(path, sep="|", schema=schema, encoding="ISO-8859-1")
    genres = F.filter(F.array(*[F.when(F.col(c) == "1", F.lit(g)) for c, g in zip(flag_cols, GENRES)]),
                      lambda x: x.isNotNull())
    return raw.select("id", "title", F.try_to_timestamp("release_date", F.lit("dd-MMM-yyyy")).alias("release_date"),
                      genres.alias("genres"))


def read_ratings_tsv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", schema=RATING_SCHEMA)
    return raw.select("user", "item", "rating", F.timestamp_seconds("epoch").alias("ts"))


def read_ratings_colons(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="::", schema="user int, item int, rating double, epoch long")
    return raw.select("user", "item")


def read_ctr_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_reviews_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """One object literal per line (single quotes allowed); malformed lines
    land in ``_corrupt_record`` instead of being evaluated."""
    s = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    s = T.StructType(list(s.fields) + [T.StructField("_corrupt_record", T.StringType())])
    return spark.read.json(path, schema=s, allowSingleQuotes=True, mode="PERMISSIVE",
                           columnNameOfCorruptRecord="_corrupt_record")


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    r = spark.read.format("libsvm")
    if num_features:
        r = r.option("numFeatures", str(num_features))
    return r.load(path)


# --------------------------------------------------------------------------- item documents
def write_item_docs(docs: DataFrame, path: str, version: int) -> str:
    """Write a complete new version, then repoint ``CURRENT`` (written to a
    temporary name and renamed, so readers see the old or the new version,
    never a partial one).  Older versions stay until retired by the caller."""
    target = f"{path.rstrip('/')}/version={int(version)}"
    docs.write.mode("overwrite").parquet(target)
    sc = docs.sparkSession.sparkContext
    jvm = sc._jvm
    conf = sc._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/CURRENT")
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/CURRENT.tmp")
    fs = p.getFileSystem(conf)
    out = fs.create(tmp, True)
    out.write(bytearray(str(int(version)).encode()))
    out.close()
    # an overwriting rename: there is a CURRENT at every moment, and a failure raises
    over = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(
        fs.makeQualified(tmp), fs.makeQualified(p), over)
    return target


def read_item_docs(spark: SparkSession, path: str) -> DataFrame:
    """Read the version named by ``CURRENT``."""
    sc = spark.sparkContext
    jvm = sc._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/CURRENT")
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    stream = fs.open(p)
    version = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    stream.close()
    return spark.read.parquet(f"{path.rstrip('/')}/version={version}")


def retire_item_docs(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Delete all but the newest ``keep`` versions, never the one CURRENT
    names; returns the retired version numbers."""
    sc = spark.sparkContext
    jvm = sc._jvm
    root = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    cur_p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/CURRENT")
    stream = fs.open(cur_p)
    current = int(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip())
    stream.close()
    versions = sorted(int(st.getPath().getName().split("=", 1)[1]) for st in fs.listStatus(root)
                      if st.isDirectory() and st.getPath().getName().startswith("version="))
    retired = [v for v in versions[:-keep] if v != current] if keep > 0 else [v for v in versions if v != current]
    for v in retired:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version={v}"), True)
    return retired


def lookup_item_doc(docs: DataFrame, ids: DataFrame, id_col: str = "item") -> DataFrame:
    """Documents whose id is in ``ids`` (semi join)."""
    return docs.join(ids.select(id_col).distinct(), id_col, "left_semi")


def write_scores_csv(df: DataFrame, path: str, id_col: str = "id", score_col: str = "target") -> None:
    df.select(id_col, F.format_number(F.col(score_col), 5).alias(score_col)) \
      .select(id_col, F.regexp_replace(score_col, ",", "").alias(score_col)) \
      .write.mode("overwrite").csv(path, header=True)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)

