"""Event layout, document store and daily sketches."""

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recoflow.operators import sketches as SK
from recoflow.sources import docstore as DS
from recoflow.sources import eventdays as ED

D0 = datetime(2024, 1, 1)


def _events(spark, n=400, hours=2):
    rows = [(k, D0 + timedelta(hours=hours * k), ["view", "buy"][k % 2], k % 37, k % 11) for k in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, action string, user long, item long")


def _periods(spark, *rows):
    return spark.createDataFrame(list(rows), "period string, start timestamp, end timestamp")


def test_periods_read_their_days_only(spark, scratch):
    ev = _events(spark)
    ED.write_event_days(ev, scratch, files=3)
    per = _periods(spark, ("a", D0 + timedelta(days=3, hours=1), D0 + timedelta(days=4)),
                   ("b", D0 + timedelta(days=3), D0 + timedelta(days=5, hours=2)), ("none", D0, D0),
                   ("null", None, D0), ("late", D0 + timedelta(days=900), D0 + timedelta(days=901)))
    got = ED.events_in_periods(spark, scratch, per, ["buy"])
    want = sorted((p, r.event_id) for r in ev.collect() for p, s, e in [tuple(x) for x in per.collect()]
                  if s is not None and s <= r.ts < e and r.action == "buy")
    assert sorted((r.period, r.event_id) for r in got.collect()) == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*action[^\]]*dynamicpruning", plan.replace("\n", " "))
    # one narrow period: files of its day and action alone
    one = ED.events_in_periods(spark, scratch, _periods(spark, ("a", D0 + timedelta(days=7), D0 + timedelta(days=8))), ["view"])
    read = {f for f in one.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert read and all("day=2024-01-08/action=view" in f for f in read)


def test_a_changed_document_rewrites_one_fold(spark, scratch):
    docs = spark.createDataFrame([(i, float(i), [f"t{i}"]) for i in range(200)], "item long, pop_rank double, tags array<string>")
    v1 = DS.publish(spark, scratch, docs, folds=16)
    first = DS.manifest(spark, scratch, v1)
    v2 = DS.publish(spark, scratch, spark.createDataFrame([(7, -1.0, None)], docs.schema), before=v1, folds=16)
    second = DS.manifest(spark, scratch, v2)
    assert [f for f in first if second[f] != first[f]] == [f for f, v in second.items() if v == v2]
    assert sum(v == v2 for v in second.values()) == 1 and DS.latest_version(spark, scratch) == 2
    rows = {r.item: r.pop_rank for r in DS.read_all(spark, scratch, v2).collect()}
    assert rows == {i: -1.0 if i == 7 else float(i) for i in range(200)}
    assert {r.item: r.pop_rank for r in DS.read_all(spark, scratch, v1).collect()}[7] == 7.0      # the old version stays
    ids = spark.createDataFrame([(7,), (7,), (9,), (5000,), (None,)], "item long")
    found = DS.lookup(spark, scratch, ids, v2, folds=16)
    assert sorted((r.item, r.pop_rank) for r in found.collect()) == [(7, -1.0), (9, 9.0)]
    assert len({re.search(r"fold=(\d+)", f)[1] for f in found.inputFiles() if "/data/" in f}) <= 4
    assert DS.lookup(spark, scratch, docs.select("item"), v2, folds=16).count() == 200
    # the same once more, a deletion, and what may be cleaned up
    assert DS.publish(spark, scratch, spark.createDataFrame([(7, -1.0, None)], docs.schema), before=v1, folds=16) == v2
    v3 = DS.publish(spark, scratch, docs.limit(0), before=v2, deleted=ids, folds=16)
    assert DS.read_all(spark, scratch, v3).count() == 198
    assert all(re.search(r"version=[12]/", x) for x in DS.unreferenced(spark, scratch, keep=1))


def test_a_store_without_documents(spark, scratch):
    empty = spark.createDataFrame([], "item long, pop_rank double")
    v = DS.publish(spark, scratch, empty)
    assert DS.manifest(spark, scratch, v) == {} and DS.read_all(spark, scratch, v) is None
    assert DS.lookup(spark, scratch, spark.createDataFrame([(1,)], "item long"), v) is None


def test_sketches_of_days_unite_to_ranges(spark):
    ev = spark.range(40_000).selectExpr("id as event_id", "timestamp_seconds(1704067200 + id * 40) as ts", "'view' as action",
                                        "id % 9000 as user", "cast(null as long) as item")
    periods = spark.createDataFrame([("a", "2024-01-01", "2024-01-03"), ("b", "2024-01-02", "2024-01-19"), ("c", "2025-01-01", "2025-01-02")],
                                    "period string, first string, last string").selectExpr("period", "date(first) first", "date(last) last")
    got = {r.period: r for r in SK.range_cardinality(SK.daily_sketches(ev), periods).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].events == 6480 and abs(got["a"].users - 6480) < 0.03 * 6480
    assert abs(got["b"].users - 9000) < 0.03 * 9000 and got["b"]["items"] == 0
