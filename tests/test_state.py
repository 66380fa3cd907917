"""State kept batch by batch: correlators, bandit sums, panes."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recoflow.operators import bandit as BA
from recoflow.operators import incremental as INC
from recoflow.operators.correlators import llr_correlators
from recoflow.operators.popularity import popularity
from recoflow.streaming import jobs as J
from recoflow.streaming import panes as P

D0 = datetime(2024, 1, 1)
INTER = "user long, action string, item long, ts timestamp, event_id long"


def _events(n, users, seed, first=0):
    r = random.Random(seed)
    return [(r.randrange(*users), r.choice(["buy", "view", "view", "like"]), min(r.randrange(15), r.randrange(15)),
             D0 + timedelta(minutes=37 * (first + k)), first + k) for k in range(n)]


def _ranked(df):
    return sorted((r.action, r.item, r.other, round(r.llr, 9), r["rank"]) for r in df.collect())


def test_batches_equal_one_full_run(spark, scratch):
    # the second batch has no new user, the third repeats pairs and is all of old users but one
    batches = [_events(150, (0, 20), 1), _events(40, (3, 9), 2, 150)]
    batches.append(_events(30, (15, 21), 3, 190) + batches[0][:25])
    rows = []
    for k, b in enumerate(batches):
        rows += b
        got = INC.add_batch(spark, scratch, k, spark.createDataFrame(b, INTER), "buy", ["view"], top_k=4, folds=8)
        want = llr_correlators(spark.createDataFrame(rows, INTER), "buy", ["view"], top_k=4)
        assert _ranked(got) == _ranked(want), k
    # the same batch once more writes the same again
    again = INC.add_batch(spark, scratch, 2, spark.createDataFrame(batches[2], INTER), "buy", ["view"], top_k=4, folds=8)
    assert _ranked(again) == _ranked(want)
    # a batch that brings nothing changes nothing
    none = INC.add_batch(spark, scratch, 3, spark.createDataFrame(batches[0][:5], INTER), "buy", ["view"], top_k=4, folds=8)
    assert _ranked(none) == _ranked(want)


def test_a_batch_reads_the_pairs_of_its_users_only(spark, scratch):
    INC.add_batch(spark, scratch, 0, spark.createDataFrame(_events(300, (0, 60), 4), INTER), "buy", folds=16)
    new = spark.createDataFrame([(7,), (9,)], "user long").withColumn("fold", INC._fold(16))
    got = INC.pairs_of_users(spark, scratch, 1, new)
    assert {r.user for r in got.collect()} == {7, 9}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*fold", plan)


def test_bandit_sums_survive_a_replayed_batch(spark, scratch):
    log = spark.createDataFrame([(k % 3, [1.0, k / 7, (k % 5) / 5], [1, 0, -1][k % 4 % 3]) for k in range(60)],
                                "arm long, x array<double>, reward int").withColumn("n", F.monotonically_increasing_id())
    rows = log.drop("n").collect()
    parts = [spark.createDataFrame(rows[a:b], log.drop("n").schema) for a, b in ((0, 20), (20, 21), (21, 60))]

    def merged(batch, old):
        return J.added(BA.linucb_sums(batch, "arm", "x", "reward"), old, ["arm", "i", "j"], "a")
    for epoch in (0, 1, 1, 1, 2, 2):        # epochs 1 and 2 are tried again
        J.write_version(scratch, epoch, parts[epoch], merged)
    got = {(r.arm, r.i, r.j): r.a for r in BA.with_identity(spark.read.parquet(f"{scratch}/version=2")).collect()}
    want = {(r.arm, r.i, r.j): r.a for r in BA.linucb_stats(log.drop("n"), "arm", "x", "reward").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("kind, hours", [("popular", 6), ("trending", 12), ("hot", 18)])
def test_trends_of_panes_equal_the_batch_model_at_every_end(spark, kind, hours):
    inter = spark.createDataFrame(_events(250, (0, 9), 5), INTER).where("action = 'view'")
    panes = inter.groupBy(F.window("ts", "2 hours").start.alias("pane_start"), "item").agg(F.count("*").alias("n"))
    last = D0 + timedelta(hours=60)
    got = {}
    for r in P.trends_from_panes(panes, kind, 7200, hours * 3600, F.lit(last)).collect():
        got.setdefault(r.period_end, {})[r.item] = r.score
    first = inter.selectExpr("min(window(ts, '2 hours').start)").first()[0]
    ends = [first + timedelta(hours=h) for h in range(hours, 100, 2) if first + timedelta(hours=h) <= last]
    assert len(ends) > 10 and set(got) <= set(ends)
    for e in ends[::5]:
        want = {r.item: r.score for r in popularity(inter, kind, None, e.isoformat(sep=" "), hours * 3600).collect()}
        assert got.get(e, {}) == want, e
    with pytest.raises(ValueError):
        P.trends_from_panes(panes, "hot", 7200, 4 * 7200, F.lit(last))
