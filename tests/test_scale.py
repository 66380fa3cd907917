"""Hot keys, bounds that bite, and options that the registered queries' tables
do not stress."""

import itertools
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recoflow.operators import basket as B
from recoflow.operators import correlators as C
from recoflow.operators import features as FE
from recoflow.operators import interactions as I
from recoflow.operators import ranking as R
from recoflow.operators import sampling as S
from recoflow.operators.joins import blocked_join

D0 = datetime(2024, 1, 1)


def _inter(spark, rows):
    return spark.createDataFrame([(u, a, i, D0 + timedelta(minutes=k), k) for k, (u, a, i) in enumerate(rows)],
                                 "user long, action string, item long, ts timestamp, event_id long")


def test_user_total_is_counted_before_the_caps(spark):
    # item 1 has 30 buyers; a cap of 5 users per item drops most of them
    inter = _inter(spark, [(u, "buy", 1) for u in range(30)] + [(u, "buy", 2) for u in range(3)] + [(99, "buy", 3)])
    pairs = C.action_pairs(inter, ["buy"])
    capped = I.interaction_cap(pairs, 5, 5, 7)
    assert capped.where("item = 1").count() == 5 and capped.select("user").distinct().count() < 31
    low = C.llr_scores(capped, "buy", 31).where("k11 > 0").collect()
    high = C.llr_scores(capped, "buy").where("k11 > 0").collect()
    all_ = C.llr_correlators(inter, "buy", [], max_events=5, materialize=False).collect()
    if low:
        assert {(r.item, r.other): r.llr for r in low} != {(r.item, r.other): r.llr for r in high}
        assert {round(r.llr, 9) for r in all_} <= {round(r.llr, 9) for r in low}


def test_caps_draw_by_hash_not_by_age(spark):
    inter = _inter(spark, [(u, "buy", 1) for u in range(200)])
    kept = {r.user for r in I.interaction_cap(C.action_pairs(inter, ["buy"]), 500, 50, 7).collect()}
    assert len(kept) == 50 and kept != set(range(150, 200)) and kept != set(range(50))


@pytest.mark.parametrize("hot", [2, 1000])
def test_blocked_join_equals_a_join(spark, hot):
    left = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("k"), F.col("id").alias("a"))
    right = spark.range(120).select((F.col("id") % 60).alias("k"), F.col("id").alias("b"))
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, blocked_join(left, right, ["k"], "a", hot).collect())) == want


def test_hot_key_is_spread_over_tasks(spark):
    left = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        j = blocked_join(left, right, ["k"], "a").withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in j.where("k = 0").groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 6667 and len(sizes) > 4 and max(sizes) < 6667 / 2


def test_itemsets_never_pass_max_len(spark):
    rows = spark.createDataFrame([(b, i) for b in (1, 2) for i in range(12)], "basket long, item long")
    got = B.itemset_count(rows, 3, 0.6).collect()
    assert len(got) == 12 + 66 + 220 and {r["count"] for r in got} == {2} and max(r.size for r in got) == 3
    assert B.itemset_count(rows.limit(0), 3, 0.6).count() == 0


def test_rule_lookup_reports_one_real_rule(spark):
    rules = spark.createDataFrame([([1], 9, 0.9, 1.0), ([2], 9, 0.1, 5.0), ([1, 2], 8, 0.5, 1.5), ([1, 3], 7, 0.99, 9.0)],
                                  "cond array<long>, conseq long, confidence double, lift double")
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 9)], "basket long, item long")
    got = [tuple(r) for r in B.rule_lookup(rows, rules, 5, 2).orderBy("basket", "rank").collect()]
    assert got == [(1, 9, 0.9, 1.0, 1), (1, 8, 0.5, 1.5, 2)]


def test_null_categories_keep_their_slot(spark):
    df = spark.createDataFrame([(1, 0, "a", 1.5), (2, 1, None, 2.0), (3, 0, "b", None)],
                               "id long, target int, f_cat string, f_num double")
    d = FE.feature_dictionary(df, ["f_num"], ["id", "target"])
    slots = {(r.field, r.value): r.feat_index for r in d.collect()}
    e = {(r.row_id, r.field): (r.feat_index, r.feat_value) for r in FE.encode_samples(df, d, "id", "target").collect()}
    assert e[(2, "f_cat")] == (slots[("f_cat", None)], 1.0)
    assert e[(1, "f_num")] == (slots[("f_num", "")], 1.5) and e[(3, "f_num")] == (slots[("f_num", "")], None)
    unseen = df.limit(1).withColumn("f_cat", F.lit("new"))
    assert [r.feat_index for r in FE.encode_samples(unseen, d, "id", "target").where("field = 'f_cat'").collect()] == [4]


def test_negatives_are_unseen_different_and_not_tied(spark):
    items = spark.range(100).select(F.col("id").alias("item"))
    seen = spark.createDataFrame([(u, i) for u in range(5) for i in range(u * 20)] + [(9, i) for i in range(97)], "user long, item long")
    pos = spark.createDataFrame([(k, k % 5, 1) for k in range(40)] + [(100, 9, 3), (101, 77, 3)], "event_id long, user long, item long")
    got = S.negatives(pos, seen, items, 6, 7).collect()
    have = {(r.user, r.item) for r in seen.collect()}
    per = {}
    for r in got:
        assert (r.user, r.neg_item) not in have
        per.setdefault(r.event_id, []).append(r.neg_item)
    assert all(len(v) == len(set(v)) for v in per.values())
    assert len(per[100]) == 3 and len(per[101]) == 6 and all(len(per[k]) == 6 for k in range(40))
    assert len({tuple(sorted(per[k])) for k in range(0, 40, 5)}) > 1     # same user, different rows


def test_histories_of_a_hot_user(spark):
    rows = [(1, "view", k % 7) for k in range(400)] + [(2, "view", 5)]
    inter = _inter(spark, rows)
    for cap in (None, 150):
        got = {(r.user, r.pos): r.history for r in S.history_prefix(inter, cap).collect()}
        for p in range(1, 401):
            want = [k % 7 for k in range(p - 1)]
            assert got[(1, p)] == (want if cap is None else want[-cap:])
        assert got[(2, 1)] == []


def test_global_positions_take_one_range_shuffle(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), F.col("id"))
    plan = R._ranged(df, [F.col("k"), F.col("id")], 4)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange") == 1
    got = R.global_running_sum(df, [F.col("k"), F.col("id")], "k", "s", position="p").orderBy("p").collect()
    total = 0
    for n, r in enumerate(got):
        total += r.k
        assert (r.p, r.s) == (n + 1, total)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from recoflow import session

    class Context:
        master = "spark://somewhere:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Conf:
        @staticmethod
        def get(key, default=None):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_repeats_across_micro_batches_are_dropped(spark):
    from recoflow.streaming import jobs as J
    ev = spark.createDataFrame([(k, D0 + timedelta(hours=k), k % 3, "purchase", 1.0, '{"k": 1}') for k in range(40)],
                               "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                               .replace("timestamp_ntz", "timestamp")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    folder, files = J.split_feed(ev, 4)
    assert spark.read.parquet(folder).count() > 40
    s = J.read_event_stream(spark, folder, "*.parquet", max_files=files).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    out = J.run_to_table(s.groupBy("user").agg(F.count(F.lit(1)).alias("n")), "t", mode="update", keys=["user"])
    assert {r.user: r.n for r in out.collect()} == {0: 14, 1: 13, 2: 13}


def _brute_itemsets(baskets, max_len, min_support):
    least = min_support * len(baskets)
    n = Counter(c for b in baskets for k in range(1, max_len + 1) for c in itertools.combinations(sorted(b), k))
    return {c: v for c, v in n.items() if v >= least}


@pytest.mark.parametrize("wide", [128, 4, 1])
def test_itemsets_match_brute_force_for_any_width(spark, wide):
    r = random.Random(3)
    baskets = [set(r.sample(range(12), r.choice([1, 2, 3, 4, 5]))) for _ in range(60)] + [set(range(12)), set(range(2, 11)), set()]
    baskets += [{1, 2, 3, 4}] * 5
    rows = spark.createDataFrame([(i, x) for i, b in enumerate(baskets) for x in b], "basket long, item long")
    got = {tuple(x.itemset): x["count"] for x in B.itemset_count(rows, 4, 0.08, wide=wide).collect()}
    assert got == _brute_itemsets([b for b in baskets if b], 4, 0.08)


def test_a_very_wide_basket_forms_no_pairs(spark, monkeypatch):
    """5,000 frequent items in one basket: what is projected, and what the
    basket answers, stays in proportion to its items."""
    wide = [("w", x) for x in range(5000)]
    small = [(f"s{i}-{k}", x) for i in range(0, 5000, 4) for k in range(3) for x in (i, i + 1, i + 2, i + 3)]
    rows = spark.createDataFrame(wide + small, "basket string, item long")
    written = []
    real = B.cut_lineage

    def counted(df):
        out = real(df)
        written.append(out.count())
        return out
    monkeypatch.setattr(B, "cut_lineage", counted)
    got = B.itemset_count(rows, 5, 3.5 / 3751)
    assert max(written) <= 2 * rows.count()
    sizes = {x.size: (x.n, x.low, x.top) for x in got.groupBy("size").agg(
        F.count("*").alias("n"), F.min("count").alias("low"), F.max("count").alias("top")).collect()}
    assert sizes == {1: (5000, 4, 4), 2: (7500, 4, 4), 3: (5000, 4, 4), 4: (1250, 4, 4)}
