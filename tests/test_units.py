"""Hand-made frames for boundaries and reference quirks (FIXTURES.md section 4)."""

import math
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recoflow.functions.scalar import llr, ucb_delta, vec_cosine
from recoflow.operators import basket as B
from recoflow.operators import correlators as C
from recoflow.operators import entities as E
from recoflow.operators import metrics as M
from recoflow.operators import popularity as P
from recoflow.operators import sampling as S
from recoflow.operators.popularity import pop_dispatch
from recoflow.sources import io as IO


def _llr_py(k11, k12, k21, k22):
    def xlx(x):
        return 0.0 if x == 0 else x * math.log(x)
    n = k11 + k12 + k21 + k22
    row = xlx(n) - xlx(k11 + k12) - xlx(k21 + k22)
    col = xlx(n) - xlx(k11 + k21) - xlx(k12 + k22)
    mat = xlx(n) - xlx(k11) - xlx(k12) - xlx(k21) - xlx(k22)
    return max(0.0, 2 * (row + col - mat))


def test_llr_values_and_symmetry(spark):
    rows = [(1, 0, 0, 3), (2, 1, 1, 6), (0, 4, 4, 2), (5, 5, 5, 5), (10, 0, 0, 0)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    got = df.select(llr("a", "b", "c", "d").alias("x"), llr("a", "c", "b", "d").alias("y")).collect()
    for (a, b, c, d), r in zip(rows, got):
        assert r.x == pytest.approx(_llr_py(a, b, c, d) if _llr_py(a, b, c, d) >= 1e-9 else 0.0, abs=1e-9)
        assert r.x == pytest.approx(r.y, abs=1e-9)


def test_correlators_no_diagonal_and_zero_cells(spark):
    # 4 users x 3 items, item 'a' seen by all: never its own correlator
    data = [(u, "purchase", i, datetime(2024, 1, 1) + timedelta(minutes=k), k)
            for k, (u, i) in enumerate([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c"),
                                        (4, "a"), (4, "c"), (1, "c"), (2, "c")])]
    inter = spark.createDataFrame(data, "user long, action string, item string, ts timestamp, event_id long")
    corr = C.llr_correlators(inter, "purchase", [], top_k=50, max_events=500, materialize=False).collect()
    assert all(r.item != r.other for r in corr)
    assert all(r.llr > 0 for r in corr)


def test_session_gap_edge(spark):
    t0 = datetime(2024, 1, 1, 12)
    w = 3600
    rows = [(1, 1, t0, 1), (1, 2, t0 + timedelta(seconds=w), 2),                    # exactly w: same basket
            (1, 3, t0 + timedelta(seconds=2 * w, microseconds=1), 3),               # w + 1us: new basket
            (1, 4, t0 + timedelta(seconds=2 * w, microseconds=2), 4),
            (2, 5, t0, 5),                                                          # single-item user
            (1, 6, t0 + timedelta(days=1, seconds=10), 6)]                          # across the day bucket
    inter = spark.createDataFrame(rows, "user long, item long, ts timestamp, event_id long")
    b = B.basket_sessions(inter, w, min_size=1).orderBy("user", "session_start").collect()
    baskets = [(r.user, list(r.items)) for r in b]
    assert baskets == [(1, [1, 2]), (1, [3, 4]), (1, [6]), (2, [5])]
    assert sorted(list(r.items) for r in B.basket_sessions(inter, w, min_size=2).collect()) == [[1, 2], [3, 4]]


def test_session_buckets_carry_across_days(spark):
    # events every 30 minutes over three days form one session whatever the bucket
    t0 = datetime(2024, 1, 1)
    rows = [(1, i % 5, t0 + timedelta(minutes=30 * i), i) for i in range(150)]
    inter = spark.createDataFrame(rows, "user long, item long, ts timestamp, event_id long")
    for bucket in (3600, 86400):
        b = B.basket_sessions(inter, 3600, min_size=1, bucket_seconds=bucket).collect()
        assert len(b) == 1 and b[0].session_start == t0


def test_popularity_thirds(spark):
    end = "2024-01-31 00:00:00"
    d = 3 * 86400
    e = datetime(2024, 1, 31)
    s = e - timedelta(seconds=d)
    third = timedelta(days=1)
    rows = []
    k = 0
    # item 'all' in all thirds (1, 2, 4 events), 'new' only in the newest, 'none' outside the range
    for n, start in ((1, s), (2, s + third), (4, s + 2 * third)):
        for _ in range(n):
            rows.append(("u", "buy", "all", start + timedelta(hours=1), k)); k += 1
    rows.append(("u", "buy", "new", e - timedelta(hours=1), k)); k += 1
    rows.append(("u", "buy", "none", e, k)); k += 1                      # end is excluded
    inter = spark.createDataFrame(rows, "user string, action string, item string, ts timestamp, event_id long")
    pop = {r.item: r.score for r in P.popularity(inter, "popular", ["buy"], end, d).collect()}
    assert pop == {"all": 7.0, "new": 1.0}
    hot = {r.item: r.score for r in P.popularity(inter, "hot", ["buy"], end, d).collect()}
    assert hot == {"all": (4 - 2) - (2 - 1)}
    assert pop_dispatch(inter, "nope", ["buy"], end, d) is None


def test_property_fold_newest_wins(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, "$set", "user", "u1", None, None, '{"a":"1","b":"x"}', t),
            (2, "$set", "user", "u1", None, None, '{"a":"2"}', t + timedelta(hours=1)),
            (3, "$set", "user", "u1", None, None, '{"a":"3"}', t + timedelta(hours=1)),   # same time, higher id wins
            (4, "$set", "user", "u2", None, None, '{"c":"9"}', t),
            (5, "rate", "user", "u2", "item", "i1", '{"rating":"4"}', t)]
    ev = spark.createDataFrame(rows, IO.EVENT_SCHEMA)
    p = {r.entity_id: dict(r.props) for r in E.aggregate_properties(ev, "user").collect()}
    assert p == {"u1": {"a": "3", "b": "x"}, "u2": {"c": "9"}}


def test_constraints_newest_wins(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, "$set", "constraint", "unavailableItems", None, None, '{"items":["a","b"]}', t),
            (2, "$set", "constraint", "unavailableItems", None, None, '{"items":["c"]}', t + timedelta(hours=1)),
            (3, "$set", "constraint", "weightedItems", None, None,
             '{"weights":[{"items":["a","b"],"weight":1.5},{"items":["b"],"weight":0.5}]}', t)]
    ev = spark.createDataFrame(rows, IO.EVENT_SCHEMA)
    assert [r.item for r in E.latest_constraint(ev, "unavailableItems").collect()] == ["c"]
    w = {r.item: r.weight for r in E.latest_weights(ev).collect()}
    assert w == {"a": 1.5, "b": 0.5}
    items = spark.createDataFrame([("a",), ("z",)], "item string")
    got = {r.item: r.weight for r in E.item_weights(items, E.latest_weights(ev)).collect()}
    assert got == {"a": 1.5, "z": 1.0}


def test_recommend_must_filters_match_brute_force(spark):
    from recoflow.operators.retrieval import recommend
    d = datetime(2024, 1, 1)
    items = list(range(1, 9))
    corr = [("buy", i, t, 1.0, 1) for i in items for t in ([100] if i % 2 == 0 else []) + ([101] if i % 3 == 0 else [])]
    corr_df = spark.createDataFrame(corr, "action string, item long, other long, llr double, rank int")
    pop = spark.createDataFrame([(i, float(9 - i)) for i in items if i != 8], "item long, score double")
    inter = spark.createDataFrame([(1, "buy", x, d + timedelta(hours=k), k) for k, x in enumerate([100, 101, 2])],
                                  "user long, action string, item long, ts timestamp, event_id long")
    colour = {i: ("red" if i % 2 else "blue") for i in items}
    dates = {i: {"d": d + timedelta(days=i), "available_date": d + timedelta(days=i),
                 "expire_date": d + timedelta(days=i + 5)} for i in items}
    dp = spark.createDataFrame([(i, {"color": [colour[i]]}, dates[i]) for i in items],
                               "item long, fields map<string,array<string>>, dates map<string,timestamp>")
    F_T = "array<struct<name:string,values:array<string>,bias:double>>"
    qrows = [(1, 1, [("color", ["red"], -1.0)], None, None, None, None, 3),
             (2, 2, None, "d", d + timedelta(days=3), d + timedelta(days=8), None, 2),
             (3, 3, None, None, None, None, d + timedelta(days=6), 10),
             (4, 1, None, None, None, None, None, 2),
             (5, 2, [("color", ["red"], 0.0)], None, None, None, None, 3)]
    q = spark.createDataFrame(qrows, f"query_id long, user long, fields {F_T}, date_field string, after timestamp, "
                                     "before timestamp, current_date timestamp, num int")
    got = {}
    for r in recommend(q, corr_df, pop, inter, primary="buy", actions=["buy"], doc_props=dp).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.item, r.score))

    def brute(qid, user, fields, date_field, after, before, now, num):
        bought = {100, 101, 2} if user == 1 else set()
        out = []
        for i in items:
            if i in bought:
                continue
            if fields and any(b < 0 and not (set(v) & {colour[i]}) for _, v, b in fields):
                continue
            if fields and any(b == 0 and (set(v) & {colour[i]}) for _, v, b in fields):
                continue
            if after and not dates[i][date_field] > after or before and not dates[i][date_field] < before:
                continue
            if now and not (dates[i]["available_date"] <= now < dates[i]["expire_date"]):
                continue
            score = float((i % 2 == 0) + (i % 3 == 0)) if user == 1 else 0.0
            pop_rank = 9 - i if i != 8 else None
            out.append((-score, -(pop_rank if pop_rank is not None else -1e9), i, score))
        out.sort()
        return [(k + 1, i, s) for k, (_, _, i, s) in enumerate(out[:num])]

    for row in qrows:
        assert got.get(row[0], []) == brute(*row), row[0]


def test_negative_user_bias_requires_a_match(spark):
    from recoflow.operators.retrieval import recommend
    d = datetime(2024, 1, 1)
    corr = spark.createDataFrame([("buy", 1, 100, 1.0, 1), ("buy", 2, 100, 1.0, 1), ("buy", 3, 101, 1.0, 1),
                                  ("buy", 4, 999, 1.0, 1)],
                                 "action string, item long, other long, llr double, rank int")
    pop = spark.createDataFrame([(4, 10.0), (1, 1.0), (2, 2.0), (3, 3.0)], "item long, score double")
    inter = spark.createDataFrame([(1, "buy", 100, d, 1), (1, "buy", 2, d + timedelta(hours=1), 2)],
                                  "user long, action string, item long, ts timestamp, event_id long")
    q = spark.createDataFrame([(1, 1)], "query_id long, user long")
    boost = [(r.item, r.score) for r in recommend(q, corr, pop, inter, primary="buy", actions=["buy"],
                                                  default_num=5).orderBy("rank").collect()]
    must = [(r.item, r.score) for r in recommend(q, corr, pop, inter, primary="buy", actions=["buy"], user_bias=-1,
                                                 default_num=5).orderBy("rank").collect()]
    assert boost == [(1, 1.0), (4, 0.0), (3, 0.0)]       # item 2 bought: excluded; backfill by popularity
    assert must == [(1, 0.0)]                             # only items matching the history, no boost


def test_metrics_bounds_and_ties(spark):
    perfect = spark.createDataFrame([(i, 1 if i < 5 else 0, float(10 - i)) for i in range(10)], "id long, label int, score double")
    assert M.auc(perfect).collect()[0].auc == pytest.approx(1.0)
    rev = perfect.withColumn("score", -F.col("score"))
    assert M.auc(rev).collect()[0].auc == pytest.approx(0.0)
    tied = perfect.withColumn("score", F.lit(0.5))
    assert M.auc(tied).collect()[0].auc == pytest.approx(0.5)
    g = M.gini_norm(perfect, "label", "score", "id").collect()[0]
    assert g.gini_norm == pytest.approx(1.0)


def test_ucb_delta_default(spark):
    df = spark.createDataFrame([(10, 0), (10, 4)], "t long, n long")
    r = df.select(ucb_delta("t", "n").alias("d")).collect()
    assert r[0].d == 1.0 and r[1].d == pytest.approx(math.sqrt(2 * math.log(10) / 4))


def test_cosine_zero_norm(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(vec_cosine("a", "b").alias("c")).collect()[0].c == 0.0


def test_negatives_never_meet_positives(spark):
    rows = [(k, u, i) for k, (u, i) in enumerate([(1, 1), (1, 2), (1, 3), (2, 1), (2, 9)])]
    pos = spark.createDataFrame(rows, "event_id long, user long, item long")
    items = spark.range(0, 12).select(F.col("id").alias("item"))
    neg = S.negatives(pos, pos.select("user", "item"), items, 4, 7).collect()
    seen = {(u, i) for _, u, i in rows}
    assert all((r.user, r.neg_item) not in seen for r in neg)
    per = {}
    for r in neg:
        per.setdefault(r.event_id, set()).add(r.neg_item)
    assert all(len(v) == 4 for v in per.values()) and len(per) == len(rows)


def test_capped_history_equals_window_form(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(u, (u * 7 + k) % 11, t0 + timedelta(minutes=k * (u + 1)), u * 100 + k)
            for u in range(3) for k in range([1, 2, 9][u])]
    inter = spark.createDataFrame(rows, "user long, item long, ts timestamp, event_id long")
    full = {r.event_id: list(r.history) for r in S.history_prefix(inter).collect()}
    capped = {r.event_id: (r.pos, list(r.history)) for r in S.history_prefix(inter, cap=3).collect()}
    assert set(full) == set(capped)
    for eid, h in full.items():
        assert capped[eid][1] == h[-3:]
        assert capped[eid][0] == len(h) + 1


def test_global_row_number_is_stable(spark):
    from pyspark.sql import Window
    from recoflow.operators.ranking import global_row_number
    df = spark.range(0, 5000).select(F.col("id"), (F.col("id") * 7919 % 613).alias("k"))
    ref = df.select("id", F.row_number().over(Window.orderBy("k", "id")).alias("rn"))
    g = global_row_number(df, [F.col("k"), F.col("id")], "g")
    for _ in range(3):     # range boundaries are re-sampled per evaluation
        j = g.join(ref, "id")
        assert j.where("g != rn").count() == 0 and j.count() == 5000


def test_folds_partition_rows(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    f = S.stratified_kfold(df, "label", "id", 5, 7).groupBy("fold", "label").count().collect()
    assert sum(r["count"] for r in f) == 1000
    k = S.kfold_split(df, "id", 5).groupBy("fold").count().collect()
    assert len(k) == 5 and sum(r["count"] for r in k) == 1000


def test_io_round_trips(spark, scratch):
    users = os.path.join(scratch, "u.user")
    with open(users, "w") as fh:
        fh.write("1|24|M|technician|85711\n2|53|F|other|T8H1N\n")
    u = IO.read_users_pipe(spark, users).collect()
    assert u[1].zipcode == "T8H1N" and u[0].age == 24
    items = os.path.join(scratch, "u.item")
    flags = ["0"] * 18
    flags[1] = "1"
    with open(items, "w", encoding="ISO-8859-1") as fh:
        fh.write("|".join(["7", "Caf\xe9 (1995)", "01-Jan-1995", "", "http://x", "0"] + flags) + "\n")
    it = IO.read_items_pipe(spark, items).collect()[0]
    assert it.title == "Caf\xe9 (1995)" and list(it.genres) == ["adventure"]
    tsv = os.path.join(scratch, "u.data")
    with open(tsv, "w") as fh:
        fh.write("1\t7\t5\t874965758\n")
    r = IO.read_ratings_tsv(spark, tsv).collect()[0]
    assert r.rating == 5.0 and r.ts is not None
    colons = os.path.join(scratch, "ratings.dat")
    with open(colons, "w") as fh:
        fh.write("1::7::5::978300760\n")
    assert IO.read_ratings_colons(spark, colons).collect()[0].item == 7
    js = os.path.join(scratch, "reviews.json")
    with open(js, "w") as fh:
        fh.write("{'reviewerID': 'A1', 'asin': 'B1', 'unixReviewTime': 5}\nnot json\n")
    j = IO.read_reviews_json(spark, js, "reviewerID string, asin string, unixReviewTime long").collect()
    assert j[0].asin == "B1" and j[1]._corrupt_record == "not json"
    csv = os.path.join(scratch, "train.csv")
    with open(csv, "w") as fh:
        fh.write("id,target,ps_a\n1,0,-1\n2,1,3\n")
    assert IO.read_ctr_csv(spark, csv, "id long, target int, ps_a int").count() == 2
    svm = os.path.join(scratch, "s.libsvm")
    with open(svm, "w") as fh:
        fh.write("1 1:0.5 3:1.0\n0 2:2.0\n")
    assert IO.read_libsvm(spark, svm, 4).count() == 2


def test_item_docs_versions(spark, scratch):
    path = os.path.join(scratch, "docs")
    d1 = spark.createDataFrame([(1, 1.0)], "item long, pop_rank double")
    d2 = spark.createDataFrame([(1, 2.0), (2, 1.0)], "item long, pop_rank double")
    IO.write_item_docs(d1, path, 1)
    assert IO.read_item_docs(spark, path).count() == 1
    IO.write_item_docs(d2, path, 2)
    assert IO.read_item_docs(spark, path).count() == 2
    ids = spark.createDataFrame([(2,)], "item long")
    assert IO.lookup_item_doc(IO.read_item_docs(spark, path), ids).collect()[0].pop_rank == 1.0
    IO.write_item_docs(d1, path, 3)
    assert IO.retire_item_docs(spark, path, keep=1) == [1, 2]
    names = os.listdir(path)
    assert "version=3" in names and "version=1" not in names and "version=2" not in names
    assert IO.read_item_docs(spark, path).count() == 1


def test_scores_csv_and_model(spark, scratch):
    df = spark.createDataFrame([(1, 0.123456789)], "id long, target double")
    out = os.path.join(scratch, "sub")
    IO.write_scores_csv(df, out, "id", "target")
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert "0.12346" in text
    from pyspark.ml.feature import StringIndexer
    m = StringIndexer(inputCol="id_s", outputCol="ix").fit(df.select(F.col("id").cast("string").alias("id_s")))
    IO.save_model(m, os.path.join(scratch, "model"))
    assert os.path.isdir(os.path.join(scratch, "model"))
