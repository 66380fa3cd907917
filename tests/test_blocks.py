"""Early-terminating walks through popularity lists."""

import datetime as dt
import random

from pyspark.sql import functions as F

from recoflow.operators.blocks import first_matches, may_hold, popularity_lists
from recoflow.operators.retrieval import recommend

DAY = dt.datetime(2024, 1, 1)
DOCS = "item long, pop_rank double, fields map<string,array<string>>, dates map<string,timestamp>"


def make_docs(spark, n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        dates = None if i % 17 == 0 else {"available_date": DAY + dt.timedelta(days=r.randrange(60))}
        if dates and i % 19:
            dates["expire_date"] = dates["available_date"] + dt.timedelta(days=20)
        rows.append((i, None if i % 3 else float(r.randrange(50)), {"c": [f"v{i % 7}", f"v{i % 5}"]} if i % 11 else None, dates))
    return rows, spark.createDataFrame(rows, DOCS)


def in_order(rows):
    return sorted(rows, key=lambda d: (d[1] is None, -(d[1] or 0), d[0]))


def alive(d, now):
    dates = d[3] or {}
    return "available_date" in dates and "expire_date" in dates and dates["available_date"] <= now < dates["expire_date"]


def walks_of(spark, rows):
    return spark.createDataFrame(rows, "walk string, name string, value string, need int, q_current_date timestamp").selectExpr(
        "*", "cast(null as string) as q_date_field", "cast(null as timestamp) as q_after", "cast(null as timestamp) as q_before")


def passes():
    return F.coalesce((F.col("dates")["available_date"] <= F.col("q_current_date"))
                      & (F.col("dates")["expire_date"] > F.col("q_current_date")), F.lit(False))


def test_walks_match_brute_force_and_end_early(spark):
    rows, docs = make_docs(spark, 3000)
    lists = popularity_lists(docs, block=8, group=4)
    walks = [(f"w{i}", "", "", 5 + i % 9, DAY + dt.timedelta(days=i % 60, hours=i)) for i in range(120)]
    walks += [(f"v{i}", "c", f"v{i % 8}", 6, DAY + dt.timedelta(days=i)) for i in range(40)]      # v7 is no value
    walks += [("far", "", "", 5, DAY + dt.timedelta(days=900))]                                  # nothing passes
    got = first_matches(walks_of(spark, walks), lists, passes(), may_hold("available_date", "expire_date"),
                        [F.col("item")], block=8, group=4, growth=4).collect()
    seen = {}
    for r in got:
        seen.setdefault(r.walk, set()).add(r.item)
    for walk, name, value, need, now in walks:
        of_list = [d for d in in_order(rows) if not name or value in ((d[2] or {}).get("c") or [])]
        want = [d[0] for d in of_list if alive(d, now)][:need]
        assert set(want) <= seen.get(walk, set()), walk
    # found rows follow walks x wanted documents: no walk has read its whole list
    assert len(got) < 6 * sum(w[3] for w in walks)


def test_twice_the_documents_find_no_more_rows(spark):
    found = []
    for n in (1500, 6000):
        _, docs = make_docs(spark, n)
        walks = walks_of(spark, [(f"w{i}", "", "", 10, DAY + dt.timedelta(days=20 + i % 30, hours=i)) for i in range(100)])
        found.append(first_matches(walks, popularity_lists(docs), passes(), may_hold("available_date", "expire_date"),
                                   [F.col("item")]).count())
    assert found[1] < 1.5 * found[0]


def test_every_query_with_its_own_filters(spark):
    """Dates, must, must-not and boosted fields, each query its own, against brute force."""
    rows, docs = make_docs(spark, 400, 3)
    r = random.Random(5)
    qs = []
    for i in range(40):
        fields = [("c", [f"v{r.randrange(7)}"], float(r.choice([-1, 0, 2])))] if i % 4 else None
        if i % 5 == 0:
            fields = [("c", ["v1", "v2"], 1.5), ("c", ["v3"], -1.0)]
        qs.append((i, None, 3 + i % 6, DAY + dt.timedelta(days=10 + i), fields))
    q = spark.createDataFrame(qs, "query_id int, user long, num int, current_date timestamp, "
                                  "fields array<struct<name:string,values:array<string>,bias:double>>")
    inter = spark.createDataFrame([], "user long, item long, action string, ts timestamp, event_id long")
    corr = spark.createDataFrame([], "action string, item long, other long, llr double, rank int")
    pop = docs.where("pop_rank is not null").selectExpr("item", "pop_rank as score")
    out = {}
    for x in recommend(q, corr, pop, inter, primary="buy", actions=["buy"], doc_props=docs.select("item", "fields", "dates")).collect():
        out.setdefault(x.query_id, []).append((x.rank, x.item, x.score))
    for i, _, num, now, fields in qs:
        scored = []
        for d in rows:
            has = set((d[2] or {}).get("c") or [])
            share = [(len(has & set(v)), b) for _, v, b in fields or []]
            if alive(d, now) and all(s > 0 for s, b in share if b < 0) and all(s == 0 for s, b in share if b == 0):
                scored.append((-sum(s * b for s, b in share if b > 0), d[1] is None, -(d[1] or 0), d[0]))
        want = [(k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:num])]
        assert sorted(out.get(i, [])) == want, i
