
import math
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from recoflow.functions.scalar import llr
from recoflow.operators import basket as B
from recoflow.operators.sampling import kfold_split

T0 = datetime(2024, 1, 1)
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _sessions_py(rows, gap):
    """Brute force: per user, sorted by (ts, event_id), split when the gap to
    the previous event exceeds ``gap`` seconds."""
    out = []
    by_user = {}
    for u, item, ts, eid in rows:
        by_user.setdefault(u, []).append((ts, eid, item))
    for u, evs in by_user.items():
        evs.sort()
        cur, start, prev = set(), None, None
        for ts, _, item in evs:
            if prev is not None and (ts - prev).total_seconds() > gap:
                out.append((u, start, tuple(sorted(cur))))
                cur, start = set(), None
            if start is None:
                start = ts
            cur.add(item)
            prev = ts
        out.append((u, start, tuple(sorted(cur))))
    return sorted(out)


events = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.integers(0, 72 * 60)), min_size=1, max_size=40)


@SLOW
@given(events, st.sampled_from([30, 90, 240]), st.sampled_from([3600, 6 * 3600, 86400]))
def test_sessions_match_brute_force(spark, evs, gap_minutes, bucket):
    rows = [(u, item, T0 + timedelta(minutes=m), k) for k, (u, item, m) in enumerate(evs)]
    df = spark.createDataFrame(rows, "user long, item long, ts timestamp, event_id long")
    got = sorted((r.user, r.session_start, tuple(r.items))
                 for r in B.basket_sessions(df, gap_minutes * 60, min_size=1, bucket_seconds=bucket).collect())
    assert got == _sessions_py(rows, gap_minutes * 60)


counts = st.tuples(*[st.integers(0, 50)] * 4)


@SLOW
@given(st.lists(counts, min_size=1, max_size=20))
def test_llr_symmetric_and_non_negative(spark, tables):
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    for r in df.select(llr("a", "b", "c", "d").alias("x"), llr("a", "c", "b", "d").alias("y"),
                       llr("d", "c", "b", "a").alias("z")).collect():
        assert r.x >= 0 and math.isclose(r.x, r.y, abs_tol=1e-9) and math.isclose(r.x, r.z, abs_tol=1e-9)


@SLOW
@given(st.lists(st.integers(0, 10 ** 9), min_size=1, max_size=50, unique=True), st.integers(2, 7))
def test_kfold_partitions_rows(spark, ids, k):
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    folds = kfold_split(df, "id", k).collect()
    assert len(folds) == len(ids) and all(0 <= r.fold < k for r in folds)
