"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

Usage: python tools/oracle_check.py [sf_dir] [key ...]
Compare = row count + column names + order-insensitive hash of rounded values.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, (float, np.floating)):
        if math.isnan(v):
            return None
        r = round(float(v), 6)
        return 0.0 if r == 0 else r
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (pd.Timestamp, _dt.datetime)):
        return pd.Timestamp(v).tz_localize(None).isoformat() if getattr(v, "tzinfo", None) else pd.Timestamp(v).isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if v is pd.NaT or v is pd.NA:
        return None
    return v


def frame_digest(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append(repr(tuple(_norm(x) for x in rec)))
    rows.sort()
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return cols, len(rows), h, rows


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, key, builder, sql, con):
    t0 = time.time()
    df = builder(spark, sf_dir)
    # object columns: a whole number beside a null stays a whole number
    sp = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    t1 = time.time()
    if sql is None:
        return {"key": key, "status": "rows-only", "rows": len(sp), "spark_s": round(t1 - t0, 2)}
    dk = con.execute(sql).df()
    a, b = frame_digest(sp), frame_digest(dk)
    ok = a[0] == b[0] and a[1] == b[1] and a[2] == b[2]
    res = {"key": key, "status": "match" if ok else "MISMATCH", "rows": a[1], "oracle_rows": b[1],
           "spark_s": round(t1 - t0, 2)}
    if not ok:
        res["cols"] = (a[0], b[0])
        sa, sb = set(a[3]), set(b[3])
        res["only_spark"] = sorted(sa - sb)[:3]
        res["only_oracle"] = sorted(sb - sa)[:3]
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    from recoflow.session import get_spark
    from recoflow.plans.registry import ORACLES, QUERIES, load_all
    load_all()
    spark = get_spark()
    con = duck(sf_dir)
    bad = 0
    for k in (keys or sorted(QUERIES)):
        try:
            r = compare(spark, sf_dir, k, QUERIES[k], ORACLES.get(k), con)
        except Exception as e:  # report and go on
            r = {"key": k, "status": "ERROR", "error": f"{type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"done: {len(keys or QUERIES)} keys, {bad} bad", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
