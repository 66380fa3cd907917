"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from recoflow.llm import hnsw
from recoflow.llm.queries import QUERIES
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<double>, label int, score double, shard int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 0.5, 2)
                                  for i, v in rows], SCHEMA)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, every=50, k=5):
    """(query, rank) -> (id, cosine) over distinct (id, vector) rows."""
    rows = sorted({(i, tuple(x + 0.0 for x in v)) for i, v in rows if i is not None and usable(v)})
    out = []
    for i, v in rows:
        if i % every:
            continue
        a = np.array(v) / max(map(abs, v))
        scored = []
        for j, w in rows:
            if (i, v) != (j, w) and len(v) == len(w):
                b = np.array(w) / max(map(abs, w))
                scored.append((-float(a @ b) / math.sqrt(float(a @ a) * float(b @ b)), j))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return out


def same(got, want):
    got, want = sorted(map(tuple, got)), sorted(want)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_hard_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    hot = rng.normal(size=6).tolist()
    rows += [(i, hot) for i in range(40, 70)] + [(50, hot), (None, hot), (100, None), (150, []), (200, [0.0] * 6),
             (250, [1.0, None, 0, 0, 0, 0]), (300, [float("nan")] * 6), (350, [float("inf"), 1, 0, 0, 0, 0]),
             (400, [1e200, -1e200, 0.0, 0, 0, 0]), (450, [1e-200, 0, 0, 0, 0, -0.0]), (500, [1.0, 2.0]), (501, [2.0, 1.0]),
             (550, rng.normal(size=6).tolist()), (550, rng.normal(size=6).tolist())]
    same(hnsw.nearest(frame(spark, rows)).collect(), brute(rows))


def test_fewer_candidates_and_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    same(hnsw.nearest(frame(spark, rows)).collect(), brute(rows))
    assert hnsw.nearest(frame(spark, [(0, [1.0, 0.0])])).collect() == []
    assert hnsw.nearest(frame(spark, [])).collect() == []


def test_recall_of_one_shard_and_its_stored_form():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3000, 32))
    keys = [f"{x:032x}" for x in sorted(rng.integers(0, 1 << 62, 3000).tolist())]
    keys = [k[16:] + k[:16] for k in keys]
    g = hnsw.build_graph(keys, vectors)
    assert g.near.max() < 3000 and (g.near != np.arange(3000)[:, None]).all()
    unit = hnsw.unit(vectors).astype(np.float32)
    got = g.search(unit[::30], 6, hnsw.EF_SEARCH)
    want = np.argsort(-(unit[::30] @ unit.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(got.tolist(), want.tolist())]) >= 0.95
    _, back, again = hnsw.loaded(hnsw.stored(keys, vectors, g) | {"ids": []})
    assert (back == vectors).all() and (again.search(unit[::30], 6, hnsw.EF_SEARCH) == got).all()


def test_selected_neighbours_are_diverse():
    sims = np.array([[0.9, 0.8, 0.7, -np.inf]], dtype=np.float32)
    between = np.array([[[1, .95, .1, 0], [.95, 1, .1, 0], [.1, .1, 1, 0], [0, 0, 0, 1]]], dtype=np.float32)
    assert hnsw.select_diverse(sims, between, 2).tolist() == [[True, False, True, False]]
    assert hnsw.select_diverse(sims, between, 3).tolist() == [[True, True, True, False]]


@pytest.mark.parametrize("folder", [SF_SMALL, "/root/testdata/sf0.1"])
def test_recall_on_the_table(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op13_nearest_neighbours"](spark, folder).collect()]
    want = brute(rows)
    assert len(got) == len(want)
    scores = {w[:2] + (w[2],): w[3] for w in want}
    assert len({g[:3] for g in got} & set(scores)) >= 0.9 * len(want)
    found = {(q, j): s for q, _, j, s in got}
    assert all(abs(s - found[q, j]) < 1e-12 for q, _, j, s in want if (q, j) in found)
