"""Approximate nearest neighbours: a navigable small-world graph per shard.

Vectors are dealt to shards by a hash of their content; each shard's graph is
built by one task and stored as a row of flat arrays (vectors, node levels,
neighbours of layer 0, neighbours of the upper layers), so a search reads a
written index.  Queries meet every shard's row in blocks; the shard results
are merged by score.

Only distinct vectors are indexed: copies of one vector would fill each
other's neighbour lists and cut the graph.  A class of equal vectors keeps its
``k + 1`` smallest ids, which is all that a result of k rows without the
query's own can show.  Graph distances are float32; scores are cosines of the
original vectors in double precision.

Inserts and searches run in lockstep over a batch of vectors: every step
expands the best open candidates of all of them with a few numpy calls.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import skew_lookup
from recoflow.operators.ranking import topn_per_group
from recoflow.session import cut_lineage

M, EF_BUILD, EF_SEARCH = 16, 80, 96     # links a node (2 M on layer 0), beam widths
SHARD_ROWS, QUERY_BLOCK = 8192, 4096
BATCH, EXPAND = 256, 4                  # vectors in lockstep, candidates they expand a step
INDEX_FIELDS = ("dim int, shard int, vkeys array<string>, ids array<long>, held array<int>, vectors array<double>, levels array<int>, "
                "near array<int>, upper array<int>, entry int")


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; the largest component is taken
    out first, so no square over- or underflows."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def select_diverse(sims: np.ndarray, between: np.ndarray, m: int) -> np.ndarray:
    """Mask of at most ``m`` candidates a row: in order of similarity, those
    nearer to the centre than to any candidate taken before; places left over
    go to the nearest others.  ``sims`` (rows, c) is -inf at empty places."""
    rows, c = sims.shape
    order = np.argsort(-sims, axis=1, kind="stable")
    taken = np.zeros((rows, c), dtype=bool)
    count = np.zeros(rows, dtype=np.int64)
    each = np.arange(rows)
    closest = np.full((rows, c), -np.inf, dtype=sims.dtype)     # of each candidate to a taken one
    for step in range(c):
        at = order[:, step]
        own = sims[each, at]
        take = (count < m) & np.isfinite(own) & (own > closest[each, at])
        taken[each[take], at[take]] = True
        count += take
        closest[take] = np.maximum(closest[take], between[each[take], at[take]])
    left = np.where(taken, -np.inf, sims)
    fill = np.argsort(-left, axis=1, kind="stable")
    want = np.arange(c)[None, :] < (m - count)[:, None]
    more = np.zeros_like(taken)
    np.put_along_axis(more, fill, want, axis=1)
    return taken | (more & np.isfinite(left))


class Graph:
    """Layers of neighbour arrays over unit vectors; -1 is an empty place."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, m: int = M):
        self.vectors, self.levels, self.m = vectors.astype(np.float32), levels, m
        self.entry = -1
        n = len(vectors)
        self.near = np.full((n, 2 * m), -1, dtype=np.int32)
        self.rows, self.upper = [], []      # per upper layer: node -> row, neighbours by row
        for level in range(1, int(levels.max(initial=0)) + 1):
            on = np.flatnonzero(levels >= level)
            row = np.full(n, -1, dtype=np.int32)
            row[on] = np.arange(len(on))
            self.rows.append(row)
            self.upper.append(np.full((len(on), m), -1, dtype=np.int32))

    def neighbours(self, layer: int, nodes: np.ndarray) -> np.ndarray:
        return self.near[nodes] if layer == 0 else self.upper[layer - 1][self.rows[layer - 1][nodes]]

    def link(self, layer: int, nodes: np.ndarray, near: np.ndarray) -> None:
        if layer == 0:
            self.near[nodes] = near
        else:
            self.upper[layer - 1][self.rows[layer - 1][nodes]] = near

    def beam(self, layer: int, queries: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, sims) of the ``ef`` best nodes that a best-first walk from
        ``start`` (one row a query) finds, best first; -1 and -inf fill up."""
        q = len(queries)
        nodes = np.full((q, ef), -1, dtype=np.int32)
        sims = np.full((q, ef), -np.inf, dtype=np.float32)
        opened = np.zeros((q, ef), dtype=bool)
        seen = np.zeros((q, len(self.vectors) + 1), dtype=bool)     # the last column takes the empty places
        each = np.arange(q)

        def admit(rows: np.ndarray, found: np.ndarray) -> None:
            found = np.sort(found, axis=1)
            fresh = (found >= 0) & ~seen[rows[:, None], found]
            fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
            seen[rows[:, None], found] = True
            near = np.einsum("qd,qcd->qc", queries[rows], self.vectors[found])
            near = np.where(fresh, near, np.float32(-np.inf))
            all_s = np.concatenate([sims[rows], near], axis=1)
            best = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            sims[rows] = np.take_along_axis(all_s, best, axis=1)
            nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], found], axis=1), best, axis=1)
            opened[rows] = np.take_along_axis(
                np.concatenate([opened[rows], np.zeros(found.shape, dtype=bool)], axis=1), best, axis=1)

        admit(each, start)
        active = each
        while len(active):
            waiting = np.where(opened[active], np.float32(-np.inf), sims[active])
            width = min(EXPAND, ef)
            pick = np.argpartition(-waiting, width - 1, axis=1)[:, :width]
            ok = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
            busy = ok.any(axis=1)
            active, pick, ok = active[busy], pick[busy], ok[busy]
            if not len(active):
                break
            held = opened[active]
            np.put_along_axis(held, pick, True, axis=1)
            opened[active] = held
            at = np.take_along_axis(nodes[active], pick, axis=1)
            found = self.neighbours(layer, np.maximum(at, 0))
            found = np.where(ok[:, :, None], found, -1).reshape(len(active), -1)
            admit(active, found)
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, axis=1)
        nodes = np.where(np.isfinite(sims), np.take_along_axis(nodes, order, axis=1), -1)
        return nodes, sims

    def descend(self, queries: np.ndarray, to_layer: np.ndarray) -> np.ndarray:
        """The best node that a greedy walk reaches above ``to_layer``, per query."""
        at = np.full((len(queries), 1), self.entry, dtype=np.int32)
        for layer in range(int(self.levels[self.entry]), 0, -1):
            go = np.flatnonzero(to_layer < layer)
            if len(go):
                at[go] = self.beam(layer, queries[go], at[go], 1)[0]
        return at

    def insert(self, new: np.ndarray, ef: int) -> None:
        """Link the nodes ``new``; they see the graph and each other."""
        if self.entry < 0:
            self.entry, new = int(new[0]), new[1:]
            if not len(new):
                return
        vecs, top = self.vectors[new], int(self.levels[self.entry])
        at = self.descend(vecs, self.levels[new])
        for layer in range(int(self.levels[new].max()), -1, -1):
            on = np.flatnonzero(self.levels[new] >= layer)
            found = np.full((len(on), ef), -1, dtype=np.int32)
            if layer <= top:
                found, _ = self.beam(layer, vecs[on], at[on], ef)
                at[on] = np.where(found[:, :1] >= 0, found[:, :1], at[on])
            each_other = np.broadcast_to(new[on].astype(np.int32), (len(on), len(on)))
            near = vecs[on] @ vecs[on].T
            np.fill_diagonal(near, -np.inf)
            keep = min(len(on), ef)
            among = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
            peers = np.where(np.isfinite(np.take_along_axis(near, among, axis=1)),
                             np.take_along_axis(each_other, among, axis=1), -1)
            self._relink(layer, new[on], np.concatenate([found, peers], axis=1), 2 * self.m if layer == 0 else self.m, self.m)
        high = int(new[np.argmax(self.levels[new])])
        if self.levels[high] > top:
            self.entry = high

    def _relink(self, layer: int, centres: np.ndarray, found: np.ndarray, room: int, wanted: int) -> None:
        chosen = self._choose(centres, found, wanted)
        near = np.full((len(centres), room), -1, dtype=np.int32)
        near[:, :chosen.shape[1]] = chosen
        self.link(layer, centres, near)
        # and back: each chosen node takes the centre, or its best set when it is full
        src = np.repeat(centres.astype(np.int32), chosen.shape[1])
        dst = chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        hit, first, count = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(hit), BATCH):
            h, c = hit[lo:lo + BATCH], count[lo:lo + BATCH]
            add = np.full((len(h), int(c.max())), -1, dtype=np.int32)
            row = np.repeat(np.arange(len(h)), c)
            place = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
            add[row, place] = src[first[lo]:first[lo] + len(row)]
            old = self.neighbours(layer, h)
            both = np.sort(np.concatenate([old, add], axis=1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            fits = (both >= 0).sum(axis=1) <= room
            got = np.full((len(h), room), -1, dtype=np.int32)
            packed = -np.sort(-both, axis=1)
            got[fits] = packed[fits][:, :room]
            if not fits.all():
                got[~fits] = self._choose(h[~fits], both[~fits], room)
            self.link(layer, h, got)

    def _choose(self, centres: np.ndarray, found: np.ndarray, m: int) -> np.ndarray:
        """At most ``m`` diverse neighbours of each centre among ``found``."""
        vecs = self.vectors[found]
        sims = np.einsum("qd,qcd->qc", self.vectors[centres], vecs)
        sims = np.where((found >= 0) & (found != centres[:, None]), sims, np.float32(-np.inf))
        width = min(found.shape[1], max(2 * m, EF_BUILD // 2))
        best = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        sims = np.take_along_axis(sims, best, axis=1)
        found = np.take_along_axis(found, best, axis=1)
        vecs = np.take_along_axis(vecs, best[:, :, None], axis=1)
        mask = select_diverse(sims, vecs @ vecs.transpose(0, 2, 1), m)
        front = np.argsort(~mask, axis=1, kind="stable")[:, :m]
        out = np.where(np.take_along_axis(mask, front, axis=1), np.take_along_axis(found, front, axis=1), -1)
        return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)

    def search(self, queries: np.ndarray, k: int, ef: int) -> np.ndarray:
        """Up to ``k`` nodes per query (unit float32 rows), best first."""
        out = []
        for lo in range(0, len(queries), BATCH):
            q = queries[lo:lo + BATCH]
            at = self.descend(q, np.zeros(len(q), dtype=np.int64))
            out.append(self.beam(0, q, at, max(ef, k))[0][:, :k])
        return np.concatenate(out)


def node_levels(vkeys: list[str], m: int = M) -> np.ndarray:
    """Top layer of each node, drawn by its key: a share 1/m goes one layer up."""
    draws = np.array([(int(v[:13], 16) + 1) / (1 << 52) for v in vkeys])
    return np.floor(-np.log(draws) / math.log(m)).astype(np.int64)


def build_graph(vkeys: list[str], vectors: np.ndarray, m: int = M, ef: int = EF_BUILD) -> Graph:
    g = Graph(unit(vectors), node_levels(vkeys, m), m)
    lo, step = 0, 1
    while lo < len(vkeys):      # batches grow with the graph, so a batch never outweighs it
        g.insert(np.arange(lo, min(lo + step, len(vkeys))), ef)
        lo, step = lo + step, min(BATCH, max(1, (lo + step) // 4))
    return g


def stored(vkeys: list[str], vectors: np.ndarray, g: Graph) -> dict:
    upper = np.concatenate([u.ravel() for u in g.upper]) if g.upper else np.zeros(0, dtype=np.int32)
    return {"vkeys": vkeys, "vectors": vectors.ravel(), "levels": g.levels.astype(np.int32), "near": g.near.ravel(),
            "upper": upper, "entry": g.entry}


def loaded(row: pd.Series) -> tuple[np.ndarray, np.ndarray, Graph]:
    """(vkeys, original vectors, graph) of a stored row."""
    vkeys = np.array(row["vkeys"], dtype=object)
    vectors = np.array(row["vectors"], dtype=np.float64).reshape(len(vkeys), -1)
    near = np.array(row["near"], dtype=np.int32).reshape(len(vkeys), -1)
    g = Graph(unit(vectors), np.array(row["levels"], dtype=np.int64), near.shape[1] // 2)
    g.near, g.entry = near, int(row["entry"])
    flat, at = np.array(row["upper"], dtype=np.int32), 0
    for u in g.upper:
        u[:] = flat[at:at + u.size].reshape(u.shape)
        at += u.size
    return vkeys, vectors, g


def vector_classes(embeddings: DataFrame, keep: int, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): usable (vec_id, vkey) rows, and per distinct vector its
    key, components, dimension and its ``keep`` smallest ids."""
    d = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # one zero, whatever its sign; two seeds make a key of 128 bits
    d = d.where(F.col("vec_id").isNotNull() & sound).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    key = F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(s), "v")), 16, "0") for s in (1, 2)]))
    d = cut_lineage(d.select("vec_id", key.alias("vkey"), "v"))
    rows = cut_lineage(d.select("vec_id", "vkey").distinct())
    low = topn_per_group(rows, ["vkey"], [F.col("vec_id").asc()], keep)
    low = low.groupBy("vkey").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    per = d.groupBy("vkey").agg(F.first("v").alias("v"))
    return rows, cut_lineage(per.join(low, "vkey").withColumn("dim", F.size("v")))


def shard_count(classes: DataFrame, shard_rows: int = SHARD_ROWS) -> int:
    """Shards of about ``shard_rows`` vectors; a query meets each of them, so
    their number follows the vectors alone."""
    return max(1, -(-classes.count() // shard_rows))


def build_index(classes: DataFrame, shards: int, m: int = M, ef: int = EF_BUILD) -> DataFrame:
    """The written index: one row of INDEX_FIELDS per dimension and shard."""
    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vkey")
        vkeys, vectors = pdf["vkey"].tolist(), np.stack(pdf["v"].to_numpy()).astype(np.float64)
        row = stored(vkeys, vectors, build_graph(vkeys, vectors, m, ef))
        return pd.DataFrame([{"dim": key[0], "shard": key[1], "ids": np.concatenate(pdf["ids"].to_numpy()),
                              "held": pdf["ids"].map(len).to_numpy()} | row])
    shard = F.pmod(F.xxhash64("vkey"), F.lit(shards)).cast("int").alias("shard")
    return cut_lineage(classes.select("dim", shard, "vkey", "ids", "v").groupBy("dim", "shard").applyInPandas(build, INDEX_FIELDS))


_FOUND = "qkey string, vkey string, ids array<long>, score double"


def search_index(index: DataFrame, shards: int, queries: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """(qkey, vkey, ids, score): up to ``k`` nearest vectors of every shard for
    each distinct query (vkey, dim, v).  A block of queries meets a shard's row once."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    q = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                       F.pmod(F.xxhash64(F.lit(5), "vkey"), F.lit(blocks)).cast("int").alias("block"), "vkey", "v")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in _FOUND.split(", ")})
        vkeys, vectors, g = loaded(rows.iloc[0])
        raw = unit(np.stack(asked["v"].to_numpy()).astype(np.float64))
        got = g.search(raw.astype(np.float32), k, ef)
        at, place = np.nonzero(got >= 0)
        hit = got[at, place]
        score = np.einsum("ij,ij->i", raw[at], unit(vectors[hit]))
        ends = np.cumsum(rows["held"].iloc[0])
        ids = np.split(np.asarray(rows["ids"].iloc[0]), ends[:-1])
        return pd.DataFrame({"qkey": asked["vkey"].to_numpy()[at], "vkey": vkeys[hit], "ids": [ids[i] for i in hit],
                             "score": score})
    by = ("dim", "shard", "block")
    return q.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(search, _FOUND)


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, shard_rows: int = SHARD_ROWS, m: int = M,
            ef_build: int = EF_BUILD, ef_search: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row
    whose id ``every`` divides, by cosine, ties to the smaller id.

    Rows with a null id, and vectors that are null, empty, zero or hold a null
    or non-finite component, take no part.  Rows equal in id and vector count
    once; an id with several vectors has a list for each of them, and each is a
    candidate of the others.  Vectors of different lengths never meet.  Fewer
    candidates than ``k`` give them all; an empty table gives an empty result."""
    rows, classes = vector_classes(embeddings, k + 1)
    asked = rows.where(F.col("vec_id") % every == 0)
    qkeys = asked.groupBy("vkey").agg(F.count(F.lit(1)).alias("asked"))
    shards = shard_count(classes, shard_rows)
    index = build_index(classes, shards, m, ef_build)
    queries = cut_lineage(classes.join(qkeys, "vkey").select("vkey", "dim", "v", "asked"))
    found = search_index(index, shards, queries, k + 1, ef_search)
    near = topn_per_group(found, ["qkey"], [F.col("score").desc(), F.col("ids")[0].asc()], k + 1).drop("rank")
    near = near.select("qkey", "vkey", "score", F.explode("ids").alias("vec_id"))
    near = topn_per_group(near, ["qkey"], [F.col("score").desc(), F.col("vec_id").asc(), F.col("vkey").asc()], k + 1)
    packed = near.groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "vkey", "score"))).alias("hits"))
    packed = cut_lineage(packed.join(queries, packed.qkey == queries.vkey).select("qkey", "hits", "asked"))
    mine = skew_lookup(asked.withColumnRenamed("vec_id", "query_id"), packed.withColumnRenamed("qkey", "vkey"), "vkey",
                       "asked", ["hits"], "query_id")
    own = lambda h: (h["vec_id"] == F.col("query_id")) & (h["vkey"] == F.col("vkey"))
    out = mine.select("query_id", F.posexplode(F.slice(F.filter("hits", lambda h: ~own(h)), 1, k)).alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
