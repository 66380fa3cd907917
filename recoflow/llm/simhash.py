"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint per document (majority bit over the XXH64 values of its
word shingles), links at ``radius`` or fewer differing bits, components over
the links.

Covering masks: every bit position i gets a nonzero vector m(i) of radius + 1
bits; table v (all nonzero v) keeps the bits with <m(i), v> odd.  Two
fingerprints that differ in at most ``radius`` bits have difference vectors
m(i) that span at most ``radius`` dimensions, so some nonzero v is orthogonal
to all of them and the pair agrees on the whole mask of table v.  No pair
within the radius is ever missed.

Only distinct fingerprints are compared, so copies cost nothing.  A bucket
yields a spanning forest of its links (at most size - 1 edges), never all of
its pairs; buckets over ``BUCKET`` are cut into blocks and every pair of
blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import row_key, skew_lookup, whole_rows
from recoflow.session import cut_lineage

BITS, SEED, BUCKET, CHUNK = 64, 42, 2048, 1 << 17


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 of each shingle: A-Z lowered, words between ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[shingle - 1:])]


def majority(groups: list[list[int]]) -> np.ndarray:
    """One fingerprint per list: a bit is 1 if set in over half of the hashes."""
    out = np.zeros(len(groups), dtype=np.uint64)
    todo = [i for i, g in enumerate(groups) if g]
    if not todo:
        return out
    sizes = np.array([len(groups[i]) for i in todo])
    flat = np.concatenate([np.array(groups[i], dtype=np.uint64) for i in todo])
    owner_start = np.concatenate([[0], np.cumsum(sizes)])
    votes = np.zeros((len(todo), BITS), dtype=np.int64)
    for lo in range(0, len(flat), CHUNK):
        part = flat[lo:lo + CHUNK]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.searchsorted(owner_start, lo, side="right") - 1
        last = np.searchsorted(owner_start, lo + len(part) - 1, side="right") - 1
        cuts = np.maximum(owner_start[first:last + 1] - lo, 0)
        votes[first:last + 1] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    set_bits = votes * 2 > sizes[:, None]
    out[todo] = np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprint_udf(shingle: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            got, held, n = [], [], 0
            for t in texts:
                held.append(shingle_hashes(t, shingle))
                n += len(held[-1])
                if n >= CHUNK:
                    got.append(majority(held))
                    held, n = [], 0
            got.append(majority(held))
            yield pd.Series(np.concatenate(got).view(np.int64))
    return F.pandas_udf(run, "long")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rk, fp) per row.  Null and word-free texts get fingerprint 0."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.select("doc_id", row_key().alias("rk"), _fingerprint_udf(shingle)("text").alias("fp"))


def covering_masks(radius: int = 3) -> list[int]:
    """The 2^(radius+1) - 1 masks; bits are dealt evenly to the nonzero vectors."""
    n = (1 << (radius + 1)) - 1
    assigned = [1 + i % n for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(assigned) if (m & v).bit_count() % 2) for v in range(1, n + 1)]


def spanning_edges(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of links among distinct fingerprints:
    breadth first, each step compares one fingerprint with those not reached."""
    edges, left = [], fps
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.bitwise_count(left ^ at) <= radius
        if near.any():
            found = left[near]
            edges += [(int(at), int(x)) for x in found]
            queue.extend(found)
            left = left[~near]
    return edges


def _bucket_edges(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def edges_of(part: pd.DataFrame) -> pd.DataFrame:
            key = part[["b", "i", "j"]].to_numpy()
            fps = part["fp"].to_numpy().view(np.uint64)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            out: list[tuple[int, int]] = []
            for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])):
                if hi - lo > 1:
                    out += spanning_edges(np.unique(fps[lo:hi]), radius)
            got = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"u": got.min(axis=1), "v": got.max(axis=1)})

        for pdf in batches:     # sorted by bucket; the last one may go on in the next batch
            if not len(pdf):
                continue
            last = pdf[["b", "i", "j"]].iloc[-1]
            tail = ((pdf["b"] == last["b"]) & (pdf["i"] == last["i"]) & (pdf["j"] == last["j"])).to_numpy()
            if tail.all():
                if held and tuple(held[-1][["b", "i", "j"]].iloc[-1]) != tuple(last):
                    yield edges_of(pd.concat(held))
                    held = []
                held.append(pdf)
                continue
            yield edges_of(pd.concat([*held, pdf[~tail]]))
            held = [pdf[tail]]
        if held:
            yield edges_of(pd.concat(held))
    return run


def link_forest(distinct_fps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links among distinct fingerprints (column fp) that connect the
    same components as all links do."""
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    rows = distinct_fps.select("fp", F.explode(F.array(*[
        F.xxhash64(F.lit(v), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for v, m in enumerate(masks)])).alias("b"))
    full = cut_lineage(rows.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    hits = skew_lookup(rows, full, "b", "n", ["n"], "fp").where(F.col("n").isNotNull())
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "fp"), blocks).cast("int")
    hits = hits.select("b", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    hits = hits.select("b", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    hits = hits.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j")
    return hits.mapInPandas(_bucket_edges(radius), "u long, v long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): connected components of (u, v) by alternating large-star
    and small-star steps; each step is one aggregate and one lookup, hot
    centres are spread by their degree, and every round is a written table."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        sym = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else \
            e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = cut_lineage(sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"),
                                               F.count(F.lit(1)).alias("n")))
        j = skew_lookup(sym, low, "u", "n", ["m"], "v")
        if large:       # larger neighbours point at the minimum
            out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:           # all smaller neighbours and the node itself do
            out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                low.select("u", F.col("m").alias("v")))
        return cut_lineage(out.where("u != v").distinct())

    e = cut_lineage(edges.where("u != v").distinct())
    seen = None
    for _ in range(max_rounds):
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        e = star(star(e, True), False)
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def classes(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, comp, component_id, n) per distinct fingerprint of (doc_id, fp):
    comp names the component (its smallest fingerprint), component_id is its
    smallest doc_id (null when all its ids are null), n its number of rows."""
    per_fp = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    roots = components(link_forest(per_fp.select("fp"), radius))
    named = cut_lineage(per_fp.join(roots, per_fp.fp == roots.node, "left")
                        .select("fp", "low", "n", F.coalesce("root", "fp").alias("comp")))
    ids = cut_lineage(named.groupBy("comp").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("w")))
    return skew_lookup(named, ids, "comp", "w", ["component_id"], "fp").select("fp", "comp", "component_id", "n")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    Null, empty and word-free texts share fingerprint zero and link like any
    other.  Repeated rows and repeated ids each keep their row.  A null id
    never names a component unless all its ids are null (then component_id is
    null).  An empty table gives an empty result."""
    fps = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    cls = cut_lineage(classes(fps, radius))
    out = skew_lookup(fps, cls, "fp", "n", ["component_id"], "rk")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id
    (among rows that repeat that id, the smallest text key; equal rows become
    one).  Columns stay as they are."""
    fps = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    cls = classes(fps, radius).select("fp", "comp", "component_id")
    # candidates hold the component's smallest id: few rows besides one per component
    mine = fps.groupBy("fp", "doc_id").agg(F.min("rk").alias("rk"))
    best = (mine.join(cls, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("comp").agg(F.min(F.struct("rk", "doc_id")).alias("b"))
            .select(F.col("b.rk").alias("_xrk"), F.col("b.doc_id").alias("_xid")))
    d = whole_rows(docs).withColumn("k", row_key(f"row.{text_col}"))
    kept = d.join(best, (F.col("k") == F.col("_xrk")) & F.col(f"row.{id_col}").cast("long").eqNullSafe(F.col("_xid")))
    return kept.dropDuplicates(["_xrk", "_xid"]).select("row.*")
