"""Substring dedup by prefix-partitioned suffix trees over words.

A window is ``window`` consecutive words.  The words of a window that also
starts in a document with a smaller id are removed; windows are judged on the
input.

Sampling of suffixes: of the k-word sequences inside a window (k about half
the window) the one with the smallest hash is the window's anchor; equal
windows have equal anchors at the same place, so only suffixes near anchors
that occur in two documents can lie below a deep internal node, and only those
are dealt out.  An anchor occurrence carries the text of all windows it
anchors (at most window + window/2 words), a bundle of neighbouring suffixes.

Prefix partitions: bundles are dealt by their anchor, a k-word prefix.  A
prefix in over ``GROUP`` documents is extended to the whole window: equal
bundles become one, a window is a single locus, and its smallest id is a Spark
aggregate with map-side combine, so a passage shared by any number of
documents never meets in one task.  All other groups are memory-sized and packed into tasks,
where the subtree's nodes are named by word depth (1, 2, 4, ... words, then
the window): suffixes below the same node at depth ``window`` share the whole
window.  Nodes with several documents are the deep internal nodes; runs of
neighbouring windows below such nodes are the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import row_key, skew_lookup
from recoflow.session import cut_lineage

GROUP, CHUNK_BUNDLES = 4096, 16384
_MUL = 0x9E3779B97F4A7C15
_P, _P_INV = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space (space and \\t \\n \\v \\f \\r), as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(_MUL)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    return x


class _Powers:
    """Growing tables of powers of an odd multiplier and of its inverse, modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            full = np.full(size, _P, dtype=np.uint64), np.full(size, _P_INV, dtype=np.uint64)
            for x in full:
                x[0] = 1
            self.up, self.down = (np.multiply.accumulate(x) for x in full)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_LETTER = _mix(np.arange(1, 257, dtype=np.uint64))


def word_hashes(joined: bytes) -> np.ndarray:
    """A 64-bit hash of each word of space-joined words."""
    raw = np.frombuffer(joined, dtype=np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], gaps + 1])
    sums = np.cumsum(_LETTER[raw] * _POWERS.upto(len(raw))[0])
    ends = np.append(gaps, len(raw)) - 1
    total = sums[ends]
    total[1:] -= sums[starts[1:] - 1]
    return _mix(total * _POWERS.upto(len(raw))[1][starts])


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of one document: (key, word position, first and
    last window start it anchors).  Needs at least ``window`` words."""
    k = window // 2
    n = len(hashes)
    up, down = _POWERS.upto(n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[:n])])
    grams = _mix((sums[k:] - sums[:n - k + 1]) * down[:n - k + 1])
    span = window - k + 1               # k-word sequences in a window
    at = np.arange(len(grams))
    width = 1
    while width * 2 <= span:            # leftmost minimum of doubling widths
        a, b = at[:-width], at[width:]
        at = np.where(grams[a] <= grams[b], a, b)
        width *= 2
    if width < span:
        a, b = at[:len(grams) - span + 1], at[span - width:]
        at = np.where(grams[a] <= grams[b], a, b)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    pos = at[first]
    return grams[pos].view(np.int64), pos, first, last


def _profile(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, rk, text in zip(pdf["doc_id"], pdf["rk"], pdf["text"]):
                words = words_of(text)
                joined = b" ".join(words)
                key = pos = lo = hi = np.zeros(0, dtype=np.int64)
                if len(words) >= window:
                    key, pos, lo, hi = anchors(word_hashes(joined), window)
                fresh = np.zeros(len(key), dtype=np.int32)      # 1 at a key's first place in the document
                fresh[np.unique(key, return_index=True)[1]] = 1
                out.append((i, rk, len(words), hashlib.sha256(joined).hexdigest(), key, fresh,
                            pos.astype(np.int32), (pos - lo).astype(np.int32), (pos - hi).astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "rk", "n_words", "sha", "key", "fresh", "pos", "back", "front"])
    return run


_PROFILE = ("doc_id string, rk long, n_words long, sha string, key array<long>, fresh array<int>, pos array<int>, "
            "back array<int>, front array<int>")


_BUNDLE = "key long, doc_id long, rk long, starts array<int>, words string"


def _bundles(window: int):
    """Docs with their shared anchors -> one row per distinct bundle of a
    document: its anchor, its first word positions and its words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _BUNDLE.split(", ")]
        for pdf in batches:
            out = []
            for i, rk, text, hits in zip(pdf["doc_id"], pdf["rk"], pdf["text"], pdf["hits"]):
                words = words_of(text)
                places: dict[tuple, list[int]] = {}
                for h in hits:
                    s, last = h["pos"] - h["back"], h["pos"] - h["front"]
                    places.setdefault((h["key"], b" ".join(words[s:last + window])), []).append(s)
                out += [(key, i, rk, starts, w.decode("utf-8", "surrogatepass")) for (key, w), starts in places.items()]
                if len(out) >= CHUNK_BUNDLES:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)
    return run


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs of names: equal pairs, and only they, get equal names."""
    return pd.factorize(left.astype(np.int64) * (int(right.max()) + 1) + right)[0]


def loci(texts: list[str], n_starts: np.ndarray, window: int) -> np.ndarray:
    """Node at depth ``window`` words for each suffix: text j has its first
    n_starts[j] word positions as suffixes.  Equal numbers are equal windows."""
    words = " ".join(texts).split(" ")
    sizes = n_starts + window - 1
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    name = pd.factorize(np.array(words, dtype=object))[0]
    depth, rest = 1, []
    while depth * 2 <= window:
        name, depth = _named(name[:-depth], name[depth:]), depth * 2
    at = np.repeat(heads, n_starts) + np.arange(n_starts.sum()) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
    return _named(name[at], name[at + window - depth]) if depth < window else name[at]


def _subtrees(window: int):
    """Sorted bundles -> spans (doc_id, rk, s, e) of words to remove.  Whole
    prefix groups are taken together; a batch may hold many."""
    def spans(part: pd.DataFrame) -> pd.DataFrame:
        n = part["words"].str.count(" ").to_numpy() + 2 - window        # suffixes of a bundle
        node = loci(part["words"].tolist(), n, window)
        ids = part["doc_id"].to_numpy()
        doc = np.repeat(ids, n)
        low = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, node, doc)
        late = doc > low[node]              # a smaller document lies below the same node
        own = np.repeat(np.arange(len(part)), n)[late]
        off = (np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n))[late]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (off[1:] != off[:-1] + 1)
        first = np.flatnonzero(new)
        end = off[np.append(first[1:], len(off)) - 1] if len(first) else off
        rows = own[first]                   # runs of neighbouring windows, at each place of their bundle
        starts = part["starts"].to_numpy()
        many = np.array([len(starts[r]) for r in rows], dtype=np.int64)
        base = np.concatenate([starts[r] for r in rows]).astype(np.int64) if len(rows) else off
        return pd.DataFrame({"doc_id": np.repeat(ids[rows], many), "rk": np.repeat(part["rk"].to_numpy()[rows], many),
                             "s": base + np.repeat(off[first], many), "e": base + np.repeat(end, many) + window})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            while len(pdf):
                take = pdf.iloc[:CHUNK_BUNDLES]
                pdf = pdf.iloc[CHUNK_BUNDLES:]
                held.append(take)
                n += len(take)
                if n < CHUNK_BUNDLES:
                    continue
                part = pd.concat(held)
                whole = (part["key"] != part["key"].iloc[-1]).to_numpy()     # the last group may go on
                if whole.any():
                    yield spans(part[whole])
                held, n = [part[~whole]], int((~whole).sum())
        if n:
            yield spans(pd.concat(held))
    return run


def _strip():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, rk, text, spans in zip(pdf["doc_id"], pdf["rk"], pdf["text"], pdf["spans"]):
                words = words_of(text)
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for x in spans:
                    gone[x["s"]] += 1
                    gone[x["e"]] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone) if not g)
                out.append((i, rk, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["doc_id", "rk", "n_removed", "kept_sha256", "kept"])
    return run


def repeated_spans(profile: DataFrame, texts: DataFrame, window: int, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rk, spans; texts of documents that share an anchor).  ``profile`` is the
    written output of ``_profile``; ids are not null here."""
    occ = profile.select(F.col("doc_id").cast("long").alias("doc_id"), "rk",
                         F.inline(F.arrays_zip("key", "fresh", "pos", "back", "front")))
    shared = occ.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"),
                                    F.count(F.lit(1)).alias("n"), F.sum("fresh").alias("docs"))
    shared = cut_lineage(shared.where("a < b").select("key", "n", "docs"))
    hits = skew_lookup(occ, shared, "key", "n", ["docs"], "rk").where(F.col("docs").isNotNull())
    hits = hits.groupBy("doc_id", "rk").agg(F.collect_set(F.struct("key", "docs", "pos", "back", "front")).alias("hits"))
    near = cut_lineage(texts.join(hits, ["doc_id", "rk"]))

    def bundles(pick) -> DataFrame:
        some = near.withColumn("hits", F.filter("hits", pick)).where(F.size("hits") > 0)
        return some.mapInPandas(_bundles(window), _BUNDLE)
    small = bundles(lambda h: h["docs"] <= group).repartition("key").sortWithinPartitions("key")
    spans = small.mapInPandas(_subtrees(window), "doc_id long, rk long, s int, e int")
    spans = spans.select("doc_id", "rk", F.array(F.struct("s", "e")).alias("spans"))

    # prefixes over budget: distinct bundles once, each suffix by its whole window
    large = cut_lineage(bundles(lambda h: h["docs"] > group).withColumn("bundle", F.sha2("words", 256)))
    texts_of = cut_lineage(large.groupBy("bundle").agg(F.first("words").alias("words"), F.min("doc_id").alias("low"),
                                                       F.count(F.lit(1)).alias("n")))
    w = texts_of.select("bundle", "low", F.split("words", " ").alias("w"))
    w = w.select("bundle", "low", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("w") - window + 1),
        lambda i: F.sha2(F.array_join(F.slice("w", i, window), " "), 256))).alias("i", "node"))
    nodes = cut_lineage(w.groupBy("node").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("m")))
    lows = skew_lookup(w, nodes, "node", "m", ["least"], "bundle")
    # at most window/2 + 1 windows share an anchor, so these lists are bounded
    lows = lows.groupBy("bundle").agg(F.collect_list(F.struct("i", "least")).alias("lows"))
    lows = cut_lineage(lows.join(texts_of.select("bundle", "n"), "bundle"))
    late = skew_lookup(large.select("doc_id", "rk", "starts", "bundle"), lows, "bundle", "n", ["lows"], "rk")
    late = late.withColumn("lows", F.filter("lows", lambda x: x["least"] < F.col("doc_id"))).where(F.size("lows") > 0)
    late = late.select("doc_id", "rk", F.flatten(F.transform("starts", lambda s: F.transform(
        "lows", lambda x: F.struct((s + x["i"]).alias("s"), (s + x["i"] + window).alias("e"))))).alias("spans"))
    return spans.union(late), near


def remove_repeats(docs: DataFrame, window: int = 50, group: int = GROUP, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and kept
    (the kept words joined by one space; null where nothing was removed).

    Null texts have no words.  Rows with a null id are never removed from and
    count for no other row.  Rows that repeat an id are one document: a window
    is not a repeat of itself within an id.  An empty table gives no rows."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("rk", row_key())
    plain = d.select(F.col("doc_id").cast("string").alias("doc_id"), "rk", "text")
    profile = cut_lineage(plain.mapInPandas(_profile(window), _PROFILE))
    known = profile.where(F.col("doc_id").isNotNull())
    spans, near = repeated_spans(known, d.where(F.col("doc_id").isNotNull()), window, group)
    spans = spans.groupBy("doc_id", "rk").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    changed = near.select("doc_id", "rk", "text").join(spans, ["doc_id", "rk"])
    changed = changed.mapInPandas(_strip(), "doc_id long, rk long, n_removed long, kept_sha256 string, kept string")
    changed = changed.dropDuplicates(["doc_id", "rk"])
    out = profile.select(F.col("doc_id").cast("long").alias("doc_id"), "rk", "n_words", "sha").join(
        changed, ["doc_id", "rk"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                      F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")
