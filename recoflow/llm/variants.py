"""Spelling variants: words at one edit from each other, found by search
schemes on a bidirectional FM-index.

One edit leaves one half of a word as it is.  A search matches one half
exactly, outwards from the middle to its end of the word, turns round, and
extends across the other half allowing one inserted, deleted or replaced code
point.  The index is over the delimited vocabulary ``#word#word...`` (read as
a ring): the pair of suffix-rank intervals, of the text and of its reverse,
stays in step whichever way the match grows (Lam et al. 2009), so a match that
reaches a delimiter at both ends is one whole word.

The vocabulary is dealt to shards by the half that has to match: a word asks
with each of its halves, and is indexed under the halves that a word of its
length, one less or one more would ask with.  Every near pair meets in one
shard; a shard's index holds the words of many halves.  A half with over
``UNIT`` rows is cut into blocks of words, and each pair of blocks is a shard
of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import partitions, skew_lookup
from recoflow.session import cut_lineage

RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LENGTH, COUNT, RATIO = 7, 2, 10
SHARD, UNIT, SLICE, STEP = 100_000, 50_000, 8192, 64


def corpus_words(docs: DataFrame, length: int = LENGTH, count: int = COUNT, slip: int = 31) -> DataFrame:
    """(word, n): letter runs of whole texts with A-Z lowered, of at least
    ``length`` code points and ``count`` occurrences.  A run whose CRC-32 with
    its document's id is a multiple of ``slip`` loses one code point (the
    contract's typing slips; a null id is written as nothing)."""
    # a slip only shortens, so shorter runs can be left in the text
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"{RUN}{{{length},}}"), F.lit(0))
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    d = d.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    d = d.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    d = d.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word"))
    d = d.where(F.length("word") >= length)
    return d.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


class Ranks:
    """One direction of the index: BWT of a ring with symbol counts at every
    ``STEP`` places and the last-to-first map."""

    def __init__(self, codes: np.ndarray, sigma: int):
        n = len(codes)
        width = int(sigma).bit_length()
        take = min(62 // width, n)
        key = np.zeros(n, dtype=np.int64)
        for j in range(take):
            key = (key << width) | np.roll(codes, -j)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        done = take
        while rank.max() < n - 1:       # distinct words: the ring has no period, so all rotations differ
            rank = np.unique(rank * n + np.roll(rank, -done), return_inverse=True)[1].astype(np.int64)
            done *= 2
        self.n, self.sa = n, np.empty(n, dtype=np.int64)
        self.sa[rank] = np.arange(n)
        self.bwt = codes[self.sa - 1].astype(np.uint8)
        self.lf = np.empty(n, dtype=np.int64)
        self.lf[np.argsort(self.bwt, kind="stable")] = np.arange(n)
        blocks = n // STEP + 1
        self.windows = np.full(blocks * STEP, 255, dtype=np.uint8)
        self.windows[:n] = self.bwt
        self.windows = self.windows.reshape(blocks, STEP)
        per = np.bincount(np.arange(n) // STEP * sigma + self.bwt, minlength=blocks * sigma).reshape(blocks, sigma)
        self.smaller = np.zeros((blocks, sigma + 1), dtype=np.int64)
        self.smaller[1:, 1:] = np.cumsum(np.cumsum(per, axis=0)[:-1], axis=1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.bwt, minlength=sigma))])

    def below(self, i: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the first ``i`` symbols are less than c, and less than c + 1."""
        block = i // STEP
        got = np.where(np.arange(STEP) < (i % STEP)[:, None], self.windows[block], np.uint8(255))
        less = (got < c[:, None]).sum(axis=1) + self.smaller[block, c]
        return less, (got <= c[:, None]).sum(axis=1) + self.smaller[block, c + 1]

    def extend(self, lo: np.ndarray, size: np.ndarray, other: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """Intervals after one more symbol in this direction: here, size, and
        the start of the interval of the other direction."""
        a0, a1 = self.below(lo, c)
        b0, b1 = self.below(lo + size, c)
        return self.first[c] + a1 - a0, (b1 - b0) - (a1 - a0), other + b0 - a0

    def children(self, lo: np.ndarray, size: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """(parent, symbol, lo, size, other) for every symbol that can follow."""
        ends = np.cumsum(size)
        parent = np.repeat(np.arange(len(lo)), size)
        place = np.arange(int(size.sum())) - np.repeat(ends - size, size) + lo[parent]
        key, at, count = np.unique(parent * 256 + self.bwt[place], return_index=True, return_counts=True)
        parent, symbol = key // 256, key % 256
        before = np.cumsum(count) - count
        heads = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(parent) else parent
        base = np.repeat(before[heads], np.diff(np.append(heads, len(parent))))
        return parent, symbol, self.lf[place[at]], count, other[parent] + before - base


def _codes(words: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, lengths): symbols of each word, 0 after its end."""
    lengths = np.array([len(w) for w in words])
    flat = np.searchsorted(letters, np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)) + 1
    out = np.zeros((len(words), int(lengths.max()) + 1), dtype=np.uint8)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


class VariantIndex:
    """Bidirectional FM-index of distinct words."""

    def __init__(self, words: list[str]):
        self.words = words
        flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.letters = np.unique(flat)
        ring = np.frombuffer(("#" + "#".join(words)).encode("utf-32-le"), dtype=np.uint32)
        codes = np.where(ring == ord("#"), 0, np.searchsorted(self.letters, ring) + 1)
        self.starts = np.flatnonzero(codes == 0)
        sigma = len(self.letters) + 1
        self.left, self.right = Ranks(codes, sigma), Ranks(codes[::-1], sigma)

    def near(self, queries: list[str], second: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query number, word number), each pair once: words at one edit that
        keep the first half of the query (``second``: the second half)."""
        known = set(map(chr, self.letters.tolist()))
        found = []
        order = sorted(range(len(queries)), key=lambda i: len(queries[i]))
        for lo in range(0, len(order), SLICE):
            part = [(i, len(queries[i]) // 2) for i in order[lo:lo + SLICE]]
            firsts = [queries[i][h:] if second else queries[i][:h][::-1] for i, h in part]
            rests = [queries[i][:h][::-1] if second else queries[i][h:] for i, h in part]
            # letters that no word has end the exact half; in the other half they are one edit
            ok = [k for k, f in enumerate(firsts) if known.issuperset(f)]
            if ok:
                at, word = self._search([firsts[k] for k in ok], [rests[k] for k in ok], second)
                found.append((np.array([part[k][0] for k in ok])[at], word))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        q, w = (np.concatenate(x) for x in zip(*found))
        pairs = np.unique(q * len(self.words) + w)
        return pairs // len(self.words), pairs % len(self.words)

    def _search(self, firsts: list[str], rests: list[str], second: bool) -> tuple[np.ndarray, np.ndarray]:
        out, back = (self.right, self.left) if second else (self.left, self.right)
        exact, n_exact = _codes(firsts, self.letters)
        rest, n_rest = self._rest_codes(rests)
        q = np.arange(len(firsts))
        lo, size, other = np.zeros_like(q), np.full_like(q, out.n), np.zeros_like(q)
        for i in range(exact.shape[1]):         # outwards: the half and its delimiter
            on = (i <= n_exact[q]) & (size > 0)
            lo[on], size[on], other[on] = out.extend(lo[on], size[on], other[on], exact[q[on], i].astype(np.int64))
        keep = size > 0
        q, size = q[keep], size[keep]
        lo, other = other[keep], lo[keep]       # turned round: ``lo`` is the interval of the direction in use
        hits, far = [], back
        e = [np.zeros(0, dtype=np.int64) for _ in range(5)]     # one edit done: q, lo, size, other, place
        i = 0
        while len(q) or len(e[0]):
            if len(q):
                want, ends = rest[q, i].astype(np.int64), i == n_rest[q]
                nxt = rest[q, np.minimum(i + 1, rest.shape[1] - 1)]
                made = []
                gap = ~ends & (want != nxt)             # of equal letters in a row, drop the last
                made.append((q[gap], lo[gap], size[gap], other[gap], np.full(gap.sum(), i + 1)))
                key, back_to = np.unique(lo * (far.n + 1) + size, return_inverse=True)
                one = np.empty(len(key), dtype=np.int64)
                one[back_to] = np.arange(len(q))
                parent, symbol, c_lo, c_size, c_other = far.children(lo[one], size[one], other[one])
                begin = np.searchsorted(parent, np.arange(len(key) + 1))
                counts = (begin[1:] - begin[:-1])[back_to]
                state = np.repeat(np.arange(len(q)), counts)
                child = np.arange(len(state)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[back_to[state]]
                sym = symbol[child]
                edit = (sym != 0) & (sym != want[state])
                s, c = state[edit], child[edit]
                made.append((q[s], c_lo[c], c_size[c], c_other[c], np.full(len(s), i)))            # inserted
                swap = ~ends[s]
                s, c = s[swap], c[swap]
                made.append((q[s], c_lo[c], c_size[c], c_other[c], np.full(len(s), i + 1)))        # replaced
                go = (sym == want[state]) & ~ends[state]
                s, c = state[go], child[go]
                e = [np.concatenate(x) for x in zip(e, *made)]
                q, lo, size, other = q[s], c_lo[c], c_size[c], c_other[c]
            c = rest[e[0], e[4]].astype(np.int64)
            e = [x[c != 255] for x in e]
            c = c[c != 255]
            end = c == 0
            n_lo, n_size, n_other = far.extend(e[1], e[2], e[3], c)
            alive = n_size > 0
            done = alive & end
            hits.append((e[0][done], (n_lo if second else n_other)[done]))
            go = alive & ~end
            e = [e[0][go], n_lo[go], n_size[go], n_other[go], e[4][go] + 1]
            i += 1
        at, rank = (np.concatenate(x) for x in zip(*hits)) if hits else (q, q)
        # a delimiter at both ends: the match is one word, and starts at its delimiter
        return at, np.searchsorted(self.starts, self.left.sa[rank])

    def _rest_codes(self, rests: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Like ``_codes``; letters that no indexed word has become 255."""
        got, lengths = _codes(rests, self.letters)
        points = np.frombuffer("".join(rests).encode("utf-32-le"), dtype=np.uint32)
        strange = ~np.isin(points, self.letters)
        if strange.any():
            cells = got[np.arange(got.shape[1]) < lengths[:, None]]
            cells[strange] = 255
            got[np.arange(got.shape[1]) < lengths[:, None]] = cells
        return got, lengths


_BEST = "word string, n_near long, form_n long, form string"


def _shard_search(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one shard (asks, second, word, n) -> per asking word the number
    of near words and the best of them."""
    asks = pdf["asks"].to_numpy()
    held = pdf[~asks].drop_duplicates("word")
    out = []
    if len(held):
        words, ns = held["word"].tolist(), held["n"].to_numpy()
        index = VariantIndex(words)
        by_word = np.argsort(np.array(words, dtype=object), kind="stable")      # code-point order
        place = np.empty(len(words), dtype=np.int64)
        place[by_word] = np.arange(len(words))
        for second in (False, True):
            queries = pdf.loc[asks & (pdf["second"].to_numpy() == second), "word"].tolist()
            if not queries:
                continue
            q, w = index.near(queries, second)
            if second:      # words that keep both halves were found with the first
                keep = np.array([not words[b].startswith(queries[a][:len(queries[a]) // 2])
                                 for a, b in zip(q.tolist(), w.tolist())], dtype=bool)
                q, w = q[keep], w[keep]
            order = np.lexsort((place[w], -ns[w], q))
            q, w = q[order], w[order]
            who, first, count = np.unique(q, return_index=True, return_counts=True)
            out += [(queries[a], int(c), int(ns[w[f]]), words[w[f]]) for a, f, c in zip(who.tolist(), first, count)]
    return pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"])


def _routes(vocab: DataFrame) -> DataFrame:
    """(key, asks, second, word, n): a word asks with both halves and is indexed
    under the halves that words of its length, one less or one more ask with."""
    size = F.length("word")

    def route(m: Column, asks: bool, second: bool) -> Column:
        half = F.floor(m / 2).cast("int")
        piece = F.right(F.col("word"), m - half) if second else F.left(F.col("word"), half)
        return F.struct(F.xxhash64(F.lit(second), m, piece).alias("key"), F.lit(asks).alias("asks"), F.lit(second).alias("second"))
    routes = [route(size + d, asks, second) for second in (False, True) for asks, d in
              ((True, 0), (False, -1), (False, 0), (False, 1))]
    d = vocab.select("word", "n", F.explode(F.array(*routes)).alias("r"))
    return d.select("r.key", "r.asks", "r.second", "word", "n")


def near_words(vocab: DataFrame, shard: int = SHARD, unit: int = UNIT) -> DataFrame:
    """(word, n_near, form_n, form) of the words of (word, n) that have near
    words: their number, and the one of largest n (ties: smallest)."""
    rows = _routes(vocab)
    spark = vocab.sparkSession
    shards = max(4 * partitions(spark), -(-8 * vocab.count() // shard))
    # keys over the unit: under 8 / unit of the vocabulary's size; the planner
    # broadcasts them when that is small, and else joins them by a shuffle
    big = cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > unit)
                      .select("key", F.ceil(F.col("rows") / unit).cast("int").alias("blocks")))
    j = rows.join(big, "key", "left").withColumn("own", F.pmod(F.xxhash64(F.lit(11), "word"), F.coalesce("blocks", F.lit(1))).cast("int"))
    j = j.select("*", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("met"))
    pair = [F.when(F.col("asks"), F.col("own")).otherwise(F.col("met")), F.when(F.col("asks"), F.col("met")).otherwise(F.col("own"))]
    # a pair of blocks of a big key is a shard of its own, below zero
    alone = -1 - F.abs(F.xxhash64("key", *pair) % (1 << 62))
    j = j.withColumn("shard", F.when(F.col("blocks").isNull(), F.pmod("key", F.lit(shards))).otherwise(alone))
    found = j.select("shard", "asks", "second", "word", "n").groupBy("shard").applyInPandas(_shard_search, _BEST)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("form_n"), F.col("b.form").alias("form"))


def _roots(links: DataFrame) -> Iterator[DataFrame]:
    """(word, to) after each doubling of the links; n grows along a link, so
    there is no ring.  The last frame names the roots."""
    while True:
        yield links
        weight = links.groupBy("to").agg(F.count(F.lit(1)).alias("w"))
        steps = cut_lineage(links.select(F.col("word").alias("to"), F.col("to").alias("next")).join(weight, "to"))
        if not steps.head(1):
            return
        links = cut_lineage(skew_lookup(links, steps, "to", "w", ["next"], "word")
                            .select("word", F.coalesce("next", "to").alias("to")))


def spelling_variants(docs: DataFrame, length: int = LENGTH, count: int = COUNT, ratio: int = RATIO,
                      shard: int = SHARD, unit: int = UNIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the corpus.

    Null, empty and letterless texts hold no word; repeated rows count as
    often as they are there; an empty table gives an empty result.  Runs of
    any length are words.  Only doc_id and text are read."""
    vocab = cut_lineage(corpus_words(docs.select("doc_id", "text"), length, count))
    near = near_words(vocab, shard, unit)
    is_form = F.col("form_n") >= ratio * F.col("n")
    forms = cut_lineage(vocab.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("form_n")).alias("form_n")))
    links = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("to"))
    for links in _roots(links):
        pass
    out = forms.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
