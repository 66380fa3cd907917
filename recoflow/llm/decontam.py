"""Benchmark decontamination by spaced-seed hashing, DataFrame functions only.

Texts become lower-case word lists (runs of letters and digits).  Each mask is
a fixed set of word offsets; the words at the other positions under the mask
are ignored, so a substitution there does not hide a hit.  Equal seed hashes of
a document and an item give hits; hits are counted per (row, item, diagonal),
and each candidate diagonal is verified on the words themselves: some stretch
of ``overlap`` words (or the whole item, if shorter) must agree in at least
``similarity`` of its positions.

The two default masks leave a hit under every placement of 4 substitutions in
20 words (tested by enumeration), so the default contract (20 words, 0.8) is
met exactly.  Of items under 20 words the masks lose some (6, 7 and 10 to 12
words) or have no seed (1 to 5 words): whatever length the enumeration finds
lossy is seeded by blocks instead.  An item that must match as a whole with
k substitutions is cut in k + 1 blocks, one of which is free of them; the
document side has runs of those lengths too, only when such items occur.
The item side is a stated query set: its seeds are broadcast
only when the item table's word count is under ``BROADCAST_WORDS`` (measured
before the join), else the join shuffles.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import row_key, whole_rows
from recoflow.session import cut_lineage

#: Word offsets that a seed looks at (fixed values): weight 5, spans 6 and 7.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 4, 6))
OVERLAP, SIMILARITY, BROADCAST_WORDS = 20, 0.8, 500_000


def words(text: str = "text") -> Column:
    """Lower-case runs of letters and digits; null gives none."""
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def seeds(h: str, mask: tuple[int, ...], number: int) -> Column:
    """Array of (position, seed hash) for one mask over an array of word hashes."""
    last = F.size(h) - F.lit(mask[-1] + 1)
    steps = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.struct(
        i.alias("p"), F.xxhash64(F.lit(number), *[F.get(F.col(h), i + o) for o in mask]).alias("seed")))


def spare(n: int, similarity: float) -> int:
    """Substitutions that a match of ``n`` words may have."""
    return n - math.ceil(n * similarity - 1e-9)


def lossless(n: int, k: int, masks=MASKS) -> bool:
    """Whether every placement of k substitutions in n words leaves a seed."""
    if math.comb(n, k) > 10_000:
        return False
    whole = [{i + o for o in m} for m in masks for i in range(n - m[-1])]
    return all(any(not s.intersection(x) for s in whole) for x in itertools.combinations(range(n), k))


def blocks(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k + 1 blocks of n words."""
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def seed_rows(df: DataFrame, keys: list[str], masks=MASKS, runs=()) -> DataFrame:
    """(keys, p, seed): every seed of every mask of the column ``w`` (word list),
    and of every run of the given lengths."""
    hashed = df.select(*keys, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    every = F.concat(*[seeds("h", m, n) for n, m in enumerate(masks)], *[seeds("h", tuple(range(n)), -n) for n in runs])
    return hashed.select(*keys, F.inline(every))


def item_rows(b: DataFrame, masks, short: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """(item, ip, seed): an item's blocks where ``short`` has its length, else its masks' seeds."""
    out = seed_rows(b.where(~F.size("w").isin(list(short))), ["item"], masks)
    hashed = b.select("item", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    for n, cut in short.items():
        one = [F.struct(F.lit(a).alias("p"), F.xxhash64(F.lit(-m), *[F.get("h", F.lit(a + o)) for o in range(m)]).alias("seed"))
               for a, m in cut]
        out = out.unionByName(hashed.where(F.size("h") == n).select("item", F.inline(F.array(*one))))
    return out.select("item", F.col("p").alias("ip"), "seed")


def contaminated(docs: DataFrame, items: DataFrame, overlap: int = OVERLAP, similarity: float = SIMILARITY,
                 masks=MASKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rk, item_id, doc_pos, matched, compared) per row and item that
    overlap: the best stretch's place in the document (in words), its agreeing
    words and its length.

    Null and empty texts match nothing; an item of fewer than ``overlap`` words
    must be matched as a whole, whatever its length; rows that repeat id and text are one row here;
    null ids are kept as null; empty tables give no rows."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.select("doc_id", row_key().alias("rk"), words().alias("w"))
    b = cut_lineage(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
                    .select("item_id", words().alias("w")).distinct()
                    .withColumn("item", F.xxhash64("item_id", "w")))
    size = F.size("w")
    n_words, lengths = b.agg(F.sum(size), F.collect_set(F.when((size > 0) & (size < overlap), size))).first()
    n_words = n_words or 0
    short = {n: blocks(n, k) for n in sorted(lengths) if not lossless(n, k := spare(n, similarity), masks)}
    runs = sorted({m for cut in short.values() for _, m in cut})
    small = (lambda x: F.broadcast(x)) if n_words <= BROADCAST_WORDS else (lambda x: x)
    item_seeds = item_rows(b, masks, short)
    hits = seed_rows(d, ["doc_id", "rk"], masks, runs).join(small(item_seeds), "seed")
    diagonals = (hits.groupBy("doc_id", "rk", "item", (F.col("p") - F.col("ip")).alias("diag"))
                 .agg(F.count(F.lit(1)).alias("hits")))
    diagonals = cut_lineage(diagonals)
    rows = diagonals.select("doc_id", "rk").distinct()
    # the candidates' own word lists, one copy per distinct row
    suspects = (d.alias("d").join(rows.alias("r"), F.col("d.rk").eqNullSafe(F.col("r.rk"))
                                  & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")), "left_semi"))
    pair = (diagonals.alias("c").join(suspects.alias("s"), (F.col("c.rk") == F.col("s.rk"))
                                      & F.col("c.doc_id").eqNullSafe(F.col("s.doc_id")))
            .join(small(b.select("item", "item_id", F.col("w").alias("iw"))), "item")
            .select("c.doc_id", "c.rk", "item_id", "diag", "iw",
                    F.slice("s.w", F.greatest(F.col("diag"), F.lit(0)) + 1, F.size("iw")).alias("dw")))
    lead = F.greatest(-F.col("diag"), F.lit(0))        # item words before the document starts
    pair = pair.withColumn("iw2", F.slice("iw", lead + 1, F.size("iw")))
    pair = pair.withColumn("same", F.zip_with("iw2", "dw", lambda x, y: F.when(x == y, 1).otherwise(0)))
    pair = pair.withColumn("len", F.least(F.size("iw2"), F.size("dw"))).withColumn(
        "need", F.least(F.size("iw"), F.lit(overlap)))
    pair = pair.where(F.col("len") >= F.col("need"))
    # best stretch of ``need`` positions
    sums = F.transform(F.sequence(F.lit(1), F.col("len") - F.col("need") + 1), lambda i: F.struct(
        F.aggregate(F.slice("same", i, F.col("need")), F.lit(0), lambda a, x: a + x).alias("matched"), (-i).alias("at")))
    best = pair.withColumn("best", F.array_max(sums))
    best = best.where(F.col("best.matched") >= F.ceil(F.col("need") * F.lit(similarity) - F.lit(1e-9)))
    best = best.select("doc_id", "rk", "item_id", F.struct(
        F.col("best.matched").alias("matched"),
        (F.greatest(F.col("diag"), F.lit(0)) - F.col("best.at") - 1).alias("doc_pos"),
        F.col("need").alias("compared")).alias("m"))
    top = best.groupBy("doc_id", "rk", "item_id").agg(F.max("m").alias("m"))
    return top.select("doc_id", "rk", "item_id", "m.doc_pos", "m.matched", "m.compared")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """``docs`` without the rows that overlap an item; columns stay as they are."""
    bad = contaminated(docs, items, id_col=id_col, text_col=text_col, **options).select(
        F.col("rk").alias("_xrk"), F.col("doc_id").alias("_xid")).distinct()
    d = whole_rows(docs).withColumn("k", row_key(f"row.{text_col}"))
    kept = d.join(bad, (F.col("k") == F.col("_xrk")) & F.col(f"row.{id_col}").cast("long").eqNullSafe(F.col("_xid")), "left_anti")
    return kept.select("row.*")
