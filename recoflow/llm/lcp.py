"""Document fingerprints by locally consistent parsing.

A text's code points are parsed into phrases level by level.  On each level
runs of one symbol become one name, deterministic coin tossing reduces the
symbols to at most six labels (each label depends on a symbol and its left
neighbours only), local maxima of the labels start phrases, and a phrase's
name is a hash of its symbols.  Boundaries depend on a few neighbouring
symbols, so equal substrings get equal interior phrase names wherever they
stand.

The fingerprint is the sorted bottom-k sketch of a document's distinct phrase
names (from level ``FIRST_LEVEL`` up, and the name of the whole text); the
likeness of two fingerprints estimates the Jaccard similarity of the name
sets, exactly when both sets fit in the sketch.  Work runs on batches of
documents as one array with document borders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import partitions, row_key

SKETCH, FIRST_LEVEL, BATCH_CHARS = 64, 2, 1 << 18
_A, _B = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 32-bit values (a bijection of multiply and shift steps)."""
    x = x ^ (x >> np.uint32(16))
    x *= _A
    x ^= x >> np.uint32(13)
    x *= _B
    x ^= x >> np.uint32(16)
    return x


def _toss(sym: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One round of coin tossing: twice the lowest bit position in which a
    symbol differs from its left neighbour, plus that bit.  The first symbol
    of a document is compared with itself, lowest bit flipped."""
    one = sym.dtype.type(1)
    low = np.empty_like(sym)
    np.bitwise_xor(sym[1:], sym[:-1], out=low[1:])
    low[start] = one
    low &= ~low + one
    label = np.bitwise_count(low - one)
    label <<= np.uint8(1)
    label |= (sym & low) != 0
    return label


def parse_level(sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of one level and their document-start flags."""
    new = start.copy()
    new[1:] |= sym[1:] != sym[:-1]
    if not new.all():
        at = np.flatnonzero(new)
        runs = np.diff(np.append(at, len(sym)))
        sym, start = sym[at], start[at]
        long = runs > 1
        sym[long] = _mix(sym[long] ^ _mix(runs[long].astype(np.uint32) + _B))
    label = sym
    for _ in range(4):
        label = _toss(label, start)
    cut = np.ones(len(sym), dtype=bool)
    cut[1:] = label[1:] > label[:-1]
    cut[:-1] &= (label[:-1] > label[1:]) | start[1:]
    cut |= start
    heads = np.flatnonzero(cut)
    room = np.diff(np.append(heads, len(sym)))
    name = _mix(sym[heads] + _B)
    alive, j = np.flatnonzero(room > 1), 1
    while len(alive):
        name[alive] = _mix(name[alive] * _A + sym[heads[alive] + j])
        j += 1
        alive = alive[room[alive] > j]
    return name, start[heads]


def sketches(texts: list[str]) -> list[str]:
    """Fingerprint of each text: up to SKETCH sorted 32-bit names in hex; the
    empty text has the empty fingerprint."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    live = np.flatnonzero(sizes)
    out = [""] * len(texts)
    if not len(live):
        return out
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sym = codes.copy()
    start = np.zeros(len(sym), dtype=bool)
    start[np.cumsum(sizes[live]) - sizes[live]] = True
    owners, names, level = [], [], 0
    doc = live
    while len(sym):
        sym, start = parse_level(sym, start)
        level += 1
        of = doc[np.cumsum(start) - 1]
        alone = start & np.append(start[1:], True)      # a document that is one phrase is done
        take = alone if level < FIRST_LEVEL else np.ones(len(sym), dtype=bool)
        owners.append(of[take])
        names.append(_mix(sym[take] ^ _B))
        keep = ~alone
        doc = doc[~alone[start]]
        sym, start = sym[keep], start[keep]
    owner, name = np.concatenate(owners), np.concatenate(names)
    order = np.argsort(owner, kind="stable")
    owner, name = owner[order], name[order]
    first = np.searchsorted(owner, live)
    last = np.searchsorted(owner, live, side="right")
    for i, lo, hi in zip(live, first, last):
        part = name[lo:hi]
        if len(part) > 8 * SKETCH:      # names are uniform: the smallest lie under this bound
            few = np.unique(part[part < np.uint32(4 * SKETCH * (1 << 32) // len(part))])
            part = few if len(few) >= SKETCH else np.unique(part)
        else:
            part = np.unique(part)
        out[i] = part[:SKETCH].astype(">u4").tobytes().hex()
    return out


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity; two empty fingerprints are alike."""
    if a == b:
        return 1.0
    x, y = ({f[i:i + 8] for i in range(0, len(f), 8)} for f in (a, b))
    both = sorted(x | y)
    if len(x) >= SKETCH or len(y) >= SKETCH:
        both = both[:SKETCH]
    return sum(1 for v in both if v in x and v in y) / len(both)


def in_batches(texts: Iterator[str]) -> Iterator[str]:
    """Fingerprints of a stream of texts, computed in batches of bounded size."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= BATCH_CHARS:
            yield from sketches(held)
            held, n = [], 0
    yield from sketches(held)


def _neighbours(docs: DataFrame) -> DataFrame:
    """Rows (id string, text, part, guard) dealt by ranges of the id, in each
    partition by part, descending id, text key.  The row after the last of a
    range is the head of the next lower range (after the lowest: of the
    highest); that head is added to the range as a guard row, so only one row
    per range is sent twice."""
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.withColumn("rk", row_key())
    n = 4 * partitions(docs.sparkSession)
    cuts = np.array(sorted(set(d.select(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n)).first()[0] or [])),
                    dtype=np.int64)

    def locate(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(dtype=np.int64)))
    located: pd.Series = F.pandas_udf(locate, "long")(F.coalesce("id", F.lit(0)))
    d = d.withColumn("part", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(located))
    # one head per range: largest id, then smallest key; at most n + 1 rows
    heads = sorted((r["part"], r["h"]["id"], ~r["h"]["inv"]) for r in
                   d.groupBy("part").agg(F.max(F.struct("id", F.bitwise_not("rk").alias("inv"))).alias("h")).collect())
    spark = docs.sparkSession
    guards = [(heads[i - 1][1], heads[i - 1][2], heads[i][0]) for i in range(len(heads))]
    g = spark.createDataFrame(guards, "gid long, grk long, gpart long")
    extra = d.join(F.broadcast(g), F.col("id").eqNullSafe(F.col("gid")) & (F.col("rk") == F.col("grk")))
    rows = d.select("id", "rk", "text", "part", F.lit(0).alias("guard")).union(
        extra.select("id", "rk", "text", F.col("gpart").alias("part"), F.lit(1).alias("guard")))
    rows = rows.repartition("part").sortWithinPartitions("part", "guard", F.col("id").desc_nulls_last(), "rk")
    return rows.select(F.col("id").cast("string").alias("id"), "text", "part", "guard")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Per row: its fingerprint, that of its edited text (the last third of the
    code points replaced by the first as many of the next row, descending id),
    and the likeness to the edited text and to the next row.

    Null texts are empty (fingerprint ""); null ids come last, equal ids are
    ordered by a key of their text, so repeated rows keep their place; a table
    of one row is its own neighbour; an empty table gives no rows."""
    fields = ("doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    names = [f.split()[0] for f in fields.split(", ")]

    def flush(rows: list[tuple], nexts: list[str]) -> pd.DataFrame:
        """rows: (id, text) with the text after each in ``nexts``."""
        edited = [t[:len(t) - len(t) // 3] + x[:len(t) // 3] for (_, t), x in zip(rows, nexts)]
        # a row's successor is mostly the next row: fingerprint each text once
        firsts = [t for _, t in rows]
        own = list(in_batches(iter([*firsts, nexts[-1]])))
        changed = list(in_batches(iter(edited)))
        after = [own[i + 1] for i in range(len(rows) - 1)] + [own[-1]]
        for i, (x, t) in enumerate(zip(nexts[:-1], firsts[1:])):
            if x is not t:          # a range ended here: its successor is a guard
                after[i] = sketches([x])[0]
        out = [(i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), f, c, likeness(f, c), likeness(f, a))
               for (i, t), e, f, c, a in zip(rows, edited, own, changed, after)]
        return pd.DataFrame(out, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, nexts, n, pending, part = [], [], 0, None, None
        for pdf in batches:
            for i, text, p, guard in pdf.itertuples(index=False, name=None):
                if pending is not None and part == p:
                    rows.append(pending)
                    nexts.append(text)
                    n += len(pending[1])
                    pending = None
                if not guard:       # the first guard row serves the range's last row; others are its equals
                    pending, part = (i if isinstance(i, str) else None, text), p
                if n >= BATCH_CHARS:
                    yield flush(rows, nexts)
                    rows, nexts, n = [], [], 0
        if rows:
            yield flush(rows, nexts)
    got = _neighbours(docs).mapInPandas(run, fields)
    return got.withColumn("doc_id", F.col("doc_id").cast("long"))
