"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of the labelled texts (at most
about ``per_lang`` rows a language, picked by a hash of the id, so the same
rows at every run); the log-probability matrix (languages x buckets) is
broadcast.  Its size is bounded by ``MAX_LANGS`` x ``BUCKETS``.  Scoring works
on Arrow batches: all texts of a batch become one list of bucket numbers with
document offsets (a sparse matrix in CSR form, one entry per n-gram), whose
product with the matrix is a gather and a segmented sum.

A text is lowered, every run of non-letters becomes one space, and a space is
put at both ends.  Texts over ``SLICE`` characters are read in slices (n-grams
across a slice border are not counted), so memory stays bounded and every
character counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import whole_rows

BUCKETS, ORDERS, MAX_LANGS, SLICE, CHUNK = 1 << 15, (1, 2, 3), 512, 1 << 20, 1 << 18
PER_LANG, TRAIN_TASKS, ALPHA = 3000, 12, 0.5
UND = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def normalised(text: str) -> np.ndarray:
    """Code points of the lowered text, runs of non-letters as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(letter_table()[codes], codes, np.uint32(32))
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


def ngram_buckets(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(orders x positions) bucket numbers of the joined pieces and the piece
    starts; BUCKETS marks n-grams that would cross a piece's end."""
    sizes = np.array([len(p) for p in pieces])
    flat = np.concatenate(pieces).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(flat))
    out = np.full((len(ORDERS), len(flat)), BUCKETS, dtype=np.int32)
    h = np.zeros(len(flat), dtype=np.uint32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    done = 0
    for row, n in enumerate(ORDERS):
        while done < n:
            h[:len(flat) - done] = h[:len(flat) - done] * np.uint32(0x01000193) + flat[done:] + np.uint32(1)
            done += 1
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)
        ok = room >= n
        out[row, ok] = (mixed >> shift)[ok]
    return out, starts


def _chunks(texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, piece starts, text index of each piece) in bounded chunks."""
    pieces, owner, n = [], [], 0
    for i, text in enumerate(texts):
        if text is None:
            continue
        for at in range(0, len(text), SLICE):
            p = normalised(text[at:at + SLICE])
            if len(p) < 2:      # no letter
                continue
            pieces.append(p)
            owner.append(i)
            n += len(p)
            if n >= CHUNK:
                yield (*ngram_buckets(pieces), np.array(owner))
                pieces, owner, n = [], [], 0
    if pieces:
        yield (*ngram_buckets(pieces), np.array(owner))


class Model:
    """Languages and their log probabilities: a row per bucket, plus a zero row."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray):
        self.langs = langs
        if langs:
            logp = np.log((counts + ALPHA) / (counts.sum(axis=1, keepdims=True) + ALPHA * BUCKETS))
            self.matrix = np.vstack([logp.T, np.zeros((1, len(langs)))]).astype(np.float32)
            self.prior = np.log(docs / docs.sum())

    def predict(self, texts) -> pd.DataFrame:
        n = len(texts)
        if not self.langs:
            return pd.DataFrame({"lang": [UND] * n, "score": np.zeros(n)})
        total, seen = np.zeros((n, len(self.langs))), np.zeros(n, dtype=bool)
        for buckets, starts, owner in _chunks(texts):
            for row in buckets:
                sums = np.add.reduceat(self.matrix[row], starts, axis=0, dtype=np.float64)
                np.add.at(total, owner, sums)
            seen[owner] = True
        total += self.prior
        best = total.argmax(axis=1)
        score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names = np.array(self.langs, dtype=object)
        return pd.DataFrame({"lang": np.where(seen, names[best], UND), "score": np.where(seen, score, 0.0)})


def _count_ngrams(langs: list[str]):
    at = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(langs), BUCKETS + 1), dtype=np.int64)
        docs = np.zeros(len(langs), dtype=np.int64)
        for pdf in batches:
            which = pdf["lang"].map(at).to_numpy()
            docs += np.bincount(which, minlength=len(langs))
            for buckets, starts, owner in _chunks(pdf["text"]):
                sizes = np.diff(np.append(starts, buckets.shape[1]))
                lang = np.repeat(which[owner], sizes) * (BUCKETS + 1)
                for row in buckets:
                    counts += np.bincount(lang + row, minlength=counts.size).reshape(counts.shape)
        rows, cols = np.nonzero(counts[:, :BUCKETS])
        yield pd.DataFrame({"lang": rows, "bucket": cols, "n": counts[rows, cols]})
        yield pd.DataFrame({"lang": np.arange(len(langs)), "bucket": -1, "n": docs})
    return run


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_lang: int = PER_LANG) -> Model:
    """Fit on rows with a non-null language and text.  ``per_lang`` bounds the
    sample: languages with more rows are thinned by a hash of id and text.
    Raises if there are over MAX_LANGS languages; no rows give a model that
    answers ``und``."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages in {lang_col}")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.lit(11), "id", "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < share[F.col("lang")]).select("text", "lang").repartition(TRAIN_TASKS)
    cells = (sample.mapInPandas(_count_ngrams(langs), "lang int, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())   # at most langs x (buckets + 1)
    counts, docs = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    for part, out in ((cells[cells.bucket >= 0], counts), (cells[cells.bucket < 0], docs)):
        if out is counts:
            out[part["lang"], part["bucket"]] = part["n"]
        else:
            out[part["lang"]] = part["n"]
    return Model(langs, counts, np.maximum(docs, 1))


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Column of struct(lang, score) for ``docs[text_col]``; only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield shared.value.predict([t if isinstance(t, str) else None for t in texts])
    return F.pandas_udf(run, "lang string, score double")(F.col(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, remainder 2 of 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row: trained on the rows not
    held out, predicted from the text alone.  Null, empty and letter-free
    texts give ``und`` with score 0; repeated rows each keep their row."""
    model = train(docs.where(~held_out()), per_lang=per_lang)
    d = docs.select(F.col("doc_id"), held_out().alias("held_out"), predicted(docs, model).alias("p"))
    return d.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, min_score: float = 0.5, per_lang: int = PER_LANG) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or less sure than
    ``min_score``; columns stay as they are."""
    model = train(docs.where(~held_out()), per_lang=per_lang)
    d = whole_rows(docs).withColumn("p", predicted(docs, model, "row.text"))
    return d.where((F.col("p.lang") != UND) & (F.col("p.score") >= min_score)).select("row.*")
