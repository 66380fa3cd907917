"""Factor models: ALS fit, vector scores and the cold-start cascade.

Scoring every candidate item for every query user is a dense product.  It is
done the way Spark's ALS ``recommendForAll`` does it: users and items are
hashed into blocks, each block pair meets once in a cogrouped
``applyInPandas`` that multiplies the two factor matrices with numpy and keeps
only the top ``n`` per user, then the per-block winners are merged per user.
No pair row is ever emitted, nothing goes through the driver, and the
replication is (item blocks) copies of each user and (user blocks) copies of
each item, both parameters.

Score rules (per query user u, candidate item i, weight w(i) default 1):
- known user:   dot(u, i) * w(i), kept when > 0
- similar:      sum over recent items r of cosine(r, i) * w(i), kept when > 0
                (= dot(sum_r r/|r|, i/|i|): the per-user profile is summed first)
- default:      buy count(i) * w(i), zero scores kept
Candidates pass the whitelist (when given), are not among the user's excluded
(user, item) rows, and carry all asked genres.  Ties: item id ascending.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.operators.joins import blocked_join
from recoflow.operators.ranking import global_row_number, topn_per_group
from recoflow.session import cut_lineage

RECS_SCHEMA = "user long, item long, score double"
CHUNK_CELLS = 1_000_000        # doubles in one score chunk (8 MB)
USERS_PER_BLOCK, ITEMS_PER_BLOCK = 25_000, 50_000      # (13 and 26 MB of 64-dim vectors)
TILE = 64                      # neighbouring columns whose best score stands for them


def als_fit(inter: DataFrame, rank: int = 10, iterations: int = 20, reg: float = 0.01, seed: int = 3,
            user_col="user", item_col="item", rating_col="rating", implicit: bool = False):
    """Explicit ALS (the engine defaults); ids must be ints (see ``remap_ids``)."""
    from pyspark.ml.recommendation import ALS
    als = ALS(rank=rank, maxIter=iterations, regParam=reg, seed=seed, userCol=user_col, itemCol=item_col,
              ratingCol=rating_col, coldStartStrategy="drop", implicitPrefs=implicit)
    return als.fit(inter)


def latest_ratings(rated: DataFrame) -> DataFrame:
    """Latest rating per (user, item): repeated ratings do not all enter ALS."""
    return rated.groupBy("user", "item").agg(
        F.max_by("rating", F.struct("ts", "event_id")).cast("double").alias("rating"))


def _blocks(df: DataFrame, key: str, name: str, n: int) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int"))


def _near_best(S: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that can be among the ``n`` best of their
    row: the n-th best of the tiles' best scores is no better than the n-th best."""
    if S.shape[1] <= n:
        return np.nonzero(S > -np.inf)
    tile = max(1, min(TILE, S.shape[1] // (4 * n)))
    best = np.maximum.reduceat(S, np.arange(0, S.shape[1], tile), axis=1) if tile > 1 else S
    m = best.shape[1]
    low = np.partition(best, m - n, axis=1)[:, m - n:m - n + 1]
    return np.nonzero(S >= np.maximum(low, np.finfo(S.dtype).min))


def _first_n(rows: np.ndarray, cols: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``n`` best of each row by (score desc, column); infinite ones take a place and are left out."""
    o = np.lexsort((cols, -s, rows))
    rows, cols, s = rows[o], cols[o], s[o]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    take = (place < n) & np.isfinite(s)
    return rows[take], cols[take], s[take]


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys the sorted ``known`` holds."""
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _listed_pairs(rows: np.ndarray, white: np.ndarray, ids: np.ndarray, size: int):
    """(rows, columns) of the listed ids that are here, whole rows at a time, near ``size`` pairs or a row."""
    got, n = [], 0
    for r in rows:
        own = np.unique(np.asarray(white[r], dtype=np.int64))
        lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
        cols = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        got.append((r, cols))
        n += len(cols)
        if n >= size:
            yield np.repeat([r for r, _ in got], [len(c) for _, c in got]), np.concatenate([c for _, c in got])
            got, n = [], 0
    if got:
        yield np.repeat([r for r, _ in got], [len(c) for _, c in got]), np.concatenate([c for _, c in got])


def _topn_block(n: int):
    """Per (user block, item block): scores as one matrix product, the block's
    excluded pairs struck out, then the best ``n`` items of every user row.
    The users' frame also holds the exclusion rows of this block pair."""
    def fn(users: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"user": pd.Series([], dtype="int64"), "item": pd.Series([], dtype="int64"),
                              "score": pd.Series([], dtype="float64")})
        struck = users[users["ex_item"].notna()]
        users = users[users["ex_item"].isna()]
        if users.empty or items.empty:
            return empty
        items = items.sort_values("item", kind="stable")
        ids = items["item"].to_numpy(np.int64)
        U = np.vstack([np.asarray(v, dtype=np.float64) for v in users["vec"]])
        X = np.vstack([np.asarray(v, dtype=np.float64) for v in items["vec"]])
        w = items["weight"].to_numpy(np.float64)[None, :]
        cos_rows = (users["mode"] == "cosine").to_numpy()
        norms = np.linalg.norm(X, axis=1)
        Xn = np.divide(X, norms[:, None], out=np.zeros_like(X), where=norms[:, None] > 0) if cos_rows.any() else X
        # genres as bits: an item passes when it carries all the bits asked for
        asked = [tuple(g) if g is not None else () for g in users["genres"]]
        names = {g: k for k, g in enumerate(sorted({x for t in asked for x in t}))}
        lacks = None
        if names:
            carries = np.zeros((len(ids), len(names)), dtype=np.float32)
            for r, g in enumerate(items["genres"] if "genres" in items else [None] * len(ids)):
                for x in (g if g is not None else ()):
                    if x in names:
                        carries[r, names[x]] = 1.0
            wants = np.zeros((len(asked), len(names)), dtype=np.float32)
            for r, t in enumerate(asked):
                wants[r, [names[x] for x in t]] = 1.0
            lacks = (wants, 1.0 - carries)
        listed = users["whitelist"].notna().to_numpy()
        white = users["whitelist"].to_numpy()
        who = users["user"].to_numpy(np.int64)
        row_of = pd.Series(np.arange(len(who)), index=who)
        ex_row = row_of.reindex(struck["user"].to_numpy(np.int64)).to_numpy(np.float64)
        ex_at = np.searchsorted(ids, struck["ex_item"].to_numpy(np.int64))
        hit = ~np.isnan(ex_row) & (ex_at < len(ids))
        ex_row, ex_at, ex_item = ex_row[hit].astype(np.int64), ex_at[hit], struck["ex_item"].to_numpy(np.int64)[hit]
        same = ids[ex_at] == ex_item
        ex_row, ex_at = ex_row[same], ex_at[same]
        by_row = np.argsort(ex_row, kind="stable")
        ex_row, ex_at = ex_row[by_row], ex_at[by_row]
        out = []
        # score users in chunks so the score matrix stays near CHUNK_CELLS
        # doubles whatever the block sizes are
        step = max(1, CHUNK_CELLS // max(1, X.shape[0]))
        open_rows = np.flatnonzero(~listed)
        for c0 in range(0, len(open_rows), step):
            at = open_rows[c0:c0 + step]
            cr = cos_rows[at]
            S = U[at] @ X.T
            if cr.any():
                S[cr] = U[at][cr] @ Xn.T
            S *= w
            S[~(S > 0)] = -np.inf
            if lacks is not None:
                S[(lacks[0][at] @ lacks[1].T) > 0] = -np.inf
            mine = slice(np.searchsorted(ex_row, at[0]), np.searchsorted(ex_row, at[-1], "right"))
            r = np.searchsorted(at, ex_row[mine])
            kept = at[r] == ex_row[mine]
            S[r[kept], ex_at[mine][kept]] = -np.inf
            rows, cols = _near_best(S, n)
            out.append(_first_n(at[rows], cols, S[rows, cols], n))
        # a query with its own list scores that list alone
        struck_pairs = np.sort(ex_row * len(ids) + ex_at)
        for rows, cols in _listed_pairs(np.flatnonzero(listed), white, ids, max(1, CHUNK_CELLS // X.shape[1])):
            cr = cos_rows[rows]
            s = np.einsum("ij,ij->i", U[rows], np.where(cr[:, None], Xn[cols], X[cols])) * w[0, cols]
            ok = s > 0
            if lacks is not None:
                ok &= (lacks[0][rows] * lacks[1][cols]).sum(axis=1) == 0
            ok &= ~_among(rows * len(ids) + cols, struck_pairs)
            out.append(_first_n(rows[ok], cols[ok], s[ok], n))
        rows, cols, s = (np.concatenate([o[k] for o in out]) for k in range(3))
        return pd.DataFrame({"user": who[rows], "item": ids[cols], "score": s})
    return fn


def blocked_topn(users: DataFrame, items: DataFrame, n: int, exclusions: DataFrame | None = None,
                 user_blocks: int | None = None, item_blocks: int | None = None) -> DataFrame:
    """Exact top ``n`` items per user by (score desc, item asc), minus the
    user's excluded items.

    users: (user long, vec array[, mode 'dot'|'cosine'][, whitelist
    array<long>][, genres array<string>]); items: (item long, vec array,
    weight double[, genres array<string>]); exclusions: (user, item) rows.
    An exclusion row goes only to the block pair of its user and item, so a
    block keeps n candidates a user however much the user excludes.
    """
    spark = users.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = max(1, int(parts ** 0.5))
    # blocks grow with the data so one group stays near USERS_PER_BLOCK x
    # ITEMS_PER_BLOCK; each side is replicated once per block of the other side.  The
    # user side (joins, profile sums) is written once, so counting it does
    # not compute it twice.
    if user_blocks is None:
        users = cut_lineage(users)
    ub = user_blocks or max(base, -(-users.count() // USERS_PER_BLOCK))
    ib = item_blocks or max(base, -(-items.select("item").count() // ITEMS_PER_BLOCK))
    if "mode" not in users.columns:
        users = users.withColumn("mode", F.lit("dot"))
    if "whitelist" not in users.columns:
        users = users.withColumn("whitelist", F.lit(None).cast("array<bigint>"))
    if "genres" not in users.columns:
        users = users.withColumn("genres", F.lit(None).cast("array<string>"))
    u = _blocks(users, "user", "ub", ub).withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(ib - 1))))
    i = _blocks(items, "item", "ib", ib).withColumn("ub", F.explode(F.sequence(F.lit(0), F.lit(ub - 1))))
    u = u.select("ub", "ib", "user", "vec", "mode", "whitelist", "genres", F.lit(None).cast("bigint").alias("ex_item"))
    if exclusions is not None:
        ex = _blocks(_blocks(exclusions.select("user", "item").distinct(), "user", "ub", ub), "item", "ib", ib)
        u = u.unionByName(ex.select("ub", "ib", "user", F.col("item").alias("ex_item")), allowMissingColumns=True)
    icols = ["ub", "ib", "item", "vec", "weight"] + (["genres"] if "genres" in items.columns else [])
    part = (u.groupBy("ub", "ib").cogroup(i.select(*icols).groupBy("ub", "ib"))
            .applyInPandas(_topn_block(n), RECS_SCHEMA))
    top = topn_per_group(part, ["user"], [F.col("score").desc(), F.col("item").asc()], n)
    return top.select("user", F.col("rank").cast("int").alias("rank"), "item", "score")


def _item_side(item_factors: DataFrame, weights: DataFrame | None) -> DataFrame:
    it = item_factors.select("item", F.col("embedding").alias("vec"),
                             *(["genres"] if "genres" in item_factors.columns else []))
    if weights is not None:
        it = it.join(weights.select("item", F.col("weight").alias("_w")), "item", "left").withColumn(
            "weight", F.coalesce("_w", F.lit(1.0))).drop("_w")
    elif "weight" in item_factors.columns:
        it = it.join(item_factors.select("item", "weight"), "item")
    else:
        it = it.withColumn("weight", F.lit(1.0))
    return it


def _known_side(queries: DataFrame, user_factors: DataFrame) -> DataFrame:
    return queries.join(user_factors.select("user", F.col("embedding").alias("vec")), "user").withColumn(
        "mode", F.lit("dot"))


def _similar_side(queries: DataFrame, recent: DataFrame, item_factors: DataFrame) -> DataFrame:
    return queries.join(user_profiles(recent, item_factors), "user").withColumn("mode", F.lit("cosine"))


def als_known_user(queries: DataFrame, user_factors: DataFrame, item_factors: DataFrame,
                   weights: DataFrame | None = None, n: int = 10, exclusions: DataFrame | None = None,
                   **blocks) -> DataFrame:
    """queries: (user[, whitelist, genres]); user_factors (user, embedding)."""
    return blocked_topn(_known_side(queries, user_factors), _item_side(item_factors, weights), n, exclusions,
                        **blocks)


def user_profiles(recent: DataFrame, item_factors: DataFrame) -> DataFrame:
    """(user, vec): sum of the unit vectors of the user's recent items (zero
    vectors add nothing), built with a shuffle on (user, position)."""
    # the norm is computed once per item row, before the explode: written next
    # to the generator it would be evaluated once per element, and
    # higher-order functions run interpreted (no codegen)
    it = item_factors.select("item", "embedding", F.sqrt(F.aggregate(
        F.transform("embedding", lambda x: x.cast("double") * x.cast("double")),
        F.lit(0.0), lambda a, b: a + b)).alias("norm"))
    j = recent.select("user", "item").distinct().join(it, "item")
    e = j.select("user", "norm", F.posexplode("embedding").alias("pos", "x"))
    e = e.withColumn("x", F.when(F.col("norm") > 0, F.col("x").cast("double") / F.col("norm")).otherwise(F.lit(0.0)))
    s = e.groupBy("user", "pos").agg(F.sum("x").alias("x"))
    return s.groupBy("user").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda t: t["x"]).alias("vec"))


def als_similar(queries: DataFrame, recent: DataFrame, item_factors: DataFrame,
                weights: DataFrame | None = None, n: int = 10, exclusions: DataFrame | None = None,
                **blocks) -> DataFrame:
    return blocked_topn(_similar_side(queries, recent, item_factors), _item_side(item_factors, weights), n,
                        exclusions, **blocks)


def als_default(queries: DataFrame, counts: DataFrame, items: DataFrame, weights: DataFrame | None = None,
                n: int = 10, exclusions: DataFrame | None = None) -> DataFrame:
    """Popularity x weight, zero scores kept, minus each query's exclusions.

    queries: (user[, whitelist array][, genres array]).  A whitelisted query
    scores its own list.  Any other query needs only the first n + |excluded|
    items that carry its genres: items are ranked once per distinct set of
    asked genres, and queries join that many places (no cross join)."""
    w = weights.select("item", "weight") if weights is not None else None
    has = F.col("genres") if "genres" in items.columns else F.lit(None).cast("array<string>")
    sc = items.groupBy("item").agg(F.first(has, ignorenulls=True).alias("has")).join(
        counts.select("item", F.col("n_buys").cast("double").alias("c")), "item", "left")
    if w is not None:
        sc = sc.join(w, "item", "left")
    else:
        sc = sc.withColumn("weight", F.lit(1.0))
    sc = cut_lineage(sc.select("item", "has", (F.coalesce("c", F.lit(0.0)) * F.coalesce("weight", F.lit(1.0))).alias("score")))

    def option(name: str, kind: str):
        return (F.col(name) if name in queries.columns else F.lit(None)).cast(kind).alias(name)
    q = queries.select("user", option("whitelist", "array<bigint>"), option("genres", "array<string>"))
    q = q.withColumn("genres", F.array_sort(F.array_distinct(F.coalesce("genres", F.array().cast("array<string>")))))
    ex = exclusions.select("user", "item").distinct() if exclusions is not None else None
    carries = F.size(F.array_except("genres", F.coalesce("has", F.array().cast("array<string>")))) == 0

    parts = []
    if "whitelist" in queries.columns:
        own = q.where(F.col("whitelist").isNotNull()).select("user", "genres", F.explode(F.array_distinct("whitelist")).alias("item"))
        parts.append(blocked_join(own, sc, ["item"], "user").where(carries).select("user", "item", "score"))
    rest = q.where(F.col("whitelist").isNull())
    if ex is not None:
        rest = rest.join(ex.groupBy("user").agg(F.count(F.lit(1)).alias("extra")), "user", "left")
    else:
        rest = rest.withColumn("extra", F.lit(0))
    rest = rest.withColumn("need", F.lit(n).cast("bigint") + F.coalesce("extra", F.lit(0)))
    rest = rest.withColumn("sig", F.array_join("genres", "\x01"))
    order = [F.col("score").desc(), F.col("item").asc()]
    ranked = global_row_number(sc.select("item", "score"), order, "pos").withColumn("sig", F.lit(""))
    if "genres" in queries.columns:
        # items meet a genre set by its first genre; ranks come in two steps, by share of items, then all
        sigs = rest.where("sig != ''").groupBy("sig", "genres").agg(F.max("need").alias("need"))
        first = sigs.withColumn("g", F.col("genres")[0])
        tagged = sc.where(F.col("has").isNotNull()).select("item", "score", "has", F.explode(F.array_distinct("has")).alias("g"))
        m = blocked_join(tagged, first, ["g"], "item").where(carries)
        m = m.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(16)))
        m = topn_per_group(m, ["sig", "salt"], order, F.col("need"), "pos")
        m = topn_per_group(m.drop("pos"), ["sig"], order, F.col("need"), "pos")
        ranked = ranked.unionByName(m.select("sig", F.col("pos").cast("bigint").alias("pos"), "item", "score"))
    need = rest.select("user", "sig", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("need"))).alias("pos"))
    parts.append(blocked_join(need, ranked, ["sig", "pos"], "user").select("user", "item", "score"))
    cand = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if ex is not None:
        cand = cand.join(ex, ["user", "item"], "left_anti")
    top = topn_per_group(cand, ["user"], order, n)
    return top.select("user", F.col("rank").cast("int").alias("rank"), "item", "score")


def cascade_recommend(queries: DataFrame, user_factors: DataFrame, item_factors: DataFrame,
                      recent: DataFrame, counts: DataFrame, weights: DataFrame | None = None, n: int = 10,
                      exclusions: DataFrame | None = None, **blocks) -> DataFrame:
    """Known user -> factor scores; else users with recent items -> cosine
    scores; else popularity.  The query table is split in three by semi and
    anti joins; the two factor paths share one blocked product (a per-row
    mode), and the results are unioned; ``path`` says which rule served.
    Whitelist and genres columns of the queries bind on all three paths."""
    options = [c for c in ("whitelist", "genres") if c in queries.columns]
    known = queries.join(user_factors.select("user"), "user", "left_semi")
    rest = queries.join(user_factors.select("user"), "user", "left_anti")
    has_recent = recent.join(item_factors.select("item"), "item", "left_semi").select("user").distinct()
    warm = rest.join(has_recent, "user", "left_semi")
    cold = rest.join(has_recent, "user", "left_anti")
    side = (_known_side(known.select("user", *options), user_factors)
            .unionByName(_similar_side(warm.select("user", *options), recent, item_factors)))
    side = cut_lineage(side.select("user", "vec", "mode", *options))
    f = blocked_topn(side, _item_side(item_factors, weights), n, exclusions, **blocks)
    f = f.join(side.select("user", F.when(F.col("mode") == "dot", "known").otherwise("similar").alias("path")), "user")
    c = als_default(cold, counts, item_factors, weights, n, exclusions).withColumn("path", F.lit("default"))
    return f.unionByName(c)
