"""Evaluation metrics, splits, negative sampling and behaviour sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recoflow.functions.scalar import vec_dot
from recoflow.operators import metrics as M
from recoflow.operators import sampling as S
from recoflow.plans.registry import register
from recoflow.plans.sqlparts import ctes
from recoflow.session import cut_lineage
from recoflow.sources import tables as T
from recoflow.sources.tables import PRIMARY, SEED

K, THRESHOLD = 10, 3
KS, THRESHOLDS = (50, 200, 300), (2, 3, 4)


def _recs(spark, sf):
    """The user's views, newest first, as a ranked list of any length."""
    w = Window.partitionBy("user").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    v = T.inter(spark, sf).where("action = 'view'")
    return v.select("user", "item", F.row_number().over(w).alias("rank"))


def _truth(spark, sf):
    return T.rated(spark, sf).select("user", "item", "rating")


_PR = f"""
recs AS (SELECT user, item, row_number() OVER (PARTITION BY user ORDER BY ts DESC, event_id DESC) AS rank
  FROM inter WHERE action = 'view'),
pos AS (SELECT DISTINCT user, item FROM rated WHERE rating >= {THRESHOLD}),
npos AS (SELECT user, count(*) AS n_pos FROM pos GROUP BY user),
hits AS (SELECT r.user, count(*) AS hits FROM recs r JOIN pos p ON p.user = r.user AND p.item = r.item
  WHERE r.rank <= {K} GROUP BY r.user),
per AS (SELECT n.user, n.n_pos, coalesce(h.hits, 0) AS hits FROM npos n LEFT JOIN hits h ON h.user = n.user)"""


@register("precision_at_k", ctes(("inter", "rated"), _PR) + f"""
SELECT round(avg(CAST(hits AS DOUBLE) / {K}), 6) AS precision, count(*) AS n_users FROM per""")
def q_precision_at_k(spark, sf):
    p = M.precision_at_k(_recs(spark, sf), _truth(spark, sf), K, THRESHOLD)
    return p.select(F.round("precision", 6).alias("precision"), "n_users")


@register("recall_at_k", ctes(("inter", "rated"), _PR) + """
SELECT round(avg(CAST(hits AS DOUBLE) / n_pos), 6) AS recall, count(*) AS n_users FROM per""")
def q_recall_at_k(spark, sf):
    p = M.recall_at_k(_recs(spark, sf), _truth(spark, sf), K, THRESHOLD)
    return p.select(F.round("recall", 6).alias("recall"), "n_users")


@register("positive_count", ctes(("rated",)) + f"""
SELECT round(avg(n), 6) AS positive_count FROM (SELECT user, sum(CASE WHEN rating >= {THRESHOLD} THEN 1 ELSE 0 END) AS n
FROM rated GROUP BY user)""")
def q_positive_count(spark, sf):
    return M.positive_count(_truth(spark, sf), THRESHOLD).select(F.round("positive_count", 6).alias("positive_count"))


_PARAMS = " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, {k} AS k" for t in THRESHOLDS for k in KS)


@register("metric_grid", ctes(("inter", "rated"), f"""
recs AS (SELECT user, item, row_number() OVER (PARTITION BY user ORDER BY ts DESC, event_id DESC) AS rank
  FROM inter WHERE action = 'view'),
params AS ({_PARAMS}),
pos AS (SELECT DISTINCT r.user, r.item, p.threshold, p.k FROM rated r CROSS JOIN params p WHERE r.rating >= p.threshold),
npos AS (SELECT threshold, k, user, count(*) AS n_pos FROM pos GROUP BY ALL),
hits AS (SELECT p.threshold, p.k, p.user, count(*) AS hits FROM pos p JOIN recs r ON r.user = p.user AND r.item = p.item
  WHERE r.rank <= p.k GROUP BY ALL),
per AS (SELECT n.*, coalesce(h.hits, 0) AS hits FROM npos n LEFT JOIN hits h
  ON h.threshold = n.threshold AND h.k = n.k AND h.user = n.user)""") + """
SELECT threshold, CAST(k AS INTEGER) AS k, round(avg(CAST(hits AS DOUBLE) / k), 6) AS precision,
  round(avg(CAST(hits AS DOUBLE) / n_pos), 6) AS recall, count(*) AS n_users FROM per GROUP BY threshold, k""")
def q_metric_grid(spark, sf):
    g = M.metric_grid(_recs(spark, sf), _truth(spark, sf), KS, THRESHOLDS)
    return g.select("threshold", "k", F.round("precision", 6).alias("precision"),
                    F.round("recall", 6).alias("recall"), "n_users")


# --------------------------------------------------------------------------- splits
@register("kfold_split", ctes(("inter",)) + """
SELECT event_id, user, item, CAST(((event_id * 7919) % 5 + 5) % 5 AS INTEGER) AS fold FROM inter""")
def q_kfold_split(spark, sf):
    return S.kfold_split(T.inter(spark, sf).select("event_id", "user", "item"), "event_id", 5)


@register("stratified_kfold", ctes(("ctr",)) + f"""
SELECT id, target, CAST((row_number() OVER (ORDER BY target, md5('{SEED}|' || id), id) - 1) % 5 AS INTEGER) AS fold
FROM ctr""")
def q_stratified_kfold(spark, sf):
    return S.stratified_kfold(T.ctr(spark, sf).select("id", "target"), "target", "id", 5, SEED)


@register("random_split", ctes(("inter", "rated")) + """
SELECT *, CASE WHEN ('0x' || substr(md5('3|' || event_id), 1, 8))::BIGINT / 4294967296.0 < 0.7 THEN 'train'
  ELSE 'test' END AS split FROM rated""")
def q_random_split(spark, sf):
    train, test = S.random_split(T.rated(spark, sf), [0.7, 0.3], 3, "event_id")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


_LLO = f"""
pur AS (SELECT * FROM inter WHERE action = '{PRIMARY}'),
lastp AS (SELECT arg_max(event_id, (ts, event_id)) AS event_id FROM pur GROUP BY user HAVING count(*) > 1),
llo AS (SELECT p.user, p.item, p.ts, p.event_id, CASE WHEN l.event_id IS NOT NULL THEN 'test' ELSE 'train' END AS split
  FROM pur p LEFT JOIN lastp l ON l.event_id = p.event_id)"""


def _llo(spark, sf):
    p = T.inter(spark, sf).where(F.col("action") == PRIMARY).select("user", "item", "ts", "event_id")
    return S.leave_last_out(p)


@register("leave_last_out", ctes(("inter",), _LLO) + "SELECT user, item, event_id, split FROM llo")
def q_leave_last_out(spark, sf):
    return _llo(spark, sf).select("user", "item", "event_id", "split")


@register("leave_one_out_set", ctes(("inter",), _LLO) + """
SELECT split, count(*) AS n_rows, count(DISTINCT user) AS n_users FROM llo GROUP BY split""")
def q_leave_one_out_set(spark, sf):
    return _llo(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                                F.count_distinct("user").alias("n_users"))


def _neg_sql(positives_cte: str, n: int) -> str:
    return f"""
cat AS (SELECT item, row_number() OVER (ORDER BY md5('{SEED}|' || item), item) - 1 AS p
  FROM (SELECT DISTINCT item FROM item_factors)),
seen AS (SELECT DISTINCT user, item FROM inter),
{positives_cte},
unseen AS (SELECT u.user, c.item, row_number() OVER (PARTITION BY u.user ORDER BY c.p) - 1 AS r,
  count(*) OVER (PARTITION BY u.user) AS n FROM (SELECT DISTINCT user FROM positives) u CROSS JOIN cat c
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user = u.user AND s.item = c.item)),
sizes AS (SELECT user, max(n) AS n FROM unseen GROUP BY user),
slices AS (SELECT p.event_id, p.user, p.item, j, j * z.n // {n} AS lo, (j + 1) * z.n // {n} AS hi
  FROM positives p JOIN sizes z ON z.user = p.user CROSS JOIN range({n}) t(j)),
picks AS (SELECT event_id, user, item, j, lo + ('0x' || substr(md5('{SEED}|' || event_id || '|' || j), 1, 8))::BIGINT
  % (hi - lo) AS r FROM slices WHERE hi > lo),
neg AS (SELECT k.event_id, k.user, k.item, u.item AS neg_item, k.j FROM picks k JOIN unseen u ON u.user = k.user AND u.r = k.r)"""


def _negatives(spark, sf, positives, n):
    inter = T.inter(spark, sf)
    return S.negatives(positives, inter.select("user", "item"), T.item_factors(spark, sf).select("item"), n, SEED)


@register("negatives_train", ctes(("inter", "item_factors"), _LLO, _neg_sql(
    "positives AS (SELECT event_id, user, item FROM llo WHERE split = 'train')", 4)) + """
SELECT event_id, user, item, neg_item, j FROM neg""")
def q_negatives_train(spark, sf):
    pos = _llo(spark, sf).where(F.col("split") == "train").select("event_id", "user", "item")
    return _negatives(spark, sf, pos, 4).select("event_id", "user", "item", "neg_item", "j")


@register("negatives_test", ctes(("inter", "item_factors"), _LLO, _neg_sql(
    "positives AS (SELECT event_id, user, item FROM llo WHERE split = 'test')", 99)) + """
SELECT event_id, user, item, neg_item, j FROM neg""")
def q_negatives_test(spark, sf):
    pos = _llo(spark, sf).where(F.col("split") == "test").select("event_id", "user", "item")
    return _negatives(spark, sf, pos, 99).select("event_id", "user", "item", "neg_item", "j")


@register("never_bought_anti", ctes(("inter", "item_factors")) + f"""
SELECT q.user, (SELECT count(DISTINCT item) FROM item_factors) - count(DISTINCT b.item) AS n_unbought
FROM (SELECT DISTINCT user FROM inter) q LEFT JOIN (SELECT DISTINCT i.user, i.item FROM inter i
  JOIN item_factors f ON f.item = i.item WHERE i.action = '{PRIMARY}') b ON b.user = q.user GROUP BY q.user""")
def q_never_bought_anti(spark, sf):
    """Size of 'all items minus the user's items' per user, without forming
    the complement; the sampled complement itself is ``negatives``."""
    cat = T.item_factors(spark, sf).select("item").distinct()
    n_cat = cat.select(F.count(F.lit(1))).scalar()
    inter = T.inter(spark, sf)
    bought = (inter.where(F.col("action") == PRIMARY).select("user", "item").distinct()
              .join(cat, "item", "left_semi").groupBy("user").agg(F.count(F.lit(1)).alias("nb")))
    users = inter.select("user").distinct()
    return users.join(bought, "user", "left").select("user", (n_cat - F.coalesce("nb", F.lit(0))).alias("n_unbought"))


# --------------------------------------------------------------------------- ranking metrics
_RANK_SQL = ctes(("inter", "item_factors", "user_factors"), _LLO, _neg_sql(
    "positives AS (SELECT event_id, user, item FROM llo WHERE split = 'test' AND user IN (SELECT user FROM user_factors))",
    99)) + f""",
cand AS (SELECT user, neg_item AS item FROM neg UNION ALL SELECT user, item FROM positives),
sc AS (SELECT c.user, c.item, list_dot_product(CAST(u.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])) AS score
  FROM cand c JOIN user_factors u ON u.user = c.user JOIN item_factors f ON f.item = c.item),
tp AS (SELECT s.user, s.item AS t_item, s.score AS t_score FROM sc s JOIN positives p ON p.user = s.user AND p.item = s.item),
ps AS (SELECT t.user, sum(CASE WHEN s.score > t.t_score OR (s.score = t.t_score AND s.item < t.t_item) THEN 1 ELSE 0 END)
  AS pos FROM sc s JOIN tp t ON t.user = s.user GROUP BY t.user),
rm AS (SELECT avg(CASE WHEN pos < {K} THEN 1.0 ELSE 0.0 END) AS hit_rate,
  avg(CASE WHEN pos < {K} THEN 1.0 / (pos + 1) ELSE 0.0 END) AS mrr,
  avg(CASE WHEN pos < {K} THEN 1.0 / log2(pos + 2) ELSE 0.0 END) AS ndcg, count(*) AS n_users FROM ps)"""


def _ranking(spark, sf):
    uf = T.user_factors(spark, sf)
    test = _llo(spark, sf).where(F.col("split") == "test").join(uf.select("user"), "user", "left_semi")
    pos = test.select("event_id", "user", "item")
    neg = _negatives(spark, sf, pos, 99)
    cand = neg.select("user", F.col("neg_item").alias("item")).unionByName(pos.select("user", "item"))
    it = T.item_factors(spark, sf).select("item", F.col("embedding").alias("ei"))
    sc = cand.join(uf.select("user", F.col("embedding").alias("eu")), "user").join(it, "item").select(
        "user", "item", vec_dot("eu", "ei").alias("score"))
    return M.ranking_metrics(sc, pos.select("user", "item"), K)


for _m in ("hit_rate", "mrr", "ndcg"):
    def _mk(m=_m):
        return lambda spark, sf: _ranking(spark, sf).select(F.round(m, 6).alias(m), "n_users")
    register(_m, _RANK_SQL + f"SELECT round({_m}, 6) AS {_m}, n_users FROM rm")(_mk())


# --------------------------------------------------------------------------- classification metrics
@register("auc", ctes(("scored",)) + """
SELECT round((sum(r) FILTER (WHERE label = 1) - p * (p + 1) / 2.0) / (p * n), 6) AS auc FROM (
  SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r,
    sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER () AS p, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) OVER () AS n
  FROM scored) GROUP BY p, n""")
def q_auc(spark, sf):
    return M.auc(T.scored(spark, sf), "label", "score").select(F.round("auc", 6).alias("auc"))


_GINI = """
g AS (SELECT sum(label * (n - pos + 1)) / tot - (n + 1) / 2.0 AS gp FROM (SELECT label,
  row_number() OVER (ORDER BY score DESC, id) AS pos, count(*) OVER () AS n, sum(label) OVER () AS tot FROM scored)
  GROUP BY n, tot),
gl AS (SELECT sum(label * (n - pos + 1)) / tot - (n + 1) / 2.0 AS gl FROM (SELECT label,
  row_number() OVER (ORDER BY label DESC, id) AS pos, count(*) OVER () AS n, sum(label) OVER () AS tot FROM scored)
  GROUP BY n, tot),
nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM scored)"""


@register("gini_norm", ctes(("scored",), _GINI) + """
SELECT round(g.gp / nn.n, 6) AS gini_pred, round(gl.gl / nn.n, 6) AS gini_label, round(g.gp / gl.gl, 6) AS gini_norm
FROM g, gl, nn""")
def q_gini_norm(spark, sf):
    g = M.gini_norm(T.scored(spark, sf), "label", "score", "id")
    return g.select(*[F.round(c, 6).alias(c) for c in ("gini_pred", "gini_label", "gini_norm")])


@register("cumulative_gini", ctes(("scored",)) + """
SELECT id, label, score, row_number() OVER (ORDER BY score DESC, id) AS pos,
  CAST(sum(label) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_label FROM scored""")
def q_cumulative_gini(spark, sf):
    return M.cumulative_gini(T.scored(spark, sf), "label", "score", "id").select(
        "id", "label", "score", "pos", F.col("cum_label").cast("bigint").alias("cum_label"))


@register("rmse", ctes(("scored",)) + "SELECT round(sqrt(avg(pow(label - score, 2))), 6) AS rmse FROM scored")
def q_rmse(spark, sf):
    return M.rmse(T.scored(spark, sf), "label", "score").select(F.round("rmse", 6).alias("rmse"))


@register("normalized_entropy", ctes(("scored",)) + """
SELECT round(ll, 6) AS logloss, round(ll / -(b * ln(b) + (1 - b) * ln(1 - b)), 6) AS normalized_entropy FROM (
  SELECT avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15))
    + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))) AS ll, avg(CAST(label AS DOUBLE)) AS b FROM scored)""")
def q_normalized_entropy(spark, sf):
    n = M.normalized_entropy(T.scored(spark, sf), "label", "score")
    return n.select(F.round("logloss", 6).alias("logloss"), F.round("normalized_entropy", 6).alias("normalized_entropy"))


# --------------------------------------------------------------------------- sequences
_HIST = """
hp AS (SELECT user, item, ts, event_id, row_number() OVER w AS pos,
  coalesce(list(item) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS history
  FROM inter WINDOW w AS (PARTITION BY user ORDER BY ts, event_id))"""


@register("history_prefix", ctes(("inter",), _HIST) + """
SELECT user, CAST(pos AS INTEGER) AS pos, item, array_to_string(history, ',') AS history FROM hp""")
def q_history_prefix(spark, sf):
    h = S.history_prefix(T.inter(spark, sf))
    return h.select("user", "pos", "item", F.array_join(F.transform("history", lambda x: x.cast("string")), ",")
                    .alias("history"))


@register("sequence_order", ctes(("inter",)) + """
SELECT user, event_id, CAST(row_number() OVER (PARTITION BY user ORDER BY ts, event_id) AS INTEGER) AS pos FROM inter""")
def q_sequence_order(spark, sf):
    return S.event_positions(T.inter(spark, sf)).select("user", "event_id", "pos")


@register("pad_histories", ctes(("inter",), _HIST) + """
SELECT user, CAST(pos AS INTEGER) AS pos, CAST(len(history) AS INTEGER) AS hist_len, array_to_string(list_concat(history,
  list_transform(range((SELECT max(len(history)) FROM hp) - len(history)), lambda x: 0)), ',') AS history FROM hp""")
def q_pad_histories(spark, sf):
    """Histories padded to the longest one; nothing is dropped."""
    p = S.pad_histories(cut_lineage(S.history_prefix(T.inter(spark, sf))))
    return p.select("user", "pos", "hist_len",
                    F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"))


CAPPED = 20


@register("history_prefix_capped", ctes(("inter",), _HIST) + f"""
SELECT user, CAST(pos AS INTEGER) AS pos, item, array_to_string(list_slice(history, greatest(len(history) - {CAPPED - 1}, 1),
  len(history)), ',') AS history FROM hp""")
def q_history_prefix_capped(spark, sf):
    """The newest items before each event: rows and cells grow with the events."""
    h = S.history_prefix(T.inter(spark, sf), cap=CAPPED)
    return h.select("user", "pos", "item", F.array_join(F.transform("history", lambda x: x.cast("string")), ",")
                    .alias("history"))


@register("pad_histories_batch", ctes(("inter",), _HIST, f"""
hc AS (SELECT user, pos, event_id, list_slice(history, greatest(len(history) - {CAPPED - 1}, 1), len(history)) AS h FROM hp),
hb AS (SELECT *, (row_number() OVER (ORDER BY len(h), event_id) - 1) // 32 AS batch FROM hc)""") + """
SELECT event_id, batch, CAST(len(h) AS INTEGER) AS hist_len, array_to_string(list_concat(h,
  list_transform(range(max(len(h)) OVER (PARTITION BY batch) - len(h)), lambda x: 0)), ',') AS history FROM hb""")
def q_pad_histories_batch(spark, sf):
    """Histories in batches of 32 by length, each padded to its batch's longest."""
    h = S.history_prefix(T.inter(spark, sf), cap=CAPPED)
    p = S.pad_batches(h, 32, [F.size("history").asc(), F.col("event_id").asc()])
    return p.select("event_id", "batch", "hist_len",
                    F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"))


_SEQ_SQL = ctes(("inter", "item_factors"), _HIST, _neg_sql(
    "positives AS (SELECT event_id, user, item FROM hp WHERE pos > 1)", 1)) + """,
lastid AS (SELECT user, arg_max(event_id, (ts, event_id)) AS last_id FROM inter GROUP BY user),
rows_ AS (SELECT h.user, h.event_id, h.pos, h.history, h.item, 1 AS label FROM hp h WHERE h.pos > 1
  UNION ALL SELECT h.user, h.event_id, h.pos, h.history, n.neg_item, 0 FROM hp h JOIN neg n ON n.event_id = h.event_id),
seq AS (SELECT r.user, r.event_id, CAST(r.pos AS INTEGER) AS pos, array_to_string(r.history, ',') AS history, r.item,
  CAST(r.label AS INTEGER) AS label, CASE WHEN r.event_id = l.last_id THEN 'test' ELSE 'train' END AS split
  FROM rows_ r JOIN lastid l ON l.user = r.user)"""
_PAIR_SCORE = "(item * 7919 + event_id * 31) % 101"       # a stand-in model score


@register("sequence_samples", _SEQ_SQL + " SELECT * FROM seq")
def q_sequence_samples(spark, sf):
    s = S.sequence_samples(T.inter(spark, sf), T.item_factors(spark, sf).select("item"), SEED)
    return s.select("user", "event_id", "pos", F.array_join(F.transform("history", lambda x: x.cast("string")), ",")
                    .alias("history"), "item", "label", "split")


@register("pairwise_auc", _SEQ_SQL + f"""
, sc AS (SELECT event_id, label, {_PAIR_SCORE} AS score FROM seq)
SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 ELSE 0.0 END), 6) AS pairwise_auc
FROM sc p JOIN sc n ON n.event_id = p.event_id WHERE p.label = 1 AND n.label = 0""")
def q_pairwise_auc(spark, sf):
    """Every sequence sample's positive against its negative (one pair per event)."""
    s = S.sequence_samples(T.inter(spark, sf), T.item_factors(spark, sf).select("item"), SEED, history=False)
    s = s.select("event_id", "label", F.expr(_PAIR_SCORE.replace("//", "div")).alias("score"))
    p = s.where("label = 1").select("event_id", F.col("score").alias("pos_score"))
    n = s.where("label = 0").select("event_id", F.col("score").alias("neg_score"))
    return M.pairwise_auc(p.join(n, "event_id")).select(F.round("pairwise_auc", 6).alias("pairwise_auc"))
