"""Feature dictionaries, encoding, FM/FFM scoring and small column operators (on ``ctr``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recoflow.functions.scalar import last_category
from recoflow.operators import ctr as C
from recoflow.operators import features as FE
from recoflow.plans.registry import register
from recoflow.plans.sqlparts import ctes
from recoflow.sources import tables as T

CATS = ["f_seg_cat", "f_brand_cat", "f_type_cat"]
NUMERIC = ["f_value", "f_price", "f_size"]
FIELDS = CATS + NUMERIC
IGNORE = ["id", "target"]
BIAS = 0.1
K_FM, K_FFM = 4, 2


def _ctr(spark, sf):
    return T.ctr(spark, sf)


def dictionary(spark, sf, cats_only=False):
    return FE.feature_dictionary(_ctr(spark, sf), NUMERIC, IGNORE, CATS if cats_only else None)


def _dict_sql(cats_only=False):
    parts = [f"SELECT DISTINCT '{c}' AS field, {i} AS fpos, CAST({c} AS VARCHAR) AS value, false AS is_numeric FROM ctr"
             for i, c in enumerate(FIELDS) if c in CATS]
    if not cats_only:
        parts += [f"SELECT '{c}', {i}, '', true" for i, c in enumerate(FIELDS) if c in NUMERIC]
    return ("d0 AS (" + " UNION ALL ".join(parts) + "),\n"
            "dict AS (SELECT field, value, row_number() OVER (ORDER BY fpos, value NULLS FIRST) - 1 AS feat_index, "
            "is_numeric FROM d0)")


_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT id AS row_id, target AS label, '{c}' AS field, {i + 1} AS fpos, CAST({c} AS VARCHAR) AS value FROM ctr"
    for i, c in enumerate(FIELDS)) + ")"
_ENC = _LONG + """,
enc AS (SELECT l.row_id, l.label, l.field, l.fpos, d.feat_index,
  CASE WHEN d.is_numeric THEN CAST(l.value AS DOUBLE) ELSE 1.0 END AS feat_value FROM long l JOIN dict d
  ON d.field = l.field AND d.value = CASE WHEN d.is_numeric THEN '' ELSE l.value END)"""


@register("feature_dictionary", ctes(("ctr",), _dict_sql()) + "SELECT field, value, feat_index, is_numeric FROM dict")
def q_feature_dictionary(spark, sf):
    return dictionary(spark, sf)


@register("feature_dictionary_cat", ctes(("ctr",), _dict_sql(True)) + "SELECT field, value, feat_index, is_numeric FROM dict")
def q_feature_dictionary_cat(spark, sf):
    return dictionary(spark, sf, cats_only=True)


def encoded(spark, sf, words=None):
    e = FE.encode_samples(_ctr(spark, sf), words if words is not None else dictionary(spark, sf), "id", "target")
    return e.withColumn("fpos", F.array_position(F.array(*[F.lit(c) for c in FIELDS]), F.col("field")).cast("int"))


@register("encode_samples", ctes(("ctr",), _dict_sql(), _ENC) + """
SELECT row_id, label, field, feat_index, round(feat_value, 6) AS feat_value FROM enc""")
def q_encode_samples(spark, sf):
    return encoded(spark, sf).select("row_id", "label", "field", "feat_index", F.round("feat_value", 6).alias("feat_value"))


def _fm_weights(dict_df):
    fi = F.col("feat_index")
    return dict_df.select("feat_index", ((fi * 37 % 11 - 5) / 10.0).cast("double").alias("w"),
                          F.array(*[((fi * (k + 3) % 7 - 3) / 10.0).cast("double") for k in range(K_FM)]).alias("v"))


_FM_SQL = ctes(("ctr",), _dict_sql(), _ENC, """
w AS (SELECT feat_index, CAST(feat_index * 37 % 11 - 5 AS DOUBLE) / 10 AS w, [""" + ", ".join(
    f"CAST(feat_index * {k + 3} % 7 - 3 AS DOUBLE) / 10" for k in range(K_FM)) + """] AS v FROM dict),
j AS (SELECT e.row_id, e.feat_value AS x, w.w, w.v FROM enc e JOIN w ON w.feat_index = e.feat_index),
lin AS (SELECT row_id, sum(w * x) AS lin FROM j GROUP BY row_id),
e2 AS (SELECT row_id, x, unnest(v) AS vk, unnest(generate_series(0, len(v) - 1)) AS k FROM j),
pk AS (SELECT row_id, k, sum(vk * x) AS s, sum(vk * x * vk * x) AS q FROM e2 GROUP BY row_id, k),
pr AS (SELECT row_id, 0.5 * sum(s * s - q) AS pair FROM pk GROUP BY row_id)""") + f"""
SELECT lin.row_id, round({BIAS} + lin + pair, 6) AS score FROM lin JOIN pr ON pr.row_id = lin.row_id"""


@register("fm_score", _FM_SQL)
def q_fm_score(spark, sf):
    d = dictionary(spark, sf)
    s = C.fm_score(encoded(spark, sf, d).select("row_id", "feat_index", "feat_value"), BIAS, _fm_weights(d), K_FM)
    return s.select("row_id", F.round("score", 6).alias("score"))


def _ffm_latent(dict_df):
    fi = F.col("feat_index")
    f = dict_df.select("feat_index", F.posexplode(F.array(*[F.lit(c) for c in FIELDS])).alias("fp", "field"))
    return f.select("feat_index", "field", F.array(*[
        ((fi * (k + 2) + (F.col("fp") + 1) * 5) % 7 - 3).cast("double") / 10.0 for k in range(K_FFM)]).alias("v"))


_FFM_SQL = ctes(("ctr",), _dict_sql(), _ENC, """
w AS (SELECT feat_index, CAST(feat_index * 37 % 11 - 5 AS DOUBLE) / 10 AS w FROM dict),
fl AS (SELECT unnest([""" + ", ".join(f"'{c}'" for c in FIELDS) + """]) AS field,
  unnest(generate_series(1, """ + str(len(FIELDS)) + """)) AS fp),
lat AS (SELECT d.feat_index, fl.field, [""" + ", ".join(
    f"CAST((d.feat_index * {k + 2} + fl.fp * 5) % 7 - 3 AS DOUBLE) / 10" for k in range(K_FFM)) + """] AS v
  FROM dict d CROSS JOIN fl),
lin AS (SELECT e.row_id, sum(w.w * e.feat_value) AS lin FROM enc e JOIN w ON w.feat_index = e.feat_index GROUP BY e.row_id),
pairs AS (SELECT a.row_id, a.feat_index AS ai, a.field AS af, a.feat_value AS ax, b.feat_index AS bi, b.field AS bf,
  b.feat_value AS bx FROM enc a JOIN enc b ON a.row_id = b.row_id AND a.fpos < b.fpos),
pv AS (SELECT p.row_id, list_dot_product(la.v, lb.v) * p.ax * p.bx AS t FROM pairs p
  JOIN lat la ON la.feat_index = p.ai AND la.field = p.bf JOIN lat lb ON lb.feat_index = p.bi AND lb.field = p.af),
pr AS (SELECT row_id, sum(t) AS pair FROM pv GROUP BY row_id)""") + f"""
SELECT lin.row_id, round({BIAS} + lin + coalesce(pair, 0.0), 6) AS score FROM lin LEFT JOIN pr ON pr.row_id = lin.row_id"""


@register("ffm_score", _FFM_SQL)
def q_ffm_score(spark, sf):
    d = dictionary(spark, sf)
    enc = encoded(spark, sf, d).select("row_id", "field", "fpos", "feat_index", "feat_value")
    lin = _fm_weights(d).select("feat_index", "w")
    s = C.ffm_score(enc, BIAS, lin, _ffm_latent(d))
    return s.select("row_id", F.round("score", 6).alias("score"))


@register("feature_pair_join", ctes(("ctr",), _dict_sql(), _ENC) + """
SELECT a.row_id, a.field AS a_field, b.field AS b_field, a.feat_index AS a_feat_index, b.feat_index AS b_feat_index
FROM enc a JOIN enc b ON a.row_id = b.row_id AND a.fpos < b.fpos""")
def q_feature_pair_join(spark, sf):
    p = C.feature_pair_join(encoded(spark, sf).select("row_id", "field", "fpos", "feat_index", "feat_value"))
    return p.select("row_id", "a_field", "b_field", "a_feat_index", "b_feat_index")


@register("remap_ids", ctes(("inter",)) + """
SELECT event_id, user, dense_rank() OVER (ORDER BY user) - 1 AS user_idx, item,
  dense_rank() OVER (ORDER BY item) - 1 AS item_idx FROM inter""")
def q_remap_ids(spark, sf):
    i = T.inter(spark, sf).select("event_id", "user", "item")
    return FE.remap_ids(FE.remap_ids(i, "user"), "item").select("event_id", "user", "user_idx", "item", "item_idx")


@register("missing_feat", ctes(("ctr",)) + "SELECT id, CAST(" + " + ".join(
    f"CASE WHEN {c} = -1 THEN 1 ELSE 0 END" for c in NUMERIC) + " AS INTEGER) AS missing_feat FROM ctr")
def q_missing_feat(spark, sf):
    return FE.missing_feat(_ctr(spark, sf), NUMERIC).select("id", F.col("missing_feat").cast("int").alias("missing_feat"))


@register("feature_cross", ctes(("ctr",)) + "SELECT id, round(f_value * f_price, 6) AS value_x_price FROM ctr")
def q_feature_cross(spark, sf):
    return FE.feature_cross(_ctr(spark, sf), "f_value", "f_price", "x").select(
        "id", F.round("x", 6).alias("value_x_price"))


@register("column_prune", ctes(("ctr",)) + "SELECT id, target, f_seg_cat, f_brand_cat, f_value, f_size FROM ctr")
def q_column_prune(spark, sf):
    return FE.column_prune(_ctr(spark, sf), ["f_type_cat", "f_price"])


@register("last_category", ctes(("items",)) + """
SELECT item, ([[p_brand], [p_type, title]])[-1][-1] AS last_category FROM items""")
def q_last_category(spark, sf):
    i = T.items(spark, sf).withColumn("categories", F.array(F.array("p_brand"), F.array("p_type", "title")))
    return i.select("item", last_category("categories").alias("last_category"))


@register("hash_feature", ctes(("ctr",)) + "SELECT id, CAST(3 AS DOUBLE) AS total, true AS slots_ok FROM ctr")
def q_hash_feature(spark, sf):
    """Sparse hashed vectors (2^20 slots) stay sparse; checked by row facts: the
    values sum to the number of columns, in at most as many slots (fewer only
    when two of a row's values share a slot)."""
    from pyspark.ml.functions import vector_to_array  # noqa: F401  (dense form is never built)
    h = FE.hash_feature(_ctr(spark, sf), CATS)
    v = F.from_json(F.to_json(F.struct("features")), "features struct<size:int,indices:array<int>,values:array<double>>")["features"]
    total = F.aggregate(v["values"], F.lit(0.0), lambda a, b: a + b)
    return h.select("id", total.alias("total"), ((F.size(v["indices"]) <= len(CATS)) & (F.size(v["indices"]) > 0)).alias("slots_ok"))


@register("one_hot_pairs", ctes(("ctr",)) + """,
d AS (SELECT *, ((id * 7919) % 5 + 5) % 5 AS fold FROM ctr),
si AS (SELECT f_seg_cat, CAST(row_number() OVER (ORDER BY count(*) DESC, f_seg_cat) - 1 AS DOUBLE) AS seg_i
  FROM d WHERE fold <> 4 GROUP BY f_seg_cat),
bi AS (SELECT f_brand_cat, CAST(row_number() OVER (ORDER BY count(*) DESC, f_brand_cat) - 1 AS DOUBLE) AS brand_i
  FROM d WHERE fold <> 4 GROUP BY f_brand_cat)
SELECT d.id, d.target, si.seg_i, bi.brand_i FROM d JOIN si ON si.f_seg_cat = d.f_seg_cat
JOIN bi ON bi.f_brand_cat = d.f_brand_cat WHERE d.fold = 4""")
def q_one_hot_pairs(spark, sf):
    """Indexes fit on train (frequency desc, then text), unseen test ids
    dropped; the one-hot vectors are built from these indexes."""
    d = _ctr(spark, sf).withColumn("fold", F.pmod(F.col("id") * 7919, F.lit(5)))
    tr, te = FE.one_hot_pairs(d.where("fold != 4"), d.where("fold = 4"), ["f_seg_cat", "f_brand_cat"])
    return te.select("id", "target", F.col("f_seg_cat_i").alias("seg_i"), F.col("f_brand_cat_i").alias("brand_i"))
