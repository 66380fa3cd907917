"""Correlators, popularity, documents and retrieval: the recommender core."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recoflow.operators import correlators as C
from recoflow.operators import docs as D
from recoflow.operators import interactions as I
from recoflow.operators import retrieval as R
from recoflow.operators.incremental import add_batch
from recoflow.operators.joins import owned_join
from recoflow.operators.popularity import popularity
from recoflow.plans.registry import register
from recoflow.plans.sqlparts import CORR, SCORES, capped_sql, ctes, pop_cte, scores_sql
from recoflow.session import cut_lineage, table_folder
from recoflow.sources import tables as T
from recoflow.sources.tables import LONG_DURATION, POP_END, PRIMARY, SECONDARY, SEED, SHORT_DURATION

ACTIONS = [PRIMARY, *SECONDARY]


def _txt(c):
    """Array column as comma text (order kept) for engine-neutral comparison."""
    return F.concat_ws(",", F.transform(F.col(c), lambda x: x.cast("string")))


def correlators(spark, sf):
    """The trained correlator model, written once (the reference publishes it
    to its index); every reader below scans the written table."""
    return cut_lineage(C.llr_correlators(T.inter(spark, sf), PRIMARY, SECONDARY, top_k=50))


def pop_model(spark, sf, kind="popular", duration=LONG_DURATION):
    return popularity(T.inter(spark, sf), kind, [PRIMARY], POP_END, duration)


def all_user_queries(spark, sf):
    """One query per user seen in the log (query_id = user), default size 20."""
    return T.inter(spark, sf).select("user").distinct().select(F.col("user").alias("query_id"), "user")


# --------------------------------------------------------------------------- flagship
def ur_recommend(spark, sf):
    """Train (correlators + popularity) and serve every user in one DAG.
    The item id lives in JSON text that Parquet cannot push down, and the
    plan reads the interactions five times (pairs, popularity, history,
    exclusions, marginals), so the narrow INTERACTION table of the used
    actions is written once and every stage scans that columnar copy."""
    inter = cut_lineage(I.action_split(T.inter(spark, sf), ACTIONS))
    corr = cut_lineage(C.llr_correlators(inter, PRIMARY, SECONDARY, top_k=50))
    pop = popularity(inter, "popular", [PRIMARY], POP_END, LONG_DURATION)
    return R.recommend(all_user_queries(spark, sf), corr, pop, inter, primary=PRIMARY, actions=ACTIONS,
                       max_query_events=100, default_num=20, doc_props=item_fields(spark, sf))


# documents: items with fields, correlators or popularity
_DOCS = """
docs AS (SELECT d.item, pop.score AS pop_rank FROM (SELECT item FROM corr UNION SELECT item FROM items
         UNION SELECT item FROM pop) d LEFT JOIN pop ON d.item = pop.item)"""

UR_RECOMMEND_SQL = ctes(("inter", "items"), CORR, pop_cte("pop"), _DOCS, f"""
q AS (SELECT DISTINCT user AS query_id, user, 20 AS num FROM inter),
hist AS (SELECT DISTINCT user, action, item FROM (SELECT *, row_number() OVER (PARTITION BY user, action
         ORDER BY ts DESC, event_id DESC) AS r FROM inter WHERE action IN ('purchase', 'view', 'click')) WHERE r <= 100),
terms AS (SELECT q.query_id, h.action, h.item AS term, CAST(1.0 AS DOUBLE) AS boost FROM q JOIN hist h ON q.user = h.user),
scores AS (SELECT t.query_id, c.item, sum(t.boost) AS score FROM terms t JOIN corr c
           ON c.action = t.action AND c.other = t.term GROUP BY 1, 2),
excl AS (SELECT DISTINCT q.query_id, i.item FROM q JOIN inter i ON i.user = q.user WHERE i.action = '{PRIMARY}'),
cand AS (SELECT q.query_id, d.item, coalesce(s.score, 0.0) AS score, d.pop_rank, q.num FROM q CROSS JOIN docs d
         LEFT JOIN scores s ON s.query_id = q.query_id AND s.item = d.item
         WHERE NOT EXISTS (SELECT 1 FROM excl e WHERE e.query_id = q.query_id AND e.item = d.item))""") + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, item, CAST(score AS DOUBLE) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pop_rank DESC NULLS LAST, item) AS rank
  FROM cand) WHERE rank <= num"""

register("ur_recommend", UR_RECOMMEND_SQL)(ur_recommend)

NOW = "2024-01-20 00:00:00"


def batch_predict(spark, sf):
    """Many queries at once, each with its own must filters: the item type of
    the user's last view must match, and the item must be available now
    (available <= now < available + 25 days).  Exact backfill under filters."""
    inter = cut_lineage(I.action_split(T.inter(spark, sf), ACTIONS))
    corr = cut_lineage(C.llr_correlators(inter, PRIMARY, SECONDARY, top_k=50))
    pop = popularity(inter, "popular", [PRIMARY], POP_END, LONG_DURATION)
    it = T.items(spark, sf)
    avail = F.col("available_date").cast("timestamp")
    dp = it.select("item", F.create_map(F.lit("type"), F.array("p_type")).alias("fields"),
                   F.create_map(F.lit("available_date"), avail, F.lit("expire_date"),
                                avail + F.make_dt_interval(F.lit(25))).alias("dates"))
    last_view = I.recent_n_per_user(inter, 1, actions=["view"]).select("user", "item")
    lv = last_view.join(it.select("item", "p_type"), "item").select("user", "p_type")
    q = (all_user_queries(spark, sf).join(lv, "user", "left")
         .select("query_id", "user",
                 F.when(F.col("p_type").isNotNull(), F.array(F.struct(
                     F.lit("type").alias("name"), F.array("p_type").alias("values"),
                     F.lit(-1.0).alias("bias")))).alias("fields"),
                 F.lit(NOW).cast("timestamp").alias("current_date")))
    return R.recommend(q, corr, pop, inter, primary=PRIMARY, actions=ACTIONS, max_query_events=100,
                       default_num=10, doc_props=dp)


def ur_dated(spark, sf):
    """A query per user with its own size, its own current date (the user's
    last event: available <= now < available + 25 days) and a brand that must
    not come.  No two queries share their filters."""
    inter = cut_lineage(T.inter(spark, sf))
    corr = cut_lineage(C.llr_correlators(inter, PRIMARY, SECONDARY, top_k=50))
    pop = popularity(inter, "popular", [PRIMARY], POP_END, LONG_DURATION)
    avail = F.col("available_date").cast("timestamp")
    dp = T.items(spark, sf).select(
        "item", F.create_map(F.lit("brand"), F.array("p_brand")).alias("fields"),
        F.create_map(F.lit("available_date"), avail, F.lit("expire_date"),
                     avail + F.make_dt_interval(F.lit(25))).alias("dates"))
    u = F.col("user")
    unwanted = F.struct(F.lit("brand").alias("name"), F.array(F.concat(F.lit("Brand#"), (1 + u % 25).cast("string")))
                        .alias("values"), F.lit(0.0).alias("bias"))
    q = inter.groupBy("user").agg(F.max("ts").cast("timestamp").alias("current_date")).select(
        u.alias("query_id"), "user", (5 + u % 20).cast("int").alias("num"), "current_date", F.array(unwanted).alias("fields"))
    return R.recommend(q, corr, pop, inter, primary=PRIMARY, actions=ACTIONS, max_query_events=100, doc_props=dp)


UR_DATED_SQL = ctes(("inter", "items"), CORR, pop_cte("pop"), _DOCS, f"""
q AS (SELECT user AS query_id, user, max(ts) AS now, 5 + user % 20 AS num, 'Brand#' || (1 + user % 25) AS brand
  FROM inter GROUP BY user),
hist AS (SELECT DISTINCT user, action, item FROM (SELECT *, row_number() OVER (PARTITION BY user, action
         ORDER BY ts DESC, event_id DESC) AS r FROM inter WHERE action IN ('purchase', 'view', 'click')) WHERE r <= 100),
scores AS (SELECT h.user AS query_id, c.item, CAST(count(*) AS DOUBLE) AS score FROM hist h JOIN corr c
           ON c.action = h.action AND c.other = h.item GROUP BY 1, 2),
excl AS (SELECT DISTINCT user, item FROM inter WHERE action = '{PRIMARY}'),
cand AS (SELECT q.query_id, d.item, coalesce(s.score, 0.0) AS score, d.pop_rank, q.num FROM q CROSS JOIN docs d
         JOIN items it ON it.item = d.item
         LEFT JOIN scores s ON s.query_id = q.query_id AND s.item = d.item
         WHERE NOT EXISTS (SELECT 1 FROM excl e WHERE e.user = q.user AND e.item = d.item)
           AND it.p_brand <> q.brand AND it.available_date <= q.now AND it.available_date + INTERVAL 25 DAY > q.now)""") + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, item, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pop_rank DESC NULLS LAST, item) AS rank
  FROM cand) WHERE rank <= num"""

register("ur_dated", UR_DATED_SQL)(ur_dated)


def _options(spark, sf):
    """A query per user, each with its own options (and an item for half of them)."""
    u = F.col("user")
    field = F.struct(F.lit("brand").alias("name"), F.array(F.concat(F.lit("Brand#"), (1 + u % 5).cast("string")))
                     .alias("values"), F.lit(1.5).alias("bias"))
    return all_user_queries(spark, sf).select(
        "query_id", "user", F.when(u % 2 == 0, u % 100).alias("item"), (5 + u % 20).cast("int").alias("num"),
        F.array(u % 50, u % 50 + 1).alias("blacklist"), (u % 4 == 0).alias("return_self"),
        F.when(u % 7 == 0, -1.0).when(u % 7 == 1, 2.5).alias("user_bias"),
        F.when(u % 8 == 0, -1.0).when(u % 8 == 2, 0.5).alias("item_bias"),
        F.when(u % 5 == 0, F.array(F.lit("view"))).alias("event_names"),
        F.when(u % 3 == 0, F.array(field)).alias("fields"))


def ur_options(spark, sf, blacklist_events):
    """Per-query item, size, blacklist, self, biases, event names and boosted fields."""
    inter = cut_lineage(T.inter(spark, sf))
    corr = cut_lineage(C.llr_correlators(inter, PRIMARY, SECONDARY, top_k=50))
    pop = popularity(inter, "popular", [PRIMARY], POP_END, LONG_DURATION)
    return R.recommend(_options(spark, sf), corr, pop, inter, primary=PRIMARY, actions=ACTIONS, max_query_events=100,
                       blacklist_events=blacklist_events, doc_props=item_fields(spark, sf))


def _options_sql(blacklist_events) -> str:
    seen = " OR ".join(f"i.action = '{e}'" for e in blacklist_events) or "false"
    return ctes(("inter", "items"), CORR, pop_cte("pop"), _DOCS, f"""
q AS (SELECT user AS query_id, user, CASE WHEN user % 2 = 0 THEN user % 100 END AS qitem, 5 + user % 20 AS num,
  coalesce(CASE user % 7 WHEN 0 THEN -1.0 WHEN 1 THEN 2.5 END, 1.0) AS ub,
  coalesce(CASE user % 8 WHEN 0 THEN -1.0 WHEN 2 THEN 0.5 END, 1.0) AS ib,
  user % 5 = 0 AS only_view, CASE WHEN user % 3 = 0 THEN 'Brand#' || (1 + user % 5) END AS brand
  FROM (SELECT DISTINCT user FROM inter)),
hist AS (SELECT DISTINCT user, action, item FROM (SELECT *, row_number() OVER (PARTITION BY user, action
         ORDER BY ts DESC, event_id DESC) AS r FROM inter WHERE action IN ('purchase', 'view', 'click')) WHERE r <= 100),
terms AS (SELECT q.query_id, h.action, h.item AS term, q.ub AS b, 'u' AS kind FROM q JOIN hist h ON q.user = h.user
          WHERE NOT q.only_view OR h.action = 'view'
          UNION ALL SELECT q.query_id, c.action, c.other, q.ib, 'i' FROM q JOIN corr c ON c.item = q.qitem
          WHERE c.rank <= 100 AND (NOT q.only_view OR c.action = 'view')),
hits AS (SELECT t.query_id, c.item, sum(t.b) FILTER (WHERE t.b > 0) AS score, count(DISTINCT t.kind) FILTER (WHERE t.b < 0) AS kinds
  FROM terms t JOIN corr c ON c.action = t.action AND c.other = t.term GROUP BY 1, 2),
excl AS (SELECT q.query_id, i.item FROM q JOIN inter i ON i.user = q.user WHERE {seen}
  UNION SELECT query_id, user % 50 FROM q UNION SELECT query_id, user % 50 + 1 FROM q
  UNION SELECT query_id, qitem FROM q WHERE qitem IS NOT NULL AND user % 4 <> 0),
cand AS (SELECT q.query_id, d.item, coalesce(h.score, 0.0) + CASE WHEN it.p_brand = q.brand THEN 1.5 ELSE 0 END AS score,
  d.pop_rank, q.num FROM q CROSS JOIN docs d LEFT JOIN hits h ON h.query_id = q.query_id AND h.item = d.item
  LEFT JOIN items it ON it.item = d.item
  WHERE coalesce(h.kinds, 0) = CASE WHEN q.ub < 0 THEN 1 ELSE 0 END + CASE WHEN q.ib < 0 AND q.qitem IS NOT NULL THEN 1 ELSE 0 END
  AND NOT EXISTS (SELECT 1 FROM excl e WHERE e.query_id = q.query_id AND e.item = d.item))""") + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, item, CAST(score AS DOUBLE) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pop_rank DESC NULLS LAST, item) AS rank
  FROM cand) WHERE rank <= num"""


register("ur_options", _options_sql([PRIMARY, "error"]))(lambda spark, sf: ur_options(spark, sf, [PRIMARY, "error"]))
register("ur_no_blacklist_events", _options_sql([]))(lambda spark, sf: ur_options(spark, sf, []))


BATCH_PREDICT_SQL = ctes(("inter", "items"), CORR, pop_cte("pop"), _DOCS, f"""
q AS (SELECT DISTINCT user AS query_id, user FROM inter),
lastview AS (SELECT user, item FROM (SELECT *, row_number() OVER (PARTITION BY user ORDER BY ts DESC, event_id DESC)
             AS r FROM inter WHERE action = 'view') WHERE r = 1),
qt AS (SELECT q.query_id, q.user, i.p_type AS must_type FROM q LEFT JOIN lastview l ON l.user = q.user
       LEFT JOIN items i ON i.item = l.item),
hist AS (SELECT DISTINCT user, action, item FROM (SELECT *, row_number() OVER (PARTITION BY user, action
         ORDER BY ts DESC, event_id DESC) AS r FROM inter WHERE action IN ('purchase', 'view', 'click')) WHERE r <= 100),
terms AS (SELECT q.query_id, h.action, h.item AS term, CAST(1.0 AS DOUBLE) AS boost FROM q JOIN hist h ON q.user = h.user),
scores AS (SELECT t.query_id, c.item, sum(t.boost) AS score FROM terms t JOIN corr c
           ON c.action = t.action AND c.other = t.term GROUP BY 1, 2),
excl AS (SELECT DISTINCT q.query_id, i.item FROM q JOIN inter i ON i.user = q.user WHERE i.action = '{PRIMARY}'),
cand AS (SELECT qt.query_id, d.item, coalesce(s.score, 0.0) AS score, d.pop_rank FROM qt CROSS JOIN docs d
         LEFT JOIN scores s ON s.query_id = qt.query_id AND s.item = d.item
         LEFT JOIN items it ON it.item = d.item
         WHERE NOT EXISTS (SELECT 1 FROM excl e WHERE e.query_id = qt.query_id AND e.item = d.item)
           AND (qt.must_type IS NULL OR it.p_type = qt.must_type)
           AND it.available_date <= TIMESTAMP '{NOW}'
           AND it.available_date + INTERVAL 25 DAY > TIMESTAMP '{NOW}')""") + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, item, CAST(score AS DOUBLE) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pop_rank DESC NULLS LAST, item) AS rank
  FROM cand) WHERE rank <= 10"""

register("batch_predict", BATCH_PREDICT_SQL)(batch_predict)


# --------------------------------------------------------------------------- correlators
@register("distinct_pairs", ctes(("inter",)) + """
SELECT user, action, item, max(ts) AS ts, max(event_id) AS event_id FROM inter GROUP BY user, action, item""")
def q_distinct_pairs(spark, sf):
    return I.distinct_pairs(T.inter(spark, sf))


@register("interaction_cap", ctes(("inter",), capped_sql(500)) + "SELECT user, action, item FROM capped")
def q_interaction_cap(spark, sf):
    return I.interaction_cap(C.action_pairs(T.inter(spark, sf), ACTIONS), 500, 500, SEED)


CAP = 12       # small enough to bind on the event log's hot items and users


@register("llr_capped", ctes(("inter",), scores_sql(capped_sql(CAP), "capped")) +
          "SELECT action, item, other, k11, n_a, n_b, round(llr, 6) AS llr FROM sc")
def q_llr_capped(spark, sf):
    """LLR over a capped draw; U still counts every user."""
    pairs = C.action_pairs(T.inter(spark, sf), ACTIONS, materialize=True)
    n_users = pairs.select(F.count_distinct("user")).scalar()
    s = C.llr_scores(I.interaction_cap(pairs, CAP, CAP, SEED), PRIMARY, n_users)
    return s.select("action", "item", "other", "k11", "n_a", "n_b", F.round("llr", 6).alias("llr"))


@register("cooccurrence_join", ctes(("inter",), SCORES) + "SELECT action, item, other, k11 FROM sc")
def q_cooccurrence_join(spark, sf):
    return C.cooccurrence_join(C.action_pairs(T.inter(spark, sf), ACTIONS, materialize=True), PRIMARY)


@register("llr", ctes(("inter",), SCORES) + "SELECT action, item, other, k11, n_a, n_b, round(llr, 6) AS llr FROM sc")
def q_llr(spark, sf):
    s = C.llr_scores(C.action_pairs(T.inter(spark, sf), ACTIONS, materialize=True), PRIMARY)
    return s.select("action", "item", "other", "k11", "n_a", "n_b", F.round("llr", 6).alias("llr"))


@register("llr_correlators", ctes(("inter",), CORR) + "SELECT action, item, other, round(llr, 6) AS llr, rank FROM corr")
def q_llr_correlators(spark, sf):
    return correlators(spark, sf).withColumn("llr", F.round("llr", 6))


BATCH_ENDS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")


@register("llr_correlators_incremental", ctes(("inter",), CORR) + "SELECT action, item, other, round(llr, 6) AS llr, rank FROM corr")
def q_llr_correlators_incremental(spark, sf):
    """The log taken in as three batches by time; each but the first brings a
    tenth of the rows before its begin once more."""
    inter = I.action_split(T.inter(spark, sf), ACTIONS)
    ends = [F.lit(e).cast("timestamp_ntz") for e in BATCH_ENDS]
    number = sum((F.col("ts") >= e).cast("int") for e in ends)
    folder = f"{table_folder(spark)}/correlators-{uuid.uuid4().hex}"
    for k in range(len(ends) + 1):
        rows = inter.where((number == k) | ((number < k) & (F.col("event_id") % 10 == 0)))
        out = add_batch(spark, folder, k, rows, PRIMARY, SECONDARY, top_k=50)
    return out.withColumn("llr", F.round("llr", 6))


@register("correlator_topk", ctes(("inter",), SCORES) + """
SELECT action, item, other, CAST(rank AS INTEGER) AS rank FROM (SELECT action, item, other,
  row_number() OVER (PARTITION BY action, item ORDER BY round(llr, 9) DESC, other) AS rank FROM sc WHERE llr > 0)
WHERE rank <= 50""")
def q_correlator_topk(spark, sf):
    s = C.llr_scores(C.action_pairs(T.inter(spark, sf), ACTIONS, materialize=True), PRIMARY).where("llr > 0")
    return C.correlator_topk(s, 50).select("action", "item", "other", "rank")


@register("correlator_lists", ctes(("inter",), CORR) + """
SELECT item, action, array_to_string(list(other ORDER BY rank), ',') AS others FROM corr GROUP BY item, action""")
def q_correlator_lists(spark, sf):
    return C.correlator_lists(correlators(spark, sf)).select("item", "action", _txt("others").alias("others"))


# --------------------------------------------------------------------------- popularity
def _pop_sql(kind, duration):
    return ctes(("inter",), pop_cte("pop", kind, (PRIMARY,), POP_END, duration)) + "SELECT item, score FROM pop"


for _kind, _dur in (("popular", SHORT_DURATION), ("trending", LONG_DURATION), ("hot", LONG_DURATION)):
    def _mk(kind=_kind, dur=_dur):
        return lambda spark, sf: pop_model(spark, sf, kind, dur)
    register(f"pop_{_kind}", _pop_sql(_kind, _dur))(_mk())


# --------------------------------------------------------------------------- documents
def docs(spark, sf, model="all"):
    return D.item_docs(None, correlators(spark, sf), pop_model(spark, sf), model)


def _docs_txt(df):
    m = F.col("correlators")
    return df.select("item", "pop_rank", *[
        F.concat_ws(",", F.transform(F.coalesce(m[a], F.array()), lambda x: x.cast("string"))).alias(f"c_{a}")
        for a in ACTIONS])


def _docs_txt_any(df, model):
    if model == "backfill":     # no correlators in these documents
        return df.select("item", "pop_rank", *[F.lit("").alias(f"c_{a}") for a in ACTIONS])
    return _docs_txt(df)


_DOC_SQL = ctes(("inter",), CORR, pop_cte("pop"), """
cl AS (SELECT item, action, array_to_string(list(other ORDER BY rank), ',') AS others FROM corr GROUP BY item, action),
cm AS (SELECT item, """ + ", ".join(
    f"coalesce(max(others) FILTER (WHERE action = '{a}'), '') AS c_{a}" for a in ACTIONS) + """ FROM cl GROUP BY item)""")


def item_fields(spark, sf):
    """(item, fields map<string, array<string>>): brand and type of each item."""
    it = T.items(spark, sf)
    return it.select("item", F.create_map(F.lit("brand"), F.array("p_brand"),
                                          F.lit("type"), F.array("p_type")).alias("fields"))


ITEM_DOCS_SQL = ctes(("inter", "items"), CORR, pop_cte("pop"), """
cl AS (SELECT item, action, array_to_string(list(other ORDER BY rank), ',') AS others FROM corr GROUP BY item, action),
cm AS (SELECT item, """ + ", ".join(
    f"coalesce(max(others) FILTER (WHERE action = '{a}'), '') AS c_{a}" for a in ACTIONS) + """ FROM cl GROUP BY item),
cp AS (SELECT coalesce(cm.item, pop.item) AS item, pop.score AS pop_rank, """ + ", ".join(
    f"c_{a}" for a in ACTIONS) + """ FROM cm FULL JOIN pop ON cm.item = pop.item)""") + """
SELECT coalesce(cp.item, it.item) AS item, cp.pop_rank, """ + ", ".join(
    f"coalesce(cp.c_{a}, '') AS c_{a}" for a in ACTIONS) + """,
  coalesce('brand=' || it.p_brand || ';type=' || it.p_type, '') AS fields
FROM cp FULL JOIN items it ON it.item = cp.item"""


def all_docs(spark, sf):
    """Fields, correlator lists and popularity merged into one row per item."""
    return D.item_docs(item_fields(spark, sf), correlators(spark, sf), pop_model(spark, sf), "all")


def docs_text(d):
    """Documents with their maps and lists as text, for comparison."""
    fields_txt = F.coalesce(F.concat_ws(";", F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(
        e["key"], F.lit("="), F.array_join(e["value"], ",")))), F.lit(""))
    m = F.col("correlators")
    return d.select("item", "pop_rank", *[
        F.concat_ws(",", F.transform(F.coalesce(m[a], F.array()), lambda x: x.cast("string"))).alias(f"c_{a}")
        for a in ACTIONS], fields_txt.alias("fields"))


@register("item_docs", ITEM_DOCS_SQL)
def q_item_docs(spark, sf):
    return docs_text(all_docs(spark, sf))


for _model, _from in (("collabFiltering", "SELECT item, CAST(NULL AS DOUBLE) AS pop_rank, " + ", ".join(f"c_{a}" for a in ACTIONS) + " FROM cm"),
                      ("backfill", "SELECT item, score AS pop_rank, " + ", ".join(f"'' AS c_{a}" for a in ACTIONS) + " FROM pop")):
    def _mk_docs(model=_model):
        return lambda spark, sf: _docs_txt_any(docs(spark, sf, model), model)
    register(f"item_docs_{_model}", _DOC_SQL + _from)(_mk_docs())


@register("group_all", _DOC_SQL + """
SELECT coalesce(cm.item, pop.item) AS item, pop.score AS pop_rank, """ + ", ".join(
    f"coalesce(c_{a}, '') AS c_{a}" for a in ACTIONS) + " FROM cm FULL JOIN pop ON cm.item = pop.item")
def q_group_all(spark, sf):
    """Keyed maps merged with one shuffle: correlator lists and popularity as
    (id, props) text maps; the later input wins on a repeated key."""
    corr = C.correlator_lists(correlators(spark, sf))
    cmap = corr.select(F.col("item").alias("id"),
                       F.create_map(F.concat(F.lit("c_"), "action"), _txt("others")).alias("props"))
    pmap = pop_model(spark, sf).select(F.col("item").alias("id"),
                                       F.create_map(F.lit("pop_rank"), F.col("score").cast("string")).alias("props"))
    g = D.group_all(cmap, pmap, id_col="id")
    return g.select(F.col("id").alias("item"), F.col("props")["pop_rank"].cast("double").alias("pop_rank"),
                    *[F.coalesce(F.col("props")[f"c_{a}"], F.lit("")).alias(f"c_{a}") for a in ACTIONS])


@register("docs_refresh_pop", ctes(("inter",), CORR, pop_cte("pop"), pop_cte("pop2", "popular", (PRIMARY,), POP_END,
                                                                          SHORT_DURATION)) + """
SELECT coalesce(d.item, p.item) AS item, p.score AS pop_rank
FROM (SELECT item FROM corr UNION SELECT item FROM pop) d FULL JOIN pop2 p ON d.item = p.item""")
def q_docs_refresh_pop(spark, sf):
    d = docs(spark, sf)
    return D.docs_refresh_pop(d, pop_model(spark, sf, "popular", SHORT_DURATION)).select("item", "pop_rank")


@register("item_pop_full", ctes(("inter", "items"), pop_cte("pop")) + """
SELECT coalesce(i.item, p.item) AS item, i.title, p.score AS pop_rank FROM items i FULL JOIN pop p ON i.item = p.item""")
def q_item_pop_full(spark, sf):
    return D.item_pop_full(T.items(spark, sf).select("item", "title"), pop_model(spark, sf))


# --------------------------------------------------------------------------- query terms
@register("user_history_query", ctes(("inter",)) + """
SELECT DISTINCT user AS query_id, action, item AS term, CAST(1.0 AS DOUBLE) AS boost FROM (
  SELECT *, row_number() OVER (PARTITION BY user, action ORDER BY ts DESC, event_id DESC) AS r
  FROM inter WHERE action IN ('purchase', 'view', 'click')) WHERE r <= 100""")
def q_user_history_query(spark, sf):
    return R.user_history_query(all_user_queries(spark, sf), T.inter(spark, sf), ACTIONS, 100).drop("must")


@register("similar_items_query", ctes(("inter",), CORR) + """
SELECT q.item AS query_id, c.action, c.other AS term, CAST(1.0 AS DOUBLE) AS boost
FROM (SELECT DISTINCT item FROM inter) q JOIN corr c ON c.item = q.item WHERE c.rank <= 100""")
def q_similar_items_query(spark, sf):
    q = T.inter(spark, sf).select("item").distinct().select(F.col("item").alias("query_id"), "item")
    return R.similar_items_query(q, correlators(spark, sf), 100).drop("must")


@register("history_cap", ctes(("inter",)) + """
SELECT DISTINCT user, action, item FROM (SELECT *, row_number() OVER (PARTITION BY user, action
  ORDER BY ts DESC, event_id DESC) AS r FROM inter) WHERE r <= 100""")
def q_history_cap(spark, sf):
    return I.history_cap(T.inter(spark, sf), per_action=100)


@register("exclusion_union", ctes(("inter",)) + f"""
SELECT DISTINCT user AS query_id, item FROM inter WHERE action = '{PRIMARY}'
UNION SELECT user AS query_id, item FROM inter WHERE action = 'error'""")
def q_exclusion_union(spark, sf):
    """Seen (primary action) + blacklisted (items a user hit an error on)."""
    i = T.inter(spark, sf)
    bl = i.where(F.col("action") == "error").groupBy("user").agg(F.collect_set("item").alias("blacklist"))
    q = i.select("user").distinct().join(bl, "user", "left").select(
        F.col("user").alias("query_id"), "user", F.coalesce("blacklist", F.array().cast("array<bigint>")).alias("blacklist"))
    return R.exclusions(q, i, [PRIMARY])


@register("seen_anti", ctes(("inter",), CORR) + f"""
SELECT s.user, s.item, s.n FROM (SELECT h.user, c.item, count(*) AS n FROM inter h JOIN corr c
  ON c.action = h.action AND c.other = h.item GROUP BY 1, 2) s
WHERE NOT EXISTS (SELECT 1 FROM inter x WHERE x.user = s.user AND x.item = s.item AND x.action = '{PRIMARY}')""")
def q_seen_anti(spark, sf):
    """Correlator candidates per user minus the items the user already bought."""
    i = T.inter(spark, sf)
    corr = correlators(spark, sf)
    acts = cut_lineage(i.groupBy("user", "action", F.col("item").alias("other")).agg(F.count(F.lit(1)).alias("times")))
    cand = (owned_join(acts, corr.select("action", "other", "item"), ["action", "other"], "user")
            .groupBy("user", "item").agg(F.sum("times").alias("n")))
    seen = i.where(F.col("action") == PRIMARY).select("user", "item")
    return cand.join(seen, ["user", "item"], "left_anti")
