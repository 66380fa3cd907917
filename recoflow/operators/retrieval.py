"""Batch retrieval over correlators: the search-engine query as joins.

A QUERY is a row (query_id, user, item, num, ...); serving many queries is a
batch join, and one query is a one-row table.  Documents are the items with
fields, correlators or popularity.

Score (fixed definition, the original relevance score cannot be reproduced):
for a query q and a candidate item X,

    score(q, X) = sum over query terms (action, t, boost) with t in
                  X.correlators[action] of boost
                + sum over boosted fields of bias * |values & X.fields[name]|

Terms come from the user's recent history (newest ``max_query_events`` events
per action, distinct items) and from the correlators of the query item; a
negative user or item bias makes its terms a must condition instead (a
candidate must match one of them).  Candidates that match nothing still
qualify with score 0 (the backfill).  Results are ordered by score desc,
popularity desc (nulls last), item asc.  Excluded: items the user did a
blacklist event on, the query blacklist and the query item unless
``return_self``.

No query x document product is formed.  Unmatched candidates of a query
depend only on its SIGNATURE (field filters and boosts, date range, current
date), and only the first ``num + |excluded(q)|`` documents of the
signature's order can be needed: any later one has ``num`` unexcluded
documents before it.  Each distinct signature reads blocks of documents from
the top of the popularity order until it has found that many (``blocks``), so
queries that differ in their dates stay cheap; queries join their signature's
list by position.  Hot terms, hot
signatures and hot positions are dealt to blocks (``joins.blocked_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflow.operators.blocks import LIST, first_matches, may_hold, popularity_lists
from recoflow.operators.interactions import history_cap
from recoflow.operators.joins import blocked_join, owned_join
from recoflow.operators.ranking import global_row_number, topn_per_group
from recoflow.session import cut_lineage

FIELDS_TYPE = "array<struct<name:string,values:array<string>,bias:double>>"
SALTS = 16
SIGNATURE = ("fields", "date_field", "after", "before", "current_date")


def _option(df: DataFrame, name: str, default, kind: str) -> Column:
    """A per-query column when the query table has it, else the default."""
    d = F.lit(default).cast(kind)
    return F.coalesce(F.col(name).cast(kind), d) if name in df.columns else d


def _terms(df: DataFrame, bias: Column) -> DataFrame:
    return df.select("query_id", "action", "term", F.when(bias > 0, bias).otherwise(F.lit(1.0)).alias("boost"),
                     (bias < 0).alias("must"))


def _of_event_names(df: DataFrame) -> DataFrame:
    """Keep terms of the query's own event names, when it lists any."""
    if "event_names" not in df.columns:
        return df
    return df.where(F.col("event_names").isNull() | F.array_contains("event_names", F.col("action")))


def user_history_query(queries: DataFrame, inter: DataFrame, actions, max_events: int = 100,
                       user_bias: float = 1.0) -> DataFrame:
    """Query terms from each query user's recent items: (query_id, action,
    term, boost, must).  Per-query columns ``user_bias`` and ``event_names``
    go before the arguments."""
    hist = history_cap(inter, per_action=max_events, actions=actions).withColumnRenamed("item", "term")
    names = [c for c in ("event_names",) if c in queries.columns]
    q = queries.where(F.col("user").isNotNull()).select(
        "query_id", "user", *names, _option(queries, "user_bias", user_bias, "double").alias("_bias"))
    return _terms(_of_event_names(blocked_join(q, hist, ["user"], "query_id")), F.col("_bias"))


def similar_items_query(queries: DataFrame, correlators: DataFrame, max_events: int = 100,
                        item_bias: float = 1.0) -> DataFrame:
    """Query terms from the query item's own correlators (at most ``max_events``
    per action, in rank order); per-query column ``item_bias``."""
    names = [c for c in ("event_names",) if c in queries.columns]
    q = queries.where(F.col("item").isNotNull()).select(
        "query_id", F.col("item").alias("qitem"), *names, _option(queries, "item_bias", item_bias, "double").alias("_bias"))
    c = correlators.where(F.col("rank") <= max_events).select(
        F.col("item").alias("qitem"), "action", F.col("other").alias("term"))
    return _terms(_of_event_names(blocked_join(q, c, ["qitem"], "query_id")), F.col("_bias"))


def match_terms(terms: DataFrame, correlators: DataFrame) -> DataFrame:
    """(query_id, item, score): terms joined to the inverted correlator table
    on (action, other), summed by (query_id, item)."""
    inv = correlators.select("action", F.col("other").alias("term"), "item")
    return (owned_join(terms.select("query_id", "action", "term", "boost"), inv, ["action", "term"], "query_id")
            .groupBy("query_id", "item").agg(F.sum("boost").alias("score")))


def exclusions(queries: DataFrame, inter: DataFrame, events) -> DataFrame:
    """(query_id, item) never to return: items the user did one of the
    blacklist ``events`` on (none: no such filter), the query blacklist, and
    the query item unless return_self."""
    parts = []
    if events:
        seen = inter.where(F.col("action").isin(list(events))).select("user", "item").distinct()
        parts.append(blocked_join(queries.where(F.col("user").isNotNull()).select("query_id", "user"), seen, ["user"],
                                  "query_id").select("query_id", "item"))
    cols = set(queries.columns)
    if "blacklist" in cols:
        parts.append(queries.select("query_id", F.explode("blacklist").alias("item")))
    if "item" in cols:
        keep_self = F.col("return_self") if "return_self" in cols else F.lit(False)
        parts.append(queries.where(F.col("item").isNotNull() & ~F.coalesce(keep_self, F.lit(False)))
                     .select("query_id", "item"))
    if not parts:
        return queries.limit(0).select("query_id", F.lit(None).alias("item"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.distinct()


def document_table(correlators: DataFrame, pop: DataFrame | None, props: DataFrame | None) -> DataFrame:
    """(item, pop_rank, fields, dates): every item with fields, correlators or
    popularity.  props: (item[, fields map<string,array<string>>][, dates
    map<string,timestamp>])."""
    none_f = F.lit(None).cast("map<string,array<string>>").alias("fields")
    none_d = F.lit(None).cast("map<string,timestamp>").alias("dates")
    none_p = F.lit(None).cast("double").alias("pop_rank")
    u = correlators.select("item", none_p, none_f, none_d)
    if pop is not None:
        u = u.unionByName(pop.select("item", F.col("score").cast("double").alias("pop_rank"), none_f, none_d))
    if props is not None:
        cols = set(props.columns)
        u = u.unionByName(props.select("item", none_p, F.col("fields") if "fields" in cols else none_f,
                                       F.col("dates") if "dates" in cols else none_d))
    return u.groupBy("item").agg(F.max("pop_rank").alias("pop_rank"), F.first("fields", ignorenulls=True).alias("fields"),
                                 F.first("dates", ignorenulls=True).alias("dates"))


def _shares(fields: Column, x: Column) -> Column:
    """Number of a query field's values that the document's field has."""
    has = F.coalesce(fields[x["name"]], F.array().cast("array<string>"))
    return F.size(F.array_intersect(has, x["values"]))


def must_filter(available_name: str = "available_date", expire_name: str = "expire_date") -> Column:
    """Filters of a signature on a joined (signature, document) row: every query
    field with bias < 0 must share a value with the document field, a field
    with bias 0 must share none (bias > 0 only boosts); the document date must
    be strictly inside (after, before) when given; with a current date,
    available <= now < expire.  Missing values fail."""
    ok = F.forall(F.filter("q_fields", lambda x: x["bias"] < 0), lambda x: _shares(F.col("fields"), x) > 0)
    none = F.forall(F.filter("q_fields", lambda x: x["bias"] == 0), lambda x: _shares(F.col("fields"), x) == 0)
    date = F.col("dates")[F.col("q_date_field")]
    range_ok = ((F.col("q_after").isNull() | F.coalesce(date > F.col("q_after"), F.lit(False)))
                & (F.col("q_before").isNull() | F.coalesce(date < F.col("q_before"), F.lit(False))))
    now = F.col("q_current_date")
    avail_ok = now.isNull() | F.coalesce((F.col("dates")[available_name] <= now)
                                         & (F.col("dates")[expire_name] > now), F.lit(False))
    return F.coalesce(ok, F.lit(True)) & F.coalesce(none, F.lit(True)) & range_ok & avail_ok


def field_score() -> Column:
    """Sum of bias * shared values over the signature's boosted fields."""
    parts = F.transform(F.filter("q_fields", lambda x: x["bias"] > 0), lambda x: x["bias"] * _shares(F.col("fields"), x))
    return F.coalesce(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))


def _signed(q: DataFrame) -> DataFrame:
    """Adds q_<option> columns and ``sig``, a key of all of them."""
    kinds = dict(zip(SIGNATURE, (FIELDS_TYPE, "string", "timestamp", "timestamp", "timestamp")))
    for name, kind in kinds.items():
        q = q.withColumn(f"q_{name}", (F.col(name) if name in q.columns else F.lit(None)).cast(kind))
    return q.withColumn("sig", F.sha2(F.to_json(F.struct(*[f"q_{c}" for c in SIGNATURE])), 256))


def _signature_lists(sigs: DataFrame, docs: DataFrame, pred: Column, available_name: str, expire_name: str) -> DataFrame:
    """(sig, place, item, field_score): the first ``need`` documents of each
    signature by (field score desc, popularity desc nulls last, item).

    A document without field score that is among them is also among the first
    ``need`` that pass in popularity order: those come from a walk (``blocks``)
    through the list of all documents, or through the lists of the values of
    the first must field.  Documents with a field score hold a boosted value
    and come from an equi join on it."""
    no_fields = F.array().cast(FIELDS_TYPE)
    musts = F.filter(F.coalesce("q_fields", no_fields), lambda x: x["bias"] < 0)
    first = F.get(musts, F.lit(0))
    keys = F.when(F.size(musts) > 0, F.transform(F.array_distinct(first["values"]), lambda v: F.struct(
        first["name"].alias("name"), v.alias("value")))).otherwise(
        F.array(F.struct(F.lit("").alias("name"), F.lit("").alias("value"))))
    asked = [c for c in sigs.columns if c.startswith("q_")]
    walks = sigs.select(F.col("sig").alias("walk"), "need", *asked, F.explode(keys).alias("k"))
    walks = cut_lineage(walks.select("walk", "need", *asked, "k.name", "k.value"))
    lists = popularity_lists(docs)
    keep = [F.col("need"), F.col("item"), F.col("pop_rank"), field_score().alias("field_score")]
    found = first_matches(walks, lists, pred, may_hold(available_name, expire_name), keep).withColumnRenamed("walk", "sig")

    boosts = F.filter(F.coalesce("q_fields", no_fields), lambda x: x["bias"] > 0)
    s = sigs.select("*", F.explode(boosts).alias("f")).select("*", F.col("f.name").alias("name"), F.explode("f.values").alias("value")).drop("f")
    held = lists.docs.where(F.col("name") != "")
    boosted = blocked_join(held, s, LIST, "item").where(pred)
    found = found.unionByName(boosted.select("sig", *keep)).distinct()
    order = [F.col("field_score").desc(), F.col("pop_rank").desc_nulls_last(), F.col("item").asc()]
    found = found.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    found = topn_per_group(found, ["sig", "salt"], order, F.col("need"), "place")      # best of each share, then of all
    found = topn_per_group(found.drop("place"), ["sig"], order, F.col("need"), "place")
    return found.select("sig", F.col("place").cast("bigint").alias("place"), "item", "field_score")


def recommend(queries: DataFrame, correlators: DataFrame, pop: DataFrame | None, inter: DataFrame,
              *, primary: str = "purchase", actions=None, max_query_events: int = 100,
              user_bias: float = 1.0, item_bias: float = 1.0, backfill: bool = True,
              default_num: int = 20, blacklist_events=None, doc_props: DataFrame | None = None,
              available_name: str = "available_date", expire_name: str = "expire_date") -> DataFrame:
    """RECS (query_id, rank, item, score) for every query row.

    queries: query_id, user (nullable) and, each optional, item, num,
    blacklist, return_self, user_bias, item_bias, event_names, fields
    (array<struct<name, values, bias>>), date_field, after, before,
    current_date.  correlators: CORRELATOR rows.  pop: (item, score) or None.
    blacklist_events: actions whose items are not returned to their user
    (default: the primary action; an empty list: no such filter).
    doc_props: items with fields and dates; they are documents too.
    """
    actions = list(actions) if actions is not None else [primary]
    events = [primary] if blacklist_events is None else list(blacklist_events)
    # a literal limit (no per-query num) lets Spark plan a partial window group
    # limit before the shuffle of the final top-n
    uniform = "num" not in queries.columns
    q = queries if not uniform else queries.withColumn("num", F.lit(default_num))
    q = cut_lineage(_signed(q.withColumn("num", F.coalesce(F.col("num"), F.lit(default_num)))))
    docs = cut_lineage(document_table(correlators, pop, doc_props))
    u_terms = user_history_query(q, inter, actions, max_query_events, user_bias)
    terms = [u_terms]
    if "item" in q.columns:
        terms.append(similar_items_query(q, correlators, max_query_events, item_bias))
    terms = [cut_lineage(t) for t in terms]
    boosts = terms[0].where(~F.col("must"))
    for t in terms[1:]:
        boosts = boosts.unionByName(t.where(~F.col("must")))
    scores = match_terms(boosts, correlators)

    excl = exclusions(q, inter, events)
    n_ex = excl.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_ex"))
    pred = must_filter(available_name, expire_name)
    # every candidate is an item of the correlators: the other documents take no part in these joins
    known = cut_lineage(docs.join(correlators.select("item").distinct(), "item", "left_semi"))
    side = q.select("query_id", "num", "sig", *[f"q_{c}" for c in SIGNATURE],
                    (_option(q, "user_bias", user_bias, "double") < 0).alias("must_u"),
                    (_option(q, "item_bias", item_bias, "double") < 0).alias("must_i"))

    # matched candidates, with the filters and field scores of their query
    cand = _with_docs(scores, side, known, pred, excl)
    open_side = side
    if min(user_bias, item_bias) < 0 or {"user_bias", "item_bias"} & set(q.columns):
        # a query with must terms takes only items that match one of each kind it has
        has = q.select("query_id", F.col("user").isNotNull().alias("hu"),
                       (F.col("item").isNotNull() if "item" in q.columns else F.lit(False)).alias("hi"))
        want = (F.col("must_u") & F.col("hu")).cast("int") + (F.col("must_i") & F.col("hi")).cast("int")
        musts = side.join(has, "query_id").select("query_id", want.alias("want")).where("want > 0")
        hits = [match_terms(t.where("must"), correlators).select("query_id", "item") for t in terms]
        hits = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
        allowed = hits.groupBy("query_id", "item").agg(F.count(F.lit(1)).alias("kinds"))
        allowed = allowed.join(musts, "query_id").where("kinds = want").select("query_id", "item")
        only = _with_docs(allowed.withColumn("score", F.lit(0.0)), side, known, pred, excl)
        cand = (cand.join(musts, "query_id", "left_anti")
                .unionByName(cand.join(allowed, ["query_id", "item"], "left_semi")).unionByName(only)
                .groupBy("query_id", "item").agg(F.max("score").alias("score")))
        open_side = side.join(musts, "query_id", "left_anti")
    if backfill:
        cand = cut_lineage(cand)
        have = cand.groupBy("query_id").agg(F.count_if(F.col("score") >= 0).alias("have"))
        # a query that already holds num candidates still needs its list when fields add to scores
        boosted = F.exists(F.coalesce("q_fields", F.array().cast(FIELDS_TYPE)), lambda x: x["bias"] > 0)
        short = (open_side.join(have, "query_id", "left").where((F.coalesce("have", F.lit(0)) < F.col("num")) | boosted)
                 .join(n_ex, "query_id", "left").withColumn("need", F.col("num") + F.coalesce("n_ex", F.lit(0))))
        short = cut_lineage(short)
        plain = F.lit(True)
        for c in SIGNATURE:
            plain = plain & F.col(f"q_{c}").isNull()
        # the bare signature: one global popularity order
        order = [F.col("pop_rank").desc_nulls_last(), F.col("item").asc()]
        ranked = global_row_number(docs.select("item", "pop_rank"), order, name="place")
        steps = lambda s: s.select("query_id", "sig", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("need").cast("bigint"))).alias("place"))
        fill = blocked_join(steps(short.where(plain)), ranked.select("place", "item"), ["place"], "query_id").select(
            "query_id", "item", F.lit(0.0).alias("score"))
        if any(c in queries.columns for c in SIGNATURE):
            sigs = short.where(~plain).groupBy("sig", *[f"q_{c}" for c in SIGNATURE]).agg(F.max("need").alias("need"))
            lists = cut_lineage(_signature_lists(cut_lineage(sigs), docs, pred, available_name, expire_name))
            more = blocked_join(steps(short.where(~plain)), lists, ["sig", "place"], "query_id")
            fill = fill.unionByName(more.select("query_id", "item", F.col("field_score").alias("score")))
        fill = fill.join(excl, ["query_id", "item"], "left_anti")
        cand = cand.unionByName(fill).groupBy("query_id", "item").agg(F.max("score").alias("score"))
    cand = cand.join(docs.select("item", "pop_rank"), "item").join(q.select("query_id", "num"), "query_id")
    order = [F.col("score").desc(), F.col("pop_rank").desc_nulls_last(), F.col("item").asc()]
    top = topn_per_group(cand, ["query_id"], order, default_num if uniform else F.col("num"))
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "item", "score")


def _with_docs(scored: DataFrame, side: DataFrame, docs: DataFrame, pred: Column, excl: DataFrame) -> DataFrame:
    """(query_id, item, score): the scored pairs that pass their query's
    filters and are not excluded, field scores added."""
    j = scored.join(excl, ["query_id", "item"], "left_anti").join(side, "query_id").join(docs, "item").where(pred)
    return j.select("query_id", "item", (F.col("score") + field_score()).alias("score"))


def boosted_fields(queries: DataFrame, docs: DataFrame, n: int | None = None) -> DataFrame:
    """(query_id, item, score) = bias * |values & doc.fields[name]| for every
    query field with bias > 0, summed over fields; with ``n`` the best n of
    each query (score desc, item asc).  queries: query_id, fields
    array<struct<name, values, bias>>; queries of equal fields are scored once."""
    f = cut_lineage(queries.select("query_id", "fields", F.sha2(F.to_json(F.struct("fields")), 256).alias("sig")))
    one = f.groupBy("sig").agg(F.first("fields").alias("fields"))
    e = one.select("sig", F.explode("fields").alias("f")).where(F.col("f.bias") > 0)
    e = e.select("sig", F.col("f.name").alias("name"), F.explode("f.values").alias("value"), F.col("f.bias").alias("bias"))
    d = docs.select("item", F.explode("fields").alias("name", "values")).select(
        "item", "name", F.explode("values").alias("value"))
    if n is not None:
        return _best_by_kind(f, cut_lineage(e), d, n)
    s = blocked_join(d, e, ["name", "value"], "item").groupBy("sig", "item").agg(F.sum("bias").alias("score"))
    return blocked_join(f.select("query_id", "sig"), s, ["sig"], "query_id").select("query_id", "item", "score")


def _best_by_kind(f: DataFrame, e: DataFrame, d: DataFrame, n: int) -> DataFrame:
    """The best ``n`` documents of every query without a row per query and
    document.  f: (query_id, sig); e: (sig, name, value, bias); d: (item, name,
    value).

    Documents that hold the same asked values (a KIND) score alike for every
    query, so only the first ``n`` items of a kind can be among the best, and
    only the first ``n`` kinds of a signature by (score desc, first item)."""
    held = blocked_join(d, e.select(*LIST).distinct(), LIST, "item").groupBy("item", *LIST).agg(F.count(F.lit(1)).alias("c"))
    sets = held.groupBy("item").agg(F.sort_array(F.collect_list(F.struct(*LIST, "c"))).alias("kind"))
    first = topn_per_group(sets, ["kind"], [F.col("item").asc()], n).drop("rank")
    kinds = first.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("item"))).alias("items"))
    kinds = cut_lineage(kinds.withColumn("k", F.sha2(F.to_json(F.struct("kind")), 256)))
    values = kinds.select("k", "items", F.inline("kind"))
    s = blocked_join(e, values, LIST, "sig").groupBy("sig", "k").agg(
        F.sum(F.col("bias") * F.col("c")).alias("score"), F.first("items").alias("items"))
    s = topn_per_group(s, ["sig"], [F.col("score").desc(), F.col("items")[0]["item"].asc()], n)
    each = F.transform("items", lambda x: F.struct((-F.col("score")).alias("s"), x["item"].alias("item")))
    best = s.groupBy("sig").agg(F.slice(F.sort_array(F.flatten(F.collect_list(each))), 1, n).alias("best"))
    out = blocked_join(f.select("query_id", "sig"), best, ["sig"], "query_id").select("query_id", F.inline("best"))
    return out.select("query_id", "item", (-F.col("s")).alias("score"))
