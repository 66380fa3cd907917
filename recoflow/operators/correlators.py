"""Multi-action co-occurrence correlators scored by log-likelihood ratio.

For a primary action A and secondary actions B (A itself included), the
correlator row (B, i, j) says: users who did A on item i often did B on item j.
With U users, n_A(i) users with A on i, n_B(j) users with B on j and k11 users
with both:

    k11, k12 = n_A(i) - k11, k21 = n_B(j) - k11, k22 = U - n_A(i) - n_B(j) + k11

U counts the users of all the actions given, before any cap.  Caps are an
explicit option (``max_events``, a seeded draw); without them all pairs count.

The plan: distinct pairs -> optional caps -> self join on user, with hot users
cut into blocks by item (``joins.blocked_join``) -> partial/final count per
pair -> marginals joined on item -> llr -> top-k per (action, item) through a
window group limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recoflow.functions.scalar import with_llr
from recoflow.session import cut_lineage
from recoflow.operators.interactions import action_split, interaction_cap
from recoflow.operators.joins import blocked_join


def action_pairs(inter: DataFrame, actions, materialize: bool = False) -> DataFrame:
    """Distinct (user, action, item) of the given actions.  ``materialize``
    writes them once to the checkpoint folder: the correlator plan reads them
    several times (join sides, marginals, user count), and without it every
    read re-scans and re-parses the event log."""
    pairs = action_split(inter, actions).select("user", "action", "item").distinct()
    return cut_lineage(pairs) if materialize else pairs


def cooccurrence_join(pairs: DataFrame, primary: str) -> DataFrame:
    """Self join of the pairs on user: (action, item, other, k11).  The primary
    action against itself drops the diagonal."""
    a = pairs.where(F.col("action") == primary).select("user", "item")
    b = pairs.select("user", "action", F.col("item").alias("other"))
    j = blocked_join(a, b, ["user"], "item").where((F.col("action") != primary) | (F.col("item") != F.col("other")))
    return j.groupBy("action", "item", "other").agg(F.count(F.lit(1)).alias("k11"))


def llr_scores(pairs: DataFrame, primary: str, n_users=None) -> DataFrame:
    """Every co-occurring (action, item, other) with its counts and llr.
    ``n_users`` (a number or one-value column) is U; pass the count taken
    before the caps when ``pairs`` are capped."""
    if n_users is None:
        n_users = pairs.select(F.count_distinct("user")).scalar()
    cooc = cooccurrence_join(pairs, primary)
    marg_a = (pairs.where(F.col("action") == primary).groupBy("item")
              .agg(F.count(F.lit(1)).alias("n_a")))
    marg_b = (pairs.groupBy("action", F.col("item").alias("other"))
              .agg(F.count(F.lit(1)).alias("n_b")))
    j = cooc.join(marg_a, "item").join(marg_b, ["action", "other"])
    nu = n_users if not isinstance(n_users, (int, float)) else F.lit(n_users)
    return with_llr(j, "k11", "n_a", "n_b", nu)


def llr_correlators(inter: DataFrame, primary: str = "purchase", secondaries=(),
                    top_k: int = 50, max_events: int | None = None, seed: int = 7,
                    materialize: bool = True) -> DataFrame:
    """CORRELATOR table (action, item, other, llr, rank): for every action, the
    ``top_k`` strongest positive-llr items per primary item, ranked by
    (llr desc, other asc).  ``max_events`` caps users per item and items per
    user by a seeded draw; None keeps all."""
    actions = [primary] + [a for a in secondaries if a != primary]
    pairs = action_pairs(inter, actions, materialize)
    n_users = pairs.select(F.count_distinct("user")).scalar()
    if max_events is not None:
        pairs = interaction_cap(pairs, max_events, max_events, seed)
        pairs = cut_lineage(pairs) if materialize else pairs
    scores = llr_scores(pairs, primary, n_users).where(F.col("llr") > 0)
    return correlator_topk(scores, top_k)


def correlator_topk(scores: DataFrame, top_k: int = 50) -> DataFrame:
    w = Window.partitionBy("action", "item").orderBy(F.round("llr", 9).desc(), F.col("other"))
    return (scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
            .select("action", "item", "other", "llr", "rank"))


def correlator_lists(correlators: DataFrame) -> DataFrame:
    """(item, action, others) with others in rank order; items without a
    correlator for an action get no row (empty rows dropped)."""
    s = F.array_sort(F.collect_list(F.struct("rank", "other")))
    return correlators.groupBy("item", "action").agg(F.transform(s, lambda x: x["other"]).alias("others"))


def correlator_maps(correlators: DataFrame) -> DataFrame:
    """(item, correlators map<action, array<other>>): the document form."""
    lists = correlator_lists(correlators)
    return lists.groupBy("item").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "others")))).alias("correlators"))
