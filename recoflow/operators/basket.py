"""Session baskets and association rules.

Sessions: a user's events, sorted by time, stay in one basket while the gap
to the previous event is <= ``gap_seconds`` (two events exactly ``gap``
apart share a basket).  The plan never puts one user's whole history in a
single window: events are windowed by (user, time bucket), and a per-bucket
summary (min, max, last session start) carries sessions across bucket edges,
so a user with a third of all rows is still spread over many tasks.

Itemsets are mined by prefix projection up to ``max_len``: frequent items
first, then each frequent prefix is extended by the items that follow it in
its (weighted, grouped) projected baskets, counted with map-side combine and
pruned by support.  Very wide baskets are held back and only asked for the
sets that the others suggest.  Nothing longer than ``max_len`` is ever formed
and no item list passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflow.operators.joins import blocked_join
from recoflow.operators.ranking import topn_per_group
from recoflow.session import cut_lineage


#: Baskets of more frequent items than this are held back from projection.
WIDE = 128


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def session_starts(events: DataFrame, gap_seconds: float, bucket_seconds: int = 86400,
                   user_col: str = "user", order_col: str = "event_id") -> DataFrame:
    """Adds ``session_start`` (timestamp of the first event of the session).
    Times are compared in integer microseconds, so the gap edge is exact."""
    gap_seconds = int(round(gap_seconds * 1_000_000))
    ev = events.withColumn("_t", _micros(F.col("ts"))).withColumn(
        "_b", F.floor(F.col("_t") / F.lit(bucket_seconds * 1_000_000)))
    wb = Window.partitionBy(user_col, "_b").orderBy("_t", order_col)
    ev = ev.withColumn("_prev", F.lag("_t").over(wb))
    local_start = F.col("_prev").isNotNull() & (F.col("_t") - F.col("_prev") > gap_seconds)
    summ = ev.groupBy(user_col, "_b").agg(
        F.min("_t").alias("_min"), F.max("_t").alias("_max"),
        F.max(F.when(local_start, F.col("_t"))).alias("_last_local"))
    wu = Window.partitionBy(user_col).orderBy("_b")
    prev_max = F.lag("_max").over(wu)
    summ = summ.withColumn("_first_start", prev_max.isNull() | (F.col("_min") - prev_max > gap_seconds))
    summ = summ.withColumn("_last_start", F.coalesce("_last_local", F.when(F.col("_first_start"), F.col("_min"))))
    summ = summ.withColumn("_carry", F.max("_last_start").over(wu.rowsBetween(Window.unboundedPreceding, -1)))
    j = ev.join(summ.select(user_col, "_b", "_first_start", "_carry"), [user_col, "_b"])
    is_start = F.when(F.col("_prev").isNull(), F.col("_first_start")).otherwise(local_start)
    run = F.max(F.when(is_start, F.col("_t"))).over(wb.rowsBetween(Window.unboundedPreceding, 0))
    start = F.coalesce(run, F.col("_carry"))
    return j.withColumn("session_start", F.timestamp_micros(start)).drop(
        "_t", "_b", "_prev", "_first_start", "_carry")


def basket_sessions(inter: DataFrame, gap_seconds: float, min_size: int = 2, action: str | None = None,
                    bucket_seconds: int = 86400) -> DataFrame:
    """(user, session_start, last_time, items sorted, n_items) for sessions
    with at least ``min_size`` distinct items."""
    df = inter if action is None else inter.where(F.col("action") == action)
    s = session_starts(df.select("user", "item", "ts", "event_id"), gap_seconds, bucket_seconds)
    b = s.groupBy("user", "session_start").agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.max("ts").alias("last_time"))
    return b.withColumn("n_items", F.size("items")).where(F.col("n_items") >= min_size)


def basket_items(baskets: DataFrame, id_col: str = "basket_id", items_col: str = "items") -> DataFrame:
    """(basket, item) rows of (id, items array)."""
    return baskets.select(F.col(id_col).alias("basket"), F.explode(items_col).alias("item")).distinct()


def _width_limit(sizes: DataFrame, wide: int, most: int) -> tuple[int, int]:
    """(limit, number over it): the smallest of wide, 2 wide, 4 wide... that at
    most ``most`` baskets exceed."""
    limits = [wide << j for j in range(40)]
    counts = sizes.agg(*[F.count_if(F.col("n") > x) for x in limits]).first()
    return next((x, c) for x, c in zip(limits, counts) if c <= most)


def itemset_count(rows: DataFrame, max_len: int, min_support: float, wide: int = WIDE) -> DataFrame:
    """(itemset sorted array, size, count) for itemsets of 1..max_len items
    found in at least the fraction ``min_support`` of the baskets.
    rows: distinct (basket, item).

    Baskets are projected once per frequent prefix: a group (prefix, rest,
    weight) stands for the ``weight`` baskets that hold the prefix and go on
    with the same rest (items ordered from rare to common), so equal rests are
    counted together.  Baskets of over ``wide`` frequent items are not
    projected, which would be quadratic in them: fewer than half of the least
    count may be held back, so every frequent set is also found among the
    others, and held-back baskets only answer which of those sets they hold.
    When more baskets are wide than may be held back, the limit doubles."""
    rows = cut_lineage(rows.select("basket", "item"))
    least = min_support * rows.select(F.count_distinct("basket")).first()[0]
    items = cut_lineage(rows.groupBy("item").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least))
    out = items.select(F.array("item").alias("itemset"), F.lit(1).alias("size"), "count")
    if max_len < 2:
        return out
    kept = cut_lineage(blocked_join(rows, items, ["item"], "basket"))
    sizes = cut_lineage(kept.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    limit, n_held = _width_limit(sizes, wide, int(max(0.0, least - 1) // 2))
    kept = cut_lineage(blocked_join(kept, sizes, ["basket"], "item"))
    held = kept.where(F.col("n") > limit).select("basket", "item")
    lists = kept.where(F.col("n") <= limit).groupBy("basket").agg(F.array_sort(F.collect_list(F.struct("count", "item"))).alias("s"))
    lists = lists.groupBy(F.transform("s", lambda x: x["item"]).alias("s")).agg(F.count(F.lit(1)).alias("w"))
    lists = lists.select("w", "s", F.posexplode("s").alias("at", "item"))
    groups = _grouped(lists.select(F.array("item").alias("prefix"), _after("s"), "w"))
    inside = held.select("basket", F.array("item").alias("prefix"))
    for size in range(2, max_len + 1):
        more = groups.select("prefix", "w", F.explode("rest").alias("item"))
        more = more.groupBy("prefix", "item").agg(F.sum("w").alias("count")).where(F.col("count") >= least - n_held)
        if n_held:
            more = cut_lineage(more)
            inside = blocked_join(more.select("prefix", "item"), inside, ["prefix"], "item")
            inside = cut_lineage(inside.join(held, ["basket", "item"], "left_semi"))
            extra = inside.groupBy("prefix", "item").agg(F.count(F.lit(1)).alias("extra"))
            more = more.join(extra, ["prefix", "item"], "left").select(
                "prefix", "item", (F.col("count") + F.coalesce("extra", F.lit(0))).alias("count")).where(F.col("count") >= least)
        more = cut_lineage(more)
        longer = F.concat("prefix", F.array("item"))
        out = out.unionByName(more.select(F.array_sort(longer).alias("itemset"), F.lit(size).alias("size"), "count"))
        if size == max_len:
            break
        found = more.select("prefix", "item")
        steps = groups.select("prefix", "w", F.col("rest").alias("s"), F.posexplode("rest").alias("at", "item"))
        steps = blocked_join(steps, found, ["prefix", "item"], "s")
        groups = _grouped(steps.select(longer.alias("prefix"), _after("s"), "w"))
        if n_held:
            inside = inside.join(found, ["prefix", "item"], "left_semi").select("basket", longer.alias("prefix"))
    return out


def _after(s: str) -> Column:
    """The items of the array ``s`` after place ``at``."""
    return F.slice(s, F.col("at") + 2, F.size(s)).alias("rest")


def _grouped(projected: DataFrame) -> DataFrame:
    """Projections with equal prefix and rest become one, of their added weight."""
    return cut_lineage(projected.where(F.size("rest") > 0).groupBy("prefix", "rest").agg(F.sum("w").alias("w")))


def transaction_total(baskets: DataFrame) -> DataFrame:
    return baskets.agg(F.count(F.lit(1)).alias("n_baskets"))


def rule_self_join(counts: DataFrame, total) -> DataFrame:
    """Rules from itemset counts: every itemset S (|S| >= 2) and item i in S
    gives cond = S - {i} -> i; the counts of cond and {i} come from two equi
    joins on the sorted-array key.  ``total`` is a number or a one-value column."""
    big = counts.where(F.col("size") >= 2)
    r = big.select(F.col("itemset"), F.col("count").alias("rule_cnt"), F.explode("itemset").alias("conseq"))
    r = r.withColumn("cond", F.array_sort(F.array_remove("itemset", F.col("conseq"))))
    cond = counts.select(F.col("itemset").alias("cond"), F.col("count").alias("cond_cnt"))
    cons = counts.where(F.col("size") == 1).select(F.col("itemset")[0].alias("conseq"),
                                                   F.col("count").alias("conseq_cnt"))
    j = r.join(cond, "cond").join(cons, "conseq")
    tot = total if isinstance(total, Column) else F.lit(float(total))
    return j.select(
        "cond", "conseq", "rule_cnt", "cond_cnt", "conseq_cnt",
        (F.col("rule_cnt") / tot).alias("support"),
        (F.col("rule_cnt") / F.col("cond_cnt")).alias("confidence"),
        (F.col("rule_cnt").cast("double") * tot / (F.col("cond_cnt").cast("double") * F.col("conseq_cnt")))
        .alias("lift"))


def association_rules(rows: DataFrame, max_len: int, min_support: float, min_conf: float = 0.0,
                      min_lift: float = 0.0, max_rules_per_cond: int = 10) -> DataFrame:
    """(cond sorted array, conseq, support, confidence, lift, rank): rules with
    |cond| <= max_len - 1 over itemsets in at least ``min_support`` of the
    baskets, confidence >= min_conf and lift >= min_lift; best
    ``max_rules_per_cond`` per condition by (confidence desc, conseq asc).
    rows: distinct (basket, item)."""
    counts = cut_lineage(itemset_count(rows, max_len, min_support))     # read three times
    total = rows.select(F.count_distinct("basket").cast("double")).scalar()
    r = rule_self_join(counts, total)
    r = r.where((F.size("cond") <= max_len - 1) & (F.col("confidence") >= min_conf) & (F.col("lift") >= min_lift))
    return rule_topk(r.select("cond", "conseq", "support", "confidence", "lift"), max_rules_per_cond)


def rule_topk(rules: DataFrame, k: int) -> DataFrame:
    order = [F.col("confidence").desc(), F.col("conseq").asc()]
    return topn_per_group(rules, ["cond"], order, k).withColumn("rank", F.col("rank").cast("int"))


def _holding(rows: DataFrame, sets: DataFrame, col: str, max_len: int) -> DataFrame:
    """(basket, every column of ``sets``) where the basket holds all items of
    the array ``col`` (1..max_len items): an equi join on the first item, then
    a semi join on (basket, item) for each further place."""
    j = rows.select("basket", F.col("item").alias("_k")).join(sets.withColumn("_k", F.col(col)[0]), "_k").drop("_k")
    for i in range(1, max_len):
        has = rows.select(F.col("basket").alias("_b"), F.col("item").alias("_i"))
        more = j.where(F.size(col) > i)
        more = more.join(has, (more["basket"] == F.col("_b")) & (F.get(more[col], F.lit(i)) == F.col("_i")), "left_semi")
        j = j.where(F.size(col) <= i).unionByName(more)
    return j


def rule_lookup(rows: DataFrame, rules: DataFrame, n: int, max_cond: int = 2) -> DataFrame:
    """Rules whose condition is inside the query basket and whose consequent is
    not.  Of several rules for one consequent the best single rule counts, by
    (confidence, lift).  Best ``n`` per basket by (confidence desc, lift desc,
    conseq asc).  rows: distinct (basket, item); no basket is held as a list."""
    j = _holding(rows, rules.select("cond", "conseq", "confidence", "lift"), "cond", max_cond)
    j = j.join(rows.select("basket", F.col("item").alias("conseq")), ["basket", "conseq"], "left_anti")
    j = j.groupBy("basket", "conseq").agg(F.max(F.struct("confidence", "lift")).alias("m")).select(
        "basket", "conseq", "m.confidence", "m.lift")
    order = [F.col("confidence").desc(), F.col("lift").desc(), F.col("conseq").asc()]
    return topn_per_group(j, ["basket"], order, n).withColumn("rank", F.col("rank").cast("int"))


def itemset_subsets(rows: DataFrame, itemsets: DataFrame, max_len: int = 3) -> DataFrame:
    """(basket, itemset) for every frequent itemset contained in a basket;
    support pruning bounds the output, no subset is enumerated blindly."""
    return _holding(rows, itemsets.select("itemset"), "itemset", max_len).select("basket", "itemset")
