"""First documents of many filters in one popularity order, read from the top.

Documents lie in one list of all of them and in one list per field value, each
in popularity order and cut into blocks.  A block, and each group of blocks,
holds the smallest and largest value of every date of its documents.  A filter
walks its list in windows that grow with every round: groups whose dates
cannot fit are skipped, then blocks, then the documents of the blocks left are
tested.  A walk ends when it has found enough, so the rows joined grow with
walks x wanted documents (over the share of documents that pass), not with
walks x documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflow.operators.joins import blocked_join
from recoflow.operators.ranking import global_row_number
from recoflow.session import cut_lineage

BLOCK, GROUP, GROWTH = 64, 64, 16   # documents a block, blocks a group, growth of the windows
LIST = ["name", "value"]


@dataclass
class Lists:
    """``docs``: name, value, block and the document's columns; ``blocks`` and
    ``groups``: name, value, number and ``span`` (date name -> lo, hi);
    ``ends``: first and last block of every list."""
    docs: DataFrame
    blocks: DataFrame
    groups: DataFrame
    ends: DataFrame


def _spans(docs: DataFrame, number: Column, name: str) -> DataFrame:
    d = docs.select(*LIST, number.alias(name), F.explode_outer(F.map_entries("dates")).alias("e"))
    d = d.groupBy(*LIST, name, F.col("e.key").alias("date")).agg(F.min("e.value").alias("lo"), F.max("e.value").alias("hi"))
    entry = F.when(F.col("lo").isNotNull(), F.struct("date", F.struct("lo", "hi")))
    return d.groupBy(*LIST, name).agg(F.map_from_entries(F.collect_list(entry)).alias("span"))


def popularity_lists(docs: DataFrame, block: int = BLOCK, group: int = GROUP) -> Lists:
    """Lists of (item, pop_rank, fields, dates).  The list of all documents is
    named by two empty texts; a document is once in each list of its values."""
    values = F.flatten(F.transform(
        F.map_entries(F.coalesce("fields", F.create_map().cast("map<string,array<string>>"))),
        lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("name"), v.alias("value")))))
    everywhere = F.array(F.struct(F.lit("").alias("name"), F.lit("").alias("value")))
    d = docs.select("*", F.explode(F.array_distinct(F.concat(everywhere, values))).alias("k"))
    d = d.select("k.name", "k.value", "item", "pop_rank", "fields", "dates").where(F.col("name").isNotNull() & F.col("value").isNotNull())
    order = [F.col("name").asc(), F.col("value").asc(), F.col("pop_rank").desc_nulls_last(), F.col("item").asc()]
    d = global_row_number(d, order, "rn").withColumn("block", F.expr(f"(rn - 1) div {block}"))
    d = cut_lineage(d)
    ends = cut_lineage(d.groupBy(*LIST).agg(F.min("block").alias("first"), F.max("block").alias("last")))
    blocks = cut_lineage(_spans(d, F.col("block"), "block"))
    groups = cut_lineage(_spans(d, F.expr(f"block div {group}"), "grp"))
    return Lists(d, blocks, groups, ends)


def may_hold(available_name: str, expire_name: str) -> Column:
    """Whether a span can hold a document that passes the date filters of a
    walk (columns q_current_date, q_date_field, q_after, q_before)."""
    def side(name: Column, part: str) -> Column:
        return F.try_element_at(F.col("span"), name)[part]
    now, field = F.col("q_current_date"), F.col("q_date_field")
    fits = [now.isNull() | ((side(F.lit(available_name), "lo") <= now) & (side(F.lit(expire_name), "hi") > now)),
            F.col("q_after").isNull() | (side(field, "hi") > F.col("q_after")),
            F.col("q_before").isNull() | (side(field, "lo") < F.col("q_before"))]
    return F.coalesce(fits[0], F.lit(False)) & F.coalesce(fits[1], F.lit(False)) & F.coalesce(fits[2], F.lit(False))


def first_matches(walks: DataFrame, lists: Lists, passes: Column, fits: Column, keep: list[Column],
                  block: int = BLOCK, group: int = GROUP, growth: int = GROWTH) -> DataFrame:
    """(walk, *keep): for every row of ``walks`` (walk, name, value, need and
    the columns that ``passes`` and ``fits`` read) at least the first ``need``
    documents of its list that pass, or all of them when there are fewer."""
    cur = blocked_join(walks, lists.ends, LIST, "walk").withColumn("lo", F.col("first"))
    wide = F.greatest(F.lit(4), 2 * F.ceil(F.col("need") / block))
    cur = cut_lineage(cur.withColumn("hi", F.col("lo") + wide).withColumn("got", F.lit(0).cast("long")))
    out = None
    while True:
        upto = F.least(F.col("hi"), F.col("last") + 1)      # exclusive
        g = cur.select("*", F.explode(F.sequence(F.expr(f"lo div {group}"), F.expr(f"(least(hi, last + 1) - 1) div {group}"))).alias("grp"))
        g = cut_lineage(blocked_join(g, lists.groups, [*LIST, "grp"], "walk").where(fits).drop("span"))
        low, top = F.greatest(F.col("lo"), F.col("grp") * group), F.least(upto, (F.col("grp") + 1) * group) - 1
        b = g.select("*", F.explode(F.sequence(low, top)).alias("block")).drop("grp")
        b = cut_lineage(blocked_join(b, lists.blocks, [*LIST, "block"], "walk").where(fits).drop("span"))
        hits = blocked_join(b, lists.docs, [*LIST, "block"], "walk").where(passes)
        hits = cut_lineage(hits.select("walk", *LIST, *keep))
        out = hits.drop(*LIST) if out is None else out.unionByName(hits.drop(*LIST))
        new = hits.groupBy("walk", *LIST).agg(F.count(F.lit(1)).alias("new"))
        cur = cur.join(new, ["walk", *LIST], "left").withColumn("got", F.col("got") + F.coalesce("new", F.lit(0))).drop("new")
        cur = cur.where((F.col("got") < F.col("need")) & (F.col("hi") <= F.col("last")))
        cur = cut_lineage(cur.withColumn("next", F.col("hi") + (F.col("hi") - F.col("lo")) * growth)
                          .withColumn("lo", F.col("hi")).withColumn("hi", F.col("next")).drop("next"))
        if not cur.head(1):
            return out
