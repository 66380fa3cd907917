"""Folds, leave-last-out splits, negative sampling, behaviour sequences.

Random choices are md5 rankings of 'seed|...' text, the same in every engine,
so sampled output can be compared exactly and reruns are identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflow.functions.scalar import md5_rank_key
from recoflow.operators.joins import blocked_join
from recoflow.operators.ranking import global_row_number, global_running_sum
from recoflow.session import cut_lineage

PRIME = 7919


def hash32(*cols) -> Column:
    """First 32 bits of md5('c1|c2|...') as a non-negative long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                                       for c in cols])), 1, 8), 16, 10).cast("bigint")


def kfold_split(df: DataFrame, id_col: str, k: int) -> DataFrame:
    """fold = (id * prime) mod k, on a stable id (never a global row number)."""
    return df.withColumn("fold", F.pmod(F.col(id_col) * PRIME, F.lit(k)).cast("int"))


def stratified_kfold(df: DataFrame, label: str, id_col: str, k: int, seed: int) -> DataFrame:
    """Equal class mix per fold: rows ordered by (label, md5(seed|id), id) are
    dealt round-robin to the k folds, so every label's run is split evenly.
    The order is one two-level global rank (range partitions + offsets), so
    no window holds a whole class in one task."""
    order = [F.col(label).asc(), md5_rank_key(seed, id_col).asc(), F.col(id_col).asc()]
    r = global_row_number(df, order, "_rn")
    return r.withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_rn")


def random_split(df: DataFrame, weights, seed: int, id_col: str) -> list[DataFrame]:
    """Parts with about the given shares, by a hash of the stable id: the same
    rows land in the same part whatever the partitioning."""
    total = float(sum(weights))
    draw = hash32(F.lit(str(seed)), id_col) / float(1 << 32)
    parts, low = [], 0.0
    for i, w in enumerate(weights):
        high = low + w / total
        inside = draw >= low if i + 1 == len(weights) else (draw >= low) & (draw < high)
        parts.append(df.where(inside))
        low = high
    return parts


def leave_last_out(inter: DataFrame) -> DataFrame:
    """split = 'test' for each user's last event by (ts, event_id), else
    'train'; users with a single event stay in train.  The last event is
    found with a partial max per user (hot users stay split across tasks)
    and marked through a semi join on its event id."""
    last = inter.groupBy("user").agg(F.max(F.struct("ts", "event_id")).alias("m"), F.count(F.lit(1)).alias("n"))
    last = last.where(F.col("n") > 1).select(F.col("m.event_id").alias("event_id"), F.lit(True).alias("_last"))
    return inter.join(last, "event_id", "left").withColumn(
        "split", F.when(F.col("_last"), "test").otherwise("train")).drop("_last")


def negatives(positives: DataFrame, seen: DataFrame, items: DataFrame, n: int, seed: int,
              pid: str = "event_id") -> DataFrame:
    """For every positive row (pid, user, item): ``n`` different catalog items
    the user has not seen (all of them when there are fewer).

    The catalog is ordered by md5(seed|item).  With U unseen items of a user,
    draw j is a hash of (seed, pid, j) inside the j-th of n equal
    slices of 0..U-1, so draws of one row, and of different rows, are not tied
    to each other.  The r-th unseen place is found by gap arithmetic: it is
    r + k, where k counts the user's seen places s_0 < s_1 < ... with
    s_i - i <= r.  That count is one global running sum over seen places and
    draws in (user, place) order, so no user's rows meet in one task.
    Output (pid, user, item, neg_item, j)."""
    cat = items.select("item").distinct()
    ranked = cut_lineage(global_row_number(cat.withColumn("_key", md5_rank_key(seed, "item")),
                                           [F.col("_key"), F.col("item")], "_pos")
                         .select((F.col("_pos") - 1).alias("_p"), F.col("item").alias("neg_item")))
    size = ranked.count()
    places = cut_lineage(seen.select("user", F.col("item").alias("neg_item")).distinct().join(ranked, "neg_item")
                         .select("user", "_p"))
    per_user = places.groupBy("user").agg(F.count(F.lit(1)).alias("_ns"))
    per_user = cut_lineage(global_running_sum(per_user, [F.col("user").asc()], "_ns", "_base", inclusive=False))
    draws = positives.select(pid, "user", "item").join(per_user, "user", "left")
    unseen = F.lit(size) - F.coalesce("_ns", F.lit(0))
    draws = draws.select("*", unseen.alias("_u"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("j"))
    draws = draws.withColumn("_lo", F.expr(f"j * _u div {n}")).withColumn("_hi", F.expr(f"(j + 1) * _u div {n}"))
    draws = draws.where(F.col("_hi") > F.col("_lo")).withColumn(
        "_r", F.col("_lo") + F.pmod(hash32(F.lit(str(seed)), pid, "j"), F.col("_hi") - F.col("_lo")))
    # a seen place's number within its user: its global number minus those of the users before
    numbered = global_row_number(places, [F.col("user").asc(), F.col("_p").asc()], "_g")
    numbered = blocked_join(numbered, per_user.select("user", F.col("_base").alias("_b0")), ["user"], "_p")
    gaps = numbered.select("user", (F.col("_p") - (F.col("_g") - F.col("_b0")) + 1).alias("_r"), F.lit(1).alias("_seen"))
    line = gaps.unionByName(draws.select("user", "_r", F.lit(0).alias("_seen"), pid, "item", "j", "_base"),
                            allowMissingColumns=True)
    order = [F.col("user").asc(), F.col("_r").asc(), F.col("_seen").desc(), F.col(pid).asc(), F.col("j").asc()]
    line = global_running_sum(line, order, "_seen", "_run").where("_seen = 0")
    return (line.withColumn("_p", F.col("_r") + F.when(F.col("_base").isNull(), 0).otherwise(F.col("_run") - F.col("_base")))
            .join(ranked, "_p").select(pid, "user", "item", "neg_item", "j"))


def event_positions(inter: DataFrame) -> DataFrame:
    """(user, item, ts, event_id, pos): 1-based place of each event in its
    user's (ts, event_id) order, from one global rank minus the user's first
    rank, so a user with a third of all rows is spread over many tasks."""
    g = global_row_number(inter.select("user", "item", "ts", "event_id"),
                          [F.col("user"), F.col("ts"), F.col("event_id")], "_g")
    first = g.groupBy("user").agg(F.min("_g").alias("_g0"))
    return g.join(first, "user").select("user", "item", "ts", "event_id",
                                        (F.col("_g") - F.col("_g0") + 1).cast("int").alias("pos"))


CHUNK = 128     # events of one user in a history chunk


def history_prefix(inter: DataFrame, cap: int | None = None) -> DataFrame:
    """(user, pos, item, ts, event_id, history): items of the user's earlier
    events in (ts, event_id) order; ``cap`` keeps only the newest ``cap``.

    A user's items are kept once, in chunks of CHUNK; an event takes the chunks
    that its history touches and cuts them to size.  Hot users' events are
    dealt to blocks.  (The whole prefix is quadratic in a user's event count
    by definition; pass ``cap`` where a bounded history is enough.)"""
    ev = cut_lineage(event_positions(inter))
    chunk = F.expr(f"(pos - 1) div {CHUNK}")
    chunks = ev.groupBy("user", chunk.alias("_c")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda t: t["item"]).alias("_items"))
    at = ev.select("*", chunk.alias("_last"), (F.lit(0) if cap is None else F.greatest(
        F.expr(f"(pos - 1 - {int(cap)}) div {CHUNK}"), F.lit(0))).alias("_first"))
    j = blocked_join(at, chunks, ["user"], "event_id").where((F.col("_c") <= F.col("_last")) & (F.col("_c") >= F.col("_first")))
    h = j.groupBy("user", "item", "ts", "event_id", "pos", "_first").agg(
        F.array_sort(F.collect_list(F.struct("_c", "_items"))).alias("_h"))
    flat = F.flatten(F.transform("_h", lambda t: t["_items"]))
    known = F.col("pos") - 1 - F.col("_first") * CHUNK       # earlier events inside the taken chunks
    keep = known if cap is None else F.least(known, F.lit(int(cap)))
    return h.select("user", "item", "ts", "event_id", "pos",
                    F.slice(flat, (known - keep + 1).cast("int"), keep.cast("int")).alias("history"))


def sequence_samples(inter: DataFrame, items: DataFrame, seed: int, cap: int | None = None,
                     history: bool = True) -> DataFrame:
    """Behaviour sequences: for every event after the user's first, a positive
    row (label 1) and a negative row (label 0, one unseen item) with the same
    history; the user's last event is the test pair, the others train.
    ``history=False`` leaves the history out (null)."""
    if history:
        h = history_prefix(inter, cap)
    else:
        kind = f"array<{inter.schema['item'].dataType.simpleString()}>"
        h = event_positions(inter).withColumn("history", F.lit(None).cast(kind))
    h = cut_lineage(h.where(F.col("pos") > 1))
    # the user's last event, marked through its unique event id (no join on a
    # possibly hot user key)
    last = inter.groupBy("user").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    h = h.join(last.select("event_id", F.lit(True).alias("_last")), "event_id", "left").withColumn(
        "split", F.when(F.col("_last"), "test").otherwise("train")).drop("_last")
    neg = negatives(h.select("event_id", "user", "item"), inter.select("user", "item"), items, 1, seed)
    pos_rows = h.select("user", "event_id", "pos", "history", "item", F.lit(1).alias("label"), "split")
    neg_rows = h.join(neg.select("event_id", "neg_item"), "event_id").select(
        "user", "event_id", "pos", "history", F.col("neg_item").alias("item"), F.lit(0).alias("label"), "split")
    return pos_rows.unionByName(neg_rows)


def pad_histories(df: DataFrame, length: int | None = None, col: str = "history", pad=0) -> DataFrame:
    """Right-pad to ``length`` (default: the longest list, so nothing is cut; a
    shorter length keeps the newest items), with the true length."""
    size = F.lit(length) if length is not None else df.select(F.max(F.size(col))).scalar()
    h = F.slice(F.col(col), F.greatest(F.size(col) - size + 1, F.lit(1)), size)
    return df.withColumn("hist_len", F.size(h)).withColumn(
        col, F.concat(h, F.array_repeat(F.lit(pad).cast(df.schema[col].dataType.elementType),
                                        (size - F.size(h)).cast("int"))))


def pad_batches(df: DataFrame, batch: int, order: list, col: str = "history", pad=0) -> DataFrame:
    """Right-pad every list to the longest of its batch: batches of ``batch``
    consecutive rows of ``order`` (which ends in a unique key), numbered from 0
    in the column ``batch``.  Ordered by length, lists are hardly padded."""
    n = F.size(col)
    d = global_row_number(df, order, "_rn").withColumn("batch", F.expr(f"(_rn - 1) div {int(batch)}")).drop("_rn")
    longest = d.groupBy("batch").agg(F.max(n).alias("_n"))
    kind = df.schema[col].dataType.elementType
    return d.join(longest, "batch").withColumn("hist_len", n).withColumn(
        col, F.concat(F.col(col), F.array_repeat(F.lit(pad).cast(kind), (F.col("_n") - n).cast("int")))).drop("_n")
