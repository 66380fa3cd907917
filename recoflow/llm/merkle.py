"""Merkle manifest of a dataset: one tree per language, a top tree over them,
and inclusion proofs by a recursive query.

Leaves are SHA-256 digests of whole rows.  A tree's leaves ascend by id; every
``arity`` consecutive nodes (the last run may have fewer) become their digest
until one is left, the tree's subroot.  The subroots, ordered by language, make
the top tree in the same way and end in the root.

The built levels are stored as node rows, one a run: its key (tree, level,
run), the digests of its members packed end to end, and the key and slot of
its parent.  A recursive query climbs from each leaf: it joins a leaf with its
run, appends the other members to the proof, folds the digest, and goes on
with the parent.  Every leaf passes the top runs, so these would be hot join
keys: a run that covers over 1/HOT_RUNS of all leaves (at most HOT_RUNS of
them a level, whatever the input) belongs to a second climb whose node rows
are broadcast; the first climb stops below it, so a key of its shuffles holds
at most 1/HOT_RUNS of the rows.  What the second climb broadcasts is bounded
too: HOT_RUNS times the levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.llm.common import skew_lookup
from recoflow.operators.ranking import global_row_number
from recoflow.session import cut_lineage

ARITY, HOT_RUNS = 8, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1        # tree number of the top tree
KEY = ("tree", "level", "run")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def row_digest(values: list[Column]) -> Column:
    """SHA-256 (binary) of the values, each ``-`` if null, else its UTF-8 byte
    count, a colon and the value."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _digest_of(packed: Column) -> Column:
    """Digest of packed digests, taken as hex text."""
    return F.unhex(F.sha2(_hex(packed), 256))


@dataclass
class Manifest:
    """``leaves``: doc_id, leaf, changed (digest of the altered row, or null),
    tree and the run and slot it starts from; ``nodes``: parent-linked node
    rows with the number of leaves they cover; ``subroots``: tree, n, subroot."""
    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: bytes | None
    n_leaves: int


def _levels(nodes: DataFrame, most: int, arity: int) -> Iterator[DataFrame]:
    """Levels of run rows, lowest first, from (tree, idx, digest, weight, n); n
    is the number of nodes of the tree on that level, ``most`` its maximum."""
    level = 0
    while most > 1:
        member = F.struct((F.col("idx") % arity).alias("slot"), F.hex("digest").alias("digest"))
        runs = nodes.where("n > 1").groupBy("tree", F.expr(f"idx div {arity}").alias("run")).agg(
            F.sort_array(F.collect_list(member)).alias("m"), F.sum("weight").alias("weight"), F.first("n").alias("n"))
        packed = F.unhex(F.array_join(F.transform("m", lambda x: x["digest"]), ""))
        runs = runs.select("tree", F.lit(level).cast("long").alias("level"), "run", packed.alias("digests"), "weight",
                           F.ceil(F.col("n") / arity).cast("long").alias("n"))
        runs = cut_lineage(runs.withColumn("digest", _digest_of(F.col("digests"))))
        yield runs
        nodes = runs.select("tree", F.col("run").alias("idx"), "digest", "weight", "n")
        most, level = -(-most // arity), level + 1


def _linked(runs: DataFrame, trees: int, arity: int) -> DataFrame:
    """Adds the key and slot of a run's parent; the root's parent is null."""
    inside = F.col("n") > 1
    to_top = (F.col("tree") != TOP) & F.lit(trees > 1)

    def pick(a: Column, b: Column) -> Column:
        return F.when(inside, a).when(to_top, b).cast("long")
    up, tree = F.expr(f"run div {arity}"), F.expr(f"tree div {arity}")
    return runs.select(
        *KEY, "digests", "weight", pick(F.col("tree"), F.lit(TOP)).alias("p_tree"),
        pick(F.col("level") + 1, F.lit(0)).alias("p_level"), pick(up, tree).alias("p_run"),
        pick(F.col("run") % arity, F.col("tree") % arity).alias("p_slot"))


def build(digests: DataFrame, arity: int = ARITY) -> Manifest:
    """Manifest of (doc_id, lang, leaf, changed) rows.

    A null language is a tree of its own and comes first; null ids come first
    in their tree; rows that share an id are ordered by digest, and equal rows
    are leaves of their own.  An empty table has no nodes and no root."""
    tag = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    d = digests.select(tag.alias("tag"), F.col("doc_id").cast("long").alias("doc_id"), "leaf", "changed")
    d = cut_lineage(d)
    order = [F.col("tag").asc(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    ranked = global_row_number(d, order, "pos")
    tags = cut_lineage(ranked.groupBy("tag").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")))
    trees = cut_lineage(global_row_number(tags, [F.col("tag").asc()], "place")
                        .select("tag", "first", "n", (F.col("place") - 1).alias("tree")))
    many, most, total = trees.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    placed = skew_lookup(ranked, trees, "tag", "n", ["first", "n", "tree"], "leaf")
    placed = cut_lineage(placed.select("doc_id", "leaf", "changed", "tree", (F.col("pos") - F.col("first")).alias("idx"), "n"))

    nodes = placed.select("tree", "idx", F.col("leaf").alias("digest"), F.lit(1).cast("long").alias("weight"), "n")
    levels = list(_levels(nodes, most or 0, arity))
    done = nodes.where("n = 1")
    for runs in levels:
        done = done.unionByName(runs.where("n = 1").select("tree", F.lit(0).cast("long").alias("idx"), "digest", "weight", "n"))
    subroots = cut_lineage(done.select("tree", F.col("weight").alias("n"), F.col("digest").alias("subroot")))
    top = list(_levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"),
                                       F.col("subroot").alias("digest"), F.col("n").alias("weight"),
                                       F.lit(many).cast("long").alias("n")), many, arity))
    last = top[-1].select("digest").first() if top else subroots.select("subroot").first()

    alone, to_top = F.col("n") == 1, F.lit(many > 1)
    tree = F.expr(f"tree div {arity}")

    def start(inside: Column, above: Column) -> Column:
        return F.when(~alone, inside).when(to_top, above).cast("long")
    leaves = placed.select(
        "doc_id", "leaf", "changed", F.col("tree").alias("own"), start(F.col("tree"), F.lit(TOP)).alias("tree"),
        start(F.lit(0), F.lit(0)).alias("level"), start(F.expr(f"idx div {arity}"), tree).alias("run"),
        start(F.col("idx") % arity, F.col("tree") % arity).alias("slot"))
    linked = [_linked(r, many, arity) for r in levels + top]
    empty = placed.limit(0).select(*[F.lit(None).cast("long").alias(c) for c in KEY], F.lit(None).cast("binary").alias("digests"),
                                   *[F.lit(None).cast("long").alias(c) for c in ("weight", "p_tree", "p_level", "p_run", "p_slot")])
    stored = reduce(DataFrame.unionByName, linked) if linked else empty
    return Manifest(leaves, cut_lineage(stored), subroots, bytes(last[0]) if last else None, total or 0)


@contextmanager
def _unlimited_rows(spark: SparkSession) -> Iterator[None]:
    """A climb returns a row per leaf and level: lift the default row limit of
    recursive queries while it runs."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_CLIMB = """
WITH RECURSIVE climb(id, tree, level, run, slot, folded, proof) AS (
  SELECT id, tree, level, run, slot, folded, proof FROM {start}
  UNION ALL
  SELECT c.id, n.p_tree, n.p_level, n.p_run, n.p_slot,
    unhex(sha2(lower(hex(concat(substring(n.digests, 1, 32 * c.slot), c.folded,
      substring(n.digests, 32 * c.slot + 33)))), 256)),
    {proof}
  FROM (SELECT * FROM climb LEFT ANTI JOIN {stop} s ON climb.tree = s.tree AND climb.level = s.level AND climb.run = s.run) c
  JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.run = n.run)
SELECT * FROM climb"""
_SIBLINGS = "substring({n}digests, 1, 32 * {c}slot), substring({n}digests, 32 * {c}slot + 33)"


def _climb(start: DataFrame, nodes: DataFrame, stop: DataFrame, append: bool = True) -> DataFrame:
    """Rows of every step from ``start`` (id, KEY, slot, folded, proof) through
    ``nodes``; a row whose run is in ``stop`` goes no further.  ``append``: the
    proof takes the siblings of each step, else it stays as it is."""
    frames = {"start": start, "nodes": nodes, "stop": stop}
    views = {k: f"merkle_{k}_{uuid4().hex}" for k in frames}
    for k, df in frames.items():
        df.createOrReplaceTempView(views[k])
    proof = f"concat(c.proof, {_SIBLINGS.format(n='n.', c='c.')})" if append else "c.proof"
    try:
        return start.sparkSession.sql(_CLIMB.format(proof=proof, **views))
    finally:
        for v in views.values():
            start.sparkSession.catalog.dropTempView(v)


def climb(manifest: Manifest, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, leaf, own, folded, proof) per leaf: the root folded from the
    changed leaf (or the leaf itself) and the digest of the siblings met on the
    way up, left to right and level by level.

    Every step of a recursive query shuffles its rows, so long rows are kept
    out of the many upper steps: below the hot runs a leaf carries its siblings
    along; those above are the same for all leaves of a hot run, so one climb
    per hot run collects them, the proof is digested, and the leaves climb on
    with digests alone."""
    nodes = manifest.nodes
    is_hot = F.col("weight") * hot_runs > manifest.n_leaves
    links = ["p_tree", "p_level", "p_run", "p_slot"]
    hot, cold = (cut_lineage(nodes.where(c).select(*KEY, "digests", *links)) for c in (is_hot, ~is_hot))
    tops, nothing = F.broadcast(hot.select(*KEY)), hot.limit(0).select(*KEY)
    none = F.unhex(F.lit(""))
    # hot runs that leaves enter: on a lowest level, or above a cold run
    below = cold.select(*[F.col(p).alias(k) for k, p in zip(KEY, links)])
    entered = hot.where("level = 0").unionByName(hot.join(below, list(KEY), "left_semi")).distinct()
    shared = entered.select(F.struct(*KEY).alias("id"), *[F.col(p).alias(k) for k, p in zip([*KEY, "slot"], links)],
                            none.alias("folded"), none.alias("proof"))
    start = manifest.leaves.select(F.struct("doc_id", "leaf", "own").alias("id"), *KEY, "slot",
                                   F.coalesce("changed", "leaf").alias("folded"), none.alias("proof"))
    with _unlimited_rows(nodes.sparkSession):
        above = cut_lineage(_climb(shared, F.broadcast(hot), nothing).where(F.col("run").isNull()).select("id.*", F.col("proof").alias("above"))
                            .join(entered.select(*KEY, "digests"), list(KEY)))
        low = _climb(start, cold, tops).join(F.broadcast(above), list(KEY), "left")
        whole = F.concat("proof", F.expr(f"coalesce(concat({_SIBLINGS.format(n='', c='')}, above), X'')"))
        low = low.where(F.col("above").isNotNull() | F.col("run").isNull())
        low = cut_lineage(low.select("id", *KEY, "slot", "folded", _digest_of(whole).alias("proof")))
        done = _climb(low, F.broadcast(hot), nothing, append=False).where(F.col("run").isNull())
        return cut_lineage(done.select("id.*", "folded", "proof"))


def tampered_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, changed) of ``documents``.  ``changed`` is the digest
    after the text's A-Z are lowered, for the ids whose decimal text has an
    unsigned CRC-32 that 3 divides; null for all other rows and null ids."""
    own = [F.col(c) for c in FIELDS]
    lowered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select("doc_id", "lang", row_digest(own).alias("leaf"), F.when(hit, row_digest(lowered)).alias("changed"))


def tamper_report(docs: DataFrame, arity: int = ARITY, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Digests, proofs and the check of the altered row, per row of ``docs``.

    Nulls are digested as ``-``; empty texts as ``0:``; a null id is never
    altered; repeated rows are separate leaves with their own proofs; a single
    row is its own root with an empty proof; an empty table gives an empty
    result.  Columns beyond ``FIELDS`` are not read."""
    manifest = build(tampered_leaves(docs.select(*FIELDS)), arity)
    got = skew_lookup(climb(manifest, hot_runs), manifest.subroots.withColumnRenamed("tree", "own"), "own", "n",
                      ["subroot"], "leaf")
    root = F.lit((manifest.root or b"").hex())
    return got.select("doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
                      root.alias("root"), _hex(F.col("proof")).alias("proof_sha256"),
                      _hex(F.col("folded")).alias("folded_root"), (_hex(F.col("folded")) == root).alias("verified"))
