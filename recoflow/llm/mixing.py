"""Mixing sources to target weights by soft membership, DataFrame functions only.

1. A Bernoulli naive Bayes over document features is counted from labelled
   rows (a bounded sample, ``TRAIN_ROWS``: all rows of a rare domain, a share
   of a frequent one) with SQL aggregates; domains are the label combinations,
   and their priors and presence come from all labelled documents.  It gives every document posteriors p(domain); the evidence
   is divided by ``TEMPERATURE`` because features are not independent.
2. Document rates r >= 0 (expected copies, without an upper bound) make the expected tokens
   of the domains, S = sum_i r_i t_i p_i, meet target totals T: weighted least
   squares (S - T)' M^-1 (S - T) / 2 with M = sum_i t_i p_i p_i' plus a small
   ridge, solved by projected gradient from r = 1.  In the metric that scales a
   document's coordinate by its tokens the gradient is p_i . M^-1 (S - T) and
   its Lipschitz constant is at most 1, so the step is 1:
   r_i <- max(0, r_i - p_i . M^-1 (S - T)).
   It goes on until every domain is within ``GAP`` and raises when ``STEPS`` do
   not get there.  T is outside the cone of the memberships when no rates at
   any budget reach it (a domain that occurs only mixed with others); that is
   proved (``nearest``), the rates so far are kept, a warning is given, and
   the reached and wanted totals in the result differ.
   A domain without labelled documents gets no posterior and no target.
   An iteration is one aggregate over all documents that returns S (as many
   numbers as domains); a rate is a closed expression of the document's own
   posteriors and those few vectors, so nothing per document is collected.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import whole_rows
from recoflow.session import cut_lineage

DOMAINS = ("good", "good_toxic", "junk", "junk_toxic")     # quality 1 or 0, toxic 0 or 1
TARGETS = {"good": 0.80, "good_toxic": 0.07, "junk": 0.11, "junk_toxic": 0.02}
TRAIN_ROWS, BUCKETS, KEPT, TEMPERATURE = 20_000, 1 << 16, 96, 4.0
STEPS, GAP, RIDGE = 600, 1e-6, 1e-6
#: Targets out of reach: the share of the corpus' own mix in what is aimed at
#: instead, how near the descent has to come to it, and in how many steps.
INNER, INNER_GAP, INNER_STEPS = 0.1, 1e-3, 2000
#: Copies of a document that one task makes.
COPIES = 64
#: Steps between two written rates: a rate's expression is that deep at most.
BLOCK = 10
#: Copies are not bounded: the expected tokens are those of the input, however rare a domain is.
MAX_RATE = math.inf


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Domain of a label row; null when a label is missing."""
    name = F.concat(F.when(F.col(quality) > 0, "good").otherwise("junk"), F.when(F.col(toxic) > 0, "_toxic").otherwise(""))
    return F.when(F.col(quality).isNotNull() & F.col(toxic).isNotNull(), name)


def tokens(text: str = "text") -> Column:
    """White-space words of a text; null and empty have none."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def features(words: str = "w") -> Column:
    """Distinct feature numbers of a word list: hashed lower-case words, and
    bins of the word count, the mean word length, the share of distinct words
    and the share of words that end in no letter."""
    w, n = F.col(words), F.greatest(F.size(words), F.lit(1)).cast("double")
    plain = F.array_distinct(F.transform(w, lambda x: F.pmod(F.xxhash64(F.lower(x)), F.lit(BUCKETS))))
    chars = F.length(F.array_join(w, "")) / n
    odd = F.size(F.filter(w, lambda x: ~F.substring(x, -1, 1).rlike(r"[\p{L}.,]"))) / n
    spread = F.size(F.array_distinct(w)) / n
    bins = (F.least(F.floor(F.log2(n)), F.lit(15)), F.least(F.floor(chars), F.lit(15)),
            F.floor(F.least(spread, F.lit(1.0)) * 15), F.floor(F.least(odd, F.lit(1.0)) * 15))
    return F.concat(plain, F.array(*[(F.lit(BUCKETS + 16 * i) + b).cast("long") for i, b in enumerate(bins)]))


class Classifier:
    """Log odds per kept feature (at most KEPT rows of one number per domain)
    on top of ``start``, the log priors plus the evidence of no feature.
    ``present``: the domains with labelled documents; nothing is known of the
    others, so their posterior is 0 (without any label all are equal)."""

    def __init__(self, start: np.ndarray, weights: dict[int, np.ndarray], present: list[bool]):
        self.start, self.weights, self.present = start, weights, present

    def log_scores(self, feats: DataFrame) -> DataFrame:
        """Adds _xl0.. (unnormalised log posteriors) from the feature list _xf."""
        kept = sorted(self.weights)
        cols = [F.col(f"`{c}`") for c in feats.columns if c != "_xf"]
        if not kept:
            return feats.select(*cols, *[F.lit(float(x)).alias(f"_xl{d}") for d, x in enumerate(self.start)])
        place = F.array(*[F.lit(k).cast("long") for k in kept])
        found = F.transform(F.array_intersect("_xf", place), lambda f: F.array_position(place, f).cast("int"))
        at = feats.select(*cols, found.alias("_xi"))
        table = [F.array(*[F.lit(float(self.weights[k][d])) for k in kept]) for d in range(len(DOMAINS))]

        def score(start: float, row: Column) -> Column:
            return F.aggregate("_xi", F.lit(float(start)), lambda a, i: a + F.element_at(row, i))
        return at.select(*cols, *[score(x, table[d]).alias(f"_xl{d}") for d, x in enumerate(self.start)])


def shares(sizes: dict[str, int], most: int) -> dict[str, float]:
    """The share of each domain to draw, so that at most ``most`` rows are drawn
    in all: a domain that needs less than its even part gives the rest on."""
    out: dict[str, float] = {}
    for i, (x, n) in enumerate(sorted(sizes.items(), key=lambda e: (e[1], e[0]))):
        take = min(float(n), most / (len(sizes) - i))
        most -= take
        out[x] = take / n
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          train_rows: int = TRAIN_ROWS) -> Classifier:
    """Fit on at most about ``train_rows`` labelled rows: of each domain all, or
    a share picked by a hash of the id.  A document with several labels counts
    once for each; labels without a document, and missing labels, are left out."""
    lab = labels.select(F.col("doc_id").cast("long").alias("_xid"), domain_of().alias("domain")).where(
        F.col("domain").isNotNull() & F.col("_xid").isNotNull())
    ids = docs.groupBy(F.col(id_col).cast("long").alias("_xid")).agg(F.count(F.lit(1)).alias("_xc"))
    lab = cut_lineage(lab.join(ids, "_xid"))
    full = {r["domain"]: r["n"] for r in lab.groupBy("domain").agg(F.sum("_xc").alias("n")).collect()}
    share = shares(full, train_rows)
    draw = F.pmod(F.xxhash64(F.lit(5), "_xid"), F.lit(1 << 20))
    lab = lab.where(F.coalesce(*[F.when(F.col("domain") == x, draw < int(q * (1 << 20))) for x, q in share.items()],
                               F.lit(False))).select("_xid", "domain")
    # bounded by train_rows, so the broadcast is too
    d = docs.select(F.col(id_col).cast("long").alias("_xid"), F.col(text_col).alias("text")).join(F.broadcast(lab), "_xid")
    one = d.select("domain", tokens().alias("w")).select("domain", features().alias("f"))
    rows = cut_lineage(one)
    per = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array([per.get(x, 0) for x in DOMAINS], dtype=float)
    whole = np.array([full.get(x, 0) for x in DOMAINS], dtype=float)
    priors = np.log((whole + 1) / (whole.sum() + len(DOMAINS)))
    seen = rows.select("domain", F.explode("f").alias("f"))
    total = max(whole.sum(), 1.0)
    grown = np.divide(whole, sizes, out=np.zeros_like(whole), where=sizes > 0)     # labelled rows per drawn row
    counts = seen.groupBy("f").agg(*[F.sum(F.when(F.col("domain") == x, 1).otherwise(0)).alias(x) for x in DOMAINS])
    # spread of the smoothed rates over domains, weighted by how often the feature occurs in each
    rate = {x: (F.col(x) + 0.5) / (s + 1.0) for x, s in zip(DOMAINS, sizes)}
    mean = (sum((F.col(x) * float(g) for x, g in zip(DOMAINS, grown)), F.lit(0.0)) + 0.5) / (total + 1.0)
    gain = sum((F.lit(s / total) * (rate[x] * F.log(rate[x] / mean)
                + (1 - rate[x]) * F.log((1 - rate[x]) / (1 - F.least(mean, F.lit(1 - 1e-9)))))
                for x, s in zip(DOMAINS, whole)), F.lit(0.0))
    best = counts.withColumn("gain", gain).orderBy(F.desc("gain"), "f").limit(KEPT).collect()
    weights = {}
    for r in best:
        p = (np.array([r[x] for x in DOMAINS]) + 0.5) / (sizes + 1.0)
        weights[r["f"]] = (np.log(p) - np.log1p(-p)) / TEMPERATURE
        priors = priors + np.log1p(-p) / TEMPERATURE
    return Classifier(priors, weights, [bool(n) for n in whole])


def memberships(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` plus _xt (tokens) and _xp0.. (posteriors)."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    d = docs.withColumn("_xw", tokens(text_col))
    d = d.select(*names, F.size("_xw").cast("double").alias("_xt"), features("_xw").alias("_xf"))
    d = model.log_scores(d)
    use = [i for i, known in enumerate(model.present) if known] or list(range(len(DOMAINS)))

    def posterior(i: int) -> Column:
        if i not in use:
            return F.lit(0.0)
        return F.lit(1.0) / sum((F.exp(F.col(f"_xl{j}") - F.col(f"_xl{i}")) for j in use), F.lit(0.0))
    return d.select(*names, "_xt", *[posterior(i).alias(f"_xp{i}") for i in range(len(DOMAINS))])


def _rate(start: Column, steps: list[np.ndarray]) -> Column:
    """The rate after the given gradient vectors, from the posterior columns."""
    r = start
    for g in steps:
        r = r - sum((F.col(f"_xp{i}") * float(x) for i, x in enumerate(g[1:], 1)), F.col("_xp0") * float(g[0]))
        r = F.greatest(r, F.lit(0.0))
    return r


def nearest(members: DataFrame, want: np.ndarray, metric: np.ndarray, gap: float) -> np.ndarray:
    """The totals nearest to ``want`` (in ``metric``) that any rates >= 0 reach:
    non-negative least squares over the documents' posteriors.  Each round adds
    the document along which the totals improve most, found by one aggregate;
    the few documents in use (at most one per domain) are solved here."""
    n = len(want)
    root = np.linalg.cholesky(metric).T
    p = F.array(*[F.col(f"_xp{i}") for i in range(n)])
    used, r, got = np.zeros((0, n)), np.zeros(0), np.zeros(n)
    for _ in range(20 * n):
        slope = metric @ (want - got)
        along = sum((F.col(f"_xp{i}") * float(x) for i, x in enumerate(slope)), F.lit(0.0))
        best = members.where("_xt > 0").agg(F.max_by(p, along)).first()[0]
        if best is None or np.dot(best, slope) <= gap * np.abs(slope).max():
            break
        used, r = np.vstack([used, best]), np.append(r, 0.0)
        while True:
            full = np.linalg.lstsq(root @ used.T, root @ want, rcond=None)[0]
            if (full > 0).all():
                r = full
                break
            low = full <= 0
            r = r + np.min(r[low] / np.maximum(r[low] - full[low], 1e-300)) * (full - r)
            keep = ~low | (r > 1e-12 * max(r.max(), 1e-300))
            used, r = used[keep], r[keep]
            if not len(r):
                break
        new = used.T @ r if len(r) else np.zeros(n)
        if np.abs(new - got).max() <= 1e-12 * np.abs(want).max():
            break
        got = new
    return got


def _descend(members: DataFrame, aim: np.ndarray, inverse: np.ndarray, total: float) -> tuple[DataFrame, np.ndarray]:
    """``members`` with rates whose totals are within INNER_GAP of ``aim``, and
    those totals: projected descent with momentum from the rates _xr (a step
    goes from _xy, the point ahead of them); raises when INNER_STEPS do not get
    there."""
    n = len(aim)
    p = [F.col(f"_xp{i}") for i in range(n)]
    names = members.columns
    members, pace = members.withColumn("_xy", F.col("_xr")), 1.0
    for step in range(INNER_STEPS):
        got = np.array([float(x) for x in members.agg(*[F.sum(F.col("_xy") * F.col("_xt") * p[i]) for i in range(n)]).first()])
        if np.abs(got - aim).max() <= INNER_GAP * total:
            return members.withColumn("_xr", F.col("_xy")).select(*names), got
        slope = inverse @ (got - aim)
        down = sum((p[i] * float(x) for i, x in enumerate(slope)), F.lit(0.0))
        after = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = F.col("_xn") + (pace - 1) / after * (F.col("_xn") - F.col("_xr"))
        members = members.withColumn("_xn", F.greatest(F.col("_xy") - down, F.lit(0.0)))
        members = members.withColumn("_xy", F.greatest(ahead, F.lit(0.0))).withColumn("_xr", F.col("_xn")).drop("_xn")
        pace = after
        if step % BLOCK == BLOCK - 1:
            members = cut_lineage(members)
    raise RuntimeError(f"token totals {got.round()} of {DOMAINS} are off {aim.round()} after {INNER_STEPS} steps")


def fit_rates(members: DataFrame, targets: dict[str, float], present: list[bool], steps: int = STEPS,
              gap: float = GAP) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``members`` with the rates _xr of the projected descent, the reached and
    the target token totals.  Target totals are all tokens, dealt by the
    weights of the domains that have labelled documents (none: every rate stays
    1).  Stops when every domain is within ``gap`` of all tokens; raises when
    ``steps`` do not get there, except where no rates could (see ``nearest``)."""
    n = len(DOMAINS)
    p = [F.col(f"_xp{i}") for i in range(n)]
    t = F.col("_xt")
    row = members.agg(F.sum(t), *[F.sum(t * p[i] * p[j]) for i in range(n) for j in range(n)],
                      *[F.sum(t * p[i]) for i in range(n)]).first()
    total = float(row[0] or 0.0)
    members = members.withColumn("_xr", F.lit(1.0))
    want = np.array([targets.get(x, 0.0) if known else 0.0 for x, known in zip(DOMAINS, present)])
    if not total or not want.sum():
        now = np.array([float(x or 0.0) for x in row[1 + n * n:]])
        return members, now, now
    want = want / want.sum() * total
    m = np.array([float(x) for x in row[1:1 + n * n]]).reshape(n, n)
    inverse = np.linalg.inv(m + RIDGE * np.trace(m) * np.eye(n))
    done: list[np.ndarray] = []
    for step in range(steps + 1):
        r = _rate(F.col("_xr"), done)
        got = np.array([float(x) for x in members.agg(*[F.sum(r * t * p[i]) for i in range(n)]).first()])
        off = np.abs(got - want).max()
        if off <= gap * total:
            return members.withColumn("_xr", r), got, want
        if step == min(BLOCK, steps):
            can = nearest(members, want, inverse, 1e-9)
            if np.abs(can - want).max() > gap * total:
                own = np.array([float(x) for x in row[1 + n * n:]])
                aim = can + INNER * (own * can.sum() / own.sum() - can)
                members, got = _descend(cut_lineage(members.withColumn("_xr", r)), aim, inverse, total)
                warnings.warn(f"no rates reach the target totals {want.round()} of {DOMAINS}; the nearest are {can.round()}, "
                              f"reached {got.round()}", stacklevel=2)
                return members, got, want
        if len(done) == BLOCK:
            members, done = cut_lineage(members.withColumn("_xr", r)), []
        done.append(inverse @ (got - want))
    raise RuntimeError(f"token totals {got.round()} of {DOMAINS} are off {want.round()} by up to {off:.0f} after {steps} steps")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate, copies, wanted_<domain>...,
    reached_<domain>...) per row of ``docs``; the last are the target and the
    expected token totals of the whole table, the same in every row.

    ``copies`` rounds the rate by a hash of id and text, so its expectation is
    the rate.  Null and empty texts have no tokens and keep their rate by
    their posteriors; repeated rows get equal rates; null ids are rounded like
    any other; without labels the posteriors are equal and every rate is 1; an
    empty table gives no rows."""
    out, got, want = _prepared(docs, labels, targets, id_col, text_col)
    return out.select("doc_id", F.col("_xt").cast("long").alias("n_tokens"),
                      *[F.round(f"_xp{i}", 9).alias(f"p_{x}") for i, x in enumerate(DOMAINS)],
                      F.round("_xr", 9).alias("rate"), _copies(F.col("_xr"), F.col("_xk")).alias("copies"),
                      *[F.lit(round(float(x), 3)).alias(f"wanted_{d}") for d, x in zip(DOMAINS, want)],
                      *[F.lit(round(float(x), 3)).alias(f"reached_{d}") for d, x in zip(DOMAINS, got)])


def _copies(rate: Column, key: Column) -> Column:
    draw = F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def _prepared(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, id_col: str,
              text_col: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    model = train(docs, labels, id_col, text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    narrow = memberships(narrow, model).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("_xk"), "_xt", *[f"_xp{i}" for i in range(len(DOMAINS))])
    return fit_rates(cut_lineage(narrow), targets or TARGETS, model.present)


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with each row repeated ``copies`` times (none: dropped); columns
    stay as they are."""
    members, _, _ = _prepared(docs, labels, targets, id_col, text_col)
    # equal rows have equal copies, so one row per key answers for all of them
    n = members.select("_xk", _copies(F.col("_xr"), F.col("_xk")).alias("_xn")).where("_xn > 0").dropDuplicates(["_xk"])
    n = n.select(F.col("_xk").alias("_xkey"), "_xn")
    d = whole_rows(docs).withColumn("k", F.xxhash64(F.col(f"row.{id_col}").cast("long"), F.col(f"row.{text_col}")))
    n = cut_lineage(n)
    j = d.join(n, F.col("k") == F.col("_xkey"))
    each = F.explode(F.array_repeat(F.lit(0), F.col("_xn"))).alias("c")
    few = j.where(F.col("_xn") <= COPIES).select("row", each).select("row.*")
    if not n.where(F.col("_xn") > COPIES).head(1):
        return few
    # many copies: blocks of them are dealt out before each makes its own
    blocks = F.sequence(F.lit(0), F.ceil(F.col("_xn") / COPIES).cast("int") - 1)
    j = j.where(F.col("_xn") > COPIES).select("row", "k", "_xn", F.explode(blocks).alias("b"))
    j = j.withColumn("_xn", F.least(F.lit(COPIES), F.col("_xn") - F.col("b") * COPIES))
    j = j.repartition("k", "b")
    return few.unionByName(j.select("row", each).select("row.*"))
