"""Secret scans with false-positive removal, DataFrame functions and Spark ML only.

Candidates are runs of ``MIN_LENGTH`` or more key characters in any word of a
whole text, and shorter runs where a key name and a sign precede them
(``NAME``), with the words beside them.  A random forest on the candidate's
length, character transitions, dictionary coverage, path and neighbouring
words, trained from labelled findings, decides which candidates are secrets.

The dictionary is the ``DICTIONARY`` most frequent letter words (four letters
or more) counted over all texts; coverage is the share of a candidate's
characters inside such words.  The path is the ``source`` column.

Labelled findings are a table (doc_id, place, secret).  Where none is given
they are derived: a candidate that is the quoted right side of an assignment,
or a long one that a key name and a sign precede, is a secret; one with neither
a quote nor a sign before it is not; others (unquoted assignments, URL
credentials, short unquoted runs) stay unlabelled.  The quote and the sign are
no features: a neighbour is the nearest word with letters.  At most about ``TRAIN_ROWS`` findings a
class train the forest (a hash of id and place picks them).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import row_key
from recoflow.session import cut_lineage

MIN_LENGTH, DICTIONARY, TRAIN_ROWS, TREES, DEPTH, SEED = 16, 400, 10_000, 30, 6, 42
SPACES = r"[\x20\x09-\x0D]+"
RUN = "[A-Za-z0-9+/_-]{%d,}"
#: The end of a key name, to be followed by a sign.
NAME = r"(?i)(?:token|key|secret|passw(?:or)?d|passphrase|pwd|credentials?)[A-Za-z0-9_.-]*[\"'`]?"
SIGN = r"[=:]+[>]?"
FEATURES = ("length", "transitions", "distinct", "digits", "upper", "hexadecimal", "coverage", "path",
            "before", "before2", "after", "before_length")


def text_words(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), SPACES)


def named(i: Column, words: str = "w") -> Column:
    """Whether a key name and a sign precede a run in word i: both in the word,
    both in the one before, or as the two before."""
    at = lambda k: F.coalesce(F.get(words, k), F.lit(""))
    return (at(i).rlike(f"{NAME}{SIGN}[\"'`]?[A-Za-z0-9+/_-]") | at(i - 1).rlike(f"{NAME}{SIGN}$")
            | (at(i - 1).rlike(f"^{SIGN}$") & at(i - 2).rlike(f"{NAME}$")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, rk, path, place, value, word, before2, before, after): a row per
    candidate; place is the word's number in the text and n the run's number in
    its word (long runs first); named says that a key name and a sign precede.
    A missing path column counts as null."""
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    run = RUN % MIN_LENGTH
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(text_col).alias("rk"), path.alias("path"),
                    text_words(text_col).alias("w"),
                    F.coalesce(F.col(text_col).rlike(f"{NAME}[\\x20\\x09-\\x0D]*[=:]"), F.lit(False)).alias("names"))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1),
                      lambda i: ((F.length(F.get("w", i)) >= MIN_LENGTH) & F.get("w", i).rlike(run)) | (F.col("names") & named(i)))
    word = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    found = F.transform(places, lambda i: F.struct(
        i.alias("place"), word(i).alias("word"), word(i - 2).alias("before2"), word(i - 1).alias("before"),
        word(i + 1).alias("after"), (F.col("names") & named(i)).alias("named")))
    one = d.select("doc_id", "rk", "path", F.inline(found))
    right = F.regexp_replace("word", f"^.*?{NAME}{SIGN}", "")
    short = F.filter(F.regexp_extract_all(right, F.lit(RUN % 1), F.lit(0)), lambda v: F.length(v) < MIN_LENGTH)
    values = F.concat(F.regexp_extract_all("word", F.lit(run), F.lit(0)),
                      F.when(F.col("named"), short).otherwise(F.array().cast("array<string>")))
    return one.select("*", F.posexplode(values).alias("n", "value"))


def frequent_words(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of four letters or more, over all texts (ties by
    the word)."""
    words = docs.select(F.explode(F.filter(text_words(text_col), lambda w: w.rlike(r"^\p{L}{4,15}$"))).alias("w"))
    top = words.groupBy(F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(size)
    return [r["w"] for r in top.collect()]      # at most ``size`` words


def with_features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """Adds the columns FEATURES (all numbers) to candidates."""
    v, n = F.col("value"), F.length("value").cast("double")
    share = lambda kind: F.length(F.regexp_replace(v, f"[^{kind}]", "")) / n
    covered = F.lit(0.0)
    if dictionary:
        longest = "|".join(sorted(dictionary, key=lambda w: (-len(w), w)))
        covered = 1 - F.length(F.regexp_replace(F.lower(v), f"(?:{longest})", "")) / n
    # a neighbour by its letters only, and before it a name in the word itself, so that quotes and signs do not matter
    letters = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}]", ""))
    near = lambda c: F.pmod(F.xxhash64(c), F.lit(64))
    some = lambda c: F.when(c != "", c)
    prefix = letters(F.regexp_extract("word", "^(.*?)[=:]", 1))
    before = F.coalesce(some(prefix), some(letters("before")), letters("before2"))
    cols = {
        "length": n, "transitions": F.size(F.regexp_extract_all(v, F.lit("[0-9]+|[a-z]+|[A-Z]+|[+/_-]+"), F.lit(0))) / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n, "digits": share("0-9"), "upper": share("A-Z"),
        "hexadecimal": share("0-9a-f"), "coverage": covered,
        "path": F.when(F.col("path").isNull(), -1).otherwise(F.pmod(F.xxhash64("path"), F.lit(32))),
        "before": near(before), "before2": near(letters("before2")), "after": near(letters("after")), "before_length": F.length(before)}
    return found.select("*", *[cols[x].cast("double").alias(f"_x{x}") for x in FEATURES])


def derived_findings(found: DataFrame) -> DataFrame:
    """(doc_id, rk, place, n, secret): the rule in the module's docstring."""
    quoted = F.col("word").rlike("[\"'`]")
    assigned = F.col("before").rlike("[=:]>?$") | F.col("word").rlike("^[^\"'`]*[=:]>?[\"'`]")
    sign = F.col("before").rlike("[=:]>?$") | F.col("word").rlike("[=:]")
    long = F.length("value") >= MIN_LENGTH
    label = F.when((quoted & assigned) | (F.col("named") & long), 1.0).when(~quoted & ~sign & ~F.col("named"), 0.0)
    return found.select("doc_id", "rk", "place", "n", label.alias("secret")).where(F.col("secret").isNotNull())


def train(featured: DataFrame, findings: DataFrame, train_rows: int = TRAIN_ROWS) -> RandomForestClassificationModel | None:
    """A forest from labelled findings; None unless both classes occur."""
    keys = ["doc_id", "rk", "place", "n"]
    lab = findings.select(*keys, F.col("secret").cast("double").alias("label"))
    sizes = {r["label"]: r["c"] for r in lab.groupBy("label").agg(F.count(F.lit(1)).alias("c")).collect()}
    if not (sizes.get(0.0) and sizes.get(1.0)):
        return None
    share = F.when(F.col("label") > 0, min(1.0, train_rows / sizes[1.0])).otherwise(min(1.0, train_rows / sizes[0.0]))
    draw = F.pmod(F.xxhash64(F.lit(13), *keys), F.lit(1 << 20)) / float(1 << 20)
    lab = lab.where(draw < share)       # bounded by twice train_rows, so the broadcast is too
    rows = featured.alias("f").join(F.broadcast(lab.alias("l")), [F.col(f"f.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys])
    rows = rows.select("label", *[f"_x{x}" for x in FEATURES])
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="_xv", labelCol="label")
    return forest.fit(_assembled(cut_lineage(rows)))


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"_x{x}" for x in FEATURES], outputCol="_xv", handleInvalid="keep").transform(df)


def scan(docs: DataFrame, findings: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """(doc_id, place, n, value, secret_score, is_secret) per candidate.

    Null and empty texts have no candidates; null ids are kept; repeated rows
    are reported each; without findings of both classes every candidate is
    reported with score 1; an empty table gives no rows."""
    found = cut_lineage(candidates(docs, text_col=text_col))
    featured = cut_lineage(with_features(found, frequent_words(docs, text_col)))
    if findings is None:
        findings = derived_findings(found)
    model = train(featured, findings.dropDuplicates(["doc_id", "rk", "place", "n"]))
    if model is None:
        out = featured.withColumn("secret_score", F.lit(1.0))
    else:
        scored = model.transform(_assembled(featured))
        out = scored.withColumn("secret_score", F.round(vector_to_array("probability")[1], 6))
    return out.select("doc_id", "place", "n", "value", "secret_score", (F.col("secret_score") >= 0.5).alias("is_secret"))
