"""Merkle manifest against a plain recomputation."""

import hashlib
import zlib

import pytest

from recoflow.llm import merkle
from tests.conftest import SF_SMALL
from tests.llm.fixtures import hard_docs, no_docs


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(leaves, arity):
    """Levels of one tree, lowest first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i:i + arity])) for i in range(0, len(low), arity)])
    return levels


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(docs, arity):
    rows = []
    for r in docs.collect():
        values = [r.doc_id, r.source, r.lang, r.n_chars, r.text]
        changed = leaf_of(values)
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
            changed = leaf_of([*values[:4], lowered(r.text)])
        rows.append((r.lang, r.doc_id, leaf_of(values), changed))
    langs = sorted({r[0] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[0] == x), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for x in langs]
    trees = [tree_of([r[2] for r in g], arity) for g in groups]
    top = tree_of([t[-1][0] for t in trees], arity)
    root = top[-1][0] if rows else None
    out = []
    for at, (g, tree) in enumerate(zip(groups, trees)):
        for i, (_, doc, leaf, changed) in enumerate(g):
            folded, proof = changed, ""
            for levels, place in ((tree, i), (top, at)):
                for level in levels[:-1]:
                    lo = place // arity * arity
                    run = level[lo:lo + arity]
                    proof += "".join(run[:place - lo] + run[place - lo + 1:])
                    folded = sha("".join([*run[:place - lo], folded, *run[place - lo + 1:]]))
                    place //= arity
            out.append((doc, leaf, tree[-1][0], root, sha(proof), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity, hot", [(8, 4096), (2, 3), (3, 1)])
def test_report_matches_recomputation(spark, arity, hot):
    for docs in (hard_docs(spark), *([spark.read.parquet(f"{SF_SMALL}/documents.parquet")] if arity == 8 else [])):
        got = merkle.tamper_report(docs, arity, hot)
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, arity)


def test_single_row_and_empty_table(spark):
    one = spark.createDataFrame([(5, None, None, 3, "Abc")], "doc_id long, source string, lang string, n_chars long, text string")
    assert [tuple(r) for r in merkle.tamper_report(one).collect()] == brute(one, 8)
    assert merkle.tamper_report(no_docs(spark)).collect() == []


def test_one_language_has_no_top_tree(spark):
    docs = spark.createDataFrame([(i, "s", "en", i, f"Text {i}") for i in range(70)],
                                 "doc_id long, source string, lang string, n_chars long, text string")
    rows = merkle.tamper_report(docs).collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, 8)
    assert {r.subroot for r in rows} == {r.root for r in rows}


def test_lowered_texts_without_capitals_still_verify(spark):
    docs = spark.createDataFrame([(i, "s", "en", i, "no capitals é É") for i in range(20)],
                                 "doc_id long, source string, lang string, n_chars long, text string")
    assert all(r.verified for r in merkle.tamper_report(docs).collect())


def test_hot_runs_are_bounded_per_level(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    m = merkle.build(merkle.tampered_leaves(docs), 2)
    per_level = m.nodes.where(f"weight * 4 > {m.n_leaves}").groupBy("tree", "level").count().collect()
    assert per_level and max(r["count"] for r in per_level) <= 4
