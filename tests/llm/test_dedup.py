"""SimHash, substring dedup and fingerprints against brute force."""

import hashlib
import itertools
import re

import numpy as np
import pytest
import xxhash

from recoflow.llm import lcp, simhash, substrings
from tests.conftest import SF_SMALL
from tests.llm.fixtures import hard_docs, no_docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def simhash_of(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """Smallest id per row of (id, fingerprint), links at 3 bits or fewer."""
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 3 and group[i] != group[j]:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    low = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return [low.get(g) for g in group], group


def test_every_pair_within_the_radius_shares_a_mask():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    for r in (1, 2, 3):
        for bits in itertools.combinations(range(64), r):
            diff = sum(1 << b for b in bits)
            assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("make", [hard_docs, lambda s: s.read.parquet(f"{SF_SMALL}/documents.parquet")])
def test_near_duplicates_match_brute_force(spark, make):
    docs = make(spark)
    rows = [(r.doc_id, simhash_of(r.text)) for r in docs.collect()]
    want, group = brute_components(rows)
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted(((i, f"{f:016x}", c) for (i, f), c in zip(rows, want)), key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(group)) and sorted(map(str, ids)) == sorted(str(c) for c in dict(zip(group, want)).values())


def test_blocks_of_an_oversize_bucket_keep_all_links(spark):
    r = np.random.default_rng(0)
    base = int(r.integers(1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 60, (120, 2))})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bucket in (7, 2048):
        edges = simhash.link_forest(df, 3, bucket).collect()
        assert all((e.u ^ e.v).bit_count() <= 3 for e in edges)
        comps = simhash.components(simhash.link_forest(df, 3, bucket)).collect()
        want, group = brute_components([(f, f) for f in fps])
        root = {c.node: c.root for c in comps}
        assert [root.get(f, f) for f in fps] == want


def test_simhash_of_no_rows(spark):
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    assert simhash.keep_one(no_docs(spark)).count() == 0


def brute_repeats(rows, window):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[s:s + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s:s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window,group", [(50, 4096), (50, 1), (8, 1), (9, 4096)])
def test_repeats_match_brute_force(spark, window, group):
    docs = hard_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substrings.remove_repeats(docs, window, group).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_repeats(rows, window), key=str)


def test_repeats_of_no_rows(spark):
    assert substrings.remove_repeats(no_docs(spark)).count() == 0


def test_anchors_cover_each_window_once():
    h = substrings.word_hashes(prose(9, 400, 6).encode())
    key, pos, lo, hi = substrings.anchors(h, 50)
    assert lo[0] == 0 and hi[-1] == 350 and (lo[1:] == hi[:-1] + 1).all()
    assert ((pos >= hi) & (pos + 25 <= lo + 50)).all()


def test_fingerprint_report_matches_the_plain_walk(spark):
    docs = hard_docs(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None and r.doc_id != 14]
    ordered = sorted(rows, key=lambda r: -r[0])
    few = docs.where("doc_id is not null and doc_id != 14")
    got = {}
    for r in lcp.fingerprint_report(few).collect():
        got.setdefault(r.doc_id, []).append(r)
    for n, (i, t) in enumerate(ordered):
        nxt = ordered[(n + 1) % len(ordered)][1]
        m = len(t) // 3
        edited = t[:len(t) - m] + nxt[:m]
        f, e, x = (lcp.sketches([s])[0] for s in (t, edited, nxt))
        want = (len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, lcp.likeness(f, e), lcp.likeness(f, x))
        assert any(tuple(r)[1:] == want for r in got[i])
    assert lcp.fingerprint_report(docs).count() == docs.count()
    assert lcp.fingerprint_report(no_docs(spark)).count() == 0
    one = docs.where("doc_id = 3")
    assert lcp.fingerprint_report(one).first().near_next == 1.0


def test_equal_substrings_share_interior_names():
    text = prose(11, 500)
    whole, part, other = lcp.sketches([text, "q" * 7 + text[300:], prose(12, 500)])
    assert lcp.likeness(whole, part) > 0.6 > 0.2 > lcp.likeness(whole, other)
    batch = lcp.sketches([text, "", prose(12, 500), "a", "aaaa"])
    assert batch[0] == whole and batch[1] == "" and batch[2] == other      # neighbours do not matter
