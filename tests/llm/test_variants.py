"""Spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from recoflow.llm import variants
from tests.llm.fixtures import hard_docs, no_docs


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def words_of(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 7
    return {w: c for w, c in n.items() if c >= 2}


def brute(rows):
    n = words_of(rows)
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def typed(seed, size):
    """Texts over a few stems with slips, capitals and chains of forms."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdé\u00D7\u00FFz") for _ in range(r.randint(6, 11))) for _ in range(25)]
    out = []
    for i in range(size):
        words = []
        for _ in range(60):
            w = stems[min(r.randrange(25), r.randrange(25))]
            for _ in range(r.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
                at = r.randrange(len(w))
                w = w[:at] + r.choice(["", "q", w[at] * 2, "ö"]) + w[at + 1:]
            words.append(w.upper() if r.random() < 0.1 else w)
        out.append((i if i % 9 else None, r.choice([" ", "-", "1", "\u0100"]).join(words)))
    return out + [(5, None), (6, ""), (7, "12 \u4e2d"), (8, "aaaaaaa" * 900), (9, "aaaaaaa" * 900 + " " + "aaaaaaa" * 900 + "b")]


@pytest.mark.parametrize("seed, unit", [(1, 50_000), (2, 7)])
def test_variants_match_brute_force(spark, seed, unit):
    rows = typed(seed, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as word", "2 as form")
    got = variants.spelling_variants(docs, unit=unit)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute(rows)


def test_hard_rows_and_empty_table(spark):
    docs = hard_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, variants.spelling_variants(docs).collect()), key=lambda r: r[0]) == brute(rows)
    assert variants.spelling_variants(no_docs(spark)).collect() == []


def test_roots_follow_chains(spark):
    counts = {"abcdefg": 2000, "abcdefgh": 200, "abcdefghi": 20, "abcdefghij": 2, "zzzzzzz": 2}
    links = spark.createDataFrame([("abcdefghij", "abcdefghi"), ("abcdefghi", "abcdefgh"), ("abcdefgh", "abcdefg")], "word string, to string")
    for links in variants._roots(links):
        pass
    assert {r.to for r in links.collect()} == {"abcdefg"}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r.word: (r.n_near, r.form) for r in variants.near_words(vocab).collect()} == {
        "abcdefg": (1, "abcdefgh"), "abcdefgh": (2, "abcdefg"), "abcdefghi": (2, "abcdefgh"), "abcdefghij": (1, "abcdefghi")}


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_word_at_one_edit(seed):
    r = random.Random(seed)
    letters = "abc\u00e9" if seed % 2 else "abcdefgh"
    words = sorted({"".join(r.choice(letters) for _ in range(r.randint(7, 9))) for _ in range([1, 2, 40, 300, 300, 500][seed])})
    r.shuffle(words)
    index = variants.VariantIndex(words)
    queries = words + [w[:-1] + "z" for w in words[:20]]        # a letter that no word has
    got = set()
    for second in (False, True):
        for a, b in zip(*index.near(queries, second)):
            u, v = queries[a], words[b]
            assert v.endswith(u[len(u) // 2:]) if second else v.startswith(u[:len(u) // 2])
            got.add((u, v))
    assert got == {(a, b) for a in queries for b in words if one_edit(a, b)}
