"""Archives, language ID, sharding, chat formatting, decontamination, mixing,
secret scans and the pipeline on small frames."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from recoflow.llm import chat, decontam, hilbert, langid, mixing, secretscan, warc
from recoflow.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tests.llm.fixtures import hard_docs, no_docs, prose
from tools.oracle_check import compare, duck


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_its_sql(spark, key):
    assert compare(spark, SF_SMALL, key, QUERIES[key], ORACLES[key], duck(SF_SMALL))["status"] == "match"


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, key):
    assert QUERIES[key](spark, SF_SMALL).count() > 0


# ---- archives

PAGES = [(1, "http://a.org/x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "not a url\r\nX: y", None), (4, "http://B.org", ""),
         (None, "http://a.org/x", "<p>é</p>"), (5, "http://a.org/x", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
         (5, "http://a.org/x", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "https://[bad", "y" * 100_000)]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload int")
    got = [tuple(r) for r in warc.pages_index(pages).collect()]
    high = {}
    for i, _, h in PAGES:
        if i is not None:
            high[h or ""] = max(high.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        first = high[h or ""]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                     "response" if i == first else "revisit", None if i == first else first))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.pages_index(pages.limit(0)).count() == 0


def test_small_payloads_are_all_responses(spark):
    caps = spark.createDataFrame([(1, "u", None, "ab"), (2, "u", None, "ab"), (3, "u", None, "abcdef"), (4, "u", None, "abcdef")],
                                 "id long, url string, ts timestamp, payload string")
    got = {r.id: r.refers_to for r in warc.with_revisits(caps, min_bytes=4).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_dates_are_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    caps = spark.range(2).selectExpr("id", "'http://a.org/' as url", "timestamp_seconds(1704067200 + id * 15724800) as ts", "'x' as payload")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = sorted(r.ts for r in warc.capture_index(caps).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == ["20240101000000", "20240701000000"]


def test_merged_index_is_in_order(spark):
    pages = spark.createDataFrame([(i, f"http://h{i * 7 % 13}.org/{i * 5 % 17}", f"p{i}") for i in range(300)],
                                  "page_id long, url string, html string")
    caps = pages.selectExpr("page_id id", "url", "timestamp_seconds(page_id % 50) ts", "html payload")
    rows = warc.capture_index(caps).orderBy("part", "pos").collect()
    keys = [(r.urlkey, r.ts, r.record_id) for r in rows]
    assert keys == sorted(keys) and len({r.record_id for r in rows}) == 300


def test_loser_tree_merges_runs():
    r = random.Random(1)
    for k in range(9):
        runs = [sorted(r.randrange(9) for _ in range(r.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(itertools.chain(*runs))


def test_url_key():
    assert warc.url_key("https://www.Example.com/A?b=C") == "com,example)/a?b=c"
    assert warc.url_key("https://[bad") == "https://[bad"


# ---- language

def test_held_out_accuracy(spark):
    import duckdb
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, SF_SMALL).collect()}
    true = duckdb.sql(f"SELECT doc_id, lang FROM '{SF_SMALL}/documents.parquet'").fetchall()
    test = [(got[i].lang_pred, lang) for i, lang in true if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in true)
    assert len(test) > 20 and sum(a == b for a, b in test) / len(test) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_hard_texts(spark):
    docs = hard_docs(spark)
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id in (4, 5, 6, 17):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.identify(no_docs(spark)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    kept = langid.keep_identified(docs, 0.0)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0 and kept.where("text is null or doc_id in (5, 6, 17)").count() == 0


def test_ngrams_do_not_cross_texts():
    both, starts = langid.ngram_buckets([langid.normalised("Abc d"), langid.normalised("xy")])
    alone, _ = langid.ngram_buckets([langid.normalised("xy")])
    assert (both[:, starts[1]:] == alone).all() and list(starts) == [0, 7]


# ---- shards

@pytest.mark.parametrize("bits,dims", [(3, 2), (2, 3), (2, 4)])
def test_curve_visits_neighbours(bits, dims):
    grid = np.array(list(np.ndindex(*[1 << bits] * dims)))
    at = hilbert.hilbert_index(grid, bits)
    assert sorted(at) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_shards_of_hard_rows(spark):
    docs = hard_docs(spark)
    rows = hilbert.shard_rows(docs).collect()
    assert len(rows) == docs.count()
    for k, part in itertools.groupby(sorted(rows, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        slots = [r.slot for r in part]
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 8, len(rows) // 8 + 1)
    text = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in text}
    kept = hilbert.shard_rows(docs, keep=True)
    assert kept.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    assert kept.drop("shard", "slot").exceptAll(docs.drop("shard")).count() == 0
    assert hilbert.shard_rows(no_docs(spark)).count() == 0


def test_written_shards_and_manifest(spark, scratch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = hilbert.shard_rows(docs, shards=4, keep=True)
    hilbert.write_shards(out, f"{scratch}/s")
    assert spark.read.parquet(f"{scratch}/s").count() == docs.count()
    assert [r.n_rows for r in hilbert.manifest(out, ["n_chars"]).collect()] == [50] * 4


# ---- chat

def test_template_compiler():
    run = lambda t, **env: "".join(x for x, _ in chat.renderer(chat.fold(chat.parse(t)))(env, False))
    assert run("a{{ 'b' ~ 1 }}{% if x == 'q' or not y %}c{% else %}d{% endif %}", x="z", y=1) == "ab1d"
    assert run("{% for m in ms %}{% if loop.first %}>{% endif %}{{ loop.index0 }}{{ m.k | upper }}{% endfor %}",
               ms=[{"k": "a"}, {"k": "b"}]) == ">0A1B"
    assert chat.fold(chat.parse("x{{ 'y' | upper }}{% if 1 == 2 %}no{% elif 'a' %}z{% endif %}")) == [("emit", ("const", "xYz"))]
    assert run("{{ a.b.c }}", a={"b": 3}) == ""
    for bad in ("{{ a.__class__ }}", "{{ f() }}", "{% for x in %}", "{% if a %}", "{{ a | eval }}", "{% endfor %}", "{{ 'a }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


CONTROL = ["\\", "###", "</turn>", "\\### Assistant: </turn> ok", "</turn", "a\\", "####", "\\\\</turn>\n### x: ", "", "é:\n"]


def test_conversations_round_trip(spark):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "sys:tem", "", None, "###\\"]), r.choice([*CONTROL, None]))
            for c in [*range(40), None] for t in r.sample([None, 0, 1, 2, 3, 3], r.randrange(1, 6))]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {g.conv_id: g for g in chat.read_back(chat.format_conversations(df)).collect()}
    order = lambda v: (v is not None, v if v is not None else 0)
    for c in {x[0] for x in rows}:
        turns = sorted((x for x in rows if x[0] == c), key=lambda x: (order(x[1]), order(x[2]) if x[2] is not None else (False, ""), order(x[3]) if x[3] is not None else (False, "")))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        g = got.pop(c)
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_a_very_long_conversation_leaves_in_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", "x" * 60_000) for t in range(60)],
                               "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df)
    assert formatted.count() > 1
    g = chat.read_back(formatted).first()
    assert (g.n_turns, g.loss_chars) == (60, 30 * 60_000)


# ---- decontamination

def test_masks_survive_four_substitutions_in_twenty_words():
    for subs in itertools.combinations(range(20), 4):
        s = set(subs)
        assert any(all(i + o not in s for o in m) for m in decontam.MASKS for i in range(20 - m[-1]))


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute_overlaps(docs, items):
    out = set()
    for i, t in docs:
        a = tokens(t)
        for j, u in items:
            b = tokens(u)
            need = min(len(b), 20)
            if len(b) < 6 or len(a) < need:
                continue
            for diag in range(need - len(b), len(a) - need + 1):
                eq = [a[p + diag] == b[p] for p in range(max(0, -diag), min(len(b), len(a) - diag))]
                if any(sum(eq[s:s + need]) >= 0.8 * need - 1e-9 for s in range(len(eq) - need + 1)):
                    out.add((i, j))
                    break
    return out


def test_overlaps_match_brute_force(spark):
    r = random.Random(5)
    items = [(k, prose(100 + k, r.randrange(3, 40), 3000)) for k in range(12)] + [(50, None), (51, ""), (None, prose(7, 25, 5000)), (0, prose(77, 30))]
    docs = [(r.doc_id, r.text) for r in hard_docs(spark).collect()]
    for k, (_, t) in enumerate(items):
        w = (t or "").split()
        for _ in range(min(len(w), k % 7)):
            w[r.randrange(len(w))] = "changed"
        cut = r.randrange(0, max(1, len(w) // 3))
        docs.append((100 + k, prose(200 + k, 15) + "\n" + " , ".join(w[cut:]).upper() + "! " + prose(300 + k, 15)))
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(d, b).collect()}
    want = brute_overlaps(docs, items)
    # substitutions may kill every seed of an item shorter than 20 words; those of 20 or more are exact
    long = {j for j, u in items if len(tokens(u)) >= 20}
    assert got <= want and {x for x in want if x[1] in long} <= got and len(got) >= 8
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns and kept.exceptAll(d).count() == 0
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted((i for i, _ in docs if i not in {x[0] for x in got}), key=str)
    assert decontam.contaminated(no_docs(spark), b).count() == 0
    assert decontam.contaminated(d, b.limit(0)).count() == 0


def test_short_items_match_under_every_placement(spark):
    for n in range(1, 20):
        k = decontam.spare(n, 0.8)
        assert k == n // 5 and (n >= 13 or n in (8, 9) or not decontam.lossless(n, k))
        for x in itertools.combinations(range(n), k):
            assert any(not set(range(a, a + m)) & set(x) for a, m in decontam.blocks(n, k))
    items, docs, want = [], [], set()
    for n in range(1, 20):
        w = [f"i{n}q{j}" for j in range(n)]
        items.append((n, " ".join(w)))
        k = decontam.spare(n, 0.8)
        for m in range(k + 2):      # one substitution too many at last
            for x in itertools.islice(itertools.combinations(range(n), m), 0, None, 1 if n < 13 else 97):
                docs.append((len(docs), " ".join(["lead"] * (len(docs) % 3) + ["gap" if j in x else v for j, v in enumerate(w)] + ["end"])))
                if m <= k:
                    want.add((docs[-1][0], n))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(d, b).collect()} == want


# ---- mixing

def labels(spark, n=21):
    rows = [(i, i % 3 != 0, i % 5 == 0) for i in range(1, n)] + [(None, True, True), (3, None, True), (900, True, False), (1, True, False)]
    return spark.createDataFrame([(i, None if q is None else int(q), int(x), "t") for i, q, x in rows],
                                 "doc_id long, quality int, toxic int, text string")


def numpy_rates(p, t, want, steps, gap):
    m = (p * t[:, None]).T @ p
    inverse = np.linalg.inv(m + mixing.RIDGE * np.trace(m) * np.eye(len(m)))
    r = np.ones(len(t))
    for _ in range(steps):
        got = (p * (t * r)[:, None]).sum(0)
        if np.abs(got - want).max() <= gap * t.sum():
            break
        r = np.clip(r - p @ (inverse @ (got - want)), 0.0, mixing.MAX_RATE)
    return r


def test_a_domain_without_labels_has_no_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("not (quality = 0 and toxic = 1)")
    out = mixing.mixed(docs, lab).toPandas()
    assert (out.p_junk_toxic == 0).all() and out.rate.between(0, mixing.MAX_RATE).all()
    p, t = out[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy(), out.n_tokens.to_numpy(dtype=float)
    want = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) * [1, 1, 1, 0]
    got = (p * (t * out.rate.to_numpy())[:, None]).sum(0)
    assert np.abs(got / t.sum() - want / want.sum()).max() < 0.01


def test_rates_match_numpy_and_reach_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = mixing.mixed(docs, lab).toPandas()
    p = out[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1, atol=1e-6) and (out.rate >= 0).all()
    t = out.n_tokens.to_numpy(dtype=float)
    want = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    want = want / want.sum() * t.sum()
    assert np.allclose(out.rate, numpy_rates(p, t, want, mixing.STEPS, mixing.GAP), atol=1e-3)
    got = (p * (t * out.rate.to_numpy())[:, None]).sum(0)
    assert np.abs(got - want).max() <= 0.01 * t.sum()
    assert np.abs(out.copies.sum() - out.rate.sum()) < 0.1 * len(out)


def members(spark, rows):
    return spark.createDataFrame([(float(t), *map(float, p)) for t, p in rows], "_xt double, _xp0 double, _xp1 double, _xp2 double, _xp3 double")


def test_rates_of_a_rare_domain_are_not_clipped(spark):
    rare = [(10, (1, 0, 0, 0))] * 500 + [(10, (.1, .9, 0, 0))] + [(20, (0, .05, .95, 0))] * 40 + [(5, (0, 0, .2, .8))]
    fit, got, want = mixing.fit_rates(members(spark, rare), mixing.TARGETS, [True] * 4)
    total = sum(t for t, _ in rare)
    assert np.allclose(want, np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) * total)
    assert np.abs(got - want).max() <= mixing.GAP * total
    rates = fit.toPandas()
    assert rates._xr.max() > 8 and np.allclose([(rates._xr * rates._xt * rates[f"_xp{i}"]).sum() for i in range(4)], want, rtol=1e-3)


def test_missed_targets_are_reported(spark):
    rows = [(10, (.9, .05, .03, .02))] * 9 + [(10, (.5, 0, .5, 0)), (3, (0, .4, 0, .6))]
    with pytest.raises(RuntimeError, match="after 0 steps"):
        mixing.fit_rates(members(spark, [(10, (1, 0, 0, 0))] * 9 + [(9, (.2, .8, 0, 0)), (7, (0, .3, .7, 0)), (3, (0, 0, .4, .6))]),
                         {"good": .3, "good_toxic": .5, "junk": .15, "junk_toxic": .05}, [True] * 4, steps=0)
    with pytest.warns(UserWarning, match="no rates reach"):
        _, got, want = mixing.fit_rates(members(spark, rows), {"good_toxic": 1.0}, [True] * 4)
    assert np.abs(got - want).max() > 0.01 * want.sum()
    docs = hard_docs(spark)
    for out in (mixing.mixed(docs, labels(spark)), mixing.mixed(docs, labels(spark).limit(0))):
        r = out.toPandas()
        for d in mixing.DOMAINS:
            assert np.isclose((r.rate * r.n_tokens * r[f"p_{d}"]).sum(), r[f"reached_{d}"].iloc[0], rtol=1e-4, atol=0.1)
        assert np.isclose(sum(r[f"wanted_{d}"].iloc[0] for d in mixing.DOMAINS), r.n_tokens.sum(), rtol=1e-6)


def test_targets_out_of_reach_come_near_the_nearest_totals(spark):
    rng = np.random.default_rng(0)
    p, t = rng.dirichlet([3, .3, .5, .1], 200), rng.integers(1, 500, 200).astype(float)
    want = np.array([.2, .5, .2, .1]) * t.sum()
    m = (p * t[:, None]).T @ p
    metric = np.linalg.inv(m + mixing.RIDGE * np.trace(m) * np.eye(4))
    frame = members(spark, [(a, tuple(b)) for a, b in zip(t, p)])
    can = mixing.nearest(frame, want, metric, 1e-9)
    targets = dict(zip(mixing.DOMAINS, [.2, .5, .2, .1]))
    if np.abs(can - want).max() <= mixing.GAP * t.sum():
        targets = {"good_toxic": 1.0}
        want = np.array([0, 1, 0, 0]) * t.sum()
        can = mixing.nearest(frame, want, metric, 1e-9)
    with pytest.warns(UserWarning, match="no rates reach"):
        out, got, asked = mixing.fit_rates(frame, targets, [True] * 4)
    assert np.allclose(asked, want)
    rates = out.toPandas()
    assert (rates._xr >= 0).all() and np.allclose((rates[[f"_xp{i}" for i in range(4)]].to_numpy() * (rates._xt * rates._xr).to_numpy()[:, None]).sum(0), got, rtol=1e-6)
    own = (p * t[:, None]).sum(0)
    aim = can + mixing.INNER * (own * can.sum() / own.sum() - can)
    assert np.abs(got - aim).max() <= mixing.INNER_GAP * t.sum()


def test_many_copies_are_dealt_to_blocks(spark):
    docs = spark.createDataFrame([(i, "good words here and there") for i in range(400)] + [(900, "bad toxin stuff")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(900, 0, 1)], "doc_id long, quality int, toxic int")
    targets = {"good": .3, "junk_toxic": .7}
    out = mixing.mixed(docs, lab, targets).toPandas()
    again = mixing.resample(docs, lab, targets).toPandas()
    want = {i: n for i, n in zip(out.doc_id, out.copies) if n}
    assert max(want.values()) > 2 * mixing.COPIES and again.groupby("doc_id").size().to_dict() == want


def test_a_rare_domain_stays_in_the_sample(spark):
    n = 3000
    kind = lambda i: (0, 1) if i == 77 or i == 1500 else (1, 0)
    docs = spark.createDataFrame([(i, "junky toxin " * 8 if kind(i)[0] == 0 else prose(i, 12)) for i in range(n)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, *kind(i)) for i in range(n)] + [(n + i, 1, 1) for i in range(500)], "doc_id long, quality int, toxic int")
    model = mixing.train(docs, lab, train_rows=100)
    assert model.present == [True, False, False, True]      # toxic good labels have no documents
    p = {r.doc_id: r for r in mixing.memberships(docs, model).collect()}
    assert p[77]["_xp3"] > 20 * p[5]["_xp3"] > 0 and p[5]["_xp0"] > 0.5
    assert mixing.shares({"a": 10, "b": 900, "c": 400}, 700) == {"a": 1.0, "c": 345 / 400, "b": 345 / 900}
    assert mixing.shares({"a": 10, "b": 20}, 30) == {"a": 1.0, "b": 1.0} and mixing.shares({}, 5) == {}


def test_mixing_hard_rows(spark):
    docs = hard_docs(spark)
    out = mixing.mixed(docs, labels(spark)).collect()
    assert len(out) == docs.count()
    again = mixing.resample(docs, labels(spark))
    assert again.columns == docs.columns and again.distinct().exceptAll(docs.distinct()).count() == 0
    n = {}
    for r in out:
        n[r.doc_id] = n.get(r.doc_id, 0) + r.copies
    got = {}
    for r in again.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in n.items() if v}
    assert mixing.mixed(no_docs(spark), labels(spark)).count() == 0
    assert {r.rate for r in mixing.mixed(docs, labels(spark).limit(0)).collect()} == {1.0}


# ---- secrets

def test_secrets_are_told_from_long_words(spark):
    r = random.Random(3)
    rows, truth = [], set()
    for i in range(200):
        text = prose(i, 40)
        if i % 4 == 0:
            key = "".join(r.choice("0123456789abcdef") for _ in range(40))
            text += f' token = "{key}" ' + prose(i + 999, 5)
            truth.add((i, key))
        elif i % 4 == 1:
            text += " " + "".join(r.choice(["ing", "tion", "the", "er"]) for _ in range(7)) + " end"
        elif i % 4 == 2:
            text += f" {r.randrange(10 ** 15, 10 ** 16)}"
        rows.append((i, text, "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = secretscan.scan(docs).collect()
    assert {(x.doc_id, x.value) for x in out if x.is_secret} == truth
    assert any(not x.is_secret for x in out)
    # labelled findings given from outside
    found = secretscan.candidates(docs).selectExpr("doc_id", "rk", "place", "n", "doc_id % 4 = 0 as secret")
    assert {x.doc_id for x in secretscan.scan(docs, found).collect() if x.is_secret} == {i for i, _ in truth}


def test_unquoted_short_and_prefixed_secrets(spark):
    r = random.Random(4)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    forms = ['token = "{}"', "TOKEN={}", "password: {}", "aws_secret_key='{}'", "url=https://u:{}@h.org"]
    rows, truth = [], {f: set() for f in forms}
    for i in range(200):
        k = key(40)
        f = forms[i // 2 % len(forms)]
        if i % 2:
            truth[f].add((i, k))
        rows.append((i, prose(i, 20) + (" " + f.format(k) if i % 2 else " " + "".join(r.choice(["ing", "tion", "the", "er"]) for _ in range(7))) + " " + prose(i + 999, 5), "s"))
    rows += [(1000, 'so password = "hunter2x" ' + prose(1, 9), "s"), (1001, "db_passwd: 'q7' " + prose(2, 9), "s"), (1002, "my API_KEY=zz81 " + prose(3, 9), "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secretscan.candidates(docs)
    assert {(x.doc_id, x.value) for x in found.where("doc_id >= 1000").collect()} == {(1000, "hunter2x"), (1001, "q7"), (1002, "zz81")}
    bad = {(x.doc_id, x.value) for x in found.join(secretscan.derived_findings(found).where("secret = 0"), ["doc_id", "rk", "place", "n"]).collect()}
    assert bad and not any(bad & t for t in truth.values())
    secrets = {(x.doc_id, x.value) for x in secretscan.scan(docs).collect() if x.is_secret}
    for f in forms:
        assert truth[f] <= secrets, f
    assert {(1000, "hunter2x"), (1001, "q7")} <= secrets and not secrets & bad


def test_scanning_hard_rows(spark):
    docs = hard_docs(spark)
    assert all(x.secret_score == 1.0 for x in secretscan.scan(docs).collect())     # no findings: all are reported
    assert secretscan.scan(no_docs(spark)).count() == 0
    assert secretscan.scan(docs.drop("source")).count() == secretscan.scan(docs).count()


# ---- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == [*docs.columns, "shard", "slot"]
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert 0 < len(ids) <= docs.count()


@pytest.mark.parametrize("make", [hard_docs, no_docs])
def test_pipeline_stages_on_hard_rows(spark, make):
    import corpus_pipeline
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name != "shard":
            assert out.columns == docs.columns
        out.count()
