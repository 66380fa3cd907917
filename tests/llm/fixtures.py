"""Small frames with the hard cases every operator must survive."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, _xk long"


def prose(seed: int, n: int, vocab: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}x" for _ in range(n))


def hard_docs(spark):
    """Nulls in every column, empty and word-free texts, ties, repeated rows,
    exact and near copies, shared passages, a very long text, extra columns."""
    a, b, passage = prose(1, 120), prose(2, 90), prose(3, 70)
    rows = [(1, a, "en"), (2, a, "en"), (2, a, "en"), (3, b, "fr"), (4, None, None), (5, "", "en"), (6, " \t\n ", "de"),
            (7, "one", None), (8, "two words", "en"), (9, prose(4, 30) + "\n" + passage + " " + prose(5, 30), "en"),
            (10, prose(6, 10) + " " + passage, "en"), (None, a, "en"), (None, None, None), (11, "x " * 300, "es"),
            (12, "x " * 200, "es"), (13, prose(7, 20_000, 5000), "de"), (14, a.replace("w1x", "zz"), "en"),
            (14, b, "fr"), (15, passage + " " + prose(8, 40), None), (16, "Ünïcödé — 　 ñ é " * 20, "fr"),
            (17, "1234 5678 !!!", "en")]
    full = [(i, t, l, f"src{(i or 0) % 3}" if i != 3 else None, None, 0.5, 1, 2) for i, t, l in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
