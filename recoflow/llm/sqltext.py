"""DuckDB text of the queries whose SQL is made from parts."""

from __future__ import annotations


def sql_crc32(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes: eight shift steps a byte."""
    code = f"hex({text})"
    steps = (f"flatten(list_transform(range(CAST(length({code}) // 2 AS BIGINT)), lambda i: "
             f"[CAST('0x' || substr({code}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))")
    folded = (f"list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), "
              "lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1)))")
    return f"xor({folded}, 4294967295)"


def sql_merkle(arity: int = 8, levels: int = 7, top_levels: int = 4) -> str:
    """Manifest and proofs of ``documents``; the levels are written out (a tree
    of one node stays as it is), enough for arity ** levels leaves a language."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        cols = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(
            f"coalesce(CAST(octet_length(encode({c})) AS VARCHAR) || ':' || {c}, '-')" for c in cols) + ")"

    parts = [f"""
d AS (SELECT doc_id, coalesce('=' || lang, '') AS tag, {leaf('text')} AS leaf,
  CASE WHEN {sql_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS changed FROM documents)""", """
a0 AS (SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS digest,
  count(*) OVER (PARTITION BY tag) AS n, doc_id, leaf, changed FROM d)""", """
ca0 AS (SELECT tag, idx AS pl, doc_id, leaf, changed AS folded, '' AS proof FROM a0)"""]

    def climb(tree: str, key: str, count: int) -> None:
        for k in range(count):
            parts.append(f"""
r{tree}{k} AS (SELECT {key}, idx // {arity} AS run, list(digest ORDER BY idx) AS m, any_value(n) AS n FROM {tree}{k} GROUP BY ALL)""")
            parts.append(f"""
{tree}{k + 1} AS (SELECT {key}, run AS idx, CASE WHEN n > 1 THEN sha256(array_to_string(m, '')) ELSE m[1] END AS digest,
  (n + {arity - 1}) // {arity} AS n FROM r{tree}{k})""")
            left = f"coalesce(array_to_string(list_slice(m, 1, CAST(pl % {arity} AS BIGINT)), ''), '')"
            right = f"coalesce(array_to_string(list_slice(m, CAST(pl % {arity} AS BIGINT) + 2, {arity}), ''), '')"
            parts.append(f"""
c{tree}{k + 1} AS (SELECT c.* REPLACE (pl // {arity} AS pl, CASE WHEN n > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded,
  CASE WHEN n > 1 THEN proof || {left} || {right} ELSE proof END AS proof) FROM c{tree}{k} c
  JOIN r{tree}{k} r ON r.run = c.pl // {arity} AND r.{key} = c.{key})""")

    climb("a", "tag", levels)
    parts.append(f"""
t0 AS (SELECT 1 AS one, row_number() OVER (ORDER BY tag) - 1 AS idx, digest, count(*) OVER () AS n, tag FROM a{levels})""")
    parts.append(f"""
ct0 AS (SELECT 1 AS one, t0.idx AS pl, doc_id, leaf, folded, proof, t0.digest AS subroot
  FROM ca{levels} c JOIN t0 ON t0.tag = c.tag)""")
    climb("t", "one", top_levels)
    return "WITH " + ",".join(parts) + f"""
SELECT doc_id, leaf, subroot, (SELECT digest FROM t{top_levels}) AS root, sha256(proof) AS proof_sha256,
  folded AS folded_root, folded = (SELECT digest FROM t{top_levels}) AS verified FROM ct{top_levels}"""


def sql_variants(length: int = 7, count: int = 2, ratio: int = 10, slip: int = 31) -> str:
    """Spelling variants of ``documents``: words that share what is left after
    one code point is dropped at the same place (replaced), or that are what is
    left of each other (inserted, deleted)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, '{upper}', '{lower}') AS run FROM runs WHERE length(run) >= {length}),
hashed AS (SELECT run, k, {sql_crc32('k')} AS h FROM
  (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM low)),
slipped AS (SELECT CASE WHEN h % {slip} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT))
  || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM slipped WHERE length(word) >= {length} GROUP BY word HAVING count(*) >= {count}),
cuts AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM
  (SELECT word, unnest(range(CAST(length(word) AS BIGINT))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.cut
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.cut),
best AS (SELECT near.word, count(*) AS n_near, arg_min(near.other, (-o.n, near.other)) AS other, max(o.n) AS other_n
  FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
forms AS (SELECT words.word, CASE WHEN other_n >= {ratio} * n THEN other END AS form, n,
  coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {ratio} * n THEN other_n END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word),
up(word, top, form) AS (SELECT word, word, form FROM forms
  UNION ALL SELECT up.word, f.word, f.form FROM up JOIN forms f ON f.word = up.form)
SELECT forms.word, forms.form, up.top AS root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN up ON up.word = forms.word AND up.form IS NULL"""
