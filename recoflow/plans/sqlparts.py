"""Shared DuckDB CTE text for the oracles (correlators, popularity, docs)."""

from __future__ import annotations

from recoflow.plans.registry import sql_llr
from recoflow.sources.tables import LONG_DURATION, POP_END, PRIMARY, SECONDARY, SEED, with_views

ACTIONS_SQL = ", ".join(f"'{a}'" for a in (PRIMARY, *SECONDARY))

# distinct pairs of the primary and secondary actions
PAIRS = f"""
pairs AS (SELECT DISTINCT user, action, item FROM inter WHERE action IN ({ACTIONS_SQL}))"""


def capped_sql(n: int) -> str:
    """The pairs after both caps, by a seeded draw."""
    key = f"md5('{SEED}|' || user || '|' || item)"
    return PAIRS + f""",
ci AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY action, item ORDER BY {key}, user) AS r
       FROM pairs) WHERE r <= {n}),
capped AS (SELECT user, action, item FROM (SELECT user, action, item, row_number() OVER (PARTITION BY action, user
           ORDER BY {key}, item) AS r FROM ci) WHERE r <= {n})"""


def scores_sql(base: str = PAIRS, pairs: str = "pairs") -> str:
    """LLR of every co-occurring pair; U is counted before any cap."""
    return base + f""",
nu AS (SELECT count(DISTINCT user) AS n FROM pairs),
cooc AS (SELECT b.action, a.item, b.item AS other, count(*) AS k11 FROM {pairs} a JOIN {pairs} b ON a.user = b.user
         WHERE a.action = '{PRIMARY}' AND (b.action <> '{PRIMARY}' OR a.item <> b.item) GROUP BY 1, 2, 3),
ma AS (SELECT item, count(*) AS n_a FROM {pairs} WHERE action = '{PRIMARY}' GROUP BY item),
mb AS (SELECT action, item AS other, count(*) AS n_b FROM {pairs} GROUP BY action, item),
kk AS (SELECT c.action, c.item, c.other, c.k11, ma.n_a, mb.n_b, CAST(c.k11 AS DOUBLE) AS k11d,
       CAST(ma.n_a - c.k11 AS DOUBLE) AS k12d, CAST(mb.n_b - c.k11 AS DOUBLE) AS k21d,
       CAST(nu.n - ma.n_a - mb.n_b + c.k11 AS DOUBLE) AS k22d
       FROM cooc c JOIN ma ON c.item = ma.item JOIN mb ON c.action = mb.action AND c.other = mb.other CROSS JOIN nu),
sc AS (SELECT action, item, other, k11, n_a, n_b, {sql_llr('k11d', 'k12d', 'k21d', 'k22d')} AS llr FROM kk)"""


SCORES = scores_sql()
CORR = SCORES + """,
corr AS (SELECT * FROM (SELECT action, item, other, llr, CAST(row_number() OVER (PARTITION BY action, item
         ORDER BY round(llr, 9) DESC, other) AS INTEGER) AS rank FROM sc WHERE llr > 0) WHERE rank <= 50)"""


def pop_cte(name: str = "pop", kind: str = "popular", events=(PRIMARY,), end: str = POP_END,
            duration: int = LONG_DURATION) -> str:
    from recoflow.operators.popularity import period_bounds
    ev = ", ".join(f"'{e}'" for e in events)
    parts = {"popular": 1, "trending": 2, "hot": 3}[kind]
    b = [f"TIMESTAMP '{x.isoformat(sep=' ')}'" for x in period_bounds(end, duration, parts)]
    base = f"FROM inter WHERE action IN ({ev}) AND ts >= {b[0]} AND ts < {b[-1]} GROUP BY item"
    if kind == "popular":
        return f"{name} AS (SELECT item, CAST(count(*) AS DOUBLE) AS score {base})"
    cnts = ", ".join(f"count(*) FILTER (WHERE ts >= {b[i]} AND ts < {b[i + 1]}) AS c{i}" for i in range(parts))
    if kind == "trending":
        return (f"{name} AS (SELECT item, CAST(c1 - c0 AS DOUBLE) AS score FROM (SELECT item, {cnts} {base}) "
                f"WHERE c0 > 0 AND c1 > 0)")
    return (f"{name} AS (SELECT item, CAST((c2 - c1) - (c1 - c0) AS DOUBLE) AS score FROM (SELECT item, {cnts} "
            f"{base}) WHERE c0 > 0 AND c1 > 0 AND c2 > 0)")


def ctes(views=("inter",), *fragments: str) -> str:
    """WITH clause: the stand-in views, then the given CTE fragments."""
    body = with_views(*views).rstrip()
    for f in fragments:
        body += ",\n" + f.strip().lstrip(",")
    return body + "\n"
