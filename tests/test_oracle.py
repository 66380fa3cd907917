"""Every registered query against its DuckDB oracle on the smallest tables;
queries without an oracle must at least run."""

import pytest

from recoflow.plans.registry import ORACLES, QUERIES, load_all
from tests.conftest import SF_SMALL

load_all()
from tools.oracle_check import compare, duck  # noqa: E402

_CON = {}


def _con():
    if "c" not in _CON:
        _CON["c"] = duck(SF_SMALL)
    return _CON["c"]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, key):
    r = compare(spark, SF_SMALL, key, QUERIES[key], ORACLES.get(key), _con())
    assert r["status"] in ("match", "rows-only"), r


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["query_id", "rank", "item", "score"]
    assert df.count() == 15 * 20      # every user gets a full list
    assert set(E.oracle_sql()) <= set(E.queries())
