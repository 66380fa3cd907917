"""Registry of named queries: key -> (spark builder, DuckDB oracle SQL or None).

A builder takes (spark, sf_dir) and returns a DataFrame that reads the given
tables.  The oracle is plain SQL over the raw tables (stand-in views are
inlined as a WITH clause); None means the check is rows-only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that its queries register."""
    from recoflow.plans import (  # noqa: F401
        q_core, q_entities, q_windows, q_features, q_models, q_metrics, q_baskets,
        q_factors, q_io, q_streaming,
    )


def sql_xlogx(x: str) -> str:
    return f"(CASE WHEN ({x}) = 0 THEN 0.0 ELSE ({x}) * ln({x}) END)"


def sql_llr(k11: str, k12: str, k21: str, k22: str) -> str:
    """DuckDB text of ``recoflow.functions.scalar.llr``."""
    tot = f"({k11} + {k12} + {k21} + {k22})"
    row = f"({sql_xlogx(tot)} - {sql_xlogx(f'{k11} + {k12}')} - {sql_xlogx(f'{k21} + {k22}')})"
    col = f"({sql_xlogx(tot)} - {sql_xlogx(f'{k11} + {k21}')} - {sql_xlogx(f'{k12} + {k22}')})"
    mat = (f"({sql_xlogx(tot)} - {sql_xlogx(k11)} - {sql_xlogx(k12)} - {sql_xlogx(k21)} "
           f"- {sql_xlogx(k22)})")
    raw = f"(2.0 * ({row} + {col} - {mat}))"
    return f"(CASE WHEN {raw} < 1e-9 THEN 0.0 ELSE {raw} END)"
