"""Query registry: every operator as (spark, sf_dir) -> DataFrame, with the
DuckDB SQL that states the same result for the correctness gate.

Parameters are fixed here and used identically on both sides. Every query
reads the whole driver tables through the shop bindings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vitrina.plans.oracle import with_views
from vitrina.session import ensure_checkpoint_dir
from vitrina.sources.bindings import ShopTables


@dataclass
class Query:
    name: str
    build: Callable[[ShopTables], DataFrame]
    sql: str | None  # None: no SQL statement of the result (rows-only check)
    survey: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, survey: str, sql: str | None = None):
    def deco(fn: Callable[[ShopTables], DataFrame]):
        REGISTRY[name] = Query(name, fn, sql, survey)
        return fn
    return deco


def _load_all() -> None:
    # importing the query modules fills REGISTRY
    from vitrina.plans import q_catalog, q_changes, q_events, q_io, q_orders, q_sales  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    out = {}
    for name, q in REGISTRY.items():
        def run(spark: SparkSession, sf_dir: str, _q=q) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return _q.build(ShopTables(spark, sf_dir))
        out[name] = run
    return out


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {name: with_views(q.sql) for name, q in REGISTRY.items() if q.sql}
