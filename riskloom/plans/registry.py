"""All registered queries of the engine: name -> callable, and name -> equivalent DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

from riskloom.functions.dialect import Duck, Spark
from riskloom.sources.tables import views

#: Modules with SQL (name -> text for a dialect) or QUERIES (name -> callable) and ORACLE.
MODULES = ("scoring", "agreement", "models", "corpus", "features", "reports", "evidence", "splits", "terms", "choice")


def _runner(text: str):
    def run(spark, sf_dir):
        views(spark, sf_dir)
        return spark.sql(text)

    return run


QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    _module = import_module(f"riskloom.plans.{_name}")
    for _key, _make in getattr(_module, "SQL", {}).items():
        QUERIES[_key] = _runner(_make(Spark))
        ORACLE[_key] = _make(Duck).strip()
    QUERIES |= getattr(_module, "QUERIES", {})
    ORACLE |= getattr(_module, "ORACLE", {})
