"""Every registered query of the engine, and the DuckDB SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans import benchmarks, configs, contracts, curation, fields, preferences, releases, timelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (benchmarks, curation, timelines, preferences, fields, configs, releases, contracts):
    for _name, (_query, _sql) in _module.CATALOGUE.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLE_SQL[_name] = _sql
