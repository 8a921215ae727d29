"""Every query of the engine by name, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans import analytics, office, scoring, structure, tables, validation

_PLANS = [structure, analytics, validation, scoring, tables, office]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
