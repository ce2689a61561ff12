"""All registered queries and the SQL that checks them, by module."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalake.plans import checks


def _modules() -> list:
    return [importlib.import_module(f"{checks.__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(checks.__path__), key=lambda m: m.name)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in _modules() for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
