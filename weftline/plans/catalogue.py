"""All queries of the library and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import answers, books, mappings, records, relational, similar, textual

MODULES = [relational, textual, mappings, records, similar, books, answers]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for module in MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for module in MODULES for name, q in module.SQL.items()}
