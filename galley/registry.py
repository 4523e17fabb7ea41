"""Every query of the library and its SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name to callable) and SQL (name to text).
MODULES: tuple[str, ...] = (
    "galley.operators.nutrition", "galley.operators.scalars", "galley.operators.search", "galley.operators.audit", "galley.operators.quantities",
    "galley.operators.more", "galley.operators.shown", "galley.operators.names", "galley.operators.kitchen", "galley.operators.graph", "galley.operators.parsing", "galley.operators.matching", "galley.operators.recipe_audit", "galley.operators.crosscheck", "galley.streaming.progress", "galley.streaming.imports",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(m).SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["AGG-1_nutrition_profile"](spark, sf_dir)
