"""Reading the tables that queries run over."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Python workers on this machine find the library too; on a cluster it is sent with --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH", ""), ROOT]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, by any path that Spark can open."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns, new or replaced, that are worked out once a row.

    Spark puts a column's expression in place of its name in what is built on it, lambdas included, where it runs again
    for every element; it does not move expressions across a generator.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.withColumns(columns).select(*rest, F.inline(F.array(F.struct(*columns))))
