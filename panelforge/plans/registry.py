"""Query registry used by the entry module, the bench and the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy parquet readers for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Registers a plan under `name`; `covers` lists the inventory ids it exercises."""

    def deco(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def rnd(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded double; adding 0.0 turns -0.0 into 0.0."""
    out = F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits) + F.lit(0.0)
    return out.alias(name if name else c)


def sql_rnd(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def rounded(df: DataFrame, keep: list[str], digits: int = 6) -> DataFrame:
    """Keeps the named columns as they are and rounds every other one."""
    return df.select(*[F.col(c) if c in keep else rnd(c, digits=digits) for c in df.columns])
