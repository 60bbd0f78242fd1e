"""Contracted publication, incremental refresh and prediction output."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.core.exprs import require_columns
from panelforge.operators.topk import align_to_sample

_CONTRACT = "_contract"
_CONTRACT_SCHEMA = "source string, rows long, columns array<string>, version string"


def _contract_path(path: str) -> str:
    return f"{path.rstrip('/')}.{_CONTRACT}"


def publish(df: DataFrame, path: str, required: Sequence[str], min_rows: int, source: str) -> int:
    """Writes a new version of the table under `path` and, next to it, a one-row contract of source, rows, columns and
    version. Rows are counted in the written files (footers only). A version below `min_rows` is never named by the
    contract: readers go on with the one before it."""
    require_columns(df, required)
    version = f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.parquet(version)
    rows = df.sparkSession.read.parquet(version).count()
    if rows < min_rows:
        raise ValueError(f"{path}: {rows} rows, at least {min_rows} expected")
    contract = df.sparkSession.createDataFrame([(source, rows, list(df.columns), version)], _CONTRACT_SCHEMA)
    contract.coalesce(1).write.mode("overwrite").json(_contract_path(path))
    return rows


def read_published(
    spark: SparkSession, path: str, required: Sequence[str], min_rows: int, source: str | None = None
) -> DataFrame:
    """The published table after checking it against its contract. Counting parquet rows reads footers only."""
    c = spark.read.schema(_CONTRACT_SCHEMA).json(_contract_path(path)).first()
    if c is None:
        raise ValueError(f"{path}: no contract")
    df = spark.read.parquet(c["version"])
    require_columns(df, required)
    rows = df.count()
    if source is not None and c["source"] != source:
        raise ValueError(f"{path}: published by {c['source']}, not {source}")
    if rows != c["rows"] or list(df.columns) != list(c["columns"]):
        raise ValueError(f"{path}: rows or columns differ from the contract")
    if rows < min_rows:
        raise ValueError(f"{path}: {rows} rows, at least {min_rows} expected")
    return df


@dataclass(frozen=True)
class TableContract:
    name: str
    required: tuple[str, ...]
    min_rows: int


def verify_contracts(tables: dict[str, DataFrame], contracts: Sequence[TableContract]) -> DataFrame:
    """One row per table: rows, missing columns, `ok`. An absent table counts as missing everything."""
    parts = []
    for c in contracts:
        df = tables.get(c.name)
        if df is None:
            raise KeyError(f"no table {c.name}")
        gone = [x for x in c.required if x not in df.columns]
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(c.name).alias("table"),
                "rows",
                F.lit(c.min_rows).cast("bigint").alias("min_rows"),
                F.lit(", ".join(gone)).alias("missing_columns"),
                (F.lit(not gone) & (F.col("rows") >= c.min_rows)).cast("int").alias("ok"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows win on equal keys; among repeated new rows the smallest by all columns. Both frames need the same
    columns. One aggregate over the union: no window over a hot key, no second pass."""
    if set(old.columns) != set(new.columns):
        raise ValueError(f"columns differ: {sorted(set(old.columns) ^ set(new.columns))}")
    rest = [c for c in new.columns if c not in keys]
    both = new.withColumn("_age", F.lit(0)).unionByName(old.withColumn("_age", F.lit(1)))
    best = both.groupBy(*keys).agg(F.min(F.struct("_age", *rest)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*new.columns)


def missing_ranges(
    df: DataFrame, entities: DataFrame, entity: Sequence[str], day: str, start: str, end: str, overlap_days: int = 0
) -> DataFrame:
    """Absent date ranges per entity within [start, end]; each range starts `overlap_days` earlier (not before start) so
    that late revisions are fetched again. Gaps come from the distance to the next seen day, not from listing days."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    seen = df.select(*entity, F.to_date(day).alias("_d")).filter(F.col("_d").between(lo, hi)).distinct()
    edges = entities.select(*entity).distinct().select(
        *entity, F.explode(F.array(F.date_sub(lo, 1), F.date_add(hi, 1))).alias("_d")
    )
    from panelforge.core.exprs import time_order

    w = time_order(entity, "_d")
    nxt = F.lead("_d").over(w)
    gaps = seen.join(entities.select(*entity).distinct(), list(entity), "left_semi").unionByName(edges)
    gaps = gaps.withColumn("_n", nxt).filter(F.datediff("_n", "_d") > 1)
    first = F.date_add("_d", 1)
    return gaps.select(
        *entity,
        F.greatest(F.date_sub(first, overlap_days), lo).alias("from_day"),
        F.date_sub("_n", 1).alias("to_day"),
        (F.datediff("_n", "_d") - 1).alias("missing_days"),
    )


def refresh_range(df: DataFrame, day: str, start: str, end: str, overlap_days: int) -> DataFrame:
    """One row with the range one whole source has to fetch: everything when it starts late or is empty, the tail with an
    overlap when it ends early, NULLs when nothing is missing."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    s = df.agg(F.min(F.to_date(day)).alias("a"), F.max(F.to_date(day)).alias("b"))
    a, b = F.col("a"), F.col("b")
    whole = a.isNull() | (a > lo)
    done = ~whole & (b >= hi)
    start_at = F.when(whole, lo).when(~done, F.greatest(F.date_sub(b, overlap_days), lo))
    return s.select(start_at.alias("from_day"), F.when(~done, hi).alias("to_day"))


def prediction_rows(
    predictions: DataFrame, sample: DataFrame, id_column: str, value: str, position: str, decimals: int = 6
) -> DataFrame:
    """Predictions in sample order, clipped at 0, as fixed-point text, with the sample position."""
    aligned = align_to_sample(predictions.select(id_column, value), sample, id_column, position)
    clipped = F.greatest(F.col(value).cast("double"), F.lit(0.0))
    return aligned.select(
        F.col(id_column), position, F.format_string(f"%.{decimals}f", clipped).alias(value)
    )


def write_predictions(
    predictions: DataFrame, sample: DataFrame, id_column: str, value: str, position: str, path: str, decimals: int = 6
) -> None:
    """CSV in sample order: a distributed sort by position, part files named in that order."""
    rows = prediction_rows(predictions, sample, id_column, value, position, decimals)
    rows.orderBy(position).select(id_column, value).write.mode("overwrite").option("header", "true").csv(path)


def clip_share(predictions: DataFrame, value: str) -> DataFrame:
    v: Column = F.col(value)
    return predictions.agg(F.count(F.lit(1)).alias("rows"), F.count_if(v < 0).alias("clipped"), F.min(v).alias("lowest"))
