"""Target transforms, prediction post-processing and soft capping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.core.scale import exact_quantiles, salted_join


def _c(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def _fail(message: str) -> Column:
    return F.raise_error(F.lit(message)).cast("double")


def log_target(y: str | Column) -> Column:
    """log1p; values below -1 fail the query."""
    v = _c(y)
    return F.when(v < -1, _fail("log1p needs values >= -1")).otherwise(F.log1p(v))


def inverse_log_target(y: str | Column, clip: bool = True) -> Column:
    v = F.expm1(_c(y))
    return F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))) if clip else v


def sqrt_target(y: str | Column) -> Column:
    v = _c(y)
    return F.when(v < 0, _fail("sqrt needs values >= 0")).otherwise(F.sqrt(v))


def inverse_sqrt_target(y: str | Column, clip: bool = True) -> Column:
    v = _c(y)
    base = F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))) if clip else v
    return base * base


def offset_target(y: str | Column, capacity: str | Column) -> Column:
    """log1p(max(y, 0)) - log1p(capacity)"""
    v = _c(y)
    return F.when(v.isNotNull(), F.log1p(F.greatest(v, F.lit(0.0)))) - F.log1p(_c(capacity))


def add_offset_back(offset: str | Column, capacity: str | Column) -> Column:
    return _c(offset) + F.log1p(_c(capacity))


def postprocess(
    value: str | Column, clip_min: float | None = 0.0, clip_max: float | None = None, to_integer: bool = False
) -> Column:
    """Clip, then round half to even."""
    v = _c(value)
    out = v
    if clip_min is not None:
        out = F.greatest(out, F.lit(float(clip_min)))
    if clip_max is not None:
        out = F.least(out, F.lit(float(clip_max)))
    if to_integer:
        out = F.bround(out, 0)
    return F.when(v.isNotNull(), out)


def postprocess_report(
    df: DataFrame, value: str, clip_min: float | None = 0.0, clip_max: float | None = None
) -> DataFrame:
    v = F.col(value)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count_if(v < clip_min) if clip_min is not None else F.lit(0)).cast("bigint").alias("raised"),
        (F.count_if(v > clip_max) if clip_max is not None else F.lit(0)).cast("bigint").alias("lowered"),
    )


def soften_outliers(
    df: DataFrame, value: str, group: Sequence[str], out: str, blend: float = 0.62, iqr_factor: float = 1.5
) -> DataFrame:
    """(1 - blend) * y + blend * min(y, Q3 + factor * IQR of the group). The quartiles are exact for groups of any
    size; without a group the ceiling is global."""
    if not 0 <= blend <= 1 or iqr_factor < 0:
        raise ValueError("blend must be in [0, 1] and iqr_factor >= 0")
    # NULL is a group of its own here
    keys = {f"_g{i}": F.coalesce(F.col(g).cast("string"), F.lit("\u0000")) for i, g in enumerate(group)}
    df = df.withColumns(keys) if keys else df
    q = exact_quantiles(df, value, {"_q1": 0.25, "_q3": 0.75}, list(keys))
    ceiling = F.col("_q3") + F.lit(iqr_factor) * (F.col("_q3") - F.col("_q1"))
    if group:
        # a few groups may hold all rows: each is spread over tasks, and its one ceiling repeated for them
        joined = salted_join(df, q.withColumn("_cap", ceiling).drop("_q1", "_q3"), list(keys), 32, "left")
    else:
        joined = df.withColumn("_cap", q.select(ceiling.alias("c")).scalar())
    y = F.col(value)
    return joined.withColumn(
        out, F.lit(1.0 - blend) * y + F.lit(blend) * F.when(y.isNotNull(), F.least(y, F.col("_cap")))
    ).drop("_cap", *keys)
