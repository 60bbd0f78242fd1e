"""Column-level building blocks shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when the denominator is 0 or NULL."""
    return col(num) / F.nullif(col(den).cast("double"), F.lit(0.0))


def clean_nan(c: str | Column) -> Column:
    """NaN becomes NULL so that Spark aggregates skip it."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def linear_quantile(c: str | Column, p: float) -> Column:
    """Exact interpolated quantile as an aggregate. Its buffer holds the distinct values of one group, so use it
    only where a group is bounded (an entity's days, a station's hours); use `exact_quantiles` elsewhere."""
    return F.percentile(col(c).cast("double"), F.lit(float(p)))


def linear_quantiles(c: str | Column, probs: Sequence[float]) -> Column:
    """Several interpolated quantiles from one buffer, as an array."""
    return F.percentile(col(c).cast("double"), F.array(*[F.lit(float(p)) for p in probs]))


def time_order(entity: Sequence[str], time: str, *more: str) -> WindowSpec:
    """Entity partition ordered by time; rows without a time come last."""
    return Window.partitionBy(*entity).orderBy(F.col(time).asc_nulls_last(), *more)


def unique_guard(df: DataFrame, entity: Sequence[str], time: str) -> DataFrame:
    """Fails the query when a (entity, time) pair occurs twice.

    The check is a lag over the window the caller uses anyway, so it costs neither an extra job nor an extra shuffle.
    """
    w = time_order(entity, time)
    prev = F.lag(F.col(time)).over(w)
    message = F.lit(f"duplicate ({', '.join(entity)}, {time}): aggregate to one row per step before shifting rows")
    return (
        df.withColumn("_prev_time", prev)
        .filter(F.assert_true(F.coalesce(F.col("_prev_time") != F.col(time), F.lit(True)), message).isNull())
        .drop("_prev_time")
    )


def null_if_any_null(keys: Sequence[str], value: Column) -> Column:
    """Rows with a NULL key belong to no group: their group-derived value is NULL."""
    if not keys:
        return value
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return F.when(ok, value)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns not in frame: {missing}")


def require_new(df: DataFrame, columns: Sequence[str]) -> None:
    clash = [c for c in columns if c in df.columns]
    if clash:
        raise ValueError(f"columns already in frame: {clash}")
