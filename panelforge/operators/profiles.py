"""Leak-free entity profiles: fitted on one frame, applied to another. `origin_blocks` builds rolling-origin blocks of them.

`by` adds leading keys (a block name) so that all blocks are fitted in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.exprs import linear_quantiles, safe_div
from panelforge.core.scale import cut_lineage, join_checked
from panelforge.operators.columns import capacity_bucket

# Fixed values of the summaries.
RECENT_WINDOWS = (7, 14, 30, 60, 90)
DEAD_AFTER_ROWS = 14
SUMMER_MONTHS = (6, 7)
WINTER_MONTHS = (1, 2, 3)
SEASON_MIN_DAYS = 15


@dataclass(frozen=True)
class EntitySummaries:
    """Four tables keyed by (by..., entity): level (with thermal slopes), weekday and month deviations."""

    level: DataFrame
    weekday: DataFrame
    month: DataFrame
    entity: str
    by: tuple[str, ...]


def log_target(target: str) -> Column:
    return F.log1p(F.greatest(F.col(target).cast("double"), F.lit(0.0)))


def _guarded_slope(y: Column, x: Column) -> Column:
    """OLS slope with at least 3 pairs and 3 distinct x; the set is bounded by the entity's days."""
    pair = y.isNotNull() & x.isNotNull()
    distinct = F.size(F.collect_set(F.when(pair, x)))
    return F.when((F.count_if(pair) >= 3) & (distinct >= 3), F.regr_slope(y, x))


def profile_deviations(source: DataFrame, entity: str, time: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Row deviations from the entity's log mean, with weekday and month."""
    y = F.when(F.col(target).isNotNull(), log_target(target))
    w = Window.partitionBy(*by, entity)
    return source.withColumns(
        {"_dev": y - F.avg(y).over(w), "_dow": F.weekday(F.to_date(time)), "_moy": F.month(F.to_date(time))}
    )


def entity_summaries(
    fit: DataFrame,
    entity: str,
    time: str,
    target: str,
    capacity: str,
    profile_source: DataFrame | None = None,
    target_window: tuple[Column, Column] | None = None,
    degree_columns: Sequence[str] = (),
    by: Sequence[str] = (),
) -> EntitySummaries:
    """Level, recency, death, last-year, season, trend and thermal-slope summaries of every entity in `fit`.

    One shuffle by entity serves the two windows and the aggregation; `target_window` holds the first and last day of
    the rows the summaries will be applied to (columns of `fit` or literals)."""
    by = list(by)
    day = F.to_date(time)
    entity_rows = Window.partitionBy(*by, entity)
    if by:
        bounds = fit.groupBy(*by).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
        base = join_checked(fit, bounds, by, "inner")
    else:
        base = fit.withColumns(
            {"_lo": fit.agg(F.min(day).alias("b")).scalar(), "_hi": fit.agg(F.max(day).alias("b")).scalar()}
        )
    positive = F.col(target) > 0
    rows = base.withColumns(
        {
            "_day": day,
            "_y": F.when(F.col(target).isNotNull(), log_target(target)),
            "_age": F.datediff("_hi", day),
            "_dayno": F.datediff(day, "_lo").cast("double"),
            "_zero": F.coalesce(F.col(target) <= 0, F.lit(False)).cast("double"),
            "_last_pos": F.max(F.when(positive, day)).over(entity_rows),
        }
    )
    tail = F.col("_last_pos").isNull() | (F.col("_day") > F.col("_last_pos"))
    month = F.month("_day")
    summer, winter = month.isin(*SUMMER_MONTHS), month.isin(*WINTER_MONTHS)
    cap24 = F.min_by(F.col(capacity).cast("double"), "_day") * 24.0
    aggs = [
        F.avg("_y").alias("log_mean"),
        F.stddev_pop("_y").alias("log_std"),
        linear_quantiles("_y", (0.5, 0.1, 0.9)).alias("_q"),
        F.count(F.lit(1)).alias("days"),
        F.avg("_zero").alias("zero_share"),
        safe_div(F.avg(target), cap24).alias("load_factor"),
        F.when(F.count("_y") >= 3, F.regr_slope("_y", "_dayno")).alias("trend"),
        F.count_if(tail).alias("tail_zero_run"),
        F.min("_age").alias("last_row_age"),
        F.count_if(summer).alias("_ns"),
        F.count_if(winter).alias("_nw"),
        (F.avg(F.when(summer, F.col("_y"))) - F.avg(F.when(winter, F.col("_y")))).alias("_season"),
    ]
    for n in RECENT_WINDOWS:
        recent = F.col("_age") <= n - 1
        aggs += [
            F.avg(F.when(recent, F.col("_y"))).alias(f"log_last{n}"),
            F.count_if(recent).alias(f"last{n}_days"),
        ]
    if target_window is not None:
        a, b = (F.date_sub(c, 365) for c in target_window)
        inside = F.col("_day").between(a, b)
        aggs += [
            F.avg(F.when(inside, F.col("_y"))).alias("last_year_log_mean"),
            F.avg(F.when(inside, F.col("_zero"))).alias("last_year_zero_share"),
            F.nullif(F.count_if(inside), F.lit(0)).alias("last_year_days"),
        ]
    for c in degree_columns:
        aggs.append(_guarded_slope(F.col("_y"), F.col(c).cast("double")).alias(f"slope_{c}"))
    level = rows.groupBy(*by, entity).agg(*aggs)
    quantiles = {n: F.get("_q", F.lit(i)) for i, n in enumerate(("log_median", "log_p10", "log_p90"))}
    level = level.withColumns(quantiles).drop("_q")
    if target_window is None:
        level = level.withColumns(
            {
                "last_year_log_mean": F.lit(None).cast("double"),
                "last_year_zero_share": F.lit(None).cast("double"),
                "last_year_days": F.lit(None).cast("bigint"),
            }
        )
    level = level.withColumns(
        {
            "dead": (F.col("tail_zero_run") >= DEAD_AFTER_ROWS).cast("int"),
            "spread": F.col("log_p90") - F.col("log_p10"),
            "drift": F.col("log_last14") - F.col("log_mean"),
            "season_amplitude": F.when(
                (F.col("_ns") >= SEASON_MIN_DAYS) & (F.col("_nw") >= SEASON_MIN_DAYS), F.col("_season")
            ),
            "season_days": F.least("_ns", "_nw"),
        }
    ).drop("_ns", "_nw", "_season")

    dev = profile_deviations(profile_source if profile_source is not None else fit, entity, time, target, by)
    weekday = dev.groupBy(*by, entity, "_dow").agg(F.avg("_dev").alias("dow_deviation"))
    monthly = dev.groupBy(*by, entity, "_moy").agg(F.avg("_dev").alias("month_deviation"))
    amplitude = weekday.groupBy(*by, entity).agg(F.stddev_pop("dow_deviation").alias("dow_amplitude"))
    level = level.join(amplitude, [*by, entity], "left")
    return EntitySummaries(level, weekday, monthly, entity, tuple(by))


def apply_summaries(rows: DataFrame, s: EntitySummaries, time: str, cold: str = "cold") -> DataFrame:
    """Attaches the summaries; entities without fit rows are `cold` and keep NULL levels and NULL profiles."""
    keys = [*s.by, s.entity]
    day = F.to_date(time)
    out = rows.withColumns({"_dow": F.weekday(day), "_moy": F.month(day)})
    out = out.join(s.level.withColumn("_seen", F.lit(1)), keys, "left")
    out = out.join(s.weekday, [*keys, "_dow"], "left").join(s.month, [*keys, "_moy"], "left")
    is_cold = F.col("_seen").isNull()
    return out.withColumns(
        {
            cold: is_cold.cast("int"),
            "dow_deviation": F.when(~is_cold, F.col("dow_deviation")),
            "month_deviation": F.when(~is_cold, F.col("month_deviation")),
        }
    ).drop("_dow", "_moy", "_seen")


def add_group_levels(
    rows: DataFrame, fit: DataFrame, target: str, capacity: str, district: str, by: Sequence[str] = ()
) -> DataFrame:
    """Fallback levels for cold entities: capacity-bucket mean, district mean, and the mean and size of their cell. The
    fit rows are read once into (bucket, district) cells; the coarser means are sums of cells."""
    by = list(by)
    y = F.when(F.col(target).isNotNull(), log_target(target))
    cells = cut_lineage(
        fit.withColumns({"bucket": capacity_bucket(capacity), "_y": y})
        .groupBy(*by, district, "bucket")
        .agg(F.sum("_y").alias("_s"), F.count("_y").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    )
    return attach_group_levels(rows, cells, capacity, district, by)


def attach_group_levels(rows: DataFrame, cells: DataFrame, capacity: str, district: str, by: Sequence[str] = ()) -> DataFrame:
    """`cells` (by..., district, bucket, _s, _n, _rows): sum and count of logs, and rows."""
    by = list(by)
    bucket = cells.groupBy(*by, "bucket").agg(safe_div(F.sum("_s"), F.sum("_n")).alias("bucket_log_mean"))
    dist = cells.groupBy(*by, district).agg(safe_div(F.sum("_s"), F.sum("_n")).alias("district_log_mean"))
    cell = cells.select(
        *by, district, "bucket", safe_div("_s", "_n").alias("cell_log_mean"), F.col("_rows").alias("cell_rows")
    )
    out = rows.withColumn("bucket", capacity_bucket(capacity))
    out = join_checked(out, bucket, [*by, "bucket"])
    out = join_checked(out, dist, [*by, district])
    out = join_checked(out, cell, [*by, district, "bucket"])
    return out.withColumn("cell_rows", F.coalesce("cell_rows", F.lit(0)))


def add_group_profiles(
    rows: DataFrame,
    profile_source: DataFrame,
    entity: str,
    time: str,
    target: str,
    capacity: str,
    district: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """District x month, district x weekday and bucket x month mean deviations from the entity level.

    The deviations collapse once into (district, bucket, month, weekday) cells; the three profiles are sums of cells."""
    by = list(by)
    dev = profile_deviations(profile_source, entity, time, target, by).withColumn("bucket", capacity_bucket(capacity))
    cells = cut_lineage(
        dev.groupBy(*by, district, "bucket", "_moy", "_dow").agg(F.sum("_dev").alias("_s"), F.count("_dev").alias("_n"))
    )
    return attach_group_profiles(rows, cells, time, capacity, district, by)


def attach_group_profiles(rows: DataFrame, cells: DataFrame, time: str, capacity: str, district: str, by: Sequence[str] = ()) -> DataFrame:
    """`cells` (by..., district, bucket, _moy, _dow, _s, _n): sum and count of deviations."""
    by = list(by)
    day = F.to_date(time)
    had_bucket = "bucket" in rows.columns
    out = rows.withColumns({"_moy": F.month(day), "_dow": F.weekday(day)})
    if not had_bucket:
        out = out.withColumn("bucket", capacity_bucket(capacity))
    for name, keys in (
        ("district_month_dev", [district, "_moy"]),
        ("district_dow_dev", [district, "_dow"]),
        ("bucket_month_dev", ["bucket", "_moy"]),
    ):
        table = cells.groupBy(*by, *keys).agg(safe_div(F.sum("_s"), F.sum("_n")).alias(name))
        out = join_checked(out, table, [*by, *keys])
    return out.drop("_moy", "_dow", *([] if had_bucket else ["bucket"]))
