"""Daily weather derivatives, exposure interactions and hourly-to-daily reducers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.exprs import linear_quantile, linear_quantiles, safe_div, time_order
from panelforge.functions.season import leaf_season
from panelforge.operators.windows import with_run_length

# Fixed values of the physical derivatives.
NEUTRAL_C = 18.0
TROPICAL_NIGHT_C = 22.0
DRY_DAY_MM = 1.0
HOT_DAY_C = 32.0


def _last_rows(entity: Sequence[str], time: str, n: int, skip: int = 0):
    return time_order(entity, time).rowsBetween(-(n - 1 + skip), -skip)


def physical_derivatives(
    df: DataFrame,
    entity: Sequence[str],
    time: str,
    t_mean: str,
    t_max: str | None = None,
    t_min: str | None = None,
    rain: str | None = None,
    wind: str | None = None,
    drought_days: int = 10,
) -> DataFrame:
    """Degree days, daily range, tropical-night and drought runs, first rain after a drought, 7-day rain, 3-day wind
    maximum and their product."""
    w = time_order(entity, time)
    temp = F.col(t_mean).cast("double")
    out = df.withColumns(
        {
            "heating_degree_days": F.greatest(F.lit(NEUTRAL_C) - temp, F.lit(0.0)),
            "cooling_degree_days": F.greatest(temp - F.lit(NEUTRAL_C), F.lit(0.0)),
        }
    )
    # greatest() skips NULL, a missing temperature must stay missing
    for c in ("heating_degree_days", "cooling_degree_days"):
        out = out.withColumn(c, F.when(temp.isNotNull(), F.col(c)))
    if t_max and t_min:
        out = out.withColumn("daily_range", F.col(t_max) - F.col(t_min))
    if t_min:
        out = with_run_length(out, F.col(t_min) > TROPICAL_NIGHT_C, entity, time, "tropical_night_run")
    if rain:
        out = with_run_length(out, F.col(rain) < DRY_DAY_MM, entity, time, "drought_run")
        before = F.coalesce(F.lag("drought_run").over(w), F.lit(0))
        wet = F.coalesce(F.col(rain) >= DRY_DAY_MM, F.lit(False))
        out = out.withColumns(
            {
                "first_rain_after_drought": (wet & (before >= drought_days)).cast("int"),
                "rain_7d": F.sum(rain).over(_last_rows(entity, time, 7)),
            }
        )
    if wind:
        out = out.withColumn("wind_3d_max", F.max(wind).over(_last_rows(entity, time, 3)))
        if rain:
            out = out.withColumn("wet_wind", F.col("rain_7d") * F.col(wind))
    return out


def weather_accumulators(
    df: DataFrame,
    entity: Sequence[str],
    time: str,
    values: Sequence[str],
    windows: Sequence[int] = (3, 7, 14),
    horizon: int = 0,
    lead_windows: Sequence[int] = (),
) -> DataFrame:
    """Backward maxima and means ending `horizon` rows back, and forward maxima where a forecast is known."""
    w = time_order(entity, time)
    new: dict[str, Column] = {}
    for c in values:
        for n in windows:
            frame = _last_rows(entity, time, n, horizon)
            new[f"{c}_back{n}_max"] = F.max(c).over(frame)
            new[f"{c}_back{n}_mean"] = F.avg(c).over(frame)
        for n in lead_windows:
            new[f"{c}_ahead{n}_max"] = F.max(c).over(w.rowsBetween(0, n - 1))
    return df.withColumns(new)


def rain_anomaly(
    df: DataFrame, rain: str, entity: Sequence[str], time: str, windows: Sequence[int] = (7, 30, 90)
) -> DataFrame:
    """Rolling sum minus the expanding mean of that rolling sum."""
    so_far = time_order(entity, time).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.withColumns({f"_sum{n}": F.sum(rain).over(_last_rows(entity, time, n)) for n in windows})
    return sums.withColumns(
        {f"{rain}_anomaly{n}d": F.col(f"_sum{n}") - F.avg(f"_sum{n}").over(so_far) for n in windows}
    ).drop(*[f"_sum{n}" for n in windows])


def antecedent_rain(df: DataFrame, rain: str, entity: Sequence[str], time: str, days: int = 7) -> DataFrame:
    """Rain of the previous `days` rows of the same entity, today excluded; 0 without any."""
    frame = time_order(entity, time).rowsBetween(-days, -1)
    return df.withColumn(f"antecedent_rain_{days}d", F.coalesce(F.sum(rain).over(frame), F.lit(0.0)))


def hot_streak(df: DataFrame, t_max: str, entity: Sequence[str], time: str, threshold: float = HOT_DAY_C) -> DataFrame:
    return with_run_length(df, F.col(t_max) > threshold, entity, time, "hot_streak")


def thermal_inertia(
    df: DataFrame,
    t_mean: str,
    entity: Sequence[str],
    time: str,
    bases: Sequence[float] = (18, 22, 24),
    windows: Sequence[int] = (3, 7, 14),
) -> DataFrame:
    """Degree days above several bases and their rolling means."""
    out = df.withColumns(
        {
            f"cdd{b:g}": F.when(F.col(t_mean).isNotNull(), F.greatest(F.col(t_mean) - F.lit(float(b)), F.lit(0.0)))
            for b in bases
        }
    )
    return out.withColumns(
        {
            f"{c}_mean{n}": F.avg(c).over(_last_rows(entity, time, n))
            for c in [t_mean, *[f"cdd{b:g}" for b in bases]]
            for n in windows
        }
    )


# Input roles with the column names that may hold them, and the interaction recipes over roles.
EXPOSURE_ALIASES: dict[str, tuple[str, ...]] = {
    "tree": ("tree_share", "tree_cover_share", "tree_cover_fraction"),
    "wind": ("wind_max", "wind_speed_10m_max"),
    "gust_hours": ("gust_20ms_hours", "gust_15ms_hours", "gust_25ms_hours"),
    "soil": ("soil_moisture_mean", "soil_wet_hours", "humidity_mean"),
    "leaf": ("leaf_season",),
    "wet": ("antecedent_rain_7d",),
    "settlement": ("settlement_share", "built_up_fraction"),
    "cooling": ("cooling_degree_days", "t_max"),
    "network": ("distribution_line_km", "transmission_line_km", "transformers"),
    "hot_streak": ("hot_streak",),
}
EXPOSURE_RECIPES: dict[str, tuple[str, ...]] = {
    "exposure_wind_tree": ("wind", "tree"),
    "exposure_gust_tree": ("gust_hours", "tree"),
    "exposure_gust_tree_leaf": ("gust_hours", "tree", "leaf"),
    "exposure_wind_tree_wet": ("wind", "tree", "wet"),
    "exposure_wind_tree_soil": ("wind", "tree", "soil"),
    "exposure_hot_settlement": ("cooling", "settlement"),
    "exposure_hot_streak": ("hot_streak",),
    "exposure_hot_streak_settlement": ("hot_streak", "settlement"),
    "exposure_network_hot": ("network", "cooling"),
}


def exposure_interactions(
    df: DataFrame,
    entity: Sequence[str],
    time: str,
    rain: str | None = None,
    t_max: str | None = None,
    recipes: Mapping[str, Sequence[str]] | None = None,
    aliases: Mapping[str, Sequence[str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Products of the roles that are present, and a report with the missing roles of every skipped recipe."""
    aliases = EXPOSURE_ALIASES if aliases is None else aliases
    out = df.withColumn("leaf_season", leaf_season(time))
    if rain:
        out = antecedent_rain(out, rain, entity, time)
    if t_max:
        out = hot_streak(out, t_max, entity, time)
    new: dict[str, Column] = {}
    report: list[tuple[str, str, str]] = []
    for name, roles in (recipes or EXPOSURE_RECIPES).items():
        found = {r: next((c for c in aliases.get(r, (r,)) if c in out.columns), None) for r in roles}
        missing = [r for r, c in found.items() if c is None]
        if missing:
            report.append((name, "skipped", "missing " + ", ".join(missing)))
            continue
        product = F.lit(1.0)
        for r in roles:
            product = product * F.col(found[r]).cast("double")
        new[name] = product
        report.append((name, "built", " x ".join(found[r] for r in roles)))
    table = df.sparkSession.createDataFrame(report, "recipe string, state string, detail string")
    return out.withColumns(new), table


def circular_mean(degrees: str | Column) -> Column:
    """Mean direction in [0, 360), rounded to 9 decimals before the wrap."""
    r = F.radians(F.col(degrees) if isinstance(degrees, str) else degrees)
    angle = F.round(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), 9)
    return F.when(angle < 0, angle + 360.0).otherwise(angle)


def circular_std(degrees: str | Column) -> Column:
    """sqrt(-2 ln R) of the mean resultant length R, in radians."""
    r = F.radians(F.col(degrees) if isinstance(degrees, str) else degrees)
    length = F.hypot(F.avg(F.sin(r)), F.avg(F.cos(r)))
    length = F.least(F.greatest(length, F.lit(1e-12)), F.lit(1.0))
    return F.sqrt(F.abs(F.lit(-2.0) * F.ln(length)))


def hourly_to_daily(
    df: DataFrame,
    time: str,
    keys: Sequence[str],
    values: Sequence[str],
    quantiles: Sequence[float] = (0.1, 0.5, 0.9),
    directions: Sequence[str] = (),
    day: str = "day",
) -> DataFrame:
    """Mean, min, max, sample std and quantiles per key and day; circular mean with its sine and cosine for directions.

    The input is an hourly feed, so a group holds at most a day of readings and the exact quantile buffer is bounded.
    """
    aggs: list[Column] = []
    for v in values:
        aggs += [
            F.avg(v).alias(f"{v}_mean"),
            F.min(v).alias(f"{v}_min"),
            F.max(v).alias(f"{v}_max"),
            F.stddev_samp(v).alias(f"{v}_std"),
        ]
        aggs.append(linear_quantiles(v, quantiles).alias(f"_q_{v}"))
    aggs += [circular_mean(d).alias(f"{d}_circular_mean") for d in directions]
    out = df.groupBy(*keys, F.to_date(time).alias(day)).agg(*aggs)
    for v in values:
        named = {f"{v}_q{round(q * 100):02d}": F.get(f"_q_{v}", F.lit(i)) for i, q in enumerate(quantiles)}
        out = out.withColumns(named).drop(f"_q_{v}")
    for d in directions:
        r = F.radians(F.col(f"{d}_circular_mean"))
        out = out.withColumns({f"{d}_sin": F.sin(r), f"{d}_cos": F.cos(r)})
    return out


# Hourly thresholds (m/s) and quantile levels.
SPEED_THRESHOLDS = (8, 10, 12)
GUST_THRESHOLDS = (15, 20, 25)
SPEED_QUANTILES = (0.25, 0.5, 0.75, 0.9)


def wind_pressure_daily(
    df: DataFrame, time: str, keys: Sequence[str], speed: str, gust: str, direction: str, pressure: str
) -> DataFrame:
    """Pressure statistics and largest 3-hour drop, hours over wind and gust thresholds, quantiles, circular spread,
    turn of the mean direction against the day before, and the direction at the strongest gust."""
    w = time_order(keys, time)
    hours = df.withColumn("_change3", F.col(pressure) - F.lag(pressure, 3).over(w))
    peak_key = F.when(
        F.col(gust).isNotNull() & F.col(direction).isNotNull(), F.struct(F.col(gust), -F.unix_timestamp(time))
    )
    aggs = [
        F.min(pressure).alias("pressure_min"),
        F.avg(pressure).alias("pressure_mean"),
        F.stddev_samp(pressure).alias("pressure_std"),
        F.greatest(-F.min("_change3"), F.lit(0.0)).alias("_drop"),
        F.count("_change3").alias("_drops"),
        linear_quantiles(speed, SPEED_QUANTILES).alias("_sq"),
        linear_quantile(gust, 0.9).alias("gust_q90"),
        linear_quantiles(direction, (0.01, 0.99)).alias("_dq"),
        F.degrees(circular_std(direction)).alias("direction_std"),
        circular_mean(direction).alias("_mean_dir"),
        F.max_by(direction, peak_key).alias("_peak_dir"),
        *[F.count_if(F.col(speed) >= s).alias(f"speed_{s}ms_hours") for s in SPEED_THRESHOLDS],
        *[F.count_if(F.col(gust) >= g).alias(f"gust_{g}ms_hours") for g in GUST_THRESHOLDS],
    ]
    daily = hours.groupBy(*keys, F.to_date(time).alias("day")).agg(*aggs)
    speeds = {f"speed_q{round(q * 100):02d}": F.get("_sq", F.lit(i)) for i, q in enumerate(SPEED_QUANTILES)}
    daily = daily.withColumns(
        {**speeds, "direction_q01": F.get("_dq", F.lit(0)), "direction_q99": F.get("_dq", F.lit(1))}
    ).drop("_sq", "_dq")
    turn = F.abs(F.col("_mean_dir") - F.lag("_mean_dir").over(time_order(keys, "day")))
    return daily.withColumns(
        {
            "pressure_drop_3h": F.when(F.col("_drops") > 0, F.col("_drop")),
            "direction_change": F.least(turn, F.lit(360.0) - turn),
            "direction_sin": F.sin(F.radians("_mean_dir")),
            "direction_cos": F.cos(F.radians("_mean_dir")),
            "gust_direction_sin": F.sin(F.radians("_peak_dir")),
            "gust_direction_cos": F.cos(F.radians("_peak_dir")),
        }
    ).drop("_drop", "_drops", "_mean_dir", "_peak_dir")


def threshold_daily(
    df: DataFrame,
    time: str,
    keys: Sequence[str],
    stats: Mapping[str, Sequence[str]],
    hours: Mapping[str, tuple[str, str, float]],
) -> DataFrame:
    """Daily reducer driven by a table: `stats` maps a column to mean/min/max/sum, `hours` maps an output name to
    (column, '>=' or '<=' or '<' or '>', threshold) and counts the hours that meet it."""
    pick = {"mean": F.avg, "min": F.min, "max": F.max, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0))}
    aggs = [pick[s](c).alias(f"{c}_{s}") for c, names in stats.items() for s in names]
    for name, (c, op, limit) in hours.items():
        x = F.col(c)
        cond = {">=": x >= limit, ">": x > limit, "<=": x <= limit, "<": x < limit}[op]
        aggs.append(F.count_if(cond).alias(name))
    return df.groupBy(*keys, F.to_date(time).alias("day")).agg(*aggs)


def humidity_soil_daily(df: DataFrame, time: str, keys: Sequence[str]) -> DataFrame:
    """Fixed thresholds: humid from 90 %, fog from 97 %, dry below 30 %, wet soil from 0.35 m3/m3."""
    return threshold_daily(
        df,
        time,
        keys,
        {
            "humidity": ("mean", "min", "max"),
            "dew_point": ("mean", "max"),
            "soil_moisture": ("mean", "max"),
            "vpd": ("mean", "max"),
            "low_cloud": ("mean",),
            "et0": ("sum",),
        },
        {
            "humid_hours": ("humidity", ">=", 90.0),
            "fog_hours": ("humidity", ">=", 97.0),
            "dry_hours": ("humidity", "<", 30.0),
            "soil_wet_hours": ("soil_moisture", ">=", 0.35),
        },
    )


def convective_daily(df: DataFrame, time: str, keys: Sequence[str]) -> DataFrame:
    """Fixed thresholds: CAPE from 1000 moderate and 2500 strong, lifted index to -2 unstable and -6 severe."""
    return threshold_daily(
        df,
        time,
        keys,
        {"cape": ("max", "mean"), "lifted_index": ("min",), "cin": ("min",)},
        {
            "cape_moderate_hours": ("cape", ">=", 1000.0),
            "cape_strong_hours": ("cape", ">=", 2500.0),
            "unstable_hours": ("lifted_index", "<=", -2.0),
            "severe_hours": ("lifted_index", "<=", -6.0),
        },
    )


def air_quality_daily(df: DataFrame, time: str, keys: Sequence[str]) -> DataFrame:
    """Fixed thresholds: PM10 limit 50 and high 100, dust transport from 20 ug/m3."""
    return threshold_daily(
        df,
        time,
        keys,
        {"pm10": ("mean", "max"), "pm25": ("mean",), "dust": ("mean", "max")},
        {
            "pm10_limit_hours": ("pm10", ">=", 50.0),
            "pm10_high_hours": ("pm10", ">=", 100.0),
            "dust_transport_hours": ("dust", ">=", 20.0),
        },
    )


def local_daily_from_hourly(
    df: DataFrame, time: str, values: Sequence[str], zone: str = "Europe/Istanbul", keys: Sequence[str] = ()
) -> DataFrame:
    """UTC hourly series to days of the local zone: sum, mean and maximum."""
    local = F.to_date(F.from_utc_timestamp(F.col(time).cast("timestamp"), zone))
    aggs = []
    for v in values:
        aggs += [F.sum(v).alias(f"{v}_sum"), F.avg(v).alias(f"{v}_mean"), F.max(v).alias(f"{v}_max")]
    return df.groupBy(*keys, local.alias("day")).agg(*aggs)


def national_index(df: DataFrame, time: str, value: str) -> DataFrame:
    """Daily total, peak, peak over mean, the total 364 days earlier and the log growth against it."""
    daily = df.groupBy(F.to_date(time).alias("day")).agg(
        F.sum(value).alias("national_total"),
        F.max(value).alias("national_peak"),
        safe_div(F.max(value), F.avg(value)).alias("national_peak_ratio"),
    )
    earlier = daily.select(
        F.date_add("day", 364).alias("day"), F.col("national_total").alias("national_year_ago")
    )
    ratio = safe_div("national_total", "national_year_ago")
    return daily.join(earlier, "day", "left").withColumn(
        "national_growth", F.when(ratio > 0, F.ln(ratio))
    )


def regional_aggregates(
    df: DataFrame, time: str, values: Sequence[str], quantiles: Sequence[float] = (0.1, 0.5, 0.9), prefix: str = "region"
) -> DataFrame:
    """Same-day mean, max, std and quantiles over all entities, joined back, and the local deviation from the mean.

    One day may hold every entity, so quantiles come from distributed positions, not from a per-day buffer.
    """
    from panelforge.core.scale import exact_quantiles

    aggs = []
    for v in values:
        aggs += [
            F.avg(v).alias(f"{prefix}_{v}_mean"),
            F.max(v).alias(f"{prefix}_{v}_max"),
            F.stddev_samp(v).alias(f"{prefix}_{v}_std"),
        ]
    regional = df.groupBy(time).agg(*aggs)
    for v in values:
        names = {f"{prefix}_{v}_q{round(q * 100):02d}": q for q in quantiles}
        regional = regional.join(exact_quantiles(df, v, names, [time]), time, "left")
    out = df.join(regional, time, "left")
    return out.withColumns({f"{v}_{prefix}_diff": F.col(v) - F.col(f"{prefix}_{v}_mean") for v in values})


def weather_flags(t_max: str, t_min: str, gust: str, rain: str) -> dict[str, Column]:
    """Extreme hot, extreme cold, storm and severe flags; a missing reading raises no flag."""
    flags = {
        "extreme_hot": F.col(t_max) > 35,
        "extreme_cold": F.col(t_min) < 0,
        "storm": F.col(gust) > 60,
        "severe": (F.col(rain) > 20) & (F.col(gust) > 50),
    }
    return {name: F.coalesce(c, F.lit(False)).cast("int") for name, c in flags.items()}
