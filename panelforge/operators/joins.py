"""Row-preserving attachment of dimensions, series and publication tables, and table merges."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from contextvars import ContextVar
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.core.exprs import require_columns, require_new, safe_div
from panelforge.core.scale import day_table, join_checked
from panelforge.operators.aggregates import month_index

MIN_MATCH_RATE = 0.5


class NoMatchError(ValueError):
    """A source met no row of the panel."""


#: Inside `attach_external` the report judges the matches of every family, not each join.
_JUDGED_LATER: ContextVar[bool] = ContextVar("judged_later", default=False)


class NoOverlapError(ValueError):
    """A source has no year in common with the panel."""


def _one_row_per_key(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One deterministic row per key: the smallest by all columns. A map-side combinable aggregate, not a window."""
    rest = [c for c in table.columns if c not in keys]
    if not rest:
        return table.distinct()
    return table.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*")


def match_rate(df: DataFrame, marker: str) -> DataFrame:
    """One row: rows, matched rows and their ratio."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(marker).alias("matched"),
        safe_div(F.count(marker), F.count(F.lit(1))).alias("match_rate"),
    )


def attach_many_to_one(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    drop: Sequence[str] = (),
    check: bool = True,
    family: str = "source",
) -> tuple[DataFrame, DataFrame | None]:
    """Left join that cannot change the row count: the table keeps one row per key and its columns must be new. Runs no job.
    With `check` the query itself fails if no row finds a match, and the second result is the match rate, a row that is
    computed when it is asked for (`judge_match_rate` warns below one half)."""
    require_columns(table, keys)
    table = table.drop(*[c for c in drop if c in table.columns])
    new = [c for c in table.columns if c not in keys]
    require_new(df, new)
    single = _one_row_per_key(table, keys).withColumn("_hit", F.lit(1))
    rate = match_rate(join_checked(df, single, list(keys)), "_hit") if check else None
    if check and not _JUDGED_LATER.get():
        df = require_match(df, table, keys, family)
    return join_checked(df, single, list(keys)).drop("_hit"), rate


def judge_match_rate(rate: DataFrame, family: str = "source") -> float | None:
    """The match rate as a number: without any match an error, below one half a warning, NULL without rows."""
    return _judged(family, rate.first()["match_rate"])


def _judged(family: str, rate: float | None) -> float | None:
    if rate == 0:
        raise NoMatchError(f"{family}: no row of the panel found a match")
    if rate is not None and rate < MIN_MATCH_RATE:
        warnings.warn(f"{family}: only {rate:.1%} of the rows found a match", stacklevel=3)
    return rate


def require_match(df: DataFrame, table: DataFrame, keys: Sequence[str], family: str) -> DataFrame:
    """The rows of `df`; the query fails if they have no key at all in common with the table. One match is enough, so the
    search for it, a part of the query, ends at the first."""
    found = df.select(*keys).join(table.select(*keys), list(keys), "left_semi").limit(1)
    met = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    message = F.lit(f"{family}: no row of the panel found a match on {list(keys)}")
    return df.withColumn("_met", met).filter(F.assert_true(F.col("_met") > 0, message).isNull()).drop("_met")


def attach_static(df: DataFrame, dim: DataFrame, key: str, drop: Sequence[str] = ()) -> DataFrame:
    return attach_many_to_one(df, dim, [key], drop, family="static")[0]


def add_province_key(df: DataFrame, reference: DataFrame, district: str, province: str) -> DataFrame:
    """Province of each district from a reference table."""
    return attach_many_to_one(df, reference.select(district, province), [district], family="province")[0]


def add_national_series(
    df: DataFrame,
    daily: DataFrame,
    time: str,
    day: str,
    values: Sequence[str],
    horizon: int,
    windows: Sequence[int] = (7, 28),
    prefix: str = "national",
) -> DataFrame:
    """Lag and rolling mean / max of daily series computed before the join; the raw series stays out of the panel."""
    if horizon < 1:
        raise ValueError("horizon must be >= 1")
    single = daily.groupBy(F.to_date(day).alias("_day")).agg(*[F.min(v).alias(v) for v in values])
    # one partition on purpose: one row per calendar day
    w = Window.partitionBy(F.lit(0)).orderBy("_day")
    tag = "" if horizon == 1 else f"h{horizon}_"
    cols: list[Column] = []
    for v in values:
        cols.append(F.lag(v, horizon).over(w).alias(f"{prefix}_{v}_shift{horizon}"))
        for n in windows:
            frame = w.rowsBetween(-(horizon + n - 1), -horizon)
            cols.append(F.avg(v).over(frame).alias(f"{prefix}_{v}_{tag}roll{n}_mean"))
            cols.append(F.max(v).over(frame).alias(f"{prefix}_{v}_{tag}roll{n}_max"))
    series = single.select("_day", *cols)
    return df.withColumn("_day", F.to_date(time)).join(day_table(series), "_day", "left").drop("_day")


def add_annual_attribute(
    df: DataFrame,
    annual: DataFrame,
    key: str,
    time: str,
    year: str,
    values: Sequence[str],
    year_lag: int = 1,
    population: DataFrame | None = None,
    population_column: str = "population",
    prefix: str = "annual",
) -> DataFrame:
    """Value of the year `year_lag` before the row's; per head where the population is positive."""
    if year_lag < 0:
        raise ValueError("year_lag must not be negative")
    table = annual.select(
        key, (F.col(year).cast("int") + year_lag).alias("_year"), *[F.col(v).alias(f"{prefix}_{v}") for v in values]
    )
    rows = require_match(df.withColumn("_year", F.year(time)), table, [key, "_year"], prefix)
    out, _ = attach_many_to_one(rows, table, [key, "_year"], check=False, family=prefix)
    if population is not None:
        people = population.select(key, F.col(population_column).alias("_people"))
        out = require_match(out, people, [key], "population")
        out, _ = attach_many_to_one(out, people, [key], check=False, family="population")
        out = out.withColumns(
            {
                f"{prefix}_{v}_per_head": F.when(
                    F.col("_people") > 0, F.col(f"{prefix}_{v}") / F.when(F.col("_people") > 0, F.col("_people"))
                )
                for v in values
            }
        ).drop("_people")
    return out.drop("_year")


def add_month_profile(
    df: DataFrame, profile: DataFrame, key: str, time: str, month: str, values: Sequence[str], prefix: str = "season"
) -> DataFrame:
    """Profile value of (key, month of the row); a profile with two rows for a month fails the query."""
    table = profile.groupBy(key, F.col(month).cast("int").alias("_month")).agg(
        F.count(F.lit(1)).alias("_dup"), *[F.min(v).alias(f"{prefix}_{v}") for v in values]
    )
    table = table.filter(
        F.assert_true(F.col("_dup") == 1, F.lit("the profile repeats a (key, month)")).isNull()
    ).drop("_dup")
    rows = require_match(df.withColumn("_month", F.month(time)), table, [key, "_month"], prefix)
    return join_checked(rows, table, [key, "_month"]).drop("_month")


def add_monthly_attribute(
    df: DataFrame,
    monthly: DataFrame,
    key: str,
    time: str,
    year: str,
    month: str,
    values: Sequence[str],
    lag_months: int = 12,
    year_share: bool = True,
    prefix: str = "monthly",
) -> DataFrame:
    """Value of the month `lag_months` before the row's month (publication takes two), and its share of the calendar
    year when all 12 months are there."""
    if lag_months < 2:
        raise ValueError("a month is published two months later: lag_months must be >= 2")
    table = monthly.select(
        key, F.col(year).cast("int").alias("_y"), F.col(month).cast("int").alias("_m"),
        *[F.col(v).cast("double").alias(f"{prefix}_{v}") for v in values],
    )
    if year_share:
        per_year = table.groupBy(key, "_y").agg(
            F.count_distinct("_m").alias("_months"), *[F.sum(f"{prefix}_{v}").alias(f"_t_{v}") for v in values]
        )
        table = table.join(per_year, [key, "_y"])
        for v in values:
            whole = (F.col("_months") == 12) & (F.col(f"_t_{v}") > 0)
            table = table.withColumn(
                f"{prefix}_{v}_year_share",
                F.when(whole, F.col(f"{prefix}_{v}") / F.when(whole, F.col(f"_t_{v}"))),
            ).drop(f"_t_{v}")
        table = table.drop("_months")
    table = table.withColumn("_ix", F.col("_y") * 12 + F.col("_m") - 1 + lag_months).drop("_y", "_m")
    rows = require_match(df.withColumn("_ix", month_index(F.to_date(time))), table, [key, "_ix"], prefix)
    return join_checked(rows, table, [key, "_ix"]).drop("_ix")


def district_monthly_estimate(
    annual: DataFrame,
    monthly: DataFrame,
    district: str,
    province: str,
    year: str,
    month: str,
    value: str,
    districts: DataFrame | None = None,
) -> DataFrame:
    """Top-down split: the district's share of the province's year times the province's month. Districts of the
    reference that are absent in a year get share 0."""
    years = annual.select(year).distinct().join(monthly.select(year).distinct(), year, "left_semi")
    yearly = annual.join(years, year, "left_semi").groupBy(district, province, year).agg(F.sum(value).alias("_v"))
    totals = yearly.groupBy(province, year).agg(F.sum("_v").alias("_p"))
    shares = yearly.join(totals, [province, year]).select(
        district, province, year,
        F.when(F.col("_p") > 0, F.col("_v") / F.when(F.col("_p") > 0, F.col("_p"))).alias("district_share"),
    )
    if districts is not None:
        ref = districts.select(province, district).distinct()
        all_years = years.agg(F.collect_set(year).alias("y")).scalar()  # a handful of calendar years
        grid = ref.withColumn("_ys", all_years).select(district, province, F.explode("_ys").alias(year))
        absent = grid.join(shares, [district, province, year], "left_anti")
        shares = shares.unionByName(absent.withColumn("district_share", F.lit(0.0)))
    by_month = monthly.select(province, year, month, F.col(value).cast("double").alias("_m"))
    return shares.join(by_month, [province, year]).select(
        district, province, year, month, (F.col("district_share") * F.col("_m")).alias(f"{value}_estimate"),
        "district_share",
    )


@dataclass(frozen=True)
class Family:
    """A named source: `attach` adds its columns; `days` (a table and its date column) gates it on the years it shares
    with the panel, seen `year_lag` years later."""

    name: str
    attach: Callable[[DataFrame], DataFrame] | None
    days: tuple[DataFrame, str] | None = None
    year_lag: int = 0


# Fixed order of the source families.
FAMILY_ORDER = (
    "weather", "weather_hourly", "air_quality", "convective", "humidity_soil", "solar", "fires", "earthquakes",
    "tourism_annual", "tourism_monthly", "tourism_province_monthly", "water", "outages", "land_cover", "grid",
)


def _common_year(panel: DataFrame, time: str, table: DataFrame, day: str, lag: int = 0) -> Column:
    """Whether both have a year in common, found when the report is computed."""
    a = panel.select((F.year(time) - lag).alias("y")).distinct()
    b = table.select(F.year(day).alias("y")).distinct()
    return a.join(b, "y", "left_semi").agg((F.count(F.lit(1)) > 0).alias("common")).scalar()


def attach_external(
    panel: DataFrame, time: str, families: Sequence[Family], order: Sequence[str] = FAMILY_ORDER
) -> tuple[DataFrame, DataFrame]:
    """Attaches the families in the fixed order and runs no job. Returns the panel and a report with state, number of columns,
    match rate (rows with any value of the family) and reason per family, computed in one aggregate over the panel when it is
    asked for. An absent source adds no columns; one without a common year adds empty ones, which the report counts as
    none. `judge_external` raises for a source without any match and warns below one half."""
    known = {f.name: f for f in families}
    unknown = [n for n in known if n not in order]
    if unknown:
        raise ValueError(f"unknown families: {unknown}")
    spark: SparkSession = panel.sparkSession
    out, rows = panel, []
    left_for_later = _JUDGED_LATER.set(True)
    try:
        for name in order:
            if name not in known:
                continue
            f = known[name]
            if f.attach is None:
                rows.append((name, [], None, "no source"))
                continue
            before = set(out.columns)
            try:
                out = f.attach(out)
            except NoOverlapError as gap:
                rows.append((name, [], None, str(gap)))
                continue
            common = None if f.days is None else _common_year(panel, time, *f.days, f.year_lag)
            rows.append((name, [c for c in out.columns if c not in before], common, ""))
    finally:
        _JUDGED_LATER.reset(left_for_later)

    def any_value(columns: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])

    counted = out.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[(F.count_if(any_value(new)) if new else F.lit(0).cast("long")).alias(f"_m{i}") for i, (_, new, _, _) in enumerate(rows)],
    )
    report = []
    for i, (name, new, common, reason) in enumerate(rows):
        used = F.lit(bool(new)) if common is None else F.lit(bool(new)) & common
        report.append(
            F.struct(
                F.lit(name).alias("family"),
                F.when(used, "attached").otherwise("skipped").alias("state"),
                F.when(used, F.lit(len(new))).otherwise(F.lit(0)).alias("columns"),
                F.when(used, safe_div(f"_m{i}", "_rows")).alias("match_rate"),
                F.when(used, F.lit("")).otherwise(F.lit(reason or "no common year")).alias("reason"),
            )
        )
    schema = "family string, state string, columns int, match_rate double, reason string"
    return out, counted.select(F.inline(F.array(*report))) if report else spark.createDataFrame([], schema)


def judge_external(report: DataFrame) -> dict[str, float | None]:
    """Match rates of the attached families: one without any match is an error, one below one half a warning."""
    return {r["family"]: _judged(r["family"], r["match_rate"]) for r in report.collect() if r["state"] == "attached"}


def seam_merge(archive: DataFrame, forecast: DataFrame, keys: Sequence[str], flag: str = "is_forecast") -> DataFrame:
    """Archive rows always win; forecast rows fill the keys the archive lacks. Old forecast rows inside the archive are
    dropped first."""
    old = archive.filter(F.col(flag) == 0) if flag in archive.columns else archive.withColumn(flag, F.lit(0))
    fill = forecast.join(old.select(*keys), list(keys), "left_anti").withColumn(flag, F.lit(1))
    return old.unionByName(fill.select(*old.columns))


def seam_error(
    archive: DataFrame, forecast: DataFrame, keys: Sequence[str], value: str, flag: str = "is_forecast"
) -> DataFrame:
    """Mean absolute difference on the overlap; no overlap fails the query."""
    old = archive.filter(F.col(flag) == 0) if flag in archive.columns else archive
    both = old.select(*keys, F.col(value).alias("_a")).join(
        forecast.select(*keys, F.col(value).alias("_f")), list(keys)
    )
    n = F.count(F.lit(1))
    return both.agg(
        F.when(n == 0, F.raise_error(F.lit("archive and forecast do not overlap")).cast("double"))
        .otherwise(F.avg(F.abs(F.col("_a") - F.col("_f"))))
        .alias("seam_error"),
        n.alias("overlap"),
    )


def merge_publishers(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two publishers of arrivals, nights and occupancy (percent): totals and the occupancy implied by bed-days
    nights / (occupancy / 100). A row of the second publisher without a row of the first fails the query."""
    b = second.select(
        *keys,
        F.col("arrivals").alias("arrivals_b"),
        F.col("nights").alias("nights_b"),
        F.col("occupancy").alias("occupancy_b"),
        F.lit(1).alias("_b"),
    )
    joined = first.withColumn("_a", F.lit(1)).join(b, list(keys), "full")
    joined = joined.filter(
        F.assert_true(F.col("_a").isNotNull(), F.lit("second publisher has rows the first lacks")).isNull()
    ).drop("_a", "_b")

    def bed_days(nights: Column, occupancy: Column) -> Column:
        return F.when(occupancy > 0, nights / (F.when(occupancy > 0, occupancy) / 100.0))

    nights_b = F.coalesce("nights_b", F.lit(0.0))
    own = bed_days(F.col("nights"), F.col("occupancy"))
    other = F.coalesce(bed_days(nights_b, F.coalesce("occupancy_b", F.lit(0.0))), F.lit(0.0))
    total_nights = F.col("nights") + nights_b
    beds = own + other
    return joined.withColumns(
        {
            "arrivals_total": F.col("arrivals") + F.coalesce("arrivals_b", F.lit(0.0)),
            "nights_total": total_nights,
            "occupancy_total": F.when(beds > 0, F.lit(100.0) * total_nights / F.when(beds > 0, beds)).otherwise(
                F.col("occupancy")
            ),
        }
    )


def replacement_pairs(
    train: DataFrame, test: DataFrame, entity: str, location: str, capacity: str, time: str, dead_days: int = 7
) -> tuple[DataFrame, DataFrame]:
    """Entities that ended against entities that began, by (location, whole capacity).

    Returns the cardinality table (ended x began keys) and the unambiguous 1-1 pairs with their day gap. Keys are counted
    first; only keys with one entity on each side are joined, so a crowded key never produces its pairs.
    """
    day = F.to_date(time)

    def per_entity(df: DataFrame) -> DataFrame:
        return df.groupBy(entity).agg(
            F.min(location).alias(location),
            F.min(F.col(capacity).cast("long")).alias("_cap"),
            F.min(day).alias("_first"),
            F.max(day).alias("_last"),
        )

    a, b = per_entity(train), per_entity(test)
    end = train.agg(F.max(day).alias("e")).scalar()
    ended = a.join(b.select(entity), entity, "left_anti").withColumn("_end", end)
    ended = ended.filter(F.col("_last") < F.date_sub("_end", dead_days))
    began = b.join(a.select(entity), entity, "left_anti")
    keys = [location, "_cap"]
    ce = ended.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ended"), F.min(entity).alias("ended_entity"), F.max("_last").alias("_last")
    )
    cb = began.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("began"), F.min(entity).alias("began_entity"), F.min("_first").alias("_first")
    )
    both = ce.join(cb, keys)
    cardinality = both.groupBy("ended", "began").agg(F.count(F.lit(1)).alias("keys"))
    pairs = both.filter((F.col("ended") == 1) & (F.col("began") == 1)).select(
        location, F.col("_cap").alias("capacity"), "ended_entity", "began_entity",
        F.datediff("_first", "_last").alias("gap_days"),
    )
    return cardinality, pairs


def key_overlap(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct key tuples of train and test, their intersection, and its share of test."""
    a, b = train.select(*keys).distinct(), test.select(*keys).distinct()
    na = a.agg(F.count(F.lit(1)).alias("n")).scalar()
    nb = b.agg(F.count(F.lit(1)).alias("n")).scalar()
    both = a.intersect(b).agg(F.count(F.lit(1)).alias("both_keys"))
    return both.withColumns({"train_keys": na, "test_keys": nb}).withColumn(
        "test_share", safe_div("both_keys", "test_keys")
    )


def safe_union(frames: Sequence[DataFrame | None]) -> DataFrame:
    """Union by name that skips absent frames and fills absent columns with NULL."""
    present = [f for f in frames if f is not None]
    if not present:
        raise ValueError("no frames to union")
    out = present[0]
    for f in present[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def id_difference(expected: DataFrame, actual: DataFrame, column: str) -> DataFrame:
    """Multiset difference of ids: how many copies are missing or extra per id. Counts per id are compared, so a
    repeated id costs one row."""
    e = expected.groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("e"))
    a = actual.groupBy(F.col(column).alias("_id")).agg(F.count(F.lit(1)).alias("a"))
    both = e.join(a, F.col("id").eqNullSafe(F.col("_id")), "full").select(
        F.coalesce("id", "_id").alias("id"), F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("a", F.lit(0)).alias("a")
    )
    return both.filter(F.col("e") != F.col("a")).select(
        "id",
        F.greatest(F.col("e") - F.col("a"), F.lit(0)).alias("missing"),
        F.greatest(F.col("a") - F.col("e"), F.lit(0)).alias("extra"),
    )


def zero_overlap(a: DataFrame, b: DataFrame, id_column: str, value: str) -> DataFrame:
    """One row comparing two prediction tables: zero sets, changed rows and RMS log difference."""
    j = a.select(id_column, F.col(value).alias("_a")).join(
        b.select(id_column, F.col(value).alias("_b")), id_column, "full"
    )
    za, zb = F.coalesce(F.col("_a") <= 0, F.lit(False)), F.coalesce(F.col("_b") <= 0, F.lit(False))
    d = F.log1p(F.greatest(F.col("_a"), F.lit(0.0))) - F.log1p(F.greatest(F.col("_b"), F.lit(0.0)))
    return j.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(za).alias("zero_a"),
        F.count_if(zb).alias("zero_b"),
        F.count_if(za & zb).alias("zero_both"),
        F.count_if(za & ~zb).alias("zero_only_a"),
        F.count_if(zb & ~za).alias("zero_only_b"),
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"),
        F.sqrt(F.avg(d * d)).alias("rms_log_diff"),
    )


def route_by_regime(warm: DataFrame, cold: DataFrame, flags: DataFrame, id_column: str, value: str, cold_flag: str) -> DataFrame:
    """Warm rows from one prediction table, cold rows from the other."""
    return (
        flags.select(id_column, cold_flag)
        .join(warm.select(id_column, F.col(value).alias("_w")), id_column, "left")
        .join(cold.select(id_column, F.col(value).alias("_c")), id_column, "left")
        .select(id_column, F.when(F.col(cold_flag) == 1, F.col("_c")).otherwise(F.col("_w")).alias(value))
    )
