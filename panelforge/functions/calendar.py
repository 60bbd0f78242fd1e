"""Calendar features: date parts, cycles, public holidays, the fasting month and the school year.

Holiday, fasting-month and school tables hold one row per calendar day, so they are broadcast and the facts never move.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.core.scale import day_table

NO_HOLIDAY_DISTANCE = 999

# Holiday codes, lower code wins when two fall on one day except that 15 July precedes 1 May.
HOLIDAY_CODES = {
    "ramazan": 1,
    "kurban": 2,
    "cumhuriyet": 3,
    "egemenlik": 4,
    "genclik": 5,
    "zafer": 6,
    "emek": 7,
    "demokrasi": 8,
    "yilbasi": 9,
}
HOLIDAY_PRIORITY = (
    "ramazan", "kurban", "cumhuriyet", "egemenlik", "genclik", "zafer", "demokrasi", "emek", "yilbasi",
)

# Extra administrative leave on top of the legal holiday (1.0 a whole day, 0.5 a half day).
ADMINISTRATIVE_LEAVE = {
    "2019-06-03": 0.5,
    "2019-06-07": 1.0,
    "2021-05-10": 1.0,
    "2021-05-11": 1.0,
    "2021-05-12": 0.5,
    "2022-07-13": 1.0,
    "2022-07-14": 1.0,
    "2023-06-26": 1.0,
    "2023-06-27": 0.5,
    "2024-04-08": 1.0,
    "2024-04-09": 0.5,
    "2024-06-20": 1.0,
    "2024-06-21": 1.0,
    "2025-04-02": 1.0,
    "2025-04-03": 1.0,
    "2025-04-04": 1.0,
    "2026-05-25": 1.0,
    "2026-05-26": 0.5,
}

# First and last day of the fasting month, and the first day of the feast of sacrifice.
FASTING_MONTHS = {
    2020: ("2020-04-24", "2020-05-23"),
    2021: ("2021-04-13", "2021-05-12"),
    2022: ("2022-04-02", "2022-05-01"),
    2023: ("2023-03-23", "2023-04-20"),
    2024: ("2024-03-11", "2024-04-09"),
    2025: ("2025-03-01", "2025-03-29"),
    2026: ("2026-02-18", "2026-03-19"),
}
SACRIFICE_FEASTS = {
    2020: "2020-07-31",
    2021: "2021-07-20",
    2022: "2022-07-09",
    2023: "2023-06-28",
    2024: "2024-06-16",
    2025: "2025-06-06",
    2026: "2026-05-27",
}

# School terms and mid-term breaks, and the span they cover.
SCHOOL_YEARS = (
    ((("2021-02-08", "2021-06-18"),), (("2021-04-12", "2021-04-16"),)),
    (
        (("2021-09-06", "2022-01-21"), ("2022-02-07", "2022-06-17")),
        (("2021-11-15", "2021-11-19"), ("2022-04-11", "2022-04-15")),
    ),
    (
        (("2022-09-12", "2023-01-20"), ("2023-02-20", "2023-06-16")),
        (("2022-11-14", "2022-11-18"), ("2023-04-17", "2023-04-21")),
    ),
    (
        (("2023-09-11", "2024-01-19"), ("2024-02-05", "2024-06-14")),
        (("2023-11-13", "2023-11-17"), ("2024-04-08", "2024-04-12")),
    ),
    (
        (("2024-09-09", "2025-01-17"), ("2025-02-03", "2025-06-20")),
        (("2024-11-11", "2024-11-15"), ("2025-03-31", "2025-04-04")),
    ),
    (
        (("2025-09-08", "2026-01-16"), ("2026-02-02", "2026-06-26")),
        (("2025-11-10", "2025-11-14"), ("2026-03-16", "2026-03-20")),
    ),
)
SCHOOL_COVERAGE = ("2021-05-01", "2026-08-31")


def _lunar_day(year: int, month: int, day: int) -> date:
    """Arithmetic lunar calendar, for years without a published date."""
    days = day + -(-(59 * (month - 1)) // 2) + (year - 1) * 354 + (3 + 11 * year) // 30
    return date.fromordinal(227014 + days)


def _lunar_years(first_year: int, last_year: int) -> range:
    return range(int((first_year - 622) * 33 / 32) - 2, int((last_year - 622) * 33 / 32) + 4)


def fasting_months(first_year: int, last_year: int) -> list[tuple[date, date]]:
    """Months that start between two years; a year may hold two."""
    out = []
    for lunar in _lunar_years(first_year, last_year):
        first, last = _lunar_day(lunar, 9, 1), _lunar_day(lunar, 10, 1) - timedelta(days=1)
        if first.year in FASTING_MONTHS:
            first, last = (date.fromisoformat(d) for d in FASTING_MONTHS[first.year])
        if first_year <= first.year <= last_year:
            out.append((first, last))
    return out


def sacrifice_feasts(first_year: int, last_year: int) -> list[date]:
    out = []
    for lunar in _lunar_years(first_year, last_year):
        first = _lunar_day(lunar, 12, 10)
        if first.year in SACRIFICE_FEASTS:
            first = date.fromisoformat(SACRIFICE_FEASTS[first.year])
        if first_year <= first.year <= last_year:
            out.append(first)
    return out


def holiday_rows(first_year: int, last_year: int) -> list[tuple[date, str, bool]]:
    """(day, holiday name, half day) for every public holiday and eve between two years."""
    rows: list[tuple[date, str, bool]] = []
    for y in range(first_year, last_year + 1):
        rows += [
            (date(y, 1, 1), "yilbasi", False),
            (date(y, 4, 23), "egemenlik", False),
            (date(y, 5, 19), "genclik", False),
            (date(y, 8, 30), "zafer", False),
            (date(y, 10, 28), "cumhuriyet", True),
            (date(y, 10, 29), "cumhuriyet", False),
        ]
        if y >= 2009:
            rows.append((date(y, 5, 1), "emek", False))
        if y >= 2017:
            rows.append((date(y, 7, 15), "demokrasi", False))
    for _, eve in fasting_months(first_year - 1, last_year):
        rows.append((eve, "ramazan", True))
        rows += [(eve + timedelta(days=i), "ramazan", False) for i in (1, 2, 3)]
    for feast in sacrifice_feasts(first_year, last_year):
        rows.append((feast - timedelta(days=1), "kurban", True))
        rows += [(feast + timedelta(days=i), "kurban", False) for i in range(4)]
    return [r for r in rows if first_year <= r[0].year <= last_year]


def holiday_days(
    spark: SparkSession,
    first_year: int,
    last_year: int,
    leave: Mapping[str, float] | None = None,
    half_days: bool = True,
) -> DataFrame:
    """One row per calendar day: full and half holiday, code, collision, leave, last holiday up to the day, next holiday
    from the day on, and next holiday strictly after it."""
    rows = [r for r in holiday_rows(first_year, last_year) if half_days or not r[2]]
    events = spark.createDataFrame(rows, "day date, name string, half boolean")
    rank = F.lit(len(HOLIDAY_PRIORITY))
    code = F.lit(0)
    for i, name in reversed(list(enumerate(HOLIDAY_PRIORITY))):
        rank = F.when(F.col("name") == name, F.lit(i)).otherwise(rank)
        code = F.when(F.col("name") == name, F.lit(HOLIDAY_CODES[name])).otherwise(code)
    per_day = events.groupBy("day").agg(
        F.max((~F.col("half")).cast("int")).alias("full_day"),
        F.min_by(code, rank).alias("code"),
        (F.count(F.lit(1)) > 1).cast("int").alias("collision"),
    )
    table = ADMINISTRATIVE_LEAVE if leave is None else leave
    leave_rows = [(date.fromisoformat(d), float(w)) for d, w in table.items()]
    leaves = spark.createDataFrame(leave_rows, "day date, leave double")
    span = spark.range(1).select(
        F.explode(F.sequence(F.lit(date(first_year, 1, 1)), F.lit(date(last_year, 12, 31)))).alias("day")
    )
    days = span.join(per_day, "day", "left").join(leaves, "day", "left")
    # one partition on purpose: the table has one row per day of a few decades
    w = Window.partitionBy(F.lit(0)).orderBy("day")
    is_day = F.when(F.col("full_day").isNotNull(), F.col("day"))
    return days.select(
        "day",
        F.coalesce("full_day", F.lit(0)).alias("holiday"),
        F.coalesce((F.col("full_day") == 0).cast("int"), F.lit(0)).alias("half_day"),
        F.coalesce("code", F.lit(0)).alias("holiday_code"),
        F.coalesce("collision", F.lit(0)).alias("collision"),
        F.coalesce("leave", F.lit(0.0)).alias("admin_leave"),
        F.last(is_day, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_prev"),
        F.first(is_day, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_next"),
        F.first(is_day, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )


def covered_day(time: str, first_year: int, last_year: int) -> Column:
    """The day of a time; fails the query on a day outside the years a calendar was built for, whose features would read
    as those of an ordinary day. It is the join key itself: a filter would be carried over to the calendar's own days."""
    day = F.to_date(time)
    message = F.concat(F.lit(f"{time}: the calendar covers {first_year} to {last_year}, not "), F.year(day).cast("string"))
    inside = F.coalesce(F.year(day).between(first_year, last_year), F.lit(True))
    return F.when(inside, day).otherwise(F.raise_error(message).cast("date"))


def add_holiday_features(
    df: DataFrame, time: str, first_year: int, last_year: int, window_days: int = 3, leave: Mapping[str, float] | None = None
) -> DataFrame:
    """Full / half day, weight, code, collision, distance to the nearest holiday, near flag, holiday or weekend, leave
    and combined workforce loss. The table covers one year more on both sides."""
    cal = holiday_days(df.sparkSession, first_year - 1, last_year + 1, leave)
    j = df.withColumn("_day", covered_day(time, first_year, last_year)).join(day_table(cal.withColumnRenamed("day", "_day")), "_day", "left")
    day = F.col("_day")
    distance = F.coalesce(
        F.least(F.datediff(day, "_prev"), F.datediff("_next", day), F.lit(NO_HOLIDAY_DISTANCE)),
        F.lit(NO_HOLIDAY_DISTANCE),
    )
    weekend = F.coalesce(F.weekday(day) >= 5, F.lit(False)).cast("int")
    weight = F.when(F.col("holiday") == 1, 1.0).when(F.col("half_day") == 1, 0.5).otherwise(0.0)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("holiday", "half_day", "holiday_code", "collision")}
    zero["admin_leave"] = F.coalesce("admin_leave", F.lit(0.0))
    return (
        j.withColumns(zero)
        .withColumns({"holiday_weight": weight, "holiday_distance": distance})
        .withColumns(
            {
                "near_holiday": (F.col("holiday_distance") <= window_days).cast("int"),
                "holiday_or_weekend": F.greatest("holiday", weekend),
                "workforce_loss": F.greatest(
                    F.least(F.lit(1.0), F.col("holiday_weight") + F.col("admin_leave")), weekend.cast("double")
                ),
            }
        )
        .drop("_day", "_prev", "_next", "_after")
    )


def add_upcoming_holiday_features(
    df: DataFrame,
    time: str,
    first_year: int,
    last_year: int,
    windows: Sequence[int] = (3, 7, 15),
    half_days: bool = True,
) -> DataFrame:
    """Days to the next holiday strictly after the row's day, and a flag per look-ahead window."""
    cal = holiday_days(df.sparkSession, first_year - 1, last_year + 1, half_days=half_days)
    j = df.withColumn("_day", F.to_date(time)).join(
        day_table(cal.select(F.col("day").alias("_day"), "_after")), "_day", "left"
    )
    ahead = F.least(
        F.coalesce(F.datediff("_after", "_day"), F.lit(NO_HOLIDAY_DISTANCE)), F.lit(NO_HOLIDAY_DISTANCE)
    )
    out = j.withColumn("next_holiday_days", ahead)
    flags = {f"holiday_within_{n}d": (F.col("next_holiday_days") <= n).cast("int") for n in windows}
    return out.withColumns(flags).drop("_day", "_after")


def fasting_days(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    rows = fasting_months(first_year, last_year)
    months = spark.createDataFrame(rows, "first date, last date")
    return months.select(F.explode(F.sequence("first", "last")).alias("day"), "first", "last")


def add_fasting_month_features(df: DataFrame, time: str, first_year: int, last_year: int) -> DataFrame:
    """In the month, day number, progress 0..1, last ten days, and days to the feast (999 outside)."""
    cal = fasting_days(df.sparkSession, first_year - 1, last_year + 1)
    j = df.withColumn("_day", covered_day(time, first_year, last_year)).join(
        day_table(cal.select(F.col("day").alias("_day"), "first", "last")), "_day", "left"
    )
    inside = F.col("first").isNotNull()
    number = F.datediff("_day", "first") + 1
    length = F.datediff("last", "first") + 1
    to_feast = F.datediff("last", "_day") + 1
    return j.withColumns(
        {
            "fasting_month": inside.cast("int"),
            "fasting_day": F.when(inside, number).otherwise(0),
            "fasting_progress": F.when(inside, (number - 1) / F.greatest(length - 1, F.lit(1))).otherwise(0.0),
            "fasting_last_ten": (inside & (to_feast <= 10)).cast("int"),
            "days_to_feast": F.when(inside, to_feast).otherwise(NO_HOLIDAY_DISTANCE),
        }
    ).drop("_day", "first", "last")


def school_days(spark: SparkSession) -> DataFrame:
    """One row per covered day: type (term, weekend, mid_break, semester, summer), open flag and days to opening."""
    spans: list[tuple[str, date, date, int]] = []
    for terms, breaks in SCHOOL_YEARS:
        spans += [("term", date.fromisoformat(a), date.fromisoformat(b), 1) for a, b in terms]
        if len(terms) == 2:
            spans.append(
                (
                    "semester",
                    date.fromisoformat(terms[0][1]) + timedelta(days=1),
                    date.fromisoformat(terms[1][0]) - timedelta(days=1),
                    2,
                )
            )
        spans += [("mid_break", date.fromisoformat(a), date.fromisoformat(b), 3) for a, b in breaks]
    table = spark.createDataFrame(spans, "kind string, first date, last date, rank int")
    kinds = table.select(F.explode(F.sequence("first", "last")).alias("day"), "kind", "rank")
    kinds = kinds.groupBy("day").agg(F.max_by("kind", "rank").alias("kind"))
    first, last = (date.fromisoformat(d) for d in SCHOOL_COVERAGE)
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    labelled = days.join(kinds, "day", "left").select(
        "day",
        F.when((F.col("kind") == "term") & (F.weekday("day") >= 5), "weekend")
        .otherwise(F.coalesce("kind", F.lit("summer")))
        .alias("school_day_type"),
    )
    is_open = F.col("school_day_type") == "term"
    # one partition on purpose: 1,949 days
    ahead = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    opening = F.first(F.when(is_open, F.col("day")), ignorenulls=True).over(ahead)
    return labelled.withColumns(
        {
            "school_open": is_open.cast("int"),
            "days_to_opening": F.least(
                F.coalesce(F.datediff(opening, "day"), F.lit(NO_HOLIDAY_DISTANCE)), F.lit(NO_HOLIDAY_DISTANCE)
            ),
        }
    )


def add_school_features(df: DataFrame, time: str) -> DataFrame:
    """School columns by day; outside the covered years type `unknown`, closed and 999 days."""
    cal = school_days(df.sparkSession).withColumnRenamed("day", "_day")
    j = df.withColumn("_day", F.to_date(time)).join(day_table(cal), "_day", "left")
    return j.withColumns(
        {
            "school_day_type": F.coalesce("school_day_type", F.lit("unknown")),
            "school_open": F.coalesce("school_open", F.lit(0)),
            "days_to_opening": F.coalesce("days_to_opening", F.lit(NO_HOLIDAY_DISTANCE)),
        }
    ).drop("_day")


def shared_origin(frames: Sequence[DataFrame], time: str) -> Column:
    """Earliest day over several frames, as a scalar subquery: train and test must count days from the same one."""
    lows = [f.agg(F.min(F.to_date(time)).alias("lo")) for f in frames]
    both = lows[0]
    for f in lows[1:]:
        both = both.unionByName(f)
    return both.agg(F.min("lo").alias("lo")).scalar()


def add_calendar_features(
    df: DataFrame,
    time: str,
    prefix: str | None = None,
    year: bool = True,
    hours: bool = False,
    origin: Column | None = None,
) -> DataFrame:
    """Date parts; hour columns on request; the day counter only with an explicit origin."""
    p = prefix or time
    d = F.col(time)
    dow = F.weekday(d)
    month = F.month(d)
    season = (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isin(9, 10, 11), "autumn")
    )
    new = {
        f"{p}_month": month,
        f"{p}_dom": F.dayofmonth(d),
        f"{p}_dow": dow,
        f"{p}_doy": F.dayofyear(d),
        f"{p}_week": F.weekofyear(d),
        f"{p}_quarter": F.quarter(d),
        f"{p}_month_start": (F.dayofmonth(d) == 1).cast("int"),
        f"{p}_month_end": (F.last_day(F.to_date(d)) == F.to_date(d)).cast("int"),
        f"{p}_weekend": (dow >= 5).cast("int"),
        f"{p}_season": season,
    }
    if hours:
        h = F.hour(d)
        new[f"{p}_hour"] = h
        new[f"{p}_office_hour"] = (h.between(8, 18) & (dow < 5)).cast("int")
        new[f"{p}_peak_hour"] = h.between(17, 22).cast("int")
    if year:
        new[f"{p}_year"] = F.year(d)
    out = df.withColumns(new)
    if origin is not None:
        out = out.withColumn("_origin", origin).withColumn(f"{p}_day_no", F.datediff(F.to_date(d), "_origin"))
        out = out.drop("_origin")
    return out


def cyclical(values: Mapping[str, tuple[Column, float]]) -> dict[str, Column]:
    """`name_sin` and `name_cos` of 2 pi x / period for each (x, period)."""
    out = {}
    for name, (x, period) in values.items():
        angle = 2.0 * F.pi() * x.cast("double") / F.lit(float(period))
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def add_extended_calendar(df: DataFrame, time: str, first_year: int, last_year: int) -> DataFrame:
    """Weekday, month and day-of-year cycles, weekday flags, and exp(-days / 5) from the nearest feast of sacrifice day."""
    d = F.to_date(time)
    dow = F.weekday(d)
    rows = [r for r in holiday_rows(first_year - 1, last_year + 1) if r[1] == "kurban" and not r[2]]
    spark = df.sparkSession
    feast = spark.createDataFrame([(r[0],) for r in rows], "day date").withColumn("_f", F.col("day"))
    span = spark.range(1).select(
        F.explode(F.sequence(F.lit(date(first_year - 1, 1, 1)), F.lit(date(last_year + 1, 12, 31)))).alias("day")
    )
    # one partition on purpose: one row per calendar day
    w = Window.partitionBy(F.lit(0)).orderBy("day")
    near = span.join(feast, "day", "left").select(
        F.col("day").alias("_day"),
        F.least(
            F.datediff("day", F.last("_f", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))),
            F.datediff(F.first("_f", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), "day"),
        ).alias("feast_distance"),
    )
    out = df.withColumn("_day", d).join(day_table(near), "_day", "left").drop("_day")
    cycles = cyclical(
        {"dow": (dow, 7.0), "month": (F.month(d), 12.0), "doy": (F.dayofyear(d), 365.25)}
    )
    return out.withColumns(
        {
            **cycles,
            "is_weekend": (dow >= 5).cast("int"),
            "is_sunday": (dow == 6).cast("int"),
            "is_monday": (dow == 0).cast("int"),
            "is_friday": (dow == 4).cast("int"),
            "feast_influence": F.exp(-F.col("feast_distance") / 5.0),
        }
    )
