"""Aggregations, hourly reducers, profiles and rolling-origin blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import aggregates as A
from panelforge.operators import origin_blocks as OB
from panelforge.operators import profiles as PR
from panelforge.operators import weather as WX
from panelforge.plans import bases as B
from panelforge.plans.registry import ORACLES, Tables, query, rnd, rounded, sql_rnd


def _q(col: str, p: float, name: str, digits: int = 6) -> str:
    return sql_rnd(f"quantile_cont({col}, {p})", name, digits)


@query(
    "group_statistics",
    "A01",
    f"""WITH s AS (SELECT p_brand, p_type, avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS sd,
        min(p_retailprice) AS lo, max(p_retailprice) AS hi, median(p_retailprice) AS med FROM part GROUP BY 1, 2)
    SELECT p_partkey, {sql_rnd('m', 'price_mean')}, {sql_rnd('sd', 'price_std')}, {sql_rnd('lo', 'price_min')},
      {sql_rnd('hi', 'price_max')}, {sql_rnd('med', 'price_median')}, {sql_rnd('p_retailprice - m', 'price_diff')},
      {sql_rnd('p_retailprice / nullif(m, 0)', 'price_ratio')},
      {sql_rnd('CASE WHEN sd > 0 THEN (p_retailprice - m) / sd END', 'price_z')}
    FROM part JOIN s USING (p_brand, p_type)""",
)
def group_stats(t: Tables) -> DataFrame:
    out = A.group_statistics(t.part, ["p_brand", "p_type"], ["p_retailprice"], target=None)
    names = {f"p_retailprice_by_p_brand_p_type_{a}": f"price_{a}" for a in ("mean", "std", "min", "max", "median")}
    names |= {f"p_retailprice_p_brand_p_type_{a}": f"price_{a}" for a in ("diff", "ratio", "z")}
    return out.select("p_partkey", *[rnd(F.col(k), v) for k, v in names.items()])


@query(
    "target_free_aggregates",
    "A02",
    f"""WITH {B.TRAIN_TEST}, u AS (SELECT * FROM train UNION ALL SELECT * FROM test),
    s AS (SELECT entity, avg(qty) AS m, max(qty) AS hi FROM u GROUP BY 1)
    SELECT entity, day, {sql_rnd('m', 'qty_by_entity_mean')}, {sql_rnd('hi', 'qty_by_entity_max')},
      {sql_rnd('qty - m', 'qty_entity_diff')}, {sql_rnd('qty / m', 'qty_entity_ratio')} FROM test JOIN s USING (entity)""",
)
def target_free(t: Tables) -> DataFrame:
    train, test = B.train_test(t)
    out = A.target_free_aggregates(train, test, ["entity"], ["qty"], None, ("mean", "max"))[1]
    return rounded(out.drop("qty"), ["entity", "day"])


@query("target_free_aggregates_whole", "A02", ORACLES["target_free_aggregates"].replace(B.TRAIN_TEST, B.WHOLE))
def target_free_whole(t: Tables) -> DataFrame:
    """Without the gap of `target_free_aggregates`."""
    train, test = B.train_test_whole(t)
    out = A.target_free_aggregates(train, test, ["entity"], ["qty"], None, ("mean", "max"))[1]
    return rounded(out.drop("qty"), ["entity", "day"])


@query(
    "paired_distribution",
    "A03 E01",
    f"""WITH tr AS (SELECT * FROM orders WHERE o_orderdate < DATE '{B.CUT}'), te AS (SELECT * FROM orders WHERE o_orderdate >= DATE '{B.CUT}'),
    s AS (SELECT o_orderpriority, avg(o_totalprice) AS m FROM tr GROUP BY 1),
    f AS (SELECT o_orderpriority, count(*) / (SELECT count(*) FROM tr) AS share FROM tr GROUP BY 1)
    SELECT o_orderkey, {sql_rnd('m', 'price_mean')}, {sql_rnd('o_totalprice - m', 'price_diff')}, {sql_rnd('coalesce(share, 0)', 'priority_share')}
    FROM te LEFT JOIN s USING (o_orderpriority) LEFT JOIN f USING (o_orderpriority)""",
)
def paired_distribution(t: Tables) -> DataFrame:
    """Distribution features learnt on train only and attached to test."""
    from panelforge.operators.encode import frequency_encode

    train, test = (t.orders.filter(c) for c in (F.col("o_orderdate") < B.CUT, F.col("o_orderdate") >= B.CUT))
    out = A.group_statistics(test, ["o_orderpriority"], ["o_totalprice"], None, ("mean",), train)
    out = frequency_encode(train, out, "o_orderpriority", "priority_share")
    return out.select(
        "o_orderkey",
        rnd("o_totalprice_by_o_orderpriority_mean", "price_mean"),
        rnd("o_totalprice_o_orderpriority_diff", "price_diff"),
        rnd("priority_share"),
    )


@query(
    "hourly_to_daily",
    "A04 A05",
    f"""WITH {B.SENSOR_HOUR}, d AS (SELECT station, CAST(hour AS DATE) AS day, avg(speed) AS m, min(speed) AS lo, max(speed) AS hi,
        stddev_samp(speed) AS sd, quantile_cont(speed, 0.1) AS q10, quantile_cont(speed, 0.5) AS q50,
        quantile_cont(speed, 0.9) AS q90, round(degrees(atan2(avg(sin(radians(direction))), avg(cos(radians(direction))))), 9) AS a
      FROM sensor GROUP BY 1, 2), e AS (SELECT *, CASE WHEN a < 0 THEN a + 360 ELSE a END AS c FROM d)
    SELECT station, day, {sql_rnd('m', 'speed_mean')}, {sql_rnd('lo', 'speed_min')}, {sql_rnd('hi', 'speed_max')},
      {sql_rnd('sd', 'speed_std')}, {sql_rnd('q10', 'speed_q10')}, {sql_rnd('q50', 'speed_q50')}, {sql_rnd('q90', 'speed_q90')},
      {sql_rnd('c', 'direction_circular_mean')}, {sql_rnd('sin(radians(c))', 'direction_sin')}, {sql_rnd('cos(radians(c))', 'direction_cos')}
    FROM e""",
)
def hourly(t: Tables) -> DataFrame:
    out = WX.hourly_to_daily(B.sensor_hour(t), "hour", ["station"], ["speed"], directions=["direction"])
    return rounded(out, ["station", "day"])


@query(
    "circular_statistics",
    "A05",
    f"""WITH m AS (SELECT user_id, avg(sin(radians((event_id * 37) % 360))) AS s, avg(cos(radians((event_id * 37) % 360))) AS c
      FROM events GROUP BY 1)
    SELECT user_id, {sql_rnd('CASE WHEN round(degrees(atan2(s, c)), 9) < 0 THEN round(degrees(atan2(s, c)), 9) + 360 ELSE round(degrees(atan2(s, c)), 9) END', 'mean_direction')},
      {sql_rnd('sqrt(abs(-2 * ln(least(greatest(sqrt(s * s + c * c), 1e-12), 1.0))))', 'std_direction')} FROM m""",
)
def circular(t: Tables) -> DataFrame:
    d = F.pmod(F.col("event_id") * 37, F.lit(360)).cast("double")
    return t.events.groupBy("user_id").agg(
        rnd(WX.circular_mean(d), "mean_direction"), rnd(WX.circular_std(d), "std_direction")
    )


@query(
    "wind_pressure_daily",
    "A06",
    f"""WITH {B.SENSOR_HOUR}, h AS (SELECT *, pressure - lag(pressure, 3) OVER (PARTITION BY station ORDER BY hour) AS ch FROM sensor),
    d AS (SELECT station, CAST(hour AS DATE) AS day, min(pressure) AS pmin, avg(pressure) AS pavg, stddev_samp(pressure) AS psd,
        CASE WHEN count(ch) > 0 THEN greatest(-min(ch), 0) END AS pdrop,
        quantile_cont(speed, 0.25) AS q25, quantile_cont(speed, 0.5) AS q50, quantile_cont(speed, 0.75) AS q75,
        quantile_cont(speed, 0.9) AS q90, quantile_cont(gust, 0.9) AS g90, quantile_cont(direction, 0.01) AS d01,
        quantile_cont(direction, 0.99) AS d99,
        degrees(sqrt(abs(-2 * ln(least(greatest(sqrt(power(avg(sin(radians(direction))), 2) + power(avg(cos(radians(direction))), 2)), 1e-12), 1.0))))) AS dsd,
        round(degrees(atan2(avg(sin(radians(direction))), avg(cos(radians(direction))))), 9) AS a,
        arg_max(direction, gust) AS peak,
        count(*) FILTER (speed >= 8) AS s8, count(*) FILTER (speed >= 10) AS s10, count(*) FILTER (speed >= 12) AS s12,
        count(*) FILTER (gust >= 15) AS g15, count(*) FILTER (gust >= 20) AS g20, count(*) FILTER (gust >= 25) AS g25
      FROM h GROUP BY 1, 2),
    e AS (SELECT *, CASE WHEN a < 0 THEN a + 360 ELSE a END AS c FROM d),
    f AS (SELECT *, abs(c - lag(c) OVER (PARTITION BY station ORDER BY day)) AS turn FROM e)
    SELECT station, day, {sql_rnd('pmin', 'pressure_min')}, {sql_rnd('pavg', 'pressure_mean')}, {sql_rnd('psd', 'pressure_std')},
      {sql_rnd('pdrop', 'pressure_drop_3h')}, {sql_rnd('q25', 'speed_q25')}, {sql_rnd('q50', 'speed_q50')},
      {sql_rnd('q75', 'speed_q75')}, {sql_rnd('q90', 'speed_q90')}, {sql_rnd('g90', 'gust_q90')}, {sql_rnd('d01', 'direction_q01')},
      {sql_rnd('d99', 'direction_q99')}, {sql_rnd('dsd', 'direction_std')}, s8 AS speed_8ms_hours, s10 AS speed_10ms_hours,
      s12 AS speed_12ms_hours, g15 AS gust_15ms_hours, g20 AS gust_20ms_hours, g25 AS gust_25ms_hours,
      {sql_rnd('least(turn, 360 - turn)', 'direction_change')}, {sql_rnd('sin(radians(c))', 'direction_sin')},
      {sql_rnd('cos(radians(c))', 'direction_cos')}, {sql_rnd('sin(radians(peak))', 'gust_direction_sin')},
      {sql_rnd('cos(radians(peak))', 'gust_direction_cos')} FROM f""",
)
def wind_pressure(t: Tables) -> DataFrame:
    out = WX.wind_pressure_daily(
        B.sensor_hour(t), "hour", ["station"], "speed", "gust", "direction", "pressure"
    )
    return rounded(out, ["station", "day", *[c for c in out.columns if c.endswith("_hours")]])


@query(
    "humidity_soil_daily",
    "A07",
    f"""WITH {B.SENSOR_HOUR}, x AS (SELECT station, CAST(hour AS DATE) AS day, least(speed, 100) AS humidity, speed / 4 AS dew_point,
        speed / 100 AS soil, gust / 50 AS vpd, gust / 2 AS cloud, total / 1000 AS et0 FROM sensor)
    SELECT station, day, {sql_rnd('avg(humidity)', 'humidity_mean', 9)}, {sql_rnd('min(humidity)', 'humidity_min', 9)},
      {sql_rnd('max(humidity)', 'humidity_max', 9)}, {sql_rnd('avg(dew_point)', 'dew_point_mean', 9)}, {sql_rnd('max(dew_point)', 'dew_point_max', 9)},
      {sql_rnd('avg(soil)', 'soil_moisture_mean', 9)}, {sql_rnd('max(soil)', 'soil_moisture_max', 9)}, {sql_rnd('avg(vpd)', 'vpd_mean', 9)},
      {sql_rnd('max(vpd)', 'vpd_max', 9)}, {sql_rnd('avg(cloud)', 'low_cloud_mean', 9)}, {sql_rnd('sum(et0)', 'et0_sum', 9)},
      count(*) FILTER (humidity >= 90) AS humid_hours, count(*) FILTER (humidity >= 97) AS fog_hours,
      count(*) FILTER (humidity < 30) AS dry_hours, count(*) FILTER (soil >= 0.35) AS soil_wet_hours FROM x GROUP BY 1, 2""",
)
def humidity(t: Tables) -> DataFrame:
    x = B.sensor_hour(t).withColumns(
        {
            "humidity": F.least("speed", F.lit(100.0)), "dew_point": F.col("speed") / 4,
            "soil_moisture": F.col("speed") / 100, "vpd": F.col("gust") / 50, "low_cloud": F.col("gust") / 2,
            "et0": F.col("total") / 1000,
        }
    )
    out = WX.humidity_soil_daily(x, "hour", ["station"])
    return rounded(out, ["station", "day", "humid_hours", "fog_hours", "dry_hours", "soil_wet_hours"], 9)


@query(
    "convective_daily",
    "A08",
    f"""WITH {B.SENSOR_HOUR} SELECT station, CAST(hour AS DATE) AS day, {sql_rnd('max(gust * 20)', 'cape_max')}, {sql_rnd('avg(gust * 20)', 'cape_mean')},
      {sql_rnd('min(4 - speed / 10)', 'lifted_index_min')}, {sql_rnd('min(-total)', 'cin_min')},
      count(*) FILTER (gust * 20 >= 1000) AS cape_moderate_hours, count(*) FILTER (gust * 20 >= 2500) AS cape_strong_hours,
      count(*) FILTER (4 - speed / 10 <= -2) AS unstable_hours, count(*) FILTER (4 - speed / 10 <= -6) AS severe_hours
    FROM sensor GROUP BY 1, 2""",
)
def convective(t: Tables) -> DataFrame:
    x = B.sensor_hour(t).withColumns(
        {"cape": F.col("gust") * 20, "lifted_index": 4 - F.col("speed") / 10, "cin": -F.col("total")}
    )
    out = WX.convective_daily(x, "hour", ["station"])
    return rounded(out, ["station", "day", *[c for c in out.columns if c.endswith("_hours")]])


@query(
    "air_quality_daily",
    "A09",
    f"""WITH {B.SENSOR_HOUR} SELECT station, CAST(hour AS DATE) AS day, {sql_rnd('avg(gust)', 'pm10_mean', 9)}, {sql_rnd('max(gust)', 'pm10_max', 9)},
      {sql_rnd('avg(speed)', 'pm25_mean', 9)}, {sql_rnd('avg(speed / 2)', 'dust_mean', 9)}, {sql_rnd('max(speed / 2)', 'dust_max', 9)},
      count(*) FILTER (gust >= 50) AS pm10_limit_hours, count(*) FILTER (gust >= 100) AS pm10_high_hours,
      count(*) FILTER (speed / 2 >= 20) AS dust_transport_hours FROM sensor GROUP BY 1, 2""",
)
def air(t: Tables) -> DataFrame:
    x = B.sensor_hour(t).withColumns({"pm10": F.col("gust"), "pm25": F.col("speed"), "dust": F.col("speed") / 2})
    out = WX.air_quality_daily(x, "hour", ["station"])
    return rounded(out, ["station", "day", *[c for c in out.columns if c.endswith("_hours")]], 9)


@query(
    "local_daily_from_hourly",
    "A10",
    f"""SELECT (ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Istanbul')::DATE AS day, {sql_rnd('sum(value)', 'value_sum')},
      {sql_rnd('avg(value)', 'value_mean')}, {sql_rnd('max(value)', 'value_max')} FROM events GROUP BY 1""",
)
def local_daily(t: Tables) -> DataFrame:
    return rounded(WX.local_daily_from_hourly(t.events, "ts", ["value"]), ["day"])


@query(
    "national_index",
    "A11",
    f"""WITH d AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice) AS s, max(o_totalprice) AS p, avg(o_totalprice) AS m FROM orders GROUP BY 1)
    SELECT d.day, {sql_rnd('d.s', 'national_total', 4)}, {sql_rnd('d.p', 'national_peak', 4)}, {sql_rnd('d.p / d.m', 'national_peak_ratio', 4)},
      {sql_rnd('e.s', 'national_year_ago', 4)}, {sql_rnd('ln(d.s / e.s)', 'national_growth', 4)}
    FROM d LEFT JOIN d e ON e.day = d.day - 364""",
)
def national(t: Tables) -> DataFrame:
    return rounded(WX.national_index(t.orders, "o_orderdate", "o_totalprice"), ["day"], 4)


@query(
    "regional_aggregates",
    "A12",
    f"""WITH {B.DENSE_USER}, r AS (SELECT day, avg(amount) AS m, max(amount) AS hi, stddev_samp(amount) AS sd,
        quantile_cont(amount, 0.1) AS q10, quantile_cont(amount, 0.5) AS q50, quantile_cont(amount, 0.9) AS q90 FROM dense GROUP BY 1)
    SELECT entity, day, {sql_rnd('m', 'region_amount_mean')}, {sql_rnd('hi', 'region_amount_max')}, {sql_rnd('sd', 'region_amount_std')},
      {sql_rnd('q10', 'region_amount_q10')}, {sql_rnd('q50', 'region_amount_q50')}, {sql_rnd('q90', 'region_amount_q90')},
      {sql_rnd('amount - m', 'amount_region_diff')} FROM dense JOIN r USING (day)""",
)
def regional(t: Tables) -> DataFrame:
    p = B.dense_user_day(t).drop("is_filled")
    return rounded(WX.regional_aggregates(p, "day", ["amount"]).drop("amount"), ["entity", "day"])


# ---- profiles -------------------------------------------------------------------------------------------------------

PROFILE_SQL = f"""{B.SUPPLIER_DAY}, prof AS (
  SELECT entity, day, qty - 1 AS use, s_acctbal AS cap, s_nationkey AS district,
         15 + 10 * sin(2 * pi() * dayofyear(day) / 365.0) AS degree
  FROM supplier_day JOIN supplier ON s_suppkey = entity)"""


def profile_rows(t: Tables) -> DataFrame:
    return (
        B.supplier_day(t)
        .join(t.supplier, F.col("entity") == F.col("s_suppkey"))
        .select(
            "entity",
            "day",
            (F.col("qty") - 1).alias("use"),
            F.col("s_acctbal").alias("cap"),
            F.col("s_nationkey").alias("district"),
            (15 + 10 * F.sin(2 * F.pi() * F.dayofyear("day") / 365.0)).alias("degree"),
        )
    )


_BUCKET = """CASE WHEN cap IS NULL OR cap <= 0 THEN -1 WHEN cap <= 100 THEN 0 WHEN cap <= 160 THEN 1 WHEN cap <= 250 THEN 2
  WHEN cap <= 400 THEN 3 WHEN cap <= 630 THEN 4 WHEN cap <= 1000 THEN 5 WHEN cap <= 1600 THEN 6 ELSE 7 END"""


def level_sql(src: str, keys: str, window: str, lo: str, hi: str) -> str:
    """SELECT over `src` (with use, cap, degree, day, and columns lo, hi, w0, w1) producing every level column."""
    recent = ", ".join(
        f"{sql_rnd(f'avg(y) FILTER (age <= {n - 1})', f'log_last{n}')}, count(*) FILTER (age <= {n - 1}) AS last{n}_days"
        for n in PR.RECENT_WINDOWS
    )
    return f"""SELECT {keys}, {sql_rnd('avg(y)', 'log_mean')}, {sql_rnd('stddev_pop(y)', 'log_std')}, {_q('y', 0.5, 'log_median')},
      {_q('y', 0.1, 'log_p10')}, {_q('y', 0.9, 'log_p90')}, count(*) AS days, {sql_rnd('avg((use <= 0)::INT)', 'zero_share')},
      {sql_rnd('avg(use) / nullif(arg_min(cap, day) * 24, 0)', 'load_factor')},
      {sql_rnd("CASE WHEN count(*) >= 3 AND var_pop(dayno) > 0 THEN regr_slope(y, dayno) END", 'trend', 8)},
      count(*) FILTER (lastpos IS NULL OR day > lastpos) AS tail_zero_run, CAST(min(age) AS INTEGER) AS last_row_age,
      {recent}, {sql_rnd(f'avg(y) FILTER ({window})', 'last_year_log_mean')},
      {sql_rnd(f'avg((use <= 0)::INT) FILTER ({window})', 'last_year_zero_share')},
      nullif(count(*) FILTER ({window}), 0) AS last_year_days,
      {sql_rnd('CASE WHEN count(*) >= 3 AND count(DISTINCT degree) >= 3 THEN regr_slope(y, degree) END', 'slope_degree')},
      (count(*) FILTER (lastpos IS NULL OR day > lastpos) >= 14)::INT AS dead,
      {sql_rnd('quantile_cont(y, 0.9) - quantile_cont(y, 0.1)', 'spread')},
      {sql_rnd('avg(y) FILTER (age <= 13) - avg(y)', 'drift')},
      {sql_rnd('CASE WHEN count(*) FILTER (month(day) IN (6, 7)) >= 15 AND count(*) FILTER (month(day) IN (1, 2, 3)) >= 15 THEN avg(y) FILTER (month(day) IN (6, 7)) - avg(y) FILTER (month(day) IN (1, 2, 3)) END', 'season_amplitude')},
      least(count(*) FILTER (month(day) IN (6, 7)), count(*) FILTER (month(day) IN (1, 2, 3))) AS season_days
    FROM (SELECT *, ln(1 + greatest(use, 0)) AS y, {hi} - day AS age, CAST(day - {lo} AS DOUBLE) AS dayno,
            max(CASE WHEN use > 0 THEN day END) OVER (PARTITION BY {keys}) AS lastpos FROM {src}) GROUP BY {keys}"""


_FIT = f"fit AS (SELECT * FROM prof WHERE day < DATE '{B.CUT}')"
_LEVEL = level_sql(
    "(SELECT *, (SELECT min(day) FROM fit) AS lo, (SELECT max(day) FROM fit) AS hi FROM fit)",
    "entity",
    "day BETWEEN DATE '1999-01-31' - 365 AND DATE '1999-06-30' - 365",
    "lo",
    "hi",
)


def _fit(t: Tables) -> PR.EntitySummaries:
    fit = profile_rows(t).filter(F.col("day") < B.CUT)
    window = (F.lit("1999-01-31").cast("date"), F.lit("1999-06-30").cast("date"))
    return PR.entity_summaries(
        fit, "entity", "day", "use", "cap", target_window=window, degree_columns=["degree"]
    )


_COUNTS = ["days", "tail_zero_run", "last_row_age", "last_year_days", "dead", "season_days"] + [
    f"last{n}_days" for n in PR.RECENT_WINDOWS
]


def _level_out(df: DataFrame, keys: list[str]) -> DataFrame:
    cols = [c for c in df.columns if c not in keys and c not in _COUNTS]
    return df.select(*keys, *_COUNTS, *[rnd(c, digits=8 if c == "trend" else 6) for c in cols])


@query(
    "entity_level_summary",
    "A13 A14 A15 A16 A17 A19 A18",
    f"""WITH {PROFILE_SQL}, {_FIT}, lv AS ({_LEVEL}),
    d AS (SELECT entity, isodow(day) AS dow, ln(1 + greatest(use, 0)) - avg(ln(1 + greatest(use, 0))) OVER (PARTITION BY entity) AS dev FROM fit),
    w AS (SELECT entity, dow, avg(dev) AS a FROM d GROUP BY 1, 2),
    m AS (SELECT entity, {sql_rnd('stddev_pop(a)', 'dow_amplitude')} FROM w GROUP BY 1)
    SELECT * FROM lv JOIN m USING (entity)""",
)
def level_summary(t: Tables) -> DataFrame:
    return _level_out(_fit(t).level, ["entity"])


@query(
    "entity_deviation_profiles",
    "A18",
    f"""WITH {PROFILE_SQL}, {_FIT}, d AS (SELECT entity, CAST(isodow(day) - 1 AS INTEGER) AS dow, CAST(month(day) AS INTEGER) AS moy,
        ln(1 + greatest(use, 0)) - avg(ln(1 + greatest(use, 0))) OVER (PARTITION BY entity) AS dev FROM fit)
    SELECT entity, 'dow' AS kind, dow AS slot, {sql_rnd('avg(dev)', 'deviation')} FROM d GROUP BY 1, 2, 3
    UNION ALL SELECT entity, 'month', moy, {sql_rnd('avg(dev)', 'deviation')} FROM d GROUP BY 1, 2, 3""",
)
def deviation_profiles(t: Tables) -> DataFrame:
    s = _fit(t)
    a = s.weekday.select("entity", F.lit("dow").alias("kind"), F.col("_dow").alias("slot"), rnd("dow_deviation", "deviation"))
    b = s.month.select("entity", F.lit("month").alias("kind"), F.col("_moy").alias("slot"), rnd("month_deviation", "deviation"))
    return a.unionByName(b)


@query(
    "apply_entity_summaries",
    "V07",
    f"""WITH {PROFILE_SQL}, fit AS (SELECT * FROM prof WHERE day < DATE '1995-02-01' AND entity % 7 <> 3), app AS (SELECT * FROM prof WHERE day >= DATE '1995-02-01'),
    lv AS (SELECT entity, avg(ln(1 + greatest(use, 0))) AS log_mean, count(*) AS days FROM fit GROUP BY 1),
    d AS (SELECT entity, day, ln(1 + greatest(use, 0)) - avg(ln(1 + greatest(use, 0))) OVER (PARTITION BY entity) AS dev FROM fit),
    w AS (SELECT entity, isodow(day) AS k, avg(dev) AS dd FROM d GROUP BY 1, 2), m AS (SELECT entity, month(day) AS k, avg(dev) AS md FROM d GROUP BY 1, 2)
    SELECT app.entity, app.day, {sql_rnd('log_mean', 'log_mean')}, days, (lv.entity IS NULL)::INT AS cold, {sql_rnd('dd', 'dow_deviation')},
      {sql_rnd('md', 'month_deviation')}
    FROM app LEFT JOIN lv ON lv.entity = app.entity LEFT JOIN w ON w.entity = app.entity AND w.k = isodow(app.day)
      LEFT JOIN m ON m.entity = app.entity AND m.k = month(app.day)""",
)
def apply_profiles(t: Tables) -> DataFrame:
    """Every seventh entity has no fit rows and must come out cold with NULL summaries."""
    rows = profile_rows(t)
    fit = rows.filter((F.col("day") < "1995-02-01") & (F.pmod("entity", F.lit(7)) != 3))
    app = rows.filter(F.col("day") >= "1995-02-01").select("entity", "day")
    s = PR.entity_summaries(fit, "entity", "day", "use", "cap")
    out = PR.apply_summaries(app, s, "day")
    return out.select(
        "entity", "day", rnd("log_mean"), "days", "cold", rnd("dow_deviation"), rnd("month_deviation")
    )


@query(
    "group_levels",
    "A20",
    f"""WITH {PROFILE_SQL}, {_FIT}, f AS (SELECT *, ln(1 + greatest(use, 0)) AS y, {_BUCKET} AS bucket FROM fit),
    app AS (SELECT *, {_BUCKET} AS bucket FROM prof WHERE day >= DATE '{B.CUT}'),
    b AS (SELECT bucket, avg(y) AS bm FROM f GROUP BY 1), d AS (SELECT district, avg(y) AS dm FROM f GROUP BY 1),
    c AS (SELECT district, bucket, avg(y) AS cm, count(*) AS n FROM f GROUP BY 1, 2)
    SELECT entity, day, bucket, {sql_rnd('bm', 'bucket_log_mean')}, {sql_rnd('dm', 'district_log_mean')}, {sql_rnd('cm', 'cell_log_mean')},
      coalesce(n, 0) AS cell_rows FROM app LEFT JOIN b USING (bucket) LEFT JOIN d USING (district) LEFT JOIN c USING (district, bucket)""",
)
def group_levels(t: Tables) -> DataFrame:
    rows = profile_rows(t)
    app, fit = rows.filter(F.col("day") >= B.CUT), rows.filter(F.col("day") < B.CUT)
    out = PR.add_group_levels(app.drop("use", "degree"), fit, "use", "cap", "district")
    return out.select(
        "entity", "day", "bucket", rnd("bucket_log_mean"), rnd("district_log_mean"), rnd("cell_log_mean"), "cell_rows"
    )


@query(
    "group_profiles",
    "A21",
    f"""WITH {PROFILE_SQL}, {_FIT}, f AS (SELECT *, {_BUCKET} AS bucket, ln(1 + greatest(use, 0)) - avg(ln(1 + greatest(use, 0)))
        OVER (PARTITION BY entity) AS dev FROM fit), app AS (SELECT *, {_BUCKET} AS bucket FROM prof WHERE day >= DATE '{B.CUT}'),
    a AS (SELECT district, month(day) AS k, avg(dev) AS x FROM f GROUP BY 1, 2), b AS (SELECT district, isodow(day) AS k, avg(dev) AS x FROM f GROUP BY 1, 2),
    c AS (SELECT bucket, month(day) AS k, avg(dev) AS x FROM f GROUP BY 1, 2)
    SELECT entity, day, {sql_rnd('a.x', 'district_month_dev')}, {sql_rnd('b.x', 'district_dow_dev')}, {sql_rnd('c.x', 'bucket_month_dev')}
    FROM app LEFT JOIN a ON a.district = app.district AND a.k = month(app.day) LEFT JOIN b ON b.district = app.district AND b.k = isodow(app.day)
      LEFT JOIN c ON c.bucket = app.bucket AND c.k = month(app.day)""",
)
def group_profiles(t: Tables) -> DataFrame:
    rows = profile_rows(t)
    app, fit = rows.filter(F.col("day") >= B.CUT), rows.filter(F.col("day") < B.CUT)
    out = PR.add_group_profiles(app.drop("use", "degree"), fit, "entity", "day", "use", "cap", "district")
    return out.select(
        "entity", "day", rnd("district_month_dev"), rnd("district_dow_dev"), rnd("bucket_month_dev")
    )


BLOCKS = [
    OB.Block("b97", "1995-01-01", "1996-12-31", "1997-01-01", "1997-04-30"),
    OB.Block("b98", "1995-01-01", "1998-05-31", "1998-06-01", "1998-09-30"),
    OB.Block("b98late", "1996-01-01", "1998-06-30", "1998-08-01", "1998-11-30"),
]


def _block_sql(b: OB.Block) -> str:
    span = f"BETWEEN DATE '{b.label_start}' AND DATE '{b.label_end}'"
    return f"""SELECT '{b.name}' AS block, l.entity, l.day, {sql_rnd('log_mean', 'log_mean')}, days, {sql_rnd('log_last30', 'log_last30')},
      {sql_rnd('ly', 'last_year_log_mean')}, (s.entity IS NULL)::INT AS cold, {sql_rnd('CASE WHEN s.entity IS NOT NULL THEN w.x END', 'dow_deviation')},
      {sql_rnd('c.cm', 'cell_log_mean')}, {sql_rnd('p.x', 'district_month_dev')},
      count(*) OVER (PARTITION BY l.entity) AS present_days,
      CAST(l.day - (SELECT max(day) FROM fit) AS INTEGER) AS horizon_day,
      {sql_rnd('days / ((SELECT max(day) FROM fit) - (SELECT min(day) FROM fit) + 1)', 'summary_fill')}
    FROM lab l
    LEFT JOIN (SELECT entity, avg(y) AS log_mean, count(*) AS days, avg(y) FILTER (day > (SELECT max(day) FROM fit) - 30) AS log_last30,
        avg(y) FILTER (day BETWEEN (SELECT min(day) FROM lab) - 365 AND (SELECT max(day) FROM lab) - 365) AS ly FROM fit GROUP BY 1) s ON s.entity = l.entity
    LEFT JOIN (SELECT entity, isodow(day) AS k, avg(dev) AS x FROM outs GROUP BY 1, 2) w ON w.entity = l.entity AND w.k = isodow(l.day)
    LEFT JOIN (SELECT district, bucket, avg(y) AS cm FROM fit GROUP BY 1, 2) c ON c.district = l.district AND c.bucket = l.bucket
    LEFT JOIN (SELECT district, month(day) AS k, avg(dev) AS x FROM outs GROUP BY 1, 2) p ON p.district = l.district AND p.k = month(l.day)"""


def _block_query(b: OB.Block) -> str:
    return f"""SELECT * FROM (WITH lab AS (SELECT * FROM pb WHERE day BETWEEN DATE '{b.label_start}' AND DATE '{b.label_end}'),
      fit AS (SELECT * FROM pb WHERE day BETWEEN DATE '{b.summary_start}' AND DATE '{b.summary_end}'),
      outs AS (SELECT *, y - avg(y) OVER (PARTITION BY entity) AS dev FROM pb WHERE day NOT BETWEEN DATE '{b.label_start}' AND DATE '{b.label_end}')
      {_block_sql(b)})"""


_BLOCKS_SQL = (
    f"WITH {PROFILE_SQL}, pb AS (SELECT *, ln(1 + greatest(use, 0)) AS y, {_BUCKET} AS bucket FROM prof) "
    + " UNION ALL ".join(_block_query(b) for b in BLOCKS)
)


def _blocks(t: Tables) -> DataFrame:
    out = OB.rolling_origin_blocks(
        profile_rows(t), BLOCKS, "entity", "day", "use", "cap", "district", ["degree"]
    )
    return out.select(
        "block", "entity", "day", rnd("log_mean"), "days", rnd("log_last30"), rnd("last_year_log_mean"), "cold",
        rnd("dow_deviation"), rnd("cell_log_mean"), rnd("district_month_dev"), "present_days", "horizon_day",
        rnd("summary_fill"),
    )


@query("rolling_origin_blocks", "V06 A13 A14 A16 A18 A20 A21 A23", _BLOCKS_SQL)
def blocks(t: Tables) -> DataFrame:
    return _blocks(t)


@query(
    "clear_origin_blocks",
    "U05",
    f"WITH {B.SUPPLIER_DAY} SELECT 'b97' AS block, count(*) AS n FROM supplier_day WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-04-30'",
)
def clear_blocks(t: Tables) -> DataFrame:
    """b98 overlaps the label window of b98late, so only b97 may train for it."""
    rows = OB.label_rows(B.supplier_day(t), "day", BLOCKS)
    return OB.keep_clear_blocks(rows, BLOCKS, BLOCKS[2]).groupBy("block").agg(F.count(F.lit(1)).alias("n"))


# ---- structure, months, events ----------------------------------------------------------------------------------------


@query(
    "district_structure",
    "A22 W17",
    f"""WITH e AS (SELECT c_custkey, c_nationkey, abs(c_acctbal) AS cap FROM customer),
    d AS (SELECT c_nationkey, count(*) AS district_entities, sum(cap) AS tot, median(cap) AS med FROM e GROUP BY 1),
    r AS (SELECT *, (rank() OVER (PARTITION BY c_nationkey ORDER BY cap) + (count(*) OVER (PARTITION BY c_nationkey, cap) - 1) / 2.0)
        / count(*) OVER (PARTITION BY c_nationkey) AS pct FROM e)
    SELECT c_custkey, c_nationkey, district_entities, {sql_rnd('cap', 'cap')}, {sql_rnd('tot', 'district_capacity')},
      {sql_rnd('med', 'district_capacity_median')}, {sql_rnd('pct', 'capacity_pct')}, {sql_rnd('cap / nullif(tot, 0)', 'capacity_share')},
      {sql_rnd('cap / nullif(med, 0)', 'capacity_over_median')}, (c_nationkey + 1) * 1000 AS population,
      {sql_rnd('(c_nationkey + 1) * 1000 / district_entities', 'people_per_entity')},
      {sql_rnd('(c_nationkey + 1) * 1000 / nullif(tot, 0)', 'people_per_capacity')}
    FROM r JOIN d USING (c_nationkey)""",
)
def structure(t: Tables) -> DataFrame:
    e = t.customer.select("c_custkey", "c_nationkey", F.abs("c_acctbal").alias("cap"))
    people = t.nation.select(
        F.col("n_nationkey").alias("c_nationkey"), ((F.col("n_nationkey") + 1) * 1000).alias("population")
    )
    out = A.district_structure(e, "c_custkey", "c_nationkey", "cap", people)
    return rounded(out, ["c_custkey", "c_nationkey", "district_entities", "population"])


@query(
    "previous_month_features",
    "A24",
    f"""WITH {B.DENSE_SUPPLIER}, m AS (SELECT entity, year(day) * 12 + month(day) - 1 AS mi, sum(qty) AS tot, avg(qty) AS av, max(qty) AS hi,
        count(*) FILTER (qty > 0) AS ev, count(*) FILTER (qty = 0) AS em FROM dense GROUP BY 1, 2),
    a AS (SELECT *, year(day - 6) * 12 + month(day - 6) - 2 AS mi FROM dense)
    SELECT a.entity, a.day, {sql_rnd('tot', 'qty_h7_month_total')}, {sql_rnd('av', 'qty_h7_month_mean')}, {sql_rnd('hi', 'qty_h7_month_max')},
      ev AS qty_h7_month_event_days, em AS qty_h7_month_empty_days, {sql_rnd('s.qty', 'qty_h7_month_same_day')}
    FROM a LEFT JOIN m ON m.entity = a.entity AND m.mi = a.mi
      LEFT JOIN dense s ON s.entity = a.entity AND year(s.day) * 12 + month(s.day) - 1 = a.mi AND day(s.day) = day(a.day)""",
)
def previous_month(t: Tables) -> DataFrame:
    out = A.previous_month_features(B.dense_supplier_day(t), "qty", ["entity"], "day", 7)
    return rounded(
        out.drop("qty", "is_filled"), ["entity", "day", "qty_h7_month_event_days", "qty_h7_month_empty_days"]
    )


@query(
    "mass_event_features",
    "A25",
    f"""WITH {B.DENSE_SUPPLIER}, s AS (SELECT day, avg((qty > 0)::INT) AS share FROM dense GROUP BY 1),
    l AS (SELECT day, lag(share, 7) OVER (ORDER BY day) AS a, avg(share) OVER (ORDER BY day ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) AS b FROM s)
    SELECT entity, day, {sql_rnd('a', 'qty_h7_mass_share')}, {sql_rnd('b', 'qty_h7_mass_share_mean7')}, (a >= 0.25)::INT AS qty_h7_mass_flag
    FROM dense JOIN l USING (day)""",
)
def mass_events(t: Tables) -> DataFrame:
    out = A.mass_event_features(B.dense_supplier_day(t), "qty", ["entity"], "day", 7, 0.25)
    return rounded(out.drop("qty", "is_filled"), ["entity", "day", "qty_h7_mass_flag"])


_STRATA = """v AS (SELECT *, o_orderpriority AS p, ntile_price AS b FROM (SELECT *, floor(ln(1 + o_totalprice)) AS ntile_price FROM orders)
    WHERE o_orderdate < DATE '1999-01-01'),
  t AS (SELECT *, o_orderpriority AS p, floor(ln(1 + o_totalprice)) AS b FROM orders WHERE o_orderdate >= DATE '1999-01-01' AND o_totalprice > 20000)"""


def _strata(t: Tables):
    o = t.orders.withColumns(
        {"p": F.col("o_orderpriority"), "b": F.floor(F.log1p("o_totalprice"))}
    ).select("o_orderkey", "o_orderdate", "o_totalprice", "p", "b")
    return o.filter(F.col("o_orderdate") < "1999-01-01"), o.filter(
        (F.col("o_orderdate") >= "1999-01-01") & (F.col("o_totalprice") > 20000)
    )


_WEIGHT_SQL = f"""WITH {_STRATA}, sv AS (SELECT p, b, count(*) AS nv FROM v GROUP BY 1, 2), st AS (SELECT p, b, count(*) AS nt FROM t GROUP BY 1, 2),
    r AS (SELECT p, b, nv, coalesce(nt, 0) / (SELECT count(*) FROM t) / (nv / (SELECT count(*) FROM v)) AS w FROM sv LEFT JOIN st USING (p, b)),
    m AS (SELECT *, w / (SELECT sum(w * nv) / sum(nv) FROM r) AS u FROM r), c AS (SELECT *, least(u, 1.05) AS c FROM m),
    f AS (SELECT *, c / (SELECT sum(c * nv) / sum(nv) FROM c) AS weight FROM c)"""


@query("stratum_weights", "A27", f"{_WEIGHT_SQL} SELECT o_orderkey, {sql_rnd('weight', 'weight')} FROM v JOIN f USING (p, b)")
def strata(t: Tables) -> DataFrame:
    valid, test = _strata(t)
    out, _ = A.stratum_weights(valid, test, ["p", "b"], cap=1.05)
    return out.select("o_orderkey", rnd("weight"))


@query(
    "stratum_diagnosis",
    "A27",
    f"""{_WEIGHT_SQL} SELECT CAST(sum(nv) AS BIGINT) AS n, count(*) AS strata, {sql_rnd('power(sum(weight * nv), 2) / (sum(weight * weight * nv) * sum(nv))', 'ess_ratio')},
      {sql_rnd('sum(CASE WHEN u > 1.05 THEN nv ELSE 0 END) / sum(nv)', 'capped')},
      {sql_rnd('(SELECT count(*) FROM t ANTI JOIN v USING (p, b)) / (SELECT count(*) FROM t)', 'uncovered')} FROM f""",
)
def strata_diagnosis(t: Tables) -> DataFrame:
    valid, test = _strata(t)
    return rounded(A.stratum_weights(valid, test, ["p", "b"], cap=1.05)[1], ["n", "strata"])


@query(
    "hierarchical_means",
    "A28",
    f"""WITH {PROFILE_SQL}, {_FIT}, f AS (SELECT *, ln(1 + greatest(use, 0)) AS y, {_BUCKET} AS bucket FROM fit), app AS (SELECT *, {_BUCKET} AS bucket FROM prof WHERE day >= DATE '{B.CUT}'),
    d AS (SELECT district, sum(y) AS s, count(*) AS n FROM f GROUP BY 1), c AS (SELECT district, bucket, sum(y) AS s, count(*) AS n FROM f GROUP BY 1, 2),
    x AS (SELECT entity, day, bucket, app.district, (coalesce(d.s, 0) + 50 * (SELECT avg(y) FROM f)) / (coalesce(d.n, 0) + 50) AS dm FROM app LEFT JOIN d ON d.district = app.district)
    SELECT entity, day, {sql_rnd('(coalesce(c.s, 0) + 20 * dm) / (coalesce(c.n, 0) + 20)', 'eb_mean')} FROM x LEFT JOIN c ON c.district = x.district AND c.bucket = x.bucket""",
)
def eb_means(t: Tables) -> DataFrame:
    from panelforge.operators.columns import capacity_bucket

    rows = profile_rows(t).withColumns({"y": PR.log_target("use"), "bucket": capacity_bucket("cap")})
    fit, app = rows.filter(F.col("day") < B.CUT), rows.filter(F.col("day") >= B.CUT)
    out = A.hierarchical_means(fit, app.select("entity", "day", "district", "bucket"), "y", [["district"], ["district", "bucket"]], [50, 20])
    return out.select("entity", "day", rnd("eb_mean"))


@query(
    "one_way_day_effect",
    "A29",
    f"""WITH {B.SUPPLIER_DAY}, c AS (SELECT day, qty - avg(qty) OVER (PARTITION BY entity) AS c FROM supplier_day),
    d AS (SELECT day, avg(c) AS e FROM c GROUP BY 1) SELECT day, {sql_rnd('e - (SELECT avg(e) FROM d)', 'day_effect')} FROM d""",
)
def one_way(t: Tables) -> DataFrame:
    return rounded(A.one_way_day_effect(B.supplier_day(t), "entity", "day", "qty"), ["day"])


@query(
    "two_way_effects",
    "A29",
    f"""WITH {B.DENSE_USER}, m AS (SELECT day, avg(amount) AS m FROM dense GROUP BY 1)
    SELECT day, {sql_rnd('m - (SELECT avg(m) FROM m)', 'day_effect')} FROM m""",
)
def two_way(t: Tables) -> DataFrame:
    """The dense panel is balanced, so the effect is the day mean less their mean; the tests fit an unbalanced one."""
    return rounded(A.two_way_effects(B.dense_user_day(t), "entity", "day", "amount"), ["day"])


@query(
    "cluster_slope",
    "A30",
    f"""WITH x AS (SELECT o_orderdate::DATE AS day, CAST(o_orderkey % 97 AS DOUBLE) AS u, o_totalprice / 1000 AS r FROM orders),
    b AS (SELECT regr_slope(r, u) AS b1, regr_intercept(r, u) AS b0, count(*) AS n, sum(u) AS su, sum(u * u) AS suu FROM x),
    s AS (SELECT day, sum(r - b0 - b1 * u) AS s0, sum(u * (r - b0 - b1 * u)) AS s1 FROM x, b GROUP BY 1)
    SELECT {sql_rnd('max(b1)', 'slope', 8)}, {sql_rnd('sqrt(sum(power((n * s1 - su * s0) / (n * suu - su * su), 2)))', 'slope_se', 8)},
      {sql_rnd('max(b0)', 'intercept')}, count(*) AS clusters FROM s, b""",
)
def robust_slope(t: Tables) -> DataFrame:
    x = t.orders.select(
        F.to_date("o_orderdate").alias("day"),
        F.pmod("o_orderkey", F.lit(97)).cast("double").alias("u"),
        (F.col("o_totalprice") / 1000).alias("r"),
    )
    out = A.cluster_slope(x, "u", "r", "day")
    return out.select(rnd("slope", digits=8), rnd("slope_se", digits=8), rnd("intercept"), "clusters")


@query(
    "tail_summary",
    "A31",
    f"""WITH {PROFILE_SQL}, r AS (SELECT *, ln(1 + greatest(use, 0)) - ln(1 + abs(cap)) AS ofs, day - lag(day) OVER (PARTITION BY entity ORDER BY day) AS gap,
        row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS back FROM prof WHERE day < DATE '{B.CUT}'),
    p AS (SELECT entity, ofs, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS pb FROM r WHERE use > 0),
    a AS (SELECT entity, avg(ofs) AS o, count(*) AS n FROM p WHERE pb <= 60 GROUP BY 1)
    SELECT r.entity, max(day) AS last_day, min(day) AS first_day, count(*) AS rows, count(*) FILTER (use > 0) AS positive_rows, max(use) AS max_value,
      max(use) FILTER (back <= 60) AS recent_max, count(*) FILTER (back <= 60) AS recent_rows, CAST(coalesce(max(gap), 0) AS INTEGER) AS largest_gap,
      {sql_rnd('CASE WHEN max(a.n) >= 10 THEN max(a.o) END', 'anchor_offset')}, coalesce(max(a.n), 0) AS anchor_rows
    FROM r LEFT JOIN a ON a.entity = r.entity GROUP BY 1""",
)
def tails(t: Tables) -> DataFrame:
    rows = profile_rows(t).withColumn("ofs", PR.log_target("use") - F.log1p(F.abs("cap")))
    out = A.tail_summary(rows, "entity", "day", "use", "ofs", B.CUT)
    return out.withColumn("anchor_offset", F.round("anchor_offset", 6) + 0.0)


@query(
    "ewma_level",
    "A32",
    f"""WITH {B.SUPPLIER_DAY}, p AS (SELECT *, power(0.5, (DATE '{B.CUT}' - day) / 30.0) AS w FROM supplier_day WHERE day < DATE '{B.CUT}'),
    l AS (SELECT entity, sum(w * qty) / sum(w) AS level FROM p GROUP BY 1)
    SELECT s_suppkey AS entity, {sql_rnd(f"coalesce(level, (SELECT avg(qty) FROM p))", 'level')} FROM supplier LEFT JOIN l ON l.entity = s_suppkey""",
)
def ewma(t: Tables) -> DataFrame:
    keys = t.supplier.select(F.col("s_suppkey").alias("entity"))
    return rounded(A.ewma_level(B.supplier_day(t), "entity", "day", "qty", B.CUT, 30.0, keys), ["entity"])


@query(
    "reactivation",
    "A33",
    f"""WITH {B.DENSE_USER}, p AS (SELECT entity, avg(amount) FILTER (day BETWEEN DATE '2024-01-01' AND DATE '2024-01-01') AS a,
        avg(amount) FILTER (day BETWEEN DATE '2024-01-02' AND DATE '2024-01-03') AS b FROM dense GROUP BY 1)
    SELECT count(*) AS quiet, count(b) AS seen_later, count(*) FILTER (b > 0) AS woken, count(*) FILTER (b = 0) AS still_zero,
      {sql_rnd('count(*) FILTER (b > 0) / nullif(count(*), 0)', 'woken_share')} FROM p WHERE a = 0""",
)
def woken(t: Tables) -> DataFrame:
    out = A.reactivation(
        B.dense_user_day(t), "entity", "day", "amount", ("2024-01-01", "2024-01-01"), ("2024-01-02", "2024-01-03")
    )
    return rounded(out, ["quiet", "seen_later", "woken", "still_zero"])


_TRANSFER = """rows0 AS (SELECT o_custkey AS entity, c_nationkey AS location, o_orderdate::DATE AS day, sum(o_totalprice) AS v
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
  f AS (SELECT entity, location, min(day) AS first FROM rows0 GROUP BY 1, 2), x AS (SELECT min(day) AS lo, max(day) AS hi FROM rows0),
  births AS (SELECT location, first AS b, count(*) AS n_new FROM f, x WHERE first - 200 >= lo AND first + 200 <= hi GROUP BY 1, 2),
  m AS (SELECT s.location, b, n_new, r.entity, avg(v) FILTER (day BETWEEN b - 200 AND b - 1) AS av_b, avg(v) FILTER (day BETWEEN b + 1 AND b + 200) AS av_a,
      count(*) FILTER (day BETWEEN b - 200 AND b - 1) AS nb, count(*) FILTER (day BETWEEN b + 1 AND b + 200) AS na
    FROM births s JOIN f ON f.location = s.location AND f.first < s.b - 200 JOIN rows0 r ON r.entity = f.entity
    WHERE day BETWEEN b - 200 AND b + 200 AND day <> b GROUP BY 1, 2, 3, 4),
  e AS (SELECT location, b, max(n_new) AS n_new, count(*) AS n_settled, sum(av_b) AS sb, sum(av_a) AS sa FROM m WHERE nb >= 1 AND na >= 1 GROUP BY 1, 2 HAVING sum(av_b) > 0),
  c AS (SELECT day, sum(v) AS c FROM rows0 JOIN f USING (entity) , x WHERE f.first = lo GROUP BY 1),
  k AS (SELECT b, sum(c) FILTER (day < b) / 200.0 AS cb, sum(c) FILTER (day > b) / 200.0 AS ca FROM (SELECT DISTINCT b FROM e) JOIN c ON day BETWEEN b - 200 AND b + 200 AND day <> b GROUP BY 1)"""


@query(
    "load_transfer_study",
    "A34",
    f"""WITH {_TRANSFER} SELECT location, e.b AS birth_day, n_new, n_settled, {sql_rnd('sb', 'before_total', 4)}, {sql_rnd('sa', 'after_total', 4)},
      {sql_rnd('CASE WHEN cb > 0 AND ca > 0 THEN ln(ca / cb) END', 'control')}, {sql_rnd('ln(greatest(sa, 1e-6) / sb)', 'log_ratio')},
      {sql_rnd('ln(greatest(sa, 1e-6) / sb) - CASE WHEN cb > 0 AND ca > 0 THEN ln(ca / cb) END', 'effect')}
    FROM e LEFT JOIN k ON k.b = e.b""",
)
def load_transfer(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    out = A.load_transfer_study(rows, "o_custkey", "c_nationkey", "o_orderdate", "o_totalprice", 200, 1)
    return out.select(
        F.col("c_nationkey").alias("location"), "birth_day", "n_new", "n_settled", rnd("before_total", digits=4),
        rnd("after_total", digits=4), rnd("control"), rnd("log_ratio"), rnd("effect"),
    )
