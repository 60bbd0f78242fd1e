"""Horizon-safe history windows, weather windows and calendar columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import calendar as K
from panelforge.functions import season as S
from panelforge.operators import weather as WX
from panelforge.operators import windows as W
from panelforge.plans import bases as B
from panelforge.plans.registry import ORACLES, Tables, query, rounded, sql_rnd

_E = "PARTITION BY entity ORDER BY day"


def _roll(agg: str, size: int, h: int, name: str, col: str = "amount") -> str:
    return sql_rnd(
        f"{agg}({col}) OVER ({_E} ROWS BETWEEN {h + size - 1} PRECEDING AND {h} PRECEDING)", name
    )


@query(
    "lag_features",
    "W01",
    f"""WITH {B.DENSE_SUPPLIER} SELECT entity, day, qty, is_filled, lag(qty, 7) OVER w AS qty_shift7,
      lag(qty, 30) OVER w AS qty_shift30, lag(qty, 7) OVER w AS qty_h7_lag1, lag(qty, 8) OVER w AS qty_h7_lag2
    FROM dense WINDOW w AS ({_E})""",
)
def lags(t: Tables) -> DataFrame:
    p = W.lag_features(B.dense_supplier_day(t), "qty", ["entity"], "day", 7, shifts=[7, 30])
    return W.lag_features(p, "qty", ["entity"], "day", 7, lags=[1, 2])


@query(
    "rolling_features",
    "W02",
    f"""WITH {B.DENSE_USER} SELECT entity, day, {_roll('avg', 7, 3, 'amount_h3_roll7_mean')},
      {_roll('stddev_samp', 7, 3, 'amount_h3_roll7_std', 'round(amount, 2)')}, {_roll('min', 7, 3, 'amount_h3_roll7_min')},
      {_roll('max', 7, 3, 'amount_h3_roll7_max')}, {_roll('median', 7, 3, 'amount_h3_roll7_median')},
      {_roll('sum', 7, 3, 'amount_h3_roll7_sum')}, {_roll('avg', 14, 3, 'amount_h3_roll14_mean')}
    FROM dense""",
)
def rolling(t: Tables) -> DataFrame:
    p = B.dense_user_day(t).withColumn("amount", F.round("amount", 2))
    out = W.rolling_features(
        p, "amount", ["entity"], "day", 3, [7], ["mean", "std", "min", "max", "median", "sum"]
    )
    out = W.rolling_features(out, "amount", ["entity"], "day", 3, [14], ["mean"])
    return rounded(out.drop("amount", "is_filled"), ["entity", "day"])


@query(
    "rolling_supplier",
    "W02",
    f"""WITH {B.DENSE_SUPPLIER} SELECT entity, day, {_roll('avg', 28, 7, 'qty_h7_roll28_mean', 'qty')},
      {_roll('max', 28, 7, 'qty_h7_roll28_max', 'qty')} FROM dense""",
)
def rolling_supplier(t: Tables) -> DataFrame:
    out = W.rolling_features(B.dense_supplier_day(t), "qty", ["entity"], "day", 7, [28], ["mean", "max"])
    return rounded(out.drop("qty", "is_filled"), ["entity", "day"])


@query(
    "rolling_calendar_days",
    "W02",
    f"""WITH {B.SUPPLIER_DAY} SELECT entity, day, {sql_rnd('''avg(qty) OVER (PARTITION BY entity ORDER BY day
      RANGE BETWEEN INTERVAL 20 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING)''', 'qty_h7_cal14_mean')} FROM supplier_day""",
)
def rolling_calendar(t: Tables) -> DataFrame:
    out = W.calendar_rolling(B.supplier_day(t), "qty", ["entity"], "day", 7, 14)
    return rounded(out.drop("qty"), ["entity", "day"])


@query(
    "expanding_features",
    "W03",
    f"""WITH {B.DENSE_USER} SELECT entity, day,
      {sql_rnd(f'avg(amount) OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING)', 'amount_expanding_mean')},
      {sql_rnd(f'stddev_samp(amount) OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING)', 'amount_expanding_std')}
    FROM dense""",
)
def expanding(t: Tables) -> DataFrame:
    out = W.expanding_features(B.dense_user_day(t), "amount", ["entity"], "day", 5)
    return rounded(out.drop("amount", "is_filled"), ["entity", "day"])


@query(
    "event_decay",
    "W04",
    f"""WITH {B.USER_DAY}, d AS (
      SELECT entity, day, amount, lag(day, 2) OVER (PARTITION BY entity ORDER BY day) AS seen FROM user_day)
    SELECT a.entity, a.day, {sql_rnd('sum(power(2.0, -(a.seen - b.day) / 3.0) * (b.amount > 0)::INT)', 'amount_h2_decay3d_event')},
      {sql_rnd('sum(power(2.0, -(a.seen - b.day) / 3.0) * b.amount)', 'amount_h2_decay3d_value')},
      {sql_rnd('sum(power(2.0, -(a.seen - b.day) / 14.0) * (b.amount > 0)::INT)', 'amount_h2_decay14d_event')},
      {sql_rnd('sum(power(2.0, -(a.seen - b.day) / 14.0) * b.amount)', 'amount_h2_decay14d_value')}
    FROM d a LEFT JOIN user_day b ON b.entity = a.entity AND b.day <= a.seen GROUP BY 1, 2""",
)
def decay(t: Tables) -> DataFrame:
    rows = B.user_rows(t).groupBy("entity", "day").agg(F.sum("amount").alias("amount"))
    return rounded(W.event_decay_features(rows, "amount", ["entity"], "day", 2).drop("amount"), ["entity", "day"])


@query(
    "event_decay_long_history",
    "W04",
    f"""WITH {B.SUPPLIER_DAY}, d AS (
      SELECT entity, day, qty, lag(day, 7) OVER (PARTITION BY entity ORDER BY day) AS seen FROM supplier_day)
    SELECT a.entity, a.day, {sql_rnd('sum(power(2.0, -(a.seen - b.day) / 1.0) * (b.qty > 0)::INT)', 'qty_h7_decay1d_event')},
      {sql_rnd('sum(power(2.0, -(a.seen - b.day) / 1.0) * b.qty)', 'qty_h7_decay1d_value')}
    FROM d a LEFT JOIN supplier_day b ON b.entity = a.entity AND b.day <= a.seen GROUP BY 1, 2""",
)
def decay_long(t: Tables) -> DataFrame:
    """Half-life of one day over 2,499 days: the exponent passes the segment length several times."""
    out = W.event_decay_features(B.supplier_day(t), "qty", ["entity"], "day", 7, [1.0])
    return rounded(out.drop("qty"), ["entity", "day"])


@query(
    "days_since_event",
    "W05",
    f"""WITH {B.DENSE_SUPPLIER}, s AS (SELECT entity, day, max(CASE WHEN qty > 0 THEN day END)
      OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND 7 PRECEDING) AS last FROM dense)
    SELECT entity, day, CAST(day - last AS INTEGER) AS qty_h7_days_since_event,
      CASE WHEN last IS NULL THEN 1 ELSE 0 END AS qty_h7_never_event FROM s""",
)
def since(t: Tables) -> DataFrame:
    return W.days_since_event(B.dense_supplier_day(t), "qty", ["entity"], "day", 7).drop("qty", "is_filled")


@query(
    "consecutive_extreme_days",
    "W06",
    f"""WITH {B.DENSE_SUPPLIER}, i AS (SELECT *, sum(CASE WHEN qty < 1 THEN 0 ELSE 1 END) OVER ({_E}) AS island FROM dense)
    SELECT entity, day, CAST(sum(CASE WHEN qty < 1 THEN 1 ELSE 0 END)
      OVER (PARTITION BY entity, island ORDER BY day) AS BIGINT) AS qty_run_below FROM i""",
)
def runs(t: Tables) -> DataFrame:
    out = W.consecutive_extreme_days(B.dense_supplier_day(t), "qty", ["entity"], "day", 1.0, above=False)
    return out.select("entity", "day", "qty_run_below")


@query(
    "hot_streak",
    "W07",
    f"""WITH {B.WEATHER_DAY}, i AS (SELECT *, sum(CASE WHEN t_max > 32 THEN 0 ELSE 1 END)
      OVER (PARTITION BY station ORDER BY day) AS island FROM weather)
    SELECT station, day, CAST(sum(CASE WHEN t_max > 32 THEN 1 ELSE 0 END)
      OVER (PARTITION BY station, island ORDER BY day) AS BIGINT) AS hot_streak FROM i""",
)
def streak(t: Tables) -> DataFrame:
    return WX.hot_streak(B.weather_day(t), "t_max", ["station"], "day").select("station", "day", "hot_streak")


@query(
    "antecedent_rain",
    "W08",
    f"""WITH {B.WEATHER_DAY} SELECT station, day, {sql_rnd('''coalesce(sum(rain) OVER (PARTITION BY station ORDER BY day
      ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0)''', 'antecedent_rain_7d')} FROM weather""",
)
def wet_before(t: Tables) -> DataFrame:
    out = WX.antecedent_rain(B.weather_day(t), "rain", ["station"], "day")
    return rounded(out.select("station", "day", "antecedent_rain_7d"), ["station", "day"])


@query(
    "physical_derivatives",
    "W09 W06",
    f"""WITH {B.WEATHER_DAY}, a AS (SELECT *,
        sum(CASE WHEN t_min > 22 THEN 0 ELSE 1 END) OVER w AS i1, sum(CASE WHEN rain < 1 THEN 0 ELSE 1 END) OVER w AS i2,
        sum(rain) OVER (PARTITION BY station ORDER BY day ROWS 6 PRECEDING) AS rain_7d,
        max(gust) OVER (PARTITION BY station ORDER BY day ROWS 2 PRECEDING) AS wind_3d_max
      FROM weather WINDOW w AS (PARTITION BY station ORDER BY day)),
    b AS (SELECT *, sum(CASE WHEN t_min > 22 THEN 1 ELSE 0 END) OVER (PARTITION BY station, i1 ORDER BY day) AS night,
        sum(CASE WHEN rain < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY station, i2 ORDER BY day) AS drought FROM a)
    SELECT station, day, {sql_rnd('greatest(18 - t_mean, 0)', 'heating_degree_days')},
      {sql_rnd('greatest(t_mean - 18, 0)', 'cooling_degree_days')}, {sql_rnd('t_max - t_min', 'daily_range')},
      CAST(night AS BIGINT) AS tropical_night_run, CAST(drought AS BIGINT) AS drought_run,
      CASE WHEN rain >= 1 AND coalesce(lag(drought) OVER (PARTITION BY station ORDER BY day), 0) >= 3 THEN 1 ELSE 0 END
        AS first_rain_after_drought, {sql_rnd('rain_7d', 'rain_7d')}, {sql_rnd('wind_3d_max', 'wind_3d_max')},
      {sql_rnd('rain_7d * gust', 'wet_wind', 8)}
    FROM b""",
)
def physical(t: Tables) -> DataFrame:
    out = WX.physical_derivatives(
        B.weather_day(t), ["station"], "day", "t_mean", "t_max", "t_min", "rain", "gust", drought_days=3
    )
    out = out.withColumn("wet_wind", F.round("wet_wind", 8)).drop("t_mean", "t_max", "t_min", "rain", "gust")
    keep = ["station", "day", "tropical_night_run", "drought_run", "first_rain_after_drought", "wet_wind"]
    return rounded(out, keep)


@query(
    "weather_accumulators",
    "W10",
    f"""WITH {B.WEATHER_DAY} SELECT station, day,
      {sql_rnd('max(gust) OVER (PARTITION BY station ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)', 'gust_back3_max')},
      {sql_rnd('avg(gust) OVER (PARTITION BY station ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)', 'gust_back3_mean')},
      {sql_rnd('max(gust) OVER (PARTITION BY station ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)', 'gust_back7_max')},
      {sql_rnd('avg(gust) OVER (PARTITION BY station ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)', 'gust_back7_mean')},
      {sql_rnd('max(gust) OVER (PARTITION BY station ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)', 'gust_ahead3_max')}
    FROM weather""",
)
def accumulators(t: Tables) -> DataFrame:
    out = WX.weather_accumulators(B.weather_day(t), ["station"], "day", ["gust"], (3, 7), 1, (3,))
    return rounded(out.drop("t_mean", "t_max", "t_min", "rain", "gust"), ["station", "day"])


@query(
    "rain_anomaly",
    "W11",
    f"""WITH {B.WEATHER_DAY}, s AS (SELECT station, day,
        sum(rain) OVER (PARTITION BY station ORDER BY day ROWS 6 PRECEDING) AS s7,
        sum(rain) OVER (PARTITION BY station ORDER BY day ROWS 29 PRECEDING) AS s30 FROM weather)
    SELECT station, day, {sql_rnd('s7 - avg(s7) OVER (PARTITION BY station ORDER BY day)', 'rain_anomaly7d', 8)},
      {sql_rnd('s30 - avg(s30) OVER (PARTITION BY station ORDER BY day)', 'rain_anomaly30d', 8)} FROM s""",
)
def anomaly(t: Tables) -> DataFrame:
    out = WX.rain_anomaly(B.weather_day(t), "rain", ["station"], "day", (7, 30))
    return rounded(out.select("station", "day", "rain_anomaly7d", "rain_anomaly30d"), ["station", "day"], 8)


@query(
    "thermal_inertia",
    "W12",
    f"""WITH {B.WEATHER_DAY}, c AS (SELECT *, greatest(t_mean - 22, 0) AS cdd22 FROM weather)
    SELECT station, day, {sql_rnd('cdd22', 'cdd22')},
      {sql_rnd('avg(t_mean) OVER (PARTITION BY station ORDER BY day ROWS 2 PRECEDING)', 't_mean_mean3')},
      {sql_rnd('avg(t_mean) OVER (PARTITION BY station ORDER BY day ROWS 13 PRECEDING)', 't_mean_mean14')},
      {sql_rnd('avg(cdd22) OVER (PARTITION BY station ORDER BY day ROWS 2 PRECEDING)', 'cdd22_mean3')},
      {sql_rnd('avg(cdd22) OVER (PARTITION BY station ORDER BY day ROWS 13 PRECEDING)', 'cdd22_mean14')} FROM c""",
)
def inertia(t: Tables) -> DataFrame:
    out = WX.thermal_inertia(B.weather_day(t), "t_mean", ["station"], "day", (22,), (3, 14))
    return rounded(out.drop("t_mean", "t_max", "t_min", "rain", "gust"), ["station", "day"])


@query(
    "age_features",
    "W13",
    f"""WITH {B.TRAIN_TEST}, f AS (SELECT entity, min(day) AS first FROM (SELECT entity, day FROM train UNION ALL
      SELECT entity, day FROM test) GROUP BY 1)
    SELECT entity, day, CAST(day - first AS INTEGER) AS age, CASE WHEN day = first THEN 1 ELSE 0 END AS first_day
    FROM test JOIN f USING (entity)""",
)
def age(t: Tables) -> DataFrame:
    train, test = B.train_test(t)
    return W.age_features([train, test], ["entity"], "day")[1].drop("qty")


@query("age_features_whole", "W13", ORACLES["age_features"].replace(B.TRAIN_TEST, B.WHOLE))
def age_whole(t: Tables) -> DataFrame:
    """Without the gap of `age_features`."""
    train, test = B.train_test_whole(t)
    return W.age_features([train, test], ["entity"], "day")[1].drop("qty")


@query(
    "boundary_flags",
    "W14",
    f"""WITH {B.SUPPLIER_DAY}, g AS (SELECT entity, day, day - lag(day) OVER w AS b, lead(day) OVER w - day AS a
      FROM supplier_day WINDOW w AS ({_E}))
    SELECT entity, day, CASE WHEN b IS NULL OR b > 1 THEN 1 ELSE 0 END AS entry,
      CASE WHEN a IS NULL OR a > 1 THEN 1 ELSE 0 END AS exit, CASE WHEN b IS NULL THEN 1 ELSE 0 END AS birth,
      CASE WHEN a IS NULL THEN 1 ELSE 0 END AS death FROM g""",
)
def boundaries(t: Tables) -> DataFrame:
    return W.boundary_flags(B.supplier_day(t), ["entity"], "day").drop("qty")


@query(
    "paired_history",
    "W15 Q04",
    f"""WITH {B.TRAIN_TEST}, bridge AS (
      SELECT entity, CAST(unnest(generate_series((SELECT max(day) FROM train) + INTERVAL 1 DAY,
        (SELECT min(day) FROM test) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day
      FROM (SELECT DISTINCT entity FROM test)),
    axis AS (SELECT entity, day, qty, 0 AS is_test FROM train UNION ALL SELECT entity, day, NULL, 1 FROM test
             UNION ALL SELECT entity, day, NULL, 2 FROM bridge),
    f AS (SELECT entity, day, is_test, lag(qty, 35) OVER w AS qty_shift35,
      avg(qty) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 62 PRECEDING AND 35 PRECEDING) AS r
      FROM axis WINDOW w AS ({_E}))
    SELECT entity, day, is_test, {sql_rnd('qty_shift35', 'qty_shift35')}, {sql_rnd('r', 'qty_h35_roll28_mean')}
    FROM f WHERE is_test < 2""",
)
def paired(t: Tables) -> DataFrame:
    train, test = B.train_test(t)
    out = W.paired_history_features(train, test, "qty", ["entity"], "day", 35, [35], [28])
    return rounded(out.drop("qty"), ["entity", "day", "is_test"])


@query(
    "recency_activity_weights",
    "W16",
    f"""WITH {B.DENSE_USER}, w AS (SELECT entity, day, count(*) OVER (PARTITION BY entity) AS n,
        row_number() OVER ({_E}) - 1 AS pos, avg((amount > 0)::INT) OVER ({_E} ROWS 27 PRECEDING) AS act FROM dense)
    SELECT entity, day, {sql_rnd('(CASE WHEN n > 1 THEN 0.05 + 0.9 * pos / greatest(n - 1, 1) ELSE 0.95 END) * (0.25 + 0.75 * act)', 'weight')} FROM w""",
)
def weights(t: Tables) -> DataFrame:
    out = W.recency_activity_weights(B.dense_user_day(t), "amount", ["entity"], "day")
    return rounded(out.select("entity", "day", "weight"), ["entity", "day"])


@query(
    "event_day_groups",
    "W18",
    f"""WITH {B.TRAIN_TEST}, r AS (SELECT entity, day, qty, min(day) OVER (PARTITION BY entity) AS f,
        max(day) OVER (PARTITION BY entity) AS l, coalesce(day - lag(day) OVER ({_E}) - 1, -1) AS gap FROM test),
    s AS (SELECT *, CAST(day - f AS INTEGER) AS age, CAST(l - day AS INTEGER) AS remaining FROM r),
    tr AS (SELECT entity, max(day) AS tl FROM train GROUP BY 1),
    p AS (SELECT s.entity, min(f) AS f, median(CASE WHEN remaining BETWEEN 1 AND 14 THEN qty END) AS tail, min(tl) AS tl
          FROM s LEFT JOIN tr USING (entity) GROUP BY 1),
    b AS (SELECT f, count(*) AS batch FROM p GROUP BY 1)
    SELECT s.entity, s.day, s.qty, CAST(gap AS INTEGER) AS gap, age, remaining, batch,
      CASE WHEN p.tl IS NULL THEN 1 ELSE 0 END AS is_new, CASE WHEN tail IS NULL OR tail > 0 THEN 1 ELSE 0 END AS alive,
      CAST(s.day - p.tl - 1 AS INTEGER) AS gap_before
    FROM s JOIN p ON s.entity = p.entity JOIN b ON b.f = p.f""",
)
def event_days(t: Tables) -> DataFrame:
    train, test = B.train_test(t)
    return W.event_day_groups(test, train, "entity", "day", "qty")


@query("event_day_groups_whole", "W18", ORACLES["event_day_groups"].replace(B.TRAIN_TEST, B.WHOLE))
def event_days_whole(t: Tables) -> DataFrame:
    """Without the gap of `event_day_groups`."""
    train, test = B.train_test_whole(t)
    return W.event_day_groups(test, train, "entity", "day", "qty")


@query(
    "season_direction",
    "W19",
    f"""WITH {B.WEATHER_DAY}, d AS (SELECT station, day,
      CASE WHEN count(t_mean) OVER a >= 5 THEN avg(t_mean) OVER a END AS s,
      CASE WHEN count(t_mean) OVER b >= 5 THEN avg(t_mean) OVER b END AS l FROM weather
      WINDOW a AS (PARTITION BY station ORDER BY day ROWS 13 PRECEDING),
             b AS (PARTITION BY station ORDER BY day ROWS 59 PRECEDING))
    SELECT station, day, {sql_rnd('s - l', 't_mean_direction')} FROM d""",
)
def direction(t: Tables) -> DataFrame:
    out = W.season_direction(B.weather_day(t), "t_mean", ["station"], "day")
    return rounded(out.select("station", "day", "t_mean_direction"), ["station", "day"])


@query(
    "presence_features",
    "A23",
    f"""WITH {B.SUPPLIER_DAY}, x AS (SELECT min(day) AS lo, max(day) AS hi FROM supplier_day),
    p AS (SELECT entity, count(*) AS days, min(day) AS a, max(day) AS b FROM supplier_day GROUP BY 1)
    SELECT entity, days, CAST(a - lo AS INTEGER) AS first_offset, CAST(b - lo AS INTEGER) AS last_offset,
      CAST(b - a + 1 AS INTEGER) AS span, {sql_rnd('days / (b - a + 1)', 'fill_ratio')},
      {sql_rnd('days / (hi - lo + 1)', 'window_share')} FROM p, x""",
)
def presence(t: Tables) -> DataFrame:
    out = W.presence_features(B.supplier_day(t), ["entity"], "day")
    return rounded(out, ["entity", "days", "first_offset", "last_offset", "span"])


@query(
    "exposure_interactions",
    "Q13 W07 W08 F14",
    f"""WITH {B.WEATHER_DAY}, x AS (SELECT *, 1.0 / (1.0 + exp(-(dayofyear(day) - 90) / 25.0)) *
        1.0 / (1.0 + exp((dayofyear(day) - 320) / 25.0)) AS leaf,
        coalesce(sum(rain) OVER (PARTITION BY station ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0) AS wet,
        sum(CASE WHEN t_max > 32 THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY day) AS i FROM weather),
    y AS (SELECT *, sum(CASE WHEN t_max > 32 THEN 1 ELSE 0 END) OVER (PARTITION BY station, i ORDER BY day) AS streak,
        (station % 10) / 10.0 AS tree FROM x)
    SELECT station, day, {sql_rnd('leaf', 'leaf_season')}, {sql_rnd('gust * tree', 'exposure_wind_tree')},
      {sql_rnd('gust * tree * wet', 'exposure_wind_tree_wet', 4)}, {sql_rnd('streak', 'exposure_hot_streak')} FROM y""",
)
def exposure(t: Tables) -> DataFrame:
    base = B.weather_day(t).withColumns(
        {"tree_share": F.pmod("station", F.lit(10)) / 10.0, "wind_max": F.col("gust")}
    )
    out, _ = WX.exposure_interactions(base, ["station"], "day", "rain", "t_max")
    out = out.withColumn("exposure_wind_tree_wet", F.round("exposure_wind_tree_wet", 4))
    return rounded(
        out.select(
            "station", "day", "leaf_season", "exposure_wind_tree", "exposure_wind_tree_wet", "exposure_hot_streak"
        ),
        ["station", "day"],
    )


@query(
    "calendar_features",
    "F07",
    """SELECT event_id, month(ts)::INT AS ts_month, day(ts)::INT AS ts_dom, (isodow(ts) - 1)::INT AS ts_dow,
      dayofyear(ts)::INT AS ts_doy, weekofyear(ts)::INT AS ts_week, quarter(ts)::INT AS ts_quarter,
      (day(ts) = 1)::INT AS ts_month_start, (last_day(ts) = ts::DATE)::INT AS ts_month_end,
      (isodow(ts) >= 6)::INT AS ts_weekend,
      CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) <= 5 THEN 'spring' WHEN month(ts) <= 8 THEN 'summer'
        ELSE 'autumn' END AS ts_season, hour(ts)::INT AS ts_hour,
      (hour(ts) BETWEEN 8 AND 18 AND isodow(ts) < 6)::INT AS ts_office_hour, (hour(ts) BETWEEN 17 AND 22)::INT AS ts_peak_hour,
      year(ts)::INT AS ts_year, (ts::DATE - (SELECT min(o_orderdate)::DATE FROM orders))::INT AS ts_day_no FROM events""",
)
def calendar(t: Tables) -> DataFrame:
    origin = K.shared_origin([t.events.select("ts"), t.orders.select(F.col("o_orderdate").alias("ts"))], "ts")
    return K.add_calendar_features(t.events.select("event_id", "ts"), "ts", hours=True, origin=origin).drop("ts")


@query(
    "cyclical_features",
    "F08",
    f"""SELECT event_id, {sql_rnd('sin(2 * pi() * hour(ts) / 24)', 'hour_sin')}, {sql_rnd('cos(2 * pi() * hour(ts) / 24)', 'hour_cos')},
      {sql_rnd('sin(2 * pi() * month(ts) / 12)', 'month_sin')}, {sql_rnd('cos(2 * pi() * month(ts) / 12)', 'month_cos')} FROM events""",
)
def cycles(t: Tables) -> DataFrame:
    out = t.events.select("event_id", "ts").withColumns(
        K.cyclical({"hour": (F.hour("ts"), 24), "month": (F.month("ts"), 12)})
    )
    return rounded(out.drop("ts"), ["event_id"])


_HOLIDAYS = K.holiday_rows(1992, 2003)
_HOLIDAY_SQL = "hol AS (SELECT * FROM (VALUES " + ", ".join(
    f"(DATE '{d}', '{n}', {int(h)}, {K.HOLIDAY_PRIORITY.index(n)}, {K.HOLIDAY_CODES[n]})" for d, n, h in _HOLIDAYS
) + ") v(day, name, half, prio, code)), hday AS (SELECT day, max(1 - half) AS f, arg_min(code, prio) AS code, " \
    "(count(*) > 1)::INT AS col FROM hol GROUP BY 1)"


@query(
    "holiday_features",
    "F09 J24",
    f"""WITH {_HOLIDAY_SQL}, o AS (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders),
    d AS (SELECT day, least(min(abs(day - h)), 999) AS dist FROM (SELECT DISTINCT day FROM o) CROSS JOIN
          (SELECT day AS h FROM hday) GROUP BY 1),
    j AS (SELECT o_orderkey, o.day, coalesce(f, 0) AS holiday, CASE WHEN f = 0 THEN 1 ELSE 0 END AS half_day,
      coalesce(code, 0) AS holiday_code, coalesce(col, 0) AS collision, d.dist, (isodow(o.day) >= 6)::INT AS we
      FROM o LEFT JOIN hday h ON h.day = o.day JOIN d ON d.day = o.day)
    SELECT o_orderkey, day, holiday, half_day, holiday_code, collision, 0.0::DOUBLE AS admin_leave,
      (CASE WHEN holiday = 1 THEN 1.0 WHEN half_day = 1 THEN 0.5 ELSE 0.0 END)::DOUBLE AS holiday_weight,
      dist::INT AS holiday_distance, (dist <= 3)::INT AS near_holiday, greatest(holiday, we) AS holiday_or_weekend,
      greatest(CASE WHEN holiday = 1 THEN 1.0 WHEN half_day = 1 THEN 0.5 ELSE 0.0 END, we)::DOUBLE AS workforce_loss
    FROM j""",
)
def holidays(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return K.add_holiday_features(rows, "day", 1993, 2002)


@query(
    "upcoming_holidays",
    "J24 F09",
    f"""WITH {_HOLIDAY_SQL}, o AS (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders),
    d AS (SELECT day, least(coalesce(min(h - day), 999), 999) AS n FROM (SELECT DISTINCT day FROM o) LEFT JOIN
          (SELECT day AS h FROM hday) ON h > day GROUP BY 1)
    SELECT o_orderkey, day, n::INT AS next_holiday_days, (n <= 3)::INT AS holiday_within_3d,
      (n <= 7)::INT AS holiday_within_7d, (n <= 15)::INT AS holiday_within_15d FROM o JOIN d USING (day)""",
)
def upcoming(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return K.add_upcoming_holiday_features(rows, "day", 1993, 2002)


_FAST_SQL = "fast AS (SELECT * FROM (VALUES " + ", ".join(
    f"(DATE '{a}', DATE '{b}')" for a, b in K.fasting_months(1992, 2003)
) + ") v(a, b))"


@query(
    "fasting_month_features",
    "F10",
    f"""WITH {_FAST_SQL}, o AS (SELECT o_orderkey, o_orderdate::DATE AS day, a, b FROM orders LEFT JOIN fast
        ON o_orderdate::DATE BETWEEN a AND b)
    SELECT o_orderkey, day, (a IS NOT NULL)::INT AS fasting_month, coalesce(day - a + 1, 0)::INT AS fasting_day,
      {sql_rnd('coalesce((day - a) / greatest(b - a, 1), 0)', 'fasting_progress')},
      coalesce((b - day + 1 <= 10)::INT, 0) AS fasting_last_ten, coalesce(b - day + 1, 999)::INT AS days_to_feast FROM o""",
)
def fasting(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    out = K.add_fasting_month_features(rows, "day", 1993, 2002)
    return out.withColumn("fasting_progress", F.round("fasting_progress", 6))


def _school_sql() -> str:
    rows = []
    for terms, breaks in K.SCHOOL_YEARS:
        rows += [f"(DATE '{a}', DATE '{b}', 'term', 1)" for a, b in terms]
        if len(terms) == 2:
            rows.append(f"(DATE '{terms[0][1]}' + 1, DATE '{terms[1][0]}' - 1, 'semester', 2)")
        rows += [f"(DATE '{a}', DATE '{b}', 'mid_break', 3)" for a, b in breaks]
    lo, hi = K.SCHOOL_COVERAGE
    return f"""span AS (SELECT * FROM (VALUES {', '.join(rows)}) v(a, b, kind, prio)),
    cal AS (SELECT CAST(unnest(generate_series(DATE '{lo}', DATE '{hi}', INTERVAL 1 DAY)) AS DATE) AS day),
    typed AS (SELECT day, arg_max(kind, prio) AS kind FROM cal LEFT JOIN span ON day BETWEEN a AND b GROUP BY 1),
    school AS (SELECT day, CASE WHEN kind = 'term' AND isodow(day) >= 6 THEN 'weekend' ELSE coalesce(kind, 'summer') END AS kind
      FROM typed),
    opening AS (SELECT s.day, min(n.day) AS nxt FROM school s LEFT JOIN school n ON n.day >= s.day AND n.kind = 'term'
      GROUP BY 1)"""


@query(
    "school_features",
    "F11 J24",
    f"""WITH {_school_sql()}, e AS (SELECT event_id, CAST(ts AS DATE) - 40 + CAST(event_id % 400 AS INTEGER) AS day FROM events)
    SELECT event_id, e.day, coalesce(kind, 'unknown') AS school_day_type, coalesce((kind = 'term')::INT, 0) AS school_open,
      coalesce(least(nxt - e.day, 999), 999)::INT AS days_to_opening
    FROM e LEFT JOIN school s ON s.day = e.day LEFT JOIN opening o ON o.day = e.day""",
)
def school(t: Tables) -> DataFrame:
    shift = F.pmod("event_id", F.lit(400)).cast("int") - 40
    rows = t.events.select("event_id", F.date_add(F.to_date("ts"), shift).alias("day"))
    return K.add_school_features(rows, "day")


@query(
    "solar_geometry",
    "F12",
    f"""WITH {B.SUPPLIER_POINT}, g AS (SELECT l_orderkey, l_linenumber, l_partkey, lat,
      23.45 * sin(radians(360.0 * (284.0 + dayofyear(l_shipdate)) / 365.0)) AS declination
      FROM lineitem JOIN site ON l_suppkey = site)
    SELECT l_orderkey, l_linenumber, l_partkey, {sql_rnd('declination', 'declination')},
      {sql_rnd('2 * degrees(acos(least(greatest(-tan(radians(lat)) * tan(radians(declination)), -1), 1))) / 15', 'day_length_hours')},
      {sql_rnd('90 - abs(lat - declination)', 'noon_elevation')} FROM g""",
)
def solar(t: Tables) -> DataFrame:
    rows = t.lineitem.join(B.supplier_point(t), F.col("l_suppkey") == F.col("site")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "lat", "l_shipdate"
    )
    out = S.add_solar_features(rows, "lat", "l_shipdate").drop("lat", "l_shipdate")
    return rounded(out, ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "clearness_index",
    "F13",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      {sql_rnd('CASE WHEN l_discount > 1e-6 THEN l_tax / l_discount END', 'clearness')} FROM lineitem""",
)
def clearness(t: Tables) -> DataFrame:
    return rounded(
        t.lineitem.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            S.clearness_index("l_tax", "l_discount").alias("clearness"),
        ),
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    )


@query(
    "leaf_season",
    "F14",
    f"""SELECT o_orderkey, {sql_rnd('1 / (1 + exp(-(dayofyear(o_orderdate) - 90) / 25.0)) / (1 + exp((dayofyear(o_orderdate) - 320) / 25.0))', 'leaf')} FROM orders""",
)
def leaf(t: Tables) -> DataFrame:
    return rounded(t.orders.select("o_orderkey", S.leaf_season("o_orderdate").alias("leaf")), ["o_orderkey"])


@query(
    "weather_flags",
    "F15",
    f"""WITH {B.WEATHER_DAY} SELECT station, day, (t_max > 35)::INT AS extreme_hot, (t_min < 0)::INT AS extreme_cold,
      (gust > 60)::INT AS storm, (rain > 20 AND gust > 50)::INT AS severe FROM weather""",
)
def flags(t: Tables) -> DataFrame:
    return B.weather_day(t).select(
        "station", "day", *[c.alias(n) for n, c in WX.weather_flags("t_max", "t_min", "gust", "rain").items()]
    )


@query(
    "regime_number",
    "F16",
    """SELECT o_orderkey, 1 + (o_orderdate >= DATE '1997-01-01')::INT + (o_orderdate >= DATE '1999-07-01')::INT AS regime
       FROM orders""",
)
def regime(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", S.regime_number("o_orderdate", ["1997-01-01", "1999-07-01"]).alias("regime")
    )


_FEAST_SQL = ", ".join(f"(DATE '{d}')" for d, n, h in K.holiday_rows(1992, 2003) if n == "kurban" and not h)


@query(
    "extended_calendar",
    "F21 F08 J24",
    f"""WITH feast AS (SELECT * FROM (VALUES {_FEAST_SQL}) v(f)), o AS (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders),
    d AS (SELECT day, min(abs(day - f)) AS dist FROM (SELECT DISTINCT day FROM o) CROSS JOIN feast GROUP BY 1)
    SELECT o_orderkey, day, {sql_rnd('sin(2 * pi() * (isodow(day) - 1) / 7)', 'dow_sin')}, {sql_rnd('cos(2 * pi() * (isodow(day) - 1) / 7)', 'dow_cos')},
      {sql_rnd('sin(2 * pi() * month(day) / 12)', 'month_sin')}, {sql_rnd('cos(2 * pi() * month(day) / 12)', 'month_cos')},
      {sql_rnd('sin(2 * pi() * dayofyear(day) / 365.25)', 'doy_sin')}, {sql_rnd('cos(2 * pi() * dayofyear(day) / 365.25)', 'doy_cos')},
      (isodow(day) >= 6)::INT AS is_weekend, (isodow(day) = 7)::INT AS is_sunday, (isodow(day) = 1)::INT AS is_monday,
      (isodow(day) = 5)::INT AS is_friday, dist::INT AS feast_distance, {sql_rnd('exp(-dist / 5.0)', 'feast_influence')}
    FROM o JOIN d USING (day)""",
)
def extended(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    out = K.add_extended_calendar(rows, "day", 1993, 2002)
    return rounded(
        out, ["o_orderkey", "day", "is_weekend", "is_sunday", "is_monday", "is_friday", "feast_distance"]
    )
