"""Shared inputs derived from the driver tables, each with its SQL spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.panel import densify_panel
from panelforge.plans.registry import Tables


def supplier_day(t: Tables) -> DataFrame:
    return (
        t.lineitem.groupBy(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("day"))
        .agg(F.sum("l_quantity").alias("qty"))
    )


SUPPLIER_DAY = """supplier_day AS (
  SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS qty
  FROM lineitem GROUP BY 1, 2)"""


def dense_supplier_day(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("qty")
    )
    return densify_panel(rows, ["entity"], "day", ["qty"])


DENSE_SUPPLIER = f"""{SUPPLIER_DAY}, dense AS (
  SELECT e.entity, g.day, coalesce(s.qty, 0.0) AS qty, CASE WHEN s.qty IS NULL THEN 1 ELSE 0 END AS is_filled
  FROM (SELECT DISTINCT entity FROM supplier_day) e
  CROSS JOIN (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
              FROM supplier_day) g
  LEFT JOIN supplier_day s ON s.entity = e.entity AND s.day = g.day)"""


def user_rows(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("entity"), F.to_date("ts").alias("day"), F.round("value", 2).alias("amount")
    )


def dense_user_day(t: Tables) -> DataFrame:
    return densify_panel(user_rows(t), ["entity"], "day", ["amount"])


USER_DAY = """user_day AS (
  SELECT user_id AS entity, CAST(ts AS DATE) AS day, sum(round(value, 2)) AS amount FROM events GROUP BY 1, 2)"""

DENSE_USER = f"""{USER_DAY}, dense AS (
  SELECT e.entity, g.day, coalesce(s.amount, 0.0) AS amount, CASE WHEN s.amount IS NULL THEN 1 ELSE 0 END AS is_filled
  FROM (SELECT DISTINCT entity FROM user_day) e
  CROSS JOIN (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
              FROM user_day) g
  LEFT JOIN user_day s ON s.entity = e.entity AND s.day = g.day)"""


def weather_day(t: Tables) -> DataFrame:
    """Daily weather per station: stations are users, readings are functions of the event rows."""
    return t.events.groupBy(F.col("user_id").alias("station"), F.to_date("ts").alias("day")).agg(
        (F.avg("value") * 0.5).alias("t_mean"),
        (F.max("value") * 0.5).alias("t_max"),
        (F.min("value") * 0.5).alias("t_min"),
        F.sum(F.when(F.col("event_type") == "purchase", F.col("value") / 10).otherwise(F.lit(0.0))).alias("rain"),
        F.max(F.when(F.col("event_type") == "error", F.col("value") / 4).otherwise(F.lit(1.0))).alias("gust"),
    )


WEATHER_DAY = """weather AS (
  SELECT user_id AS station, CAST(ts AS DATE) AS day, avg(value) * 0.5 AS t_mean, max(value) * 0.5 AS t_max,
         min(value) * 0.5 AS t_min,
         sum(CASE WHEN event_type = 'purchase' THEN value / 10 ELSE 0.0 END) AS rain,
         max(CASE WHEN event_type = 'error' THEN value / 4 ELSE 1.0 END) AS gust
  FROM events GROUP BY 1, 2)"""


def sensor_hour(t: Tables) -> DataFrame:
    """Hourly feed per station (event type): mean and maximum value, total, and a wind direction in degrees."""
    return t.events.groupBy(
        F.col("event_type").alias("station"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")
    ).agg(
        F.avg("value").alias("speed"),
        F.max("value").alias("gust"),
        F.sum("value").alias("total"),
        F.max(F.pmod(F.col("event_id") * 37, F.lit(360))).cast("double").alias("direction"),
        (F.avg(F.pmod(F.col("event_id"), F.lit(97))) + 980).alias("pressure"),
    )


SENSOR_HOUR = """sensor AS (
  SELECT event_type AS station, date_trunc('hour', ts) AS hour, avg(value) AS speed, max(value) AS gust,
         sum(value) AS total, CAST(max((event_id * 37) % 360) AS DOUBLE) AS direction,
         avg(event_id % 97) + 980 AS pressure
  FROM events GROUP BY 1, 2)"""


def supplier_point(t: Tables) -> DataFrame:
    """Suppliers as points; the formula spreads them over the box lat 36..42, lon 26..45."""
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("site"),
        F.col("s_nationkey").alias("district"),
        (F.lit(36.0) + F.pmod(k * 7919, F.lit(60000)) / 10000.0).alias("lat"),
        (F.lit(26.0) + F.pmod(k * 104729, F.lit(190000)) / 10000.0).alias("lon"),
    )


SUPPLIER_POINT = """site AS (
  SELECT s_suppkey AS site, s_nationkey AS district, 36.0::DOUBLE + ((s_suppkey * 7919) % 60000) / 10000.0::DOUBLE AS lat,
         26.0::DOUBLE + ((s_suppkey * 104729) % 190000) / 10000.0::DOUBLE AS lon
  FROM supplier)"""


def event_point(t: Tables) -> DataFrame:
    """Point events in the same box as the suppliers, weighted by value."""
    k = F.col("event_id")
    return t.events.select(
        k.alias("point_id"),
        F.to_date("ts").alias("day"),
        (F.lit(36.0) + F.pmod(k * 6007, F.lit(60000)) / 10000.0).alias("lat"),
        (F.lit(26.0) + F.pmod(k * 90001, F.lit(190000)) / 10000.0).alias("lon"),
        F.col("value").alias("weight"),
    )


EVENT_POINT = """point AS (
  SELECT event_id AS point_id, CAST(ts AS DATE) AS day, 36.0::DOUBLE + ((event_id * 6007) % 60000) / 10000.0::DOUBLE AS lat,
         26.0::DOUBLE + ((event_id * 90001) % 190000) / 10000.0::DOUBLE AS lon, value AS weight
  FROM events)"""


def haversine_sql(a: str, b: str) -> str:
    return (
        f"2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * "
        f"cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )


def predictions(t: Tables) -> DataFrame:
    """One row per order: truth and three members, fold = order year, cold = customer without an order before 1996."""
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    p = F.col("o_totalprice")
    return t.orders.join(first, "o_custkey").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("entity"),
        F.to_date("o_orderdate").alias("day"),
        F.year("o_orderdate").alias("fold"),
        F.col("o_orderpriority").alias("segment"),
        p.alias("truth"),
        (p * 1.05).alias("m1"),
        (p * 0.9 + 500).alias("m2"),
        (p + 20000 * F.sin(F.col("o_orderkey").cast("double"))).alias("m3"),
        (F.year("first_order") >= 1996).cast("int").alias("cold"),
    )


PREDICTIONS = """pred AS (
  SELECT o_orderkey AS id, o_custkey AS entity, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS fold,
         o_orderpriority AS segment, o_totalprice AS truth, o_totalprice * 1.05 AS m1, o_totalprice * 0.9 + 500 AS m2,
         o_totalprice + 20000 * sin(CAST(o_orderkey AS DOUBLE)) AS m3,
         CASE WHEN year(min(o_orderdate) OVER (PARTITION BY o_custkey)) >= 1996 THEN 1 ELSE 0 END AS cold
  FROM orders)"""

CUT = "1999-01-01"


def train_test(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Supplier days before the cut, and from 30 days after it."""
    base = supplier_day(t)
    return base.filter(F.col("day") < CUT), base.filter(F.col("day") >= F.date_add(F.lit(CUT).cast("date"), 30))


TRAIN_TEST = f"""{SUPPLIER_DAY},
train AS (SELECT * FROM supplier_day WHERE day < DATE '{CUT}'),
test AS (SELECT * FROM supplier_day WHERE day >= DATE '{CUT}' + 30)"""


def train_test_whole(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Supplier days before the cut and from it on: no day is left out."""
    base = supplier_day(t)
    return base.filter(F.col("day") < CUT), base.filter(F.col("day") >= CUT)


WHOLE = f"""{SUPPLIER_DAY},
train AS (SELECT * FROM supplier_day WHERE day < DATE '{CUT}'),
test AS (SELECT * FROM supplier_day WHERE day >= DATE '{CUT}')"""
