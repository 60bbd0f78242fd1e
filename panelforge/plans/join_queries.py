"""Attachment joins, spatial joins, table merges, set operations, key alignment and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import text as TX
from panelforge.operators import joins as J
from panelforge.operators import spatial as SP
from panelforge.operators import topk as TK
from panelforge.operators.encode import category_overlap
from panelforge.plans import bases as B
from panelforge.plans.registry import Tables, query, rnd, rounded, sql_rnd

# ---- shared inputs --------------------------------------------------------------------------------------------------


def customer_point(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("site"),
        (F.lit(36.0) + F.pmod(k * 7919, F.lit(60000)) / 10000.0).alias("lat"),
        (F.lit(26.0) + F.pmod(k * 104729, F.lit(190000)) / 10000.0).alias("lon"),
    )


CUSTOMER_POINT = """site AS (SELECT c_custkey AS site, 36.0::DOUBLE + ((c_custkey * 7919) % 60000) / 10000.0::DOUBLE AS lat,
  26.0::DOUBLE + ((c_custkey * 104729) % 190000) / 10000.0::DOUBLE AS lon FROM customer)"""


def user_point(t: Tables) -> DataFrame:
    k = F.col("user_id")
    return t.events.select(k).distinct().select(
        k.alias("entity"),
        (F.lit(36.0) + F.pmod(k * 7919, F.lit(60000)) / 10000.0).alias("lat"),
        (F.lit(26.0) + F.pmod(k * 104729, F.lit(190000)) / 10000.0).alias("lon"),
    )


USER_POINT = """usite AS (SELECT DISTINCT user_id AS entity, 36.0::DOUBLE + ((user_id * 7919) % 60000) / 10000.0::DOUBLE AS lat,
  26.0::DOUBLE + ((user_id * 104729) % 190000) / 10000.0::DOUBLE AS lon FROM events)"""


def knn_sql(site: str, key: str, k: int, km: float) -> str:
    return f"""nn AS (SELECT * FROM (SELECT a.{key}, b.{key} AS neighbour, {B.haversine_sql('a', 'b')} AS d,
      row_number() OVER (PARTITION BY a.{key} ORDER BY {B.haversine_sql('a', 'b')}, b.{key}) AS r
      FROM {site} a JOIN {site} b ON a.{key} <> b.{key} WHERE {B.haversine_sql('a', 'b')} <= {km}) WHERE r <= {k})"""


def priority_year(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("key"), F.year("o_orderdate").alias("yr")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("spend")
    )


PRIORITY_YEAR = """annual AS (SELECT o_orderpriority AS key, year(o_orderdate) AS yr, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1, 2)"""


def priority_month(t: Tables) -> DataFrame:
    return t.orders.groupBy(
        F.col("o_orderpriority").alias("key"), F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo")
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("nights"))


PRIORITY_MONTH = """monthly AS (SELECT o_orderpriority AS key, year(o_orderdate)::INT AS yr, month(o_orderdate)::INT AS mo,
  round(sum(o_totalprice), 2) AS nights FROM orders GROUP BY 1, 2, 3)"""


def order_rows(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day")
    )


# ---- attachments ----------------------------------------------------------------------------------------------------


@query(
    "attach_many_to_one",
    "J01",
    f"""WITH {B.SUPPLIER_DAY}, w AS (SELECT l_suppkey % 90 AS entity, l_shipdate::DATE AS day, min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)
    SELECT entity, day, {sql_rnd('price', 'price')} FROM supplier_day LEFT JOIN w USING (entity, day)""",
)
def many_to_one(t: Tables) -> DataFrame:
    """The weather-like table repeats its keys; the smallest row of a key is the one attached."""
    table = t.lineitem.select(
        F.pmod("l_suppkey", F.lit(90)).alias("entity"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("price")
    )
    out, _ = J.attach_many_to_one(B.supplier_day(t), table, ["entity", "day"])
    return rounded(out.drop("qty"), ["entity", "day"])


@query(
    "match_rate",
    "J01",
    f"""SELECT count(*) AS rows, count(p_partkey) AS matched, {sql_rnd('count(p_partkey) / count(*)', 'match_rate')}
    FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey""",
)
def measured(t: Tables) -> DataFrame:
    p = t.part.filter(F.col("p_size") > 10).select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("hit"))
    return rounded(J.match_rate(t.lineitem.join(p, "l_partkey", "left"), "hit"), ["rows", "matched"])


@query(
    "static_dimension",
    "J02",
    """SELECT c_custkey, c_nationkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def static_dim(t: Tables) -> DataFrame:
    names = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = J.attach_static(t.customer.select("c_custkey", "c_nationkey"), names, "c_nationkey")
    ref = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return J.add_province_key(out, ref, "c_nationkey", "n_regionkey")


@query(
    "national_series",
    "J10",
    f"""WITH d AS (SELECT o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS load FROM orders GROUP BY 1),
    s AS (SELECT day, lag(load, 7) OVER w AS l, avg(load) OVER (ORDER BY day ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) AS m,
      max(load) OVER (ORDER BY day ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) AS x FROM d WINDOW w AS (ORDER BY day))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sql_rnd('l', 'national_load_shift7', 3)}, {sql_rnd('m', 'national_load_h7_roll7_mean', 3)},
      {sql_rnd('x', 'national_load_h7_roll7_max', 3)} FROM lineitem LEFT JOIN s ON day = l_shipdate::DATE""",
)
def national_series(t: Tables) -> DataFrame:
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("load"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    out = J.add_national_series(rows, daily, "l_shipdate", "day", ["load"], 7, (7,)).drop("l_shipdate")
    return rounded(out, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 3)


@query(
    "annual_attribute",
    "J11",
    f"""WITH {PRIORITY_YEAR}, people AS (SELECT o_orderpriority AS key, count(DISTINCT o_custkey) AS population FROM orders GROUP BY 1)
    SELECT o_orderkey, {sql_rnd('spend', 'annual_spend', 2)}, {sql_rnd('spend / population', 'annual_spend_per_head', 4)}
    FROM orders LEFT JOIN annual a ON a.key = o_orderpriority AND a.yr + 1 = year(o_orderdate) LEFT JOIN people p ON p.key = o_orderpriority""",
)
def annual(t: Tables) -> DataFrame:
    people = t.orders.groupBy(F.col("o_orderpriority").alias("key")).agg(F.count_distinct("o_custkey").alias("population"))
    out = J.add_annual_attribute(order_rows(t), priority_year(t), "key", "day", "yr", ["spend"], population=people)
    return out.select("o_orderkey", rnd("annual_spend", digits=2), rnd("annual_spend_per_head", digits=4))


@query(
    "month_profile",
    "J12",
    f"""WITH p AS (SELECT o_orderpriority AS key, month(o_orderdate) AS mo, avg(o_totalprice) AS level FROM orders GROUP BY 1, 2)
    SELECT o_orderkey, {sql_rnd('level', 'season_level')} FROM orders JOIN p ON p.key = o_orderpriority AND p.mo = month(o_orderdate)""",
)
def month_profile(t: Tables) -> DataFrame:
    prof = t.orders.groupBy(F.col("o_orderpriority").alias("key"), F.month("o_orderdate").alias("mo")).agg(
        F.avg("o_totalprice").alias("level")
    )
    out = J.add_month_profile(order_rows(t), prof, "key", "day", "mo", ["level"])
    return out.select("o_orderkey", rnd("season_level"))


@query(
    "monthly_attribute",
    "J13",
    f"""WITH {PRIORITY_MONTH}, y AS (SELECT key, yr, count(DISTINCT mo) AS n, sum(nights) AS tot FROM monthly GROUP BY 1, 2),
    m AS (SELECT monthly.key, yr * 12 + mo - 1 + 12 AS ix, nights, CASE WHEN n = 12 AND tot > 0 THEN nights / tot END AS share FROM monthly JOIN y USING (key, yr))
    SELECT o_orderkey, {sql_rnd('nights', 'monthly_nights', 2)}, {sql_rnd('share', 'monthly_nights_year_share')}
    FROM orders LEFT JOIN m ON m.key = o_orderpriority AND m.ix = year(o_orderdate) * 12 + month(o_orderdate) - 1""",
)
def monthly_attr(t: Tables) -> DataFrame:
    out = J.add_monthly_attribute(order_rows(t), priority_month(t), "key", "day", "yr", "mo", ["nights"])
    return out.select("o_orderkey", rnd("monthly_nights", digits=2), rnd("monthly_nights_year_share"))


@query(
    "district_monthly_estimate",
    "J14",
    f"""WITH oc AS (SELECT o_orderstatus AS province, c_nationkey AS district, year(o_orderdate)::INT AS yr, month(o_orderdate)::INT AS mo, o_totalprice AS v
        FROM orders JOIN customer ON o_custkey = c_custkey),
    a AS (SELECT district, province, yr, sum(v) AS v FROM oc WHERE v > 100000 AND yr < 2001 GROUP BY 1, 2, 3),
    s AS (SELECT district, province, yr, v / sum(v) OVER (PARTITION BY province, yr) AS share FROM a),
    g AS (SELECT DISTINCT province, district FROM oc), ys AS (SELECT DISTINCT yr FROM a),
    f AS (SELECT g.district, g.province, ys.yr, coalesce(share, 0) AS share FROM g CROSS JOIN ys LEFT JOIN s ON s.district = g.district AND s.province = g.province AND s.yr = ys.yr),
    m AS (SELECT province, yr, mo, sum(v) AS v FROM oc GROUP BY 1, 2, 3)
    SELECT f.district, f.province, f.yr, m.mo, {sql_rnd('share * m.v', 'v_estimate', 3)}, {sql_rnd('share', 'district_share')}
    FROM f JOIN m ON m.province = f.province AND m.yr = f.yr""",
)
def top_down(t: Tables) -> DataFrame:
    oc = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderstatus").alias("province"), F.col("c_nationkey").alias("district"), F.year("o_orderdate").alias("yr"),
        F.month("o_orderdate").alias("mo"), F.col("o_totalprice").alias("v"),
    )
    annual_rows = oc.filter((F.col("v") > 100000) & (F.col("yr") < 2001))
    monthly = oc.groupBy("province", "yr", "mo").agg(F.sum("v").alias("v"))
    out = J.district_monthly_estimate(annual_rows, monthly, "district", "province", "yr", "mo", "v", oc)
    return out.select(
        "district", "province", "yr", "mo", rnd("v_estimate", digits=3), rnd("district_share")
    )


def _families(t: Tables) -> list[J.Family]:
    prof = t.orders.groupBy(F.col("o_orderpriority").alias("key"), F.month("o_orderdate").alias("mo")).agg(
        F.avg("o_totalprice").alias("level")
    )
    return [
        J.Family("water", lambda p: J.add_month_profile(p, prof, "key", "day", "mo", ["level"], "water")),
        J.Family(
            "tourism_annual",
            lambda p: J.add_annual_attribute(p, priority_year(t), "key", "day", "yr", ["spend"], prefix="tourism"),
        ),
        J.Family("fires", lambda p: p.withColumn("never", F.lit(1)), (t.events, "ts")),
        J.Family("earthquakes", None),
    ]


@query(
    "attach_external",
    "J15",
    f"""WITH {PRIORITY_YEAR}, p AS (SELECT o_orderpriority AS key, month(o_orderdate) AS mo, avg(o_totalprice) AS level FROM orders GROUP BY 1, 2)
    SELECT o_orderkey, {sql_rnd('spend', 'tourism_spend', 2)}, {sql_rnd('level', 'water_level')} FROM orders
    LEFT JOIN annual a ON a.key = o_orderpriority AND a.yr + 1 = year(o_orderdate)
    LEFT JOIN p ON p.key = o_orderpriority AND p.mo = month(o_orderdate)""",
)
def external(t: Tables) -> DataFrame:
    """Events lie outside the panel's years and one source is absent: both are skipped, the other two attached."""
    out, _ = J.attach_external(order_rows(t), "day", _families(t))
    return out.select("o_orderkey", rnd("tourism_spend", digits=2), rnd("water_level"))


@query(
    "attach_external_report",
    "J15",
    f"""WITH {PRIORITY_YEAR}, o AS (SELECT count(*) AS n, count(a.key) AS t, count(*) FILTER (o_orderpriority IS NOT NULL) AS w FROM orders
      LEFT JOIN annual a ON a.key = o_orderpriority AND a.yr + 1 = year(o_orderdate))
    SELECT v.family, v.state, v.columns, CASE v.family WHEN 'tourism_annual' THEN round(t / n, 6) WHEN 'water' THEN round(w / n, 6) END AS match_rate, v.reason
    FROM (VALUES ('fires', 'skipped', 0, 'no common year'), ('earthquakes', 'skipped', 0, 'no source'),
      ('tourism_annual', 'attached', 1, ''), ('water', 'attached', 1, '')) v(family, state, columns, reason), o WHERE n > 0""",
)
def external_report(t: Tables) -> DataFrame:
    return J.attach_external(order_rows(t), "day", _families(t))[1].withColumn("match_rate", F.round("match_rate", 6))


# ---- merges ---------------------------------------------------------------------------------------------------------

_SEAM = """arch AS (SELECT user_id AS station, CAST(ts AS DATE) AS day, avg(value) AS t FROM events WHERE ts < TIMESTAMP '2024-01-22' GROUP BY 1, 2),
  fore AS (SELECT user_id AS station, CAST(ts AS DATE) AS day, max(value) AS t FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2)"""


def _seam(t: Tables) -> tuple[DataFrame, DataFrame]:
    keys = [F.col("user_id").alias("station"), F.to_date("ts").alias("day")]
    a = t.events.filter(F.col("ts") < "2024-01-22").groupBy(*keys).agg(F.avg("value").alias("t"))
    f = t.events.filter(F.col("ts") >= "2024-01-15").groupBy(*keys).agg(F.max("value").alias("t"))
    return a, f


@query(
    "seam_merge",
    "J16",
    f"""WITH {_SEAM} SELECT station, day, {sql_rnd('t', 't')}, 0 AS is_forecast FROM arch UNION ALL
    SELECT station, day, {sql_rnd('t', 't')}, 1 FROM fore ANTI JOIN arch USING (station, day)""",
)
def seam(t: Tables) -> DataFrame:
    return rounded(J.seam_merge(*_seam(t), ["station", "day"]), ["station", "day", "is_forecast"])


@query(
    "seam_error",
    "J16",
    f"""WITH {_SEAM} SELECT {sql_rnd('avg(abs(arch.t - fore.t))', 'seam_error')}, count(*) AS overlap FROM arch JOIN fore USING (station, day)""",
)
def seam_err(t: Tables) -> DataFrame:
    return rounded(J.seam_error(*_seam(t), ["station", "day"], "t"), ["overlap"])


_PUB = """pa AS (SELECT year(o_orderdate)::INT AS yr, month(o_orderdate)::INT AS mo, o_orderpriority AS key, count(*)::DOUBLE AS arrivals, sum(o_totalprice) / 1000 AS nights,
    (count(*) % 60 + 20)::DOUBLE AS occupancy FROM orders GROUP BY 1, 2, 3),
  pb AS (SELECT year(o_orderdate)::INT AS yr, month(o_orderdate)::INT AS mo, o_orderpriority AS key, count(*)::DOUBLE AS arrivals, sum(o_totalprice) / 2000 AS nights,
    (count(*) % 7 * 10)::DOUBLE AS occupancy FROM orders WHERE o_totalprice > 400000 GROUP BY 1, 2, 3)"""


@query(
    "merge_publishers",
    "J17",
    f"""WITH {_PUB}, j AS (SELECT pa.*, pb.arrivals AS ab, pb.nights AS nb, pb.occupancy AS ob FROM pa LEFT JOIN pb USING (yr, mo, key)),
    k AS (SELECT *, nights + coalesce(nb, 0) AS nt, nights / (occupancy / 100) + coalesce(CASE WHEN ob > 0 THEN nb / (ob / 100) END, 0) AS beds FROM j)
    SELECT yr, mo, key, {sql_rnd('arrivals + coalesce(ab, 0)', 'arrivals_total')}, {sql_rnd('nt', 'nights_total', 4)},
      {sql_rnd('100 * nt / beds', 'occupancy_total')} FROM k""",
)
def publishers(t: Tables) -> DataFrame:
    keys = [F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo"), F.col("o_orderpriority").alias("key")]
    n = F.count(F.lit(1))
    a = t.orders.groupBy(*keys).agg(
        n.cast("double").alias("arrivals"), (F.sum("o_totalprice") / 1000).alias("nights"),
        (F.pmod(n, F.lit(60)) + 20).cast("double").alias("occupancy"),
    )
    b = t.orders.filter(F.col("o_totalprice") > 400000).groupBy(*keys).agg(
        n.cast("double").alias("arrivals"), (F.sum("o_totalprice") / 2000).alias("nights"),
        (F.pmod(n, F.lit(7)) * 10).cast("double").alias("occupancy"),
    )
    out = J.merge_publishers(a, b, ["yr", "mo", "key"])
    return out.select(
        "yr", "mo", "key", rnd("arrivals_total"), rnd("nights_total", digits=4), rnd("occupancy_total")
    )


_REPL = """base AS (SELECT o_custkey AS entity, c_nationkey AS location, abs(c_acctbal) / 1000 AS cap, o_orderdate::DATE AS day
    FROM orders JOIN customer ON o_custkey = c_custkey),
  a AS (SELECT entity, min(location) AS location, min(floor(cap)) AS cap, min(day) AS f, max(day) AS l FROM base WHERE day < DATE '1998-01-01' AND entity % 3 <> 1 GROUP BY 1),
  b AS (SELECT entity, min(location) AS location, min(floor(cap)) AS cap, min(day) AS f, max(day) AS l FROM base WHERE day >= DATE '1998-01-01' AND entity % 3 <> 0 GROUP BY 1),
  e AS (SELECT location, cap, count(*) AS ended, min(entity) AS ended_entity, max(l) AS l FROM a WHERE entity NOT IN (SELECT entity FROM b)
        AND l < (SELECT max(day) FROM base WHERE day < DATE '1998-01-01' AND entity % 3 <> 1) - 7 GROUP BY 1, 2),
  n AS (SELECT location, cap, count(*) AS began, min(entity) AS began_entity, min(f) AS f FROM b WHERE entity NOT IN (SELECT entity FROM a) GROUP BY 1, 2),
  j AS (SELECT * FROM e JOIN n USING (location, cap))"""


def _repl(t: Tables) -> tuple[DataFrame, DataFrame]:
    base = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("entity"), F.col("c_nationkey").alias("location"),
        (F.abs("c_acctbal") / 1000).alias("cap"), F.to_date("o_orderdate").alias("day"),
    )
    third = F.pmod("entity", F.lit(3))
    train = base.filter((F.col("day") < "1998-01-01") & (third != 1))
    test = base.filter((F.col("day") >= "1998-01-01") & (third != 0))
    return J.replacement_pairs(train, test, "entity", "location", "cap", "day")


@query(
    "replacement_pairs",
    "J18",
    f"""WITH {_REPL} SELECT location, CAST(cap AS BIGINT) AS capacity, ended_entity, began_entity, CAST(f - l AS INTEGER) AS gap_days FROM j WHERE ended = 1 AND began = 1""",
)
def replacement(t: Tables) -> DataFrame:
    return _repl(t)[1]


@query("replacement_cardinality", "J18", f"WITH {_REPL} SELECT ended, began, count(*) AS keys FROM j GROUP BY 1, 2")
def replacement_card(t: Tables) -> DataFrame:
    return _repl(t)[0]


@query(
    "key_overlap",
    "J22",
    f"""WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < DATE '{B.CUT}'), b AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate >= DATE '{B.CUT}')
    SELECT (SELECT count(*) FROM a) AS train_keys, (SELECT count(*) FROM b) AS test_keys, count(*) AS both_keys, {sql_rnd('count(*) / (SELECT count(*) FROM b)', 'test_share')}
    FROM a JOIN b USING (o_custkey, o_orderpriority)""",
)
def overlap(t: Tables) -> DataFrame:
    a, b = (t.orders.filter(c) for c in (F.col("o_orderdate") < B.CUT, F.col("o_orderdate") >= B.CUT))
    return rounded(J.key_overlap(a, b, ["o_custkey", "o_orderpriority"]), ["train_keys", "test_keys", "both_keys"])


@query(
    "category_overlap",
    "J23",
    f"""WITH a AS (SELECT * FROM orders WHERE o_orderdate < DATE '1995-06-01'), b AS (SELECT * FROM orders WHERE o_orderdate >= DATE '1995-06-01')
    SELECT 'o_custkey' AS "column", (SELECT count(*) FROM b) AS test_rows, count(*) AS covered_rows, {sql_rnd('count(*) / (SELECT count(*) FROM b)', 'overlap')}
      FROM b WHERE o_custkey IN (SELECT o_custkey FROM a)
    UNION ALL SELECT 'o_orderpriority', (SELECT count(*) FROM b), count(*), {sql_rnd('count(*) / (SELECT count(*) FROM b)', 'overlap')}
      FROM b WHERE o_orderpriority IN (SELECT o_orderpriority FROM a)""",
)
def cat_overlap(t: Tables) -> DataFrame:
    a, b = (t.orders.filter(c) for c in (F.col("o_orderdate") < "1995-06-01", F.col("o_orderdate") >= "1995-06-01"))
    return rounded(category_overlap(a, b, ["o_custkey", "o_orderpriority"]), ["column", "test_rows", "covered_rows"])


# ---- spatial --------------------------------------------------------------------------------------------------------


@query(
    "nearest_neighbours",
    "J03 K03",
    f"WITH {CUSTOMER_POINT}, {knn_sql('site', 'site', 3, 120.0)} SELECT site, neighbour, {sql_rnd('d', 'distance_km', 2)}, CAST(r AS INTEGER) AS neighbour_rank FROM nn",
)
def knn(t: Tables) -> DataFrame:
    return SP.nearest_neighbours(customer_point(t), "site", k=3, max_distance_km=120.0)


@query(
    "distance_pairs",
    "J04",
    f"""WITH {B.SUPPLIER_POINT}, c AS (SELECT c_custkey, 36.0::DOUBLE + ((c_custkey * 7919) % 60000) / 10000.0::DOUBLE AS lat,
      26.0::DOUBLE + ((c_custkey * 104729) % 190000) / 10000.0::DOUBLE AS lon FROM customer)
    SELECT site, c_custkey, {sql_rnd(B.haversine_sql('a', 'b'), 'distance_km')} FROM site a JOIN c b ON {B.haversine_sql('a', 'b')} <= 60""",
)
def distances(t: Tables) -> DataFrame:
    sites = B.supplier_point(t).select("site", "lat", "lon")
    points = customer_point(t).withColumnRenamed("site", "c_custkey")
    return rounded(SP.distance_pairs(sites, points, "site", "c_custkey", 60.0), ["site", "c_custkey"])


_INTENSITY = f"""x AS (SELECT entity, day, {B.haversine_sql('a', 'b')} AS d, weight FROM usite a JOIN point b ON {B.haversine_sql('a', 'b')} <= 100),
  i AS (SELECT entity, day, count(*) FILTER (d <= 25) AS c25, count(*) FILTER (d <= 50) AS c50, count(*) AS c100, sum(weight) FILTER (d <= 25) AS w25,
    sum(weight) FILTER (d <= 50) AS w50, sum(weight) AS w100, max(weight) FILTER (d <= 25) AS m25, max(weight) FILTER (d <= 50) AS m50, max(weight) AS m100
    FROM x GROUP BY 1, 2)"""


@query(
    "radius_intensity",
    "J05",
    f"""WITH {USER_POINT}, {B.EVENT_POINT}, {_INTENSITY} SELECT entity, day, nullif(c25, 0)::DOUBLE AS event_count_r25, nullif(c50, 0)::DOUBLE AS event_count_r50, c100::DOUBLE AS event_count_r100,
      {sql_rnd('w25', 'event_weight_r25')}, {sql_rnd('w50', 'event_weight_r50')}, {sql_rnd('w100', 'event_weight_r100')},
      {sql_rnd('m25', 'event_weight_max_r25')}, {sql_rnd('m50', 'event_weight_max_r50')}, {sql_rnd('m100', 'event_weight_max_r100')} FROM i""",
)
def intensity(t: Tables) -> DataFrame:
    out = SP.daily_point_intensity(B.event_point(t), user_point(t), "entity", "day", weight="weight")
    return rounded(out, ["entity", "day"])


@query(
    "point_event_features",
    "J06 W01 W02",
    f"""WITH {B.DENSE_USER}, {USER_POINT}, {B.EVENT_POINT}, x AS (SELECT entity, day, weight FROM usite a JOIN point b ON {B.haversine_sql('a', 'b')} <= 50),
    i AS (SELECT entity, day, count(*)::DOUBLE AS c, sum(weight) AS w FROM x GROUP BY 1, 2),
    p AS (SELECT entity, day, coalesce(c, 0) AS c, coalesce(w, 0) AS w FROM dense LEFT JOIN i USING (entity, day))
    SELECT entity, day, {sql_rnd('lag(c, 3) OVER (PARTITION BY entity ORDER BY day)', 'event_count_r50_shift3')},
      {sql_rnd('sum(c) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 9 PRECEDING AND 3 PRECEDING)', 'event_count_r50_h3_roll7_sum')},
      {sql_rnd('max(w) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 9 PRECEDING AND 3 PRECEDING)', 'event_weight_r50_h3_roll7_max')} FROM p""",
)
def point_features(t: Tables) -> DataFrame:
    out = SP.point_event_features(
        B.dense_user_day(t), B.event_point(t), user_point(t), "entity", "day", 3, "day", (50,), (7,), "weight"
    )
    return rounded(
        out.select("entity", "day", "event_count_r50_shift3", "event_count_r50_h3_roll7_sum", "event_weight_r50_h3_roll7_max"),
        ["entity", "day"],
    )


_NN = knn_sql("usite", "entity", 3, 120.0)


def _edges(t: Tables) -> DataFrame:
    return SP.nearest_neighbours(user_point(t), "entity", k=3, max_distance_km=120.0)


@query(
    "neighbour_aggregate",
    "J07",
    f"""WITH {B.USER_DAY}, {USER_POINT}, {_NN} SELECT nn.entity, u.day, {sql_rnd('sum(amount / greatest(round(d, 2), 0.001)) / sum(1 / greatest(round(d, 2), 0.001))', 'near_mean')},
      {sql_rnd('max(amount)', 'near_max')}, {sql_rnd('sum(amount)', 'near_sum')} FROM nn JOIN user_day u ON u.entity = nn.neighbour GROUP BY 1, 2""",
)
def neighbour_agg(t: Tables) -> DataFrame:
    rows = B.user_rows(t).groupBy("entity", "day").agg(F.sum("amount").alias("amount"))
    out = SP.neighbour_aggregate(rows, _edges(t), "entity", "day", "amount", ["mean", "max", "sum"], "near", True)
    return rounded(out, ["entity", "day"])


@query(
    "neighbour_target_lag",
    "J08",
    f"""WITH {B.DENSE_USER}, {USER_POINT}, {_NN}, s AS (SELECT entity, day, lag(amount, 3) OVER (PARTITION BY entity ORDER BY day) AS v FROM dense),
    g AS (SELECT nn.entity, day, avg(v) AS m, max(v) AS x, sum(v) AS t FROM nn JOIN s ON s.entity = nn.neighbour GROUP BY 1, 2)
    SELECT dense.entity, dense.day, {sql_rnd('m', 'neighbour_amount_h3_mean')}, {sql_rnd('x', 'neighbour_amount_h3_max')}, {sql_rnd('t', 'neighbour_amount_h3_sum')}
    FROM dense LEFT JOIN g ON g.entity = dense.entity AND g.day = dense.day""",
)
def neighbour_lag(t: Tables) -> DataFrame:
    out = SP.neighbour_target_lag(B.dense_user_day(t).drop("is_filled"), _edges(t), "entity", "day", "amount", 3)
    return rounded(out.drop("amount"), ["entity", "day"])


@query(
    "neighbour_feature_mean",
    "J09",
    f"""WITH {B.WEATHER_DAY}, {USER_POINT}, {_NN}, g AS (SELECT nn.entity, day, avg(rain) AS m, max(rain) AS x FROM nn JOIN weather w ON w.station = nn.neighbour GROUP BY 1, 2)
    SELECT w.station AS entity, w.day, {sql_rnd('m', 'neighbour_rain_mean')}, {sql_rnd('x', 'neighbour_rain_max')} FROM weather w LEFT JOIN g ON g.entity = w.station AND g.day = w.day""",
)
def neighbour_mean(t: Tables) -> DataFrame:
    rows = B.weather_day(t).select(F.col("station").alias("entity"), "day", "rain")
    out = SP.neighbour_feature_mean(rows, _edges(t), "entity", "day", ["rain"], target=None)
    return rounded(out.drop("rain"), ["entity", "day"])


# ---- set operations and top-k ---------------------------------------------------------------------------------------


@query(
    "safe_union",
    "U01",
    """SELECT o_orderkey AS id, o_totalprice AS amount, NULL AS kind FROM orders UNION ALL SELECT event_id, NULL, event_type FROM events""",
)
def union(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return J.safe_union([a, None, b])


@query(
    "id_difference",
    "U02 D10",
    """WITH e AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_linenumber < 6 GROUP BY 1), a AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
    SELECT coalesce(e.id, a.id) AS id, greatest(coalesce(e.n, 0) - coalesce(a.n, 0), 0) AS missing, greatest(coalesce(a.n, 0) - coalesce(e.n, 0), 0) AS extra
    FROM e FULL JOIN a ON a.id = e.id WHERE coalesce(e.n, 0) <> coalesce(a.n, 0)""",
)
def id_diff(t: Tables) -> DataFrame:
    li = t.lineitem
    return J.id_difference(li.filter("l_linenumber < 6"), li.filter("l_linenumber > 1"), "l_orderkey")


@query(
    "zero_overlap",
    "U03",
    f"""WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END AS v FROM orders), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END AS v FROM orders)
    SELECT count(*) AS rows, count(*) FILTER (a.v <= 0) AS zero_a, count(*) FILTER (b.v <= 0) AS zero_b, count(*) FILTER (a.v <= 0 AND b.v <= 0) AS zero_both,
      count(*) FILTER (a.v <= 0 AND b.v > 0) AS zero_only_a, count(*) FILTER (a.v > 0 AND b.v <= 0) AS zero_only_b, count(*) FILTER (a.v <> b.v) AS changed,
      {sql_rnd('sqrt(avg(power(ln(1 + a.v) - ln(1 + b.v), 2)))', 'rms_log_diff')} FROM a JOIN b USING (id)""",
)
def zeros(t: Tables) -> DataFrame:
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    a = t.orders.select(k.alias("id"), F.when(F.pmod(k, F.lit(5)) == 0, 0.0).otherwise(v).alias("v"))
    b = t.orders.select(k.alias("id"), F.when(F.pmod(k, F.lit(3)) == 0, 0.0).otherwise(v).alias("v"))
    out = J.zero_overlap(a, b, "id", "v")
    return rounded(out, [c for c in out.columns if c != "rms_log_diff"])


@query(
    "route_by_regime",
    "U04",
    f"WITH {B.PREDICTIONS} SELECT id, {sql_rnd('CASE WHEN cold = 1 THEN m2 ELSE m1 END', 'prediction')} FROM pred",
)
def route(t: Tables) -> DataFrame:
    p = B.predictions(t)
    warm, cold = p.select("id", F.col("m1").alias("prediction")), p.select("id", F.col("m2").alias("prediction"))
    return rounded(J.route_by_regime(warm, cold, p, "id", "prediction", "cold"), ["id"])


@query(
    "worst_segments",
    "K02",
    f"""WITH {B.PREDICTIONS} SELECT entity, {sql_rnd('sqrt(avg(power(m3 - truth, 2)))', 'rmse')}, count(*) AS n FROM pred GROUP BY 1 ORDER BY rmse DESC, entity LIMIT 10""",
)
def worst(t: Tables) -> DataFrame:
    err = F.col("m3") - F.col("truth")
    rep = B.predictions(t).groupBy("entity").agg(rnd(F.sqrt(F.avg(err * err)), "rmse"), F.count(F.lit(1)).alias("n"))
    return TK.worst_segments(rep, "rmse", 10)


@query(
    "robustness_trim",
    "K04",
    f"""WITH {B.PREDICTIONS}, e AS (SELECT entity, sum((power(m2 - truth, 2) - power(m1 - truth, 2)) / 1e6) AS d, count(*) AS n FROM pred GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY d, entity) AS r FROM e)
    SELECT CAST(k AS INTEGER) AS removed, {sql_rnd('sum(CASE WHEN r > k THEN d END) / sum(CASE WHEN r > k THEN n END)', 'delta_mse')}, CAST(sum(CASE WHEN r > k THEN n END) AS BIGINT) AS rows_left
    FROM r CROSS JOIN (VALUES (0), (1), (5), (10), (25), (50)) v(k) GROUP BY 1""",
)
def trim(t: Tables) -> DataFrame:
    p = B.predictions(t)
    e1, e2 = F.col("m1") - F.col("truth"), F.col("m2") - F.col("truth")
    rows = p.select("entity", (e1 * e1 / 1e6).alias("a"), (e2 * e2 / 1e6).alias("b"))
    return rounded(TK.trim_table(rows, "entity", "a", "b"), ["removed", "rows_left"])


@query(
    "align_to_sample",
    "K05",
    f"WITH {B.PREDICTIONS} SELECT id, id * 7 % 15013 AS position, {sql_rnd('m1', 'prediction')} FROM pred",
)
def align(t: Tables) -> DataFrame:
    p = B.predictions(t)
    sample = t.orders.select(F.col("o_orderkey").alias("id"), F.pmod(F.col("o_orderkey") * 7, F.lit(15013)).alias("position"))
    return rounded(
        TK.align_to_sample(p.select("id", F.col("m1").alias("prediction")), sample, "id", "position"), ["id", "position"]
    )


# ---- text -----------------------------------------------------------------------------------------------------------

_LOWER = "lower(translate({x}, 'İI', 'iı'))"
_KEY = (
    "trim(regexp_replace(translate(nfc_normalize(lower(translate({x}, 'İI', 'iı'))), 'çğıöşü', 'cgiosu'), '\\s+', ' ', 'g'))"
)


@query(
    "locale_case",
    "F01",
    """SELECT doc_id, md5(lower(translate(text, 'İI', 'iı'))) AS lowered,
      md5(upper(replace(translate(text, 'ıi', 'Iİ'), 'ß', 'ss'))) AS uppered FROM documents""",
)
def locale_case(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.md5(TX.locale_lower("text")).alias("lowered"), F.md5(TX.locale_upper("text")).alias("uppered")
    )


@query("join_key", "F02", f"SELECT doc_id, {_KEY.format(x='text')} AS key FROM documents")
def keys(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", TX.join_key("text").alias("key"))


@query(
    "strip_qualifier",
    "F03",
    """WITH a AS (SELECT page_id, CASE WHEN position('/' IN url) > 0 AND trim(split_part(url, '/', 1)) <> '' THEN trim(split_part(url, '/', 1)) ELSE url END AS x FROM pages),
    b AS (SELECT page_id, CASE WHEN position('(' IN x) > 0 AND trim(split_part(x, '(', 1)) <> '' THEN trim(split_part(x, '(', 1)) ELSE x END AS x FROM a)
    SELECT page_id, CASE WHEN position(' - ' IN x) > 0 AND trim(split_part(x, ' - ', 1)) <> '' THEN trim(split_part(x, ' - ', 1)) ELSE x END AS name FROM b""",
)
def qualifier(t: Tables) -> DataFrame:
    return t.pages.select("page_id", TX.strip_qualifier("url").alias("name"))


@query(
    "split_composite",
    "F04",
    r"""WITH a AS (SELECT p_partkey, trim(p_brand || CASE p_partkey % 4 WHEN 0 THEN '|' WHEN 1 THEN ' / ' WHEN 2 THEN '-' ELSE '' END || p_name) AS x FROM part),
    s AS (SELECT p_partkey, x, CASE WHEN position('|' IN x) > 0 THEN '|' WHEN position('/' IN x) > 0 THEN '/' WHEN position('-' IN x) > 0 THEN '-' END AS sep FROM a)
    SELECT p_partkey, CASE WHEN sep IS NOT NULL THEN trim(substr(x, 1, position(sep IN x) - 1)) END AS province,
      CASE WHEN sep IS NOT NULL THEN trim(substr(x, position(sep IN x) + 1)) ELSE x END AS district FROM s""",
)
def composite(t: Tables) -> DataFrame:
    k = F.pmod("p_partkey", F.lit(4))
    sep = F.when(k == 0, "|").when(k == 1, " / ").when(k == 2, "-").otherwise("")
    rows = t.part.select("p_partkey", F.concat("p_brand", sep, "p_name").alias("x"))
    left, right = TX.split_composite("x")
    return rows.select("p_partkey", left.alias("province"), right.alias("district"))


@query(
    "codepoints",
    "F05",
    """SELECT doc_id, (position(chr(775) IN text) > 0)::INT AS dotted, md5(array_to_string(list_transform(string_split(text, ''), lambda ch: 'U+' || upper(lpad(to_hex(ord(ch)), 4, '0'))), ' ')) AS points FROM documents""",
)
def points(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        TX.has_combining_dot("text").cast("int").alias("dotted"),
        F.md5(F.concat_ws(" ", TX.codepoints("text"))).alias("points"),
    )


_PHRASES = (
    "Olumsuz Hava Şartları - Sigorta Arıza", "AĞAÇ DALI TEMASI", "Kuş Çarpması (hayvan)", "3. Şahıs Hasarı", "TEİAŞ İletim Arızası",
    "Borçtan Kesme - Hattan kesme", "Can ve Mal Emniyeti", "PLANLI BAKIM_çalışması", "Müşteri talebi", "Aşırı Yük/Termik Açma",
    "Kablo koptu", "Trafo patladı", "Ayırıcı; kesici", "İzolatör atlama", "Klemens oksitlenmesi", "Sayaç panosu", "Direk devrildi",
    "Saha dağıtım kutusu", "Ekonomik ömür", "OG-Arıza", "Geçici", "Nedeni bilinmeyen", "", "zzz",
)


def reason_rows(t: Tables) -> DataFrame:
    """Outage reasons: a phrase per event in front of the event type, and every document as free text."""
    phrases = F.array(*[F.lit(p) for p in _PHRASES])
    pick = F.element_at(phrases, (F.pmod("event_id", F.lit(len(_PHRASES))) + 1).cast("int"))
    a = t.events.select(F.col("event_id").alias("id"), F.lit("event").alias("src"), F.concat(pick, F.lit(" "), "event_type").alias("reason"))
    b = t.documents.select(F.col("doc_id").alias("id"), F.lit("document").alias("src"), F.col("text").alias("reason"))
    return a.unionByName(b)


def _reason_sql() -> str:
    phrases = "[" + ", ".join(f"'{p}'" for p in _PHRASES) + "]"
    key = _KEY.format(x="reason")
    norm = f"' ' || trim(regexp_replace(regexp_replace({key}, '[;,/\\\\\\-_()\\[\\]]+', ' ', 'g'), '\\s+', ' ', 'g')) || ' '"
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(n, '{w}')" for w in words) + f" THEN {code}"
        for _, code, _, words in TX.REASON_FAMILIES
    )
    lookup = ", ".join(f"({c}, '{f}', {int(b)})" for f, c, b, _ in TX.REASON_FAMILIES) + ", (0, 'DIGER', 1)"
    return f"""r AS (SELECT event_id AS id, 'event' AS src, ({phrases})[event_id % {len(_PHRASES)} + 1] || ' ' || event_type AS reason FROM events
      UNION ALL SELECT doc_id, 'document', text FROM documents),
    c AS (SELECT id, src, CASE {whens} ELSE 0 END AS code FROM (SELECT id, src, {norm} AS n FROM r)),
    fam(code, family, fault) AS (VALUES {lookup})"""


@query(
    "reason_taxonomy",
    "F06",
    f"""WITH {_reason_sql()} SELECT id, src, c.code AS reason_code, family AS reason_family, fault AS reason_fault, (c.code = 1)::INT AS reason_weather FROM c JOIN fam USING (code)""",
)
def reasons(t: Tables) -> DataFrame:
    return TX.add_reason_features(reason_rows(t), "reason").drop("reason")


@query(
    "reason_family_report",
    "A26 F06",
    f"""WITH {_reason_sql()} SELECT family AS reason_family, count(*) AS rows, max(fault) AS fault, round(count(*) * 100 / (SELECT count(*) FROM c), 2) AS percent FROM c JOIN fam USING (code) GROUP BY 1""",
)
def reason_report(t: Tables) -> DataFrame:
    return TX.reason_family_report(reason_rows(t), "reason")


@query(
    "alphabet_sort",
    "K01",
    """WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+')) AS word FROM documents)
    SELECT word, array_to_string(list_transform(string_split(lower(translate(word, 'İI', 'iı')), ''), lambda ch:
      CASE WHEN position(ch IN 'abcçdefgğhıijklmnoöprsştuüvyz') > 0 THEN chr(32 + CAST(position(ch IN 'abcçdefgğhıijklmnoöprsştuüvyz') AS INTEGER)) ELSE '~' END), '') AS place
    FROM w""",
)
def alphabet(t: Tables) -> DataFrame:
    """Every distinct word of the documents in the order of the alphabet, with the key that orders it."""
    words = t.documents.select(F.explode(F.split("text", r"\s+")).alias("word")).distinct()
    return TX.alphabet_sorted(words, "word").select("word", TX.alphabet_sort_key("word").alias("place"))


def _dirty(t: Tables) -> DataFrame:
    k = F.pmod("s_suppkey", F.lit(6))
    name = F.col("n_name")
    raw = (
        F.when(k == 0, name).when(k == 1, F.concat(F.lit("  "), name, F.lit(" / Merkez"))).when(k == 2, F.concat(F.col("r_name"), F.lit("-"), name))
        .when(k == 3, F.lower(name)).when(k == 4, F.concat(F.lit("Eski "), name)).otherwise(F.concat(name, F.lit("̇")))
    )
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "s_suppkey", raw.alias("raw"), name.alias("clean")
    )


def _reference(t: Tables) -> DataFrame:
    return t.nation.select(F.regexp_replace(TX.join_key("n_name"), "_", " ").alias("key"), TX.join_key("n_name").alias("raw_key"))


_DIRTY = f"""d AS (SELECT s_suppkey, n_name AS clean, CASE s_suppkey % 6 WHEN 0 THEN n_name WHEN 1 THEN '  ' || n_name || ' / Merkez' WHEN 2 THEN r_name || '-' || n_name
    WHEN 3 THEN lower(n_name) WHEN 4 THEN 'Eski ' || n_name ELSE n_name || chr(775) END AS raw
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  ref AS (SELECT {_KEY.format(x='n_name')} AS k FROM nation)"""


@query(
    "align_keys",
    "J20",
    f"""WITH {_DIRTY}, u AS (SELECT DISTINCT raw FROM d), c AS (SELECT raw, {_KEY.format(x='raw')} AS base,
        CASE WHEN raw LIKE '%/%' THEN {_KEY.format(x="split_part(raw, '/', 1)")} ELSE {_KEY.format(x='raw')} END AS q,
        CASE WHEN raw LIKE '%/%' THEN {_KEY.format(x="split_part(raw, '/', 2)")} WHEN raw LIKE '%-%' THEN {_KEY.format(x="split_part(raw, '-', 2)")}
             WHEN raw LIKE '%\\_%' ESCAPE '\\' THEN {_KEY.format(x="split_part(raw, '_', 2)")} ELSE {_KEY.format(x='raw')} END AS p FROM u),
    al AS (SELECT *, CASE WHEN base = 'eski nation_3' THEN 'nation_3' WHEN base = 'eski nation_7' THEN 'nation_7' END AS a FROM c)
    SELECT raw, CASE WHEN base IN (SELECT k FROM ref) THEN base WHEN q IN (SELECT k FROM ref) THEN q WHEN p IN (SELECT k FROM ref) THEN p
        WHEN a IN (SELECT k FROM ref) THEN a ELSE base END AS key,
      CASE WHEN base IN (SELECT k FROM ref) THEN 'direct' WHEN q IN (SELECT k FROM ref) THEN 'qualifier' WHEN p IN (SELECT k FROM ref) THEN 'composite'
        WHEN a IN (SELECT k FROM ref) THEN 'alias' ELSE 'NOT_FOUND' END AS method FROM al""",
)
def aligned(t: Tables) -> DataFrame:
    return TX.align_keys(
        _dirty(t), "raw", _reference(t), "raw_key", {"eski nation_3": "nation_3", "eski nation_7": "nation_7"}
    )


@query(
    "pick_group_column",
    "J21",
    f"""WITH {_DIRTY}, x AS (SELECT count(DISTINCT clean) AS n FROM d),
    u AS (SELECT DISTINCT raw FROM d), h AS (SELECT count(*) AS n, count(*) FILTER (NOT starts_with(raw, 'Eski') AND position(chr(775) IN raw) = 0) AS m FROM u)
    SELECT 'raw' AS "column", {sql_rnd('m / n', 'match_ratio')}, 0 AS chosen FROM h UNION ALL SELECT 'clean', 1.0::DOUBLE, 1 FROM x""",
)
def picked(t: Tables) -> DataFrame:
    return rounded(TX.pick_group_column(_dirty(t), ["raw", "clean"], _reference(t), "raw_key"), ["column", "chosen"])


@query(
    "diagnose_join",
    "J19",
    f"""WITH {_DIRTY}, l AS (SELECT DISTINCT raw FROM d), r AS (SELECT DISTINCT n_name AS raw FROM nation), ln AS (SELECT DISTINCT {_KEY.format(x='raw')} AS k FROM l), rn AS (SELECT DISTINCT {_KEY.format(x='raw')} AS k FROM r),
    m AS (SELECT (SELECT count(*) FROM l) AS left_unique, (SELECT count(*) FROM r) AS right_unique, (SELECT count(*) FROM l JOIN r USING (raw)) AS raw_matched,
      (SELECT count(*) FROM ln JOIN rn USING (k)) AS nm, (SELECT count(*) FROM ln) AS nl, (SELECT count(*) FROM rn) AS nr,
      (SELECT count(*) FROM ln ANTI JOIN rn USING (k) WHERE k LIKE '%/%') AS q, (SELECT count(*) FROM ln ANTI JOIN rn USING (k) WHERE k NOT LIKE '%/%' AND k LIKE '%-%') AS c,
      (SELECT count(*) FROM l WHERE position(chr(775) IN raw) > 0) AS dots)
    SELECT left_unique, right_unique, raw_matched, nm AS normalized_matched, nm - raw_matched AS recovered, nl - nm - q - c AS left_only, nr - nm AS right_only,
      q AS qualifier_rescue, c AS composite_rescue, dots AS combining_dot_keys FROM m""",
)
def diagnosed(t: Tables) -> DataFrame:
    return TX.diagnose_join(_dirty(t), "raw", t.nation, "n_name")
