"""Panel construction, row-local columns and the flagship plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.exprs import safe_div
from panelforge.operators import columns as C
from panelforge.operators import panel as P
from panelforge.operators import windows as W
from panelforge.plans import bases as B
from panelforge.plans.registry import Tables, query, rnd, rounded, sql_rnd


@query(
    "flagship_panel_forecast",
    "Q01 W01 W02 M01 M07",
    f"""WITH {B.DENSE_SUPPLIER}, f AS (
      SELECT entity, day, qty, lag(qty, 7) OVER w AS lag7,
             avg(qty) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 34 PRECEDING AND 7 PRECEDING) AS roll
      FROM dense WINDOW w AS (PARTITION BY entity ORDER BY day))
    SELECT CAST(month(day) AS INTEGER) AS month, count(*) AS n,
           {sql_rnd('sqrt(avg(power(qty - roll, 2)))', 'rmse_roll')},
           {sql_rnd('avg(abs(qty - roll))', 'mae_roll')},
           {sql_rnd('sqrt(avg(power(qty - lag7, 2)))', 'rmse_lag')}
    FROM f WHERE roll IS NOT NULL GROUP BY 1""",
)
def flagship(t: Tables) -> DataFrame:
    """Dense panel, lag and 28-row mean at horizon 7, and the error of both as forecasts by month."""
    panel = B.dense_supplier_day(t)
    f = W.lag_features(panel, "qty", ["entity"], "day", 7, shifts=[7])
    f = W.rolling_features(f, "qty", ["entity"], "day", 7, [28], ["mean"])
    roll, lag = F.col("qty_h7_roll28_mean"), F.col("qty_shift7")
    err, err_lag = F.col("qty") - roll, F.col("qty") - lag
    return (
        f.filter(roll.isNotNull())
        .groupBy(F.month("day").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            rnd(F.sqrt(F.avg(err * err)), "rmse_roll"),
            rnd(F.avg(F.abs(err)), "mae_roll"),
            rnd(F.sqrt(F.avg(err_lag * err_lag)), "rmse_lag"),
        )
    )


@query("densify_panel", "Q01", f"WITH {B.DENSE_SUPPLIER} SELECT * FROM dense")
def densify(t: Tables) -> DataFrame:
    return B.dense_supplier_day(t)


@query(
    "densify_panel_hourly",
    "Q01",
    f"""WITH cell AS (SELECT user_id % 20 AS entity, date_trunc('hour', ts) AS hour, sum(round(value, 2)) AS amount FROM events GROUP BY 1, 2),
    grid AS (SELECT e.entity, g.hour FROM (SELECT DISTINCT entity FROM cell) e CROSS JOIN (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM cell) g)
    SELECT entity, CAST(hour AS TIMESTAMP) AS hour, {sql_rnd('coalesce(amount, 0)', 'amount')}, (amount IS NULL)::INT AS is_filled FROM grid LEFT JOIN cell USING (entity, hour)""",
)
def densify_hourly(t: Tables) -> DataFrame:
    rows = t.events.select(F.pmod("user_id", F.lit(20)).alias("entity"), F.col("ts").alias("hour"), F.round("value", 2).alias("amount"))
    out = P.densify_panel(rows, ["entity"], "hour", ["amount"], freq="hour")
    return out.select("entity", "hour", rnd("amount"), "is_filled")


@query(
    "densify_panel_monthly",
    "Q01",
    f"""WITH cell AS (SELECT l_suppkey AS entity, last_day(l_shipdate::DATE) AS month, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
    grid AS (SELECT e.entity, g.month FROM (SELECT DISTINCT entity FROM cell) e CROSS JOIN
      (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(month)), max(month), INTERVAL 1 MONTH)) AS DATE)) AS month FROM cell) g)
    SELECT entity, month, {sql_rnd('coalesce(qty, 0)', 'qty')}, (qty IS NULL)::INT AS is_filled FROM grid LEFT JOIN cell USING (entity, month)""",
)
def densify_monthly(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").alias("month"), F.col("l_quantity").alias("qty"))
    out = P.densify_panel(rows, ["entity"], "month", ["qty"], freq="month")
    return out.select("entity", "month", rnd("qty"), "is_filled")


@query(
    "panel_coverage_weekly",
    "Q03",
    f"""WITH c AS (SELECT DISTINCT user_id % 50 AS entity, date_trunc('week', ts)::DATE AS week FROM events WHERE hour(ts) < 3),
    s AS (SELECT count(DISTINCT entity) AS entity_count, CAST((max(week) - min(week)) / 7 + 1 AS BIGINT) AS time_steps, count(*) AS actual_rows FROM c)
    SELECT entity_count, time_steps, entity_count * time_steps AS expected_rows, actual_rows, {sql_rnd('actual_rows / (entity_count * time_steps)', 'coverage')} FROM s""",
)
def coverage_weekly(t: Tables) -> DataFrame:
    rows = t.events.filter(F.hour("ts") < 3).select(F.pmod("user_id", F.lit(50)).alias("entity"), "ts")
    return rounded(P.panel_coverage(rows, ["entity"], "ts", freq="week"), ["entity_count", "time_steps", "expected_rows", "actual_rows"])


@query(
    "densify_panel_measures",
    "Q01",
    f"""WITH cell AS (
      SELECT user_id AS entity, CAST(ts AS DATE) AS day, sum(round(value, 2)) AS amount,
             arg_min(event_type, event_id) AS kind FROM events GROUP BY 1, 2),
    grid AS (SELECT e.entity, g.day FROM (SELECT DISTINCT entity FROM cell) e CROSS JOIN
      (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM cell) g)
    SELECT entity, day, {sql_rnd('amount', 'amount')}, kind, CASE WHEN kind IS NULL THEN 1 ELSE 0 END AS is_filled
    FROM grid LEFT JOIN cell USING (entity, day)""",
)
def densify_measures(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("user_id").alias("entity"),
        F.col("ts").alias("day"),
        F.round("value", 2).alias("amount"),
        F.col("event_type").alias("kind"),
        "event_id",
    )
    out = P.densify_panel(rows, ["entity"], "day", ["amount"], {"kind": "event_id"}, fill=None)
    return rounded(out, ["entity", "day", "kind", "is_filled"])


@query(
    "snap_to_grid",
    "Q02",
    """SELECT event_type, to_timestamp(floor(epoch(date_trunc('second', ts)) / 21600) * 21600)::TIMESTAMP AS step,
              count(*) AS n, CAST(min(event_id) AS BIGINT) AS first_event
       FROM events GROUP BY 1, 2""",
)
def snap(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", P.snap_to_step("ts", "6 hours").alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event")
    )


@query(
    "panel_coverage",
    "Q03",
    f"""WITH {B.SUPPLIER_DAY}, s AS (
      SELECT count(DISTINCT entity) AS entity_count, CAST(max(day) - min(day) + 1 AS BIGINT) AS time_steps,
             count(*) AS actual_rows FROM supplier_day)
    SELECT entity_count, time_steps, entity_count * time_steps AS expected_rows, actual_rows,
           {sql_rnd('actual_rows / (entity_count * time_steps)', 'coverage')} FROM s""",
)
def coverage(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").alias("day"))
    return rounded(
        P.panel_coverage(rows, ["entity"], "day"), ["entity_count", "time_steps", "expected_rows", "actual_rows"]
    )


@query(
    "bridge_rows",
    "Q04",
    f"""WITH {B.TRAIN_TEST}, b AS (
      SELECT CAST(unnest(generate_series((SELECT max(day) FROM train) + INTERVAL 1 DAY,
                                         (SELECT min(day) FROM test) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT entity, day, 1 AS is_bridge FROM (SELECT DISTINCT entity FROM test) CROSS JOIN b""",
)
def bridge(t: Tables) -> DataFrame:
    train, test = B.train_test(t)
    return P.bridge_days(train, test, ["entity"], "day", "is_bridge")


@query(
    "duration_panel",
    "Q05",
    """WITH log AS (
      SELECT lower(event_type) AS key, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Istanbul')::DATE AS day,
             (floor(epoch(ts + INTERVAL 1 MINUTE * (event_id % 300 - 20))) - floor(epoch(ts))) / 60.0 AS minutes
      FROM events),
    cell AS (SELECT key, day, sum(minutes) AS minutes, count(*) AS outages FROM log WHERE minutes >= 0 GROUP BY 1, 2),
    grid AS (SELECT k.key, g.day FROM (SELECT DISTINCT key FROM cell) k CROSS JOIN
      (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM cell) g)
    SELECT key, day, round(coalesce(minutes, 0), 4) + 0.0 AS minutes, CAST(coalesce(outages, 0) AS DOUBLE) AS outages,
           CASE WHEN outages IS NULL THEN 1 ELSE 0 END AS is_filled FROM grid LEFT JOIN cell USING (key, day)""",
)
def durations(t: Tables) -> DataFrame:
    start = F.col("ts").cast("timestamp")
    log = t.events.select(
        F.lower("event_type").alias("key"),
        start.alias("started"),
        (start + F.make_dt_interval(mins=(F.pmod("event_id", F.lit(300)) - 20).cast("int"))).alias("ended"),
    )
    return P.duration_panel(log, "key", "started", "ended").withColumn("minutes", F.round("minutes", 4) + 0.0)


@query(
    "reference_panel",
    "Q06",
    """WITH log AS (SELECT c_nationkey AS nation, o_orderdate::DATE AS day, o_totalprice AS amount
                    FROM orders JOIN customer ON o_custkey = c_custkey),
    cell AS (SELECT nation, day, count(*) AS events, sum(amount) AS amount FROM log GROUP BY 1, 2),
    grid AS (SELECT n_nationkey AS nation, day FROM nation CROSS JOIN
      (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM log))
    SELECT nation, day, coalesce(events, 0) AS events, round(coalesce(amount, 0.0), 4) + 0.0 AS amount,
           CASE WHEN day IN (SELECT day FROM log) THEN 1 ELSE 0 END AS covered_day
    FROM grid LEFT JOIN cell USING (nation, day)""",
)
def reference_driven(t: Tables) -> DataFrame:
    log = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount")
    )
    ref = t.nation.select(F.col("n_nationkey").alias("nation"))
    out = P.reference_panel(log, ref, ["nation"], "day", ["amount"])
    return rounded(out, ["nation", "day", "events", "covered_day"], digits=4)


_PATH_SQL = """path AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN r_name || '>' || n_name
      ELSE r_name || '> Zone ' || (s_suppkey % 7) || ' >' || n_name END AS loc
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def supplier_path(t: Tables) -> DataFrame:
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    zone = F.concat(F.lit("> Zone "), F.pmod("s_suppkey", F.lit(7)).cast("string"), F.lit(" >"))
    return joined.select(
        "s_suppkey",
        F.when(F.pmod("s_suppkey", F.lit(3)) == 0, F.concat("r_name", F.lit(">"), "n_name"))
        .otherwise(F.concat("r_name", zone, "n_name"))
        .alias("loc"),
    )


@query(
    "split_location",
    "Q07",
    f"""WITH {_PATH_SQL}
    SELECT s_suppkey, trim(split_part(loc, '>', 1)) AS province, trim(string_split(loc, '>')[-1]) AS district,
           CASE WHEN len(string_split(loc, '>')) >= 3 THEN trim(split_part(loc, '>', 2)) ELSE 'NONE' END AS region
    FROM path""",
)
def location(t: Tables) -> DataFrame:
    return C.split_location(supplier_path(t), "loc").drop("loc")


@query(
    "identifier_features",
    "Q08",
    """WITH ids AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'T' || o_orderkey
                           ELSE CAST(o_orderkey * 7 AS VARCHAR) END AS code FROM orders)
    SELECT o_orderkey, code,
           CASE WHEN regexp_full_match(code, '\\d+') THEN TRY_CAST(code AS DOUBLE) END AS code_num,
           CAST(length(code) AS DOUBLE) AS code_length,
           TRY_CAST(substr(code, 1, 2) AS DOUBLE) AS code_first2, TRY_CAST(substr(code, 1, 3) AS DOUBLE) AS code_first3,
           TRY_CAST(substr(code, 1, 4) AS DOUBLE) AS code_first4, TRY_CAST(substr(code, 1, 5) AS DOUBLE) AS code_first5
    FROM ids""",
)
def identifiers(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    code = F.when(F.pmod(k, F.lit(10)) == 3, F.concat(F.lit("T"), k.cast("string"))).otherwise((k * 7).cast("string"))
    return C.identifier_features(t.orders.select(k, code.alias("code")), "code")


@query(
    "pair_features",
    "Q09",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      {sql_rnd('l_extendedprice / l_quantity', 'price_over_qty', 8)},
      {sql_rnd('l_extendedprice - l_quantity', 'price_minus_qty')},
      {sql_rnd('l_extendedprice * l_quantity', 'price_times_qty', 4)},
      {sql_rnd('CASE WHEN abs(l_discount) >= 1e-9 THEN l_tax / l_discount END', 'tax_over_disc')},
      {sql_rnd('l_tax - l_discount', 'tax_minus_disc')}, {sql_rnd('l_tax * l_discount', 'tax_times_disc')}
    FROM lineitem""",
)
def pairs(t: Tables) -> DataFrame:
    li = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"),
        F.col("l_tax").alias("tax"), F.col("l_discount").alias("disc"),
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    out = C.pair_features(li, [("price", "qty"), ("tax", "disc")])
    names = [c for c in out.columns if any(x in c for x in ("_over_", "_minus_", "_times_"))]
    digits = {"price_times_qty": 4, "price_over_qty": 8}
    return out.select(*keys, *[rnd(c, digits=digits.get(c, 6)) for c in names])


@query(
    "combine_categories",
    "Q10",
    """SELECT p_partkey, p_brand || '__' || p_type AS p_brand__p_type,
       nullif(p_type, 'PROMO') || '__' || p_size AS promo__p_size FROM part""",
)
def combined(t: Tables) -> DataFrame:
    p = t.part.withColumn("promo", F.nullif(F.col("p_type"), F.lit("PROMO")))
    return C.combine_categories(p, [["p_brand", "p_type"], ["promo", "p_size"]]).select(
        "p_partkey", "p_brand__p_type", "promo__p_size"
    )


@query(
    "fold_rare_categories",
    "Q11",
    """WITH d AS (SELECT doc_id, nullif(lang, 'de') || '/' || source AS cat FROM documents),
    n AS (SELECT cat, count(*) AS n FROM d GROUP BY 1)
    SELECT doc_id, CASE WHEN n.n >= 10 THEN d.cat ELSE '_OTHER' END AS cat
    FROM d JOIN n ON d.cat IS NOT DISTINCT FROM n.cat""",
)
def rare(t: Tables) -> DataFrame:
    d = t.documents.select(
        "doc_id", F.concat(F.nullif(F.col("lang"), F.lit("de")), F.lit("/"), F.col("source")).alias("cat")
    )
    return C.fold_rare_categories(d, "cat", 10)


@query(
    "capacity_bucket",
    "Q14",
    """SELECT c_custkey, CASE WHEN c_acctbal IS NULL OR c_acctbal <= 0 THEN -1 WHEN c_acctbal <= 100 THEN 0
      WHEN c_acctbal <= 160 THEN 1 WHEN c_acctbal <= 250 THEN 2 WHEN c_acctbal <= 400 THEN 3 WHEN c_acctbal <= 630 THEN 4
      WHEN c_acctbal <= 1000 THEN 5 WHEN c_acctbal <= 1600 THEN 6 ELSE 7 END AS bucket FROM customer""",
)
def capacity(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", C.capacity_bucket("c_acctbal").alias("bucket"))


@query(
    "population_class",
    "Q15",
    """WITH d AS (SELECT c_nationkey, c_mktsegment, CAST(sum(abs(c_acctbal)) / 10 AS BIGINT) AS population
                  FROM customer GROUP BY 1, 2)
    SELECT c_nationkey, c_mktsegment, CASE WHEN population >= 50000 THEN 'urban' WHEN population >= 2000 THEN 'suburban'
      ELSE 'rural' END AS class FROM d""",
)
def population(t: Tables) -> DataFrame:
    d = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(
        F.round(F.sum(F.abs("c_acctbal")) / 10).cast("bigint").alias("population")
    )
    return d.select("c_nationkey", "c_mktsegment", C.population_class("population").alias("class"))


@query(
    "downcast_plan",
    "Q16",
    """WITH s AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi, min(l_linenumber) AS llo, max(l_linenumber) AS lhi,
        max(abs(l_extendedprice - CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE))) / max(abs(l_extendedprice)) AS pe,
        max(abs(l_discount - CAST(CAST(l_discount AS FLOAT) AS DOUBLE))) / max(abs(l_discount)) AS de FROM lineitem)
    SELECT 'l_orderkey' AS "column", 'bigint' AS type_now, CASE WHEN lo >= -128 AND hi <= 127 THEN 'tinyint'
      WHEN lo >= -32768 AND hi <= 32767 THEN 'smallint' WHEN hi <= 2147483647 THEN 'int' ELSE 'bigint' END AS type_fit FROM s
    UNION ALL SELECT 'l_linenumber', 'int', CASE WHEN llo >= -128 AND lhi <= 127 THEN 'tinyint' ELSE 'int' END FROM s
    UNION ALL SELECT 'l_extendedprice', 'double', CASE WHEN pe < 1e-6 THEN 'float' ELSE 'double' END FROM s
    UNION ALL SELECT 'l_discount', 'double', CASE WHEN de < 1e-6 THEN 'float' ELSE 'double' END FROM s""",
)
def narrow(t: Tables) -> DataFrame:
    return C.downcast_plan(t.lineitem, ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"])


@query(
    "rescue_number",
    "Q17",
    """SELECT o_orderkey, round(o_totalprice, 2) + 0.0 AS price FROM orders""",
)
def rescue(t: Tables) -> DataFrame:
    """Order totals written with a decimal comma and dots between thousands come back as the numbers they were."""
    text = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return C.rescue_number(t.orders.select("o_orderkey", text.alias("text")), "text", "price").drop("text")


@query(
    "parse_dates",
    "Q18",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders""",
)
def dates(t: Tables) -> DataFrame:
    """Day-first order dates; the reading is proven by a first component above 12."""
    text = F.date_format("o_orderdate", "dd.MM.yyyy")
    return C.parse_dates(t.orders.select("o_orderkey", text.alias("text")), "text", "day").drop("text")


@query(
    "parse_dates_with_times",
    "Q18",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 97 > 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""",
)
def dates_with_times(t: Tables) -> DataFrame:
    """Half of the dates carry a time of day; one in 97 is no date at all."""
    form = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.date_format("o_orderdate", "dd.MM.yyyy HH:mm")).otherwise(
        F.date_format("o_orderdate", "d/M/yyyy")
    )
    text = F.when(F.pmod("o_orderkey", F.lit(97)) > 0, form).otherwise(F.lit("no date"))
    return C.parse_dates(t.orders.select("o_orderkey", text.alias("text")), "text", "day").drop("text")


@query(
    "date_order",
    "Q18",
    """SELECT CASE WHEN max(day(o_orderdate)) > 12 THEN 'day_first' ELSE 'ambiguous' END AS date_order FROM orders""",
)
def order_of_dates(t: Tables) -> DataFrame:
    return C.date_order(t.orders.select(F.date_format("o_orderdate", "d/M/yyyy").alias("text")), "text")


@query(
    "id_pattern",
    "Q19",
    f"""WITH {B.SUPPLIER_DAY} SELECT 'entity + day:compact' AS pattern, '_' AS separator, count(*) AS made,
      count(*) AS wanted, 0::BIGINT AS missing, 0::BIGINT AS extra FROM supplier_day""",
)
def id_synthesis(t: Tables) -> DataFrame:
    """The sample ids are entity_yyyymmdd; the search must find exactly that spelling."""
    test = B.supplier_day(t)
    sample = test.select(F.concat_ws("_", F.col("entity").cast("string"), F.date_format("day", "yyyyMMdd")).alias("id"))
    return C.id_patterns(test, sample, "id", ["entity"], "day")


@query(
    "id_pattern_none",
    "Q19",
    """SELECT '' AS pattern, '' AS separator, 0::BIGINT AS made, 0::BIGINT AS wanted, 0::BIGINT AS missing, 0::BIGINT AS extra FROM orders WHERE false""",
)
def no_pattern(t: Tables) -> DataFrame:
    """Ids that no combination of key and date makes: the report is empty."""
    test = B.supplier_day(t)
    sample = test.select(F.concat(F.lit("x"), F.col("entity").cast("string")).alias("id"))
    return C.id_patterns(test, sample, "id", ["entity"], "day")


@query(
    "mask_history",
    "Q20",
    f"""WITH {B.SUPPLIER_DAY}, h AS (SELECT *, ('0x' || substr(md5('7|' || entity), 1, 8))::BIGINT % 10000 < 2216 AS hit FROM supplier_day)
    SELECT entity, day, CASE WHEN NOT hit THEN qty END AS qty, hit::INT AS cold FROM h""",
)
def masked(t: Tables) -> DataFrame:
    return P.mask_history(B.supplier_day(t), "entity", ["qty"], 0.2216, seed=7)


@query(
    "densify_ratio",
    "Q01 Q03",
    f"WITH {B.DENSE_USER} SELECT entity, {sql_rnd('avg(is_filled)', 'filled_share')} FROM dense GROUP BY 1",
)
def filled_share(t: Tables) -> DataFrame:
    return B.dense_user_day(t).groupBy("entity").agg(
        rnd(safe_div(F.sum("is_filled"), F.count(F.lit(1))), "filled_share")
    )
