"""Data quality, sources, model dataflow and streaming."""

from __future__ import annotations

import time
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.scale import shared_folder
from panelforge.operators import ml as ML
from panelforge.operators import quality as Q
from panelforge.operators import splits as V
from panelforge.plans import bases as B
from panelforge.plans.registry import Tables, query, rnd, rounded, sql_rnd
from panelforge.sources import partitions as PT
from panelforge.sources import publish as P
from panelforge.sources import readers as R
from panelforge.streaming import rollup as ST

# ---- profiles -------------------------------------------------------------------------------------------------------


def _num(c: str) -> str:
    return f"""SELECT '{c}' AS "column", 'numeric' AS kind, CAST(count(*) - count({c}) AS BIGINT) AS missing, count(DISTINCT {c}) + (count(*) > count({c}))::INT AS "distinct",
      {sql_rnd(f'min({c})', 'min', 5)}, {sql_rnd(f'quantile_cont({c}, 0.25)', 'p25', 5)}, {sql_rnd(f'median({c})', 'median', 5)}, {sql_rnd(f'quantile_cont({c}, 0.75)', 'p75', 5)},
      {sql_rnd(f'max({c})', 'max', 5)}, {sql_rnd(f'avg({c})', 'mean', 5)}, {sql_rnd(f'stddev_samp({c})', 'std', 5)}, {sql_rnd(f'skewness({c})', 'skew', 5)}"""


def _cat(c: str, kind: str) -> str:
    return f"""SELECT '{c}', '{kind}', CAST(count(*) - count({c}) AS BIGINT), count(DISTINCT {c}) + (count(*) > count({c}))::INT, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"""


_KEEP = ["column", "kind", "missing", "distinct", "flags"]


@query(
    "profile_columns",
    "D01",
    f"""{_num('l_orderkey')}, CASE WHEN count(DISTINCT l_orderkey) >= 0.98 * count(*) THEN 'ID_LIKE' ELSE '' END AS flags FROM lineitem
    UNION ALL {_num('l_quantity')}, '' FROM lineitem UNION ALL {_num('l_extendedprice')}, '' FROM lineitem
    UNION ALL {_num('l_tax')}, '' FROM lineitem UNION ALL {_cat('l_returnflag', 'category')}, '' FROM lineitem UNION ALL {_cat('l_shipdate', 'time')}, '' FROM lineitem""",
)
def profile(t: Tables) -> DataFrame:
    cols = ["l_orderkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_shipdate"]
    return rounded(Q.profile_columns(t.lineitem.select(*cols)), _KEEP, 5)


@query(
    "profile_flags",
    "D01",
    """SELECT * FROM (VALUES ('o_orderkey', 'ID_LIKE'), ('batch_no', 'REPEATED_MONOTONE'), ('one', 'CONSTANT'), ('rare', 'VERY_SKEWED | ZERO_PILE'),
      ('gone', 'MOSTLY_MISSING'), ('name', 'ID_LIKE | COMBINING_DOT'), ('o_orderpriority', '')) v("column", flags) WHERE (SELECT count(*) FROM orders) > 0""",
)
def profile_flags(t: Tables) -> DataFrame:
    """Every flag must fire on the column built for it, and only there."""
    k = F.col("o_orderkey")
    rows = t.orders.select(
        k,
        F.floor(k / 100).cast("bigint").alias("batch_no"),
        F.lit(1).alias("one"),
        F.when(F.pmod(k, F.lit(100)) == 7, F.col("o_totalprice")).otherwise(0.0).alias("rare"),
        F.when(F.pmod(k, F.lit(10)) == 0, F.col("o_totalprice")).alias("gone"),
        F.concat(F.lit("i"), F.lit("̇"), k.cast("string")).alias("name"),
        "o_orderpriority",
    )
    return Q.profile_columns(rows, order_by="o_orderkey").select("column", "flags")


@query(
    "target_summary",
    "D02",
    f"""SELECT 0::BIGINT AS missing, count(DISTINCT o_totalprice) AS "distinct", {sql_rnd("(SELECT min(n) / sum(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_totalprice))", 'rarest_share', 8)}, 'regression' AS task,
      {sql_rnd('min(o_totalprice)', 'min', 5)}, {sql_rnd('max(o_totalprice)', 'max', 5)}, {sql_rnd('avg(o_totalprice)', 'mean', 5)}, {sql_rnd('median(o_totalprice)', 'median', 5)},
      {sql_rnd('skewness(o_totalprice)', 'skew', 5)}, {sql_rnd('avg((o_totalprice = 0)::INT)', 'zero_share', 5)}, '' AS advice FROM orders""",
)
def target(t: Tables) -> DataFrame:
    out = Q.target_summary(t.orders, "o_totalprice")
    return out.select(
        "missing", "distinct", rnd("rarest_share", digits=8), "task", "advice",
        *[rnd(c, digits=5) for c in ("min", "max", "mean", "median", "skew", "zero_share")],
    )


def _leaky(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", p, (p * 1.02 + 3).alias("scaled"), F.pow(p / 1000, F.lit(9.0)).alias("powered"),
        F.pmod("o_custkey", F.lit(97)).cast("double").alias("harmless"),
        F.concat(F.lit("c"), F.floor(p / 5000).cast("string")).alias("binned"), "o_orderpriority", "o_orderdate",
    )


_LEAKY = """lk AS (SELECT o_orderkey, o_totalprice, o_totalprice * 1.02 + 3 AS scaled, power(o_totalprice / 1000, 9.0) AS powered, (o_custkey % 97)::DOUBLE AS harmless,
    'c' || floor(o_totalprice / 5000)::BIGINT AS binned, o_orderpriority FROM orders)"""


def _rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(
    "leakage_correlations",
    "D03 W17",
    f"""WITH {_LEAKY}, r AS (SELECT *, {_rank('o_totalprice')} AS ry, {_rank('o_orderkey')} AS r1, {_rank('scaled')} AS r2, {_rank('powered')} AS r3, {_rank('harmless')} AS r4 FROM lk),
    s AS (SELECT 'o_orderkey' AS c, count(*) AS n, corr(o_orderkey, o_totalprice) AS p, corr(r1, ry) AS q FROM r UNION ALL SELECT 'scaled', count(*), corr(scaled, o_totalprice), corr(r2, ry) FROM r
      UNION ALL SELECT 'powered', count(*), corr(powered, o_totalprice), corr(r3, ry) FROM r UNION ALL SELECT 'harmless', count(*), corr(harmless, o_totalprice), corr(r4, ry) FROM r)
    SELECT c AS "column", n AS rows, {sql_rnd('p', 'pearson')}, {sql_rnd('q', 'spearman')}, CASE WHEN abs(p) >= 0.95 THEN 'pearson' WHEN abs(q) >= 0.95 THEN 'spearman' END AS suspect FROM s""",
)
def leak_corr(t: Tables) -> DataFrame:
    return rounded(Q.leakage_correlations(_leaky(t), "o_totalprice"), ["column", "rows", "suspect"])


@query(
    "leakage_categories",
    "D03",
    f"""WITH {_LEAKY}, v AS (SELECT var_pop(o_totalprice) AS v FROM lk), b AS (SELECT 'binned' AS c, count(*) AS n, count(DISTINCT binned) AS k, 1 - avg(power(o_totalprice - m, 2)) / max(v) AS e FROM (SELECT binned, o_totalprice, avg(o_totalprice) OVER (PARTITION BY binned) AS m FROM lk), v
      UNION ALL SELECT 'o_orderpriority', count(*), count(DISTINCT o_orderpriority), 1 - avg(power(o_totalprice - m, 2)) / max(v) FROM (SELECT o_orderpriority, o_totalprice, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m FROM lk), v)
    SELECT c AS "column", n AS rows, k AS levels, {sql_rnd('e', 'eta_squared')}, CASE WHEN e >= 0.95 THEN 'eta_squared' END AS suspect FROM b""",
)
def leak_cat(t: Tables) -> DataFrame:
    return rounded(Q.leakage_categories(_leaky(t), "o_totalprice"), ["column", "rows", "levels", "suspect"])


@query(
    "leakage_report",
    "D03",
    f"""WITH {_LEAKY} SELECT * FROM (VALUES ('critical', 'pearson', 'scaled'), ('critical', 'spearman', 'powered'), ('critical', 'eta_squared', 'binned'), ('warning', 'train_only', 'scaled'),
      ('warning', 'train_only', 'powered'), ('warning', 'train_only', 'binned'), ('warning', 'near_unique', 'o_orderkey'), ('warning', 'near_unique', 'scaled'), ('warning', 'near_unique', 'powered'),
      ('info', 'clean_time_split', 'o_orderdate')) v(severity, "check", "column") WHERE (SELECT count(*) FROM lk) > 0""",
)
def leak_report(t: Tables) -> DataFrame:
    lk = _leaky(t)
    # near-unique columns repeat in the full table only by coincidence of prices, so train keeps every order
    test = lk.filter(F.col("o_orderdate") >= "1999-01-01").select("o_orderkey", "harmless", "o_orderpriority", "o_orderdate")
    later = test.withColumn("o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 10 YEARS"))
    return Q.leakage_report(lk, "o_totalprice", later, "o_orderdate").select("severity", "check", "column")


@query("adversarial_validation", "D04")
def adversarial(t: Tables) -> DataFrame:
    """Rows-only: a tree ensemble. The order date tells train from test almost perfectly, so the verdict is severe."""
    o = t.orders.select(
        "o_orderkey", "o_totalprice", F.pmod("o_custkey", F.lit(50)).alias("c"), F.dayofyear("o_orderdate").alias("doy"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("age"), "o_orderdate",
    )
    train, test = o.filter(F.col("o_orderdate") < B.CUT), o.filter(F.col("o_orderdate") >= B.CUT)
    one, _, _ = ML.adversarial_validation(
        train, test, "o_orderkey", ["o_totalprice", "c", "doy", "age"]
    )
    return rounded(one, ["verdict"])


# ---- source health --------------------------------------------------------------------------------------------------


@query(
    "source_health",
    "D05",
    f"""WITH w AS (SELECT user_id, ts::DATE AS day, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events), s AS (SELECT count(*) AS n, max(day) AS hi, avg((v IS NULL)::INT) AS nv, min(v) AS lo FROM w)
    SELECT 'events' AS source, 'min_rows' AS "check", {sql_rnd('n', 'measured')}, 1e9::DOUBLE AS allowed FROM s UNION ALL SELECT 'events', 'ends_early', {sql_rnd("DATE '2024-03-01' - hi", 'measured')}, 3.0 FROM s
    UNION ALL SELECT 'events', 'null_share:v', {sql_rnd('nv', 'measured')}, 0.02 FROM s UNION ALL SELECT 'events', 'rule:never negative total', NULL, NULL FROM s WHERE lo < 100""",
)
def health(t: Tables) -> DataFrame:
    rows = t.events.select(
        "user_id", F.to_date("ts").alias("day"), F.when(F.pmod("event_id", F.lit(7)) != 0, F.col("value")).alias("v")
    )
    c = Q.SourceContract(
        "events", 10**9, "day", "2024-01-01", "2024-03-01", "user_id", 10, rules={"never negative total": "min(v) >= 100", "sane": "max(v) < 1e6"}
    )
    return rounded(Q.source_health(rows, c), ["source", "check"])


def _sources(t: Tables) -> dict:
    ev = t.events.select(F.to_date("ts").alias("day"), (F.col("ts") >= "2024-01-25").cast("int").alias("f"))
    return {
        "events": (ev, "day", "f"),
        "purchases": (t.events.filter("event_type = 'purchase' AND ts < '2024-01-20'").select(F.to_date("ts").alias("day")), "day", None),
    }


@query(
    "source_alignment",
    "D06",
    """WITH s AS (SELECT 'events' AS source, max(ts::DATE) AS l, max(ts::DATE) FILTER (ts < DATE '2024-01-25') AS o FROM events UNION ALL
      SELECT 'purchases', max(ts::DATE), max(ts::DATE) FROM events WHERE event_type = 'purchase' AND ts < DATE '2024-01-20'), b AS (SELECT max(l) AS b FROM s)
    SELECT source, l AS last_day, o AS last_observed, (b - l)::INT AS days_behind, (l - o)::INT AS forecast_days, (b - l > 3)::INT AS lagging, (DATE '2024-02-01' - b > 7)::INT AS all_stale FROM s, b""",
)
def alignment(t: Tables) -> DataFrame:
    return Q.source_alignment(_sources(t), "2024-02-01")


@query(
    "panel_horizon",
    "D07",
    "SELECT max(ts::DATE) AS horizon, 'purchases' AS limited_by FROM events WHERE event_type = 'purchase' AND ts < DATE '2024-01-20'",
)
def horizon(t: Tables) -> DataFrame:
    return Q.panel_horizon({n: (df, d) for n, (df, d, _) in _sources(t).items()})


@query(
    "fill_pattern",
    "D07",
    f"""WITH w AS (SELECT ts::DATE AS day, CASE WHEN event_id % 7 <> 0 THEN value END AS a, CASE WHEN ts < DATE '2024-01-28' THEN event_type END AS b FROM events), c AS (SELECT max(day) - 6 AS c FROM w)
    SELECT 'a' AS "column", {sql_rnd('avg((a IS NOT NULL)::INT) FILTER (day < c)', 'train_filled')}, {sql_rnd('avg((a IS NOT NULL)::INT) FILTER (day >= c)', 'test_filled')}, count(DISTINCT a) AS "distinct" FROM w, c
    UNION ALL SELECT 'b', {sql_rnd('avg((b IS NOT NULL)::INT) FILTER (day < c)', 'train_filled')}, {sql_rnd('avg((b IS NOT NULL)::INT) FILTER (day >= c)', 'test_filled')}, count(DISTINCT b) FROM w, c""",
)
def fill(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.to_date("ts").alias("day"), F.when(F.pmod("event_id", F.lit(7)) != 0, F.col("value")).alias("a"),
        F.when(F.col("ts") < "2024-01-28", F.col("event_type")).alias("b"),
    )
    return rounded(Q.fill_pattern(rows, ["a", "b"], "day", 7), ["column", "distinct"])


@query(
    "external_coverage",
    "D08",
    f"""WITH x AS (SELECT max(ts::DATE) AS hi FROM events) SELECT 'events' AS source, max(ts::DATE) AS last_day, 0 AS missing_days, 1 AS covers, {sql_rnd("avg((ts >= DATE '2024-01-25')::INT) FILTER (ts >= DATE '2024-01-20')", 'forecast_share')} FROM events
    UNION ALL SELECT 'purchases', max(ts::DATE), (max(hi) - max(ts::DATE))::INT, 0, NULL FROM events, x WHERE event_type = 'purchase' AND ts < DATE '2024-01-20'""",
)
def ext_coverage(t: Tables) -> DataFrame:
    test = t.events.filter(F.col("ts") >= "2024-01-20").select(F.to_date("ts").alias("day"))
    return rounded(Q.external_coverage(_sources(t), test, "day"), ["source", "last_day", "missing_days", "covers"])


@query(
    "combined_gate",
    "D09",
    f"""WITH w AS (SELECT l_suppkey AS k, l_shipdate::DATE AS day, l_quantity AS q, CASE WHEN l_linenumber < 7 THEN l_tax END AS x FROM lineitem), c AS (SELECT k, day, count(*) AS n FROM w GROUP BY 1, 2),
    s AS (SELECT sum(n) AS r, sum(n - 1) AS d, (max(day) - min(day) + 1) * 100 AS e FROM c)
    SELECT 'expected_rows' AS "check", {sql_rnd('r', 'measured')}, {sql_rnd('e', 'limit')}, (r = e)::INT AS ok FROM s UNION ALL SELECT 'duplicate_keys', {sql_rnd('d', 'measured')}, 0.0, (d = 0)::INT FROM s
    UNION ALL SELECT 'null_share:q', 0.0, 0.1, 1 FROM s UNION ALL SELECT 'null_share:x', {sql_rnd('avg((x IS NULL)::INT)', 'measured')}, 0.1, (avg((x IS NULL)::INT) < 0.1)::INT FROM w
    UNION ALL SELECT 'season:q', {sql_rnd('avg(q) FILTER (month(day) IN (6, 7, 8))', 'measured')}, {sql_rnd('avg(q) FILTER (month(day) IN (12, 1, 2))', 'limit')},
      (avg(q) FILTER (month(day) IN (6, 7, 8)) > avg(q) FILTER (month(day) IN (12, 1, 2)))::INT FROM w""",
)
def gate(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("q"),
        F.when(F.col("l_linenumber") < 7, F.col("l_tax")).alias("x"),
    )
    return rounded(Q.combined_gate(rows, ["k"], "day", 100, season=("q", (6, 7, 8), (12, 1, 2))), ["check", "ok"])


_BROKEN = """p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 1 THEN -1.0 WHEN o_orderkey % 50 = 2 THEN NULL ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 100 <> 3
    UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 200 = 4), s AS (SELECT o_orderkey AS id FROM orders)"""


def _broken(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.when(F.pmod(k, F.lit(50)) == 1, -1.0).when(F.pmod(k, F.lit(50)) != 2, F.col("o_totalprice"))
    a = t.orders.filter(F.pmod(k, F.lit(100)) != 3).select(k.alias("id"), v.alias("v"))
    return a.unionByName(t.orders.filter(F.pmod(k, F.lit(200)) == 4).select(k.alias("id"), F.col("o_totalprice").alias("v")))


@query(
    "validate_predictions",
    "D10 U02",
    f"""WITH {_BROKEN}, c AS (SELECT s.id, count(p.id) AS n FROM s LEFT JOIN p ON p.id = s.id GROUP BY 1), r(k, sev, n) AS (
      SELECT 'missing_columns', 'error', 0 UNION ALL SELECT 'extra_columns', 'error', 0 UNION ALL SELECT 'row_count_gap', 'error', abs((SELECT count(*) FROM p) - (SELECT count(*) FROM s))
      UNION ALL SELECT 'missing_ids', 'error', count(*) FROM c WHERE n = 0 UNION ALL SELECT 'extra_ids', 'error', sum(n - 1) FROM c WHERE n > 1 UNION ALL SELECT 'null_values', 'error', count(*) FROM p WHERE v IS NULL
      UNION ALL SELECT 'infinite_values', 'error', 0 UNION ALL SELECT 'negative_values', 'warning', count(*) FROM p WHERE v < 0 UNION ALL SELECT 'constant', 'warning', 0)
    SELECT k AS "check", sev AS severity, CAST(n AS BIGINT) AS count, (n = 0)::INT AS ok FROM r""",
)
def validate(t: Tables) -> DataFrame:
    sample = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(0.0).alias("v"))
    return Q.validate_predictions(_broken(t), sample, "id", "v")


@query(
    "prediction_gate",
    "D11",
    f"""WITH {B.PREDICTIONS}, l AS (SELECT cold, m3, ln(1 + greatest(m3, 0)) AS a, ln(1 + m2) AS b FROM pred)
    SELECT count(*) AS rows, 0::BIGINT AS out_of_order, 0::BIGINT AS nulls, count(*) FILTER (m3 < 0) AS negatives, 0::BIGINT AS zeros, {sql_rnd('avg(a)', 'log_mean')}, {sql_rnd('avg(a) FILTER (cold = 0)', 'log_mean_warm')},
      {sql_rnd('avg(a) FILTER (cold = 1)', 'log_mean_cold')}, {sql_rnd('avg(a - b)', 'ref_diff_mean')}, {sql_rnd('max(abs(a - b))', 'ref_diff_max')}, count(*) FILTER (abs(a - b) > 1e-9) AS ref_changed,
      0::BIGINT AS duplicates, (count(*) FILTER (m3 < 0) = 0)::INT AS passed FROM l""",
)
def pred_gate(t: Tables) -> DataFrame:
    p = B.predictions(t)
    pos = F.col("id").alias("pos")
    mine = p.select("id", pos, F.col("m3").alias("v"))
    ref = p.select("id", F.col("m2").alias("v"))
    sample = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"))
    out = Q.prediction_gate(mine, sample, "id", "v", "pos", p, "cold", ref)
    keep = ["rows", "out_of_order", "nulls", "negatives", "zeros", "ref_changed", "duplicates", "passed"]
    return rounded(out, keep)


@query(
    "uniqueness_report",
    "D12",
    "WITH c AS (SELECT l_suppkey, l_shipdate::DATE AS d, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT count(*) AS pairs, count(*) FILTER (n > 1) AS repeated_pairs, CAST(sum(n - 1) AS BIGINT) AS surplus_rows FROM c",
)
def unique(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", F.to_date("l_shipdate").alias("d"))
    return Q.uniqueness_report(rows, ["l_suppkey"], "d")


@query(
    "duplicate_samples",
    "D12",
    "SELECT l_suppkey, l_shipdate::DATE AS d, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY copies DESC, 1, 2 LIMIT 2",
)
def duplicates(t: Tables) -> DataFrame:
    return Q.duplicate_samples(t.lineitem.select("l_suppkey", F.to_date("l_shipdate").alias("d")), ["l_suppkey"], "d")


# ---- sources and sinks ----------------------------------------------------------------------------------------------


@query("read_dialect_table", "S01 S02", "SELECT o_orderkey, round(o_totalprice, 2) + 0.0 AS toplam_tutar, o_orderpriority AS oncelik FROM orders")
def dialect(t: Tables) -> DataFrame:
    """Semicolon text with decimal commas and Turkish headers, written and read back."""
    path = shared_folder(t.spark, "dialect") + ".csv"
    text = t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.translate(F.format_number("o_totalprice", 2), ",.", ".,").alias("Toplam Tutar"),
        F.col("o_orderpriority").alias("Öncelik"),
    )
    text.write.option("header", "true").option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    df = R.read_any(t.spark, path, R.TURKISH).withColumn("toplam_tutar", R.dialect_number("toplam_tutar", R.TURKISH))
    return df.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query(
    "read_quoted_table",
    "S01 S02",
    """SELECT o_orderkey, o_orderpriority || ', "' || o_orderstatus || '"' || chr(10) || 'end' AS note FROM orders""",
)
def quoted(t: Tables) -> DataFrame:
    """Delimiters, doubled quotes and line breaks inside quotes, written as text lines and read back."""
    path = shared_folder(t.spark, "quoted") + ".csv"
    note = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(', ""'), F.col("o_orderstatus"), F.lit('""\nend"'))
    t.orders.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), note).alias("value")).write.text(path)
    df = R.read_any(t.spark, path, R.Dialect(header=False, multiline=True), normalize_names=False)
    return df.toDF("o_orderkey", "note").withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query("parquet_cache", "S05", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY 1")
def cache(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "cache")
    R.write_cache(t.lineitem, path, ["l_returnflag"])
    return R.read_cache(t.spark, path, ["l_returnflag", "l_quantity"]).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")
    )


@query("contracted_publish", "S06", "SELECT * FROM part")
def published(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "published")
    P.publish(t.part, path, ["p_partkey", "p_name"], 100, "parts")
    return P.read_published(t.spark, path, ["p_partkey"], 100, "parts")


@query("refused_publish", "S06", "SELECT * FROM part")
def refused(t: Tables) -> DataFrame:
    """A version below its row floor is refused and the published table stays what it was."""
    path = shared_folder(t.spark, "refused")
    P.publish(t.part, path, ["p_partkey"], 100, "parts")
    try:
        P.publish(t.part.filter("p_partkey < 4"), path, ["p_partkey"], 100, "parts")
    except ValueError:
        return P.read_published(t.spark, path, ["p_partkey"], 100, "parts")
    raise AssertionError("a table of three rows was published")


@query(
    "upsert",
    "S07",
    f"""WITH o AS (SELECT user_id, ts::DATE AS day, max(value) AS v FROM events WHERE ts < DATE '2024-01-22' GROUP BY 1, 2), n AS (SELECT user_id, ts::DATE AS day, min(value) AS v FROM events WHERE ts >= DATE '2024-01-18' GROUP BY 1, 2)
    SELECT user_id, day, {sql_rnd('v', 'v')} FROM n UNION ALL SELECT user_id, day, {sql_rnd('v', 'v')} FROM o ANTI JOIN n USING (user_id, day)""",
)
def upserted(t: Tables) -> DataFrame:
    k = ["user_id", F.to_date("ts").alias("day")]
    old = t.events.filter(F.col("ts") < "2024-01-22").groupBy(*k).agg(F.max("value").alias("v"))
    new = t.events.filter(F.col("ts") >= "2024-01-18").groupBy(*k).agg(F.min("value").alias("v"))
    return rounded(P.upsert(old, new, ["user_id", "day"]), ["user_id", "day"])


@query(
    "upsert_partitions",
    "S07",
    f"""WITH o AS (SELECT user_id, ts::DATE AS day, max(value) AS v FROM events WHERE ts < DATE '2024-01-22' GROUP BY 1, 2), n AS (SELECT user_id, ts::DATE AS day, min(value) AS v FROM events WHERE ts >= DATE '2024-01-18' GROUP BY 1, 2)
    SELECT user_id, day, {sql_rnd('v', 'v')} FROM n UNION ALL SELECT user_id, day, {sql_rnd('v', 'v')} FROM o ANTI JOIN n USING (user_id, day)""",
)
def upserted_partitions(t: Tables) -> DataFrame:
    """The same upsert into a table kept by day, in two merges; the second reads the days from 18 to 21 January alone."""
    path = shared_folder(t.spark, "upserted")
    k = ["user_id", F.to_date("ts").alias("day")]
    old = t.events.filter(F.col("ts") < "2024-01-22").groupBy(*k).agg(F.max("value").alias("v"))
    new = t.events.filter(F.col("ts") >= "2024-01-18").groupBy(*k).agg(F.min("value").alias("v"))
    for number, rows in enumerate((old, new)):
        PT.upsert_partitions(rows, path, ["user_id", "day"], "day", f"merge {number}")
    return rounded(PT.read_current(t.spark, path), ["user_id", "day"])


@query(
    "missing_ranges",
    "S08",
    f"""WITH {B.USER_DAY}, g AS (SELECT e.entity, d.day FROM (SELECT DISTINCT entity FROM user_day) e CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day) d
      ANTI JOIN user_day u ON u.entity = e.entity AND u.day = d.day), i AS (SELECT entity, day, day - CAST(row_number() OVER (PARTITION BY entity ORDER BY day) AS INTEGER) AS k FROM g)
    SELECT entity, greatest(min(day) - 2, DATE '2023-12-30') AS from_day, max(day) AS to_day, CAST(count(*) AS INTEGER) AS missing_days FROM i GROUP BY entity, k""",
)
def missing(t: Tables) -> DataFrame:
    rows = B.user_rows(t)
    return P.missing_ranges(rows, rows, ["entity"], "day", "2023-12-30", "2024-02-02", 2)


@query(
    "refresh_range",
    "S08",
    "SELECT max(ts)::DATE - 3 AS from_day, DATE '2024-02-10' AS to_day FROM events",
)
def refresh(t: Tables) -> DataFrame:
    return P.refresh_range(t.events, "ts", "2024-01-05", "2024-02-10", 3)


@query(
    "table_contracts",
    "S09",
    """SELECT 'orders' AS "table", count(*) AS rows, 100::BIGINT AS min_rows, '' AS missing_columns, 1 AS ok FROM orders UNION ALL SELECT 'part', count(*), 1000000000::BIGINT, 'p_weight', 0 FROM part""",
)
def contracts(t: Tables) -> DataFrame:
    wanted = [P.TableContract("orders", ("o_orderkey",), 100), P.TableContract("part", ("p_partkey", "p_weight"), 10**9)]
    return P.verify_contracts({"orders": t.orders, "part": t.part}, wanted)


@query(
    "clean_point_events",
    "S10",
    f"""WITH {B.EVENT_POINT} SELECT day, weight AS power, lat, lon, 'MODIS' AS device FROM point WHERE lat BETWEEN 37 AND 39 AND lon BETWEEN 27 AND 31""",
)
def points(t: Tables) -> DataFrame:
    """Coordinates travel as POINT text and come back."""
    p = B.event_point(t)
    text = F.concat(F.lit("POINT("), F.format_string("%.4f", "lon"), F.lit(" "), F.format_string("%.4f", "lat"), F.lit(")"))
    lat, lon = R.wkt_point("wkt")
    rows = p.withColumn("wkt", text).withColumns({"latitude": lat, "longitude": lon}).select("day", "weight", "latitude", "longitude")
    return R.clean_point_events(rows, "modis", (37, 39, 27, 31), {"day": "day", "weight": "power"})


@query(
    "write_predictions",
    "S12 K05",
    f"""WITH {B.PREDICTIONS} SELECT CAST(id AS VARCHAR) AS id, printf('%.4f', greatest(m3, 0)) AS prediction FROM pred""",
)
def written(t: Tables) -> DataFrame:
    """Written in sample order, read back as text."""
    path = shared_folder(t.spark, "predictions")
    sample = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"))
    P.write_predictions(B.predictions(t).select("id", F.col("m3").alias("prediction")), sample, "id", "prediction", "pos", path, 4)
    return t.spark.read.option("header", "true").csv(path)


# ---- model dataflow (rows-only: MLlib fits) -------------------------------------------------------------------------


def _model_rows(t: Tables) -> DataFrame:
    p = B.predictions(t)
    return p.select(
        "id", "entity", "day", "cold", (F.col("truth") / 1000).alias("y"), (F.col("m3") / 1000).alias("x1"),
        F.dayofyear("day").cast("double").alias("doy"), F.when(F.pmod("id", F.lit(11)) != 0, F.pmod("entity", F.lit(13))).cast("double").alias("x2"),
    )


def _split(t: Tables):
    return ML.time_split(V.purged_time_folds(t.orders, "o_orderdate", timedelta(days=30), 2, timedelta(days=365))[0], "day")


def _plain():
    """Least squares without a penalty, by the normal equations, which SQL can solve as well."""
    return ML.linear().setRegParam(0.0).setSolver("normal")


def _keyed():
    """Three folds by key."""
    part = F.pmod("id", F.lit(3))
    return [(i, part != i, part == i) for i in range(3)]


_MODEL_SQL = f"""{B.PREDICTIONS}, d AS (SELECT id, day, truth / 1000 AS y, m3 / 1000 AS x, CAST(dayofyear(day) AS DOUBLE) AS z FROM pred)"""


def _least_squares(name: str, rows: str) -> str:
    """Coefficients of y ~ x + z, y ~ x and y ~ z per k of `rows` (k, x, z, y)."""
    return f"""{name} AS (SELECT *, ay - b1 * ax - b2 * az AS b0, xy / xx AS x1, ay - xy / xx * ax AS x0, zy / zz AS z1, ay - zy / zz * az AS z0 FROM (
      SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM (
        SELECT k, avg(x) AS ax, avg(z) AS az, avg(y) AS ay, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy
        FROM {rows} GROUP BY k)))"""


_FOLDS_SQL = f"""{_MODEL_SQL}, g AS (SELECT unnest([0, 1, 2]) AS k), tr AS (SELECT k, x, z, y FROM d JOIN g ON id % 3 <> k), {_least_squares('c', 'tr')},
    v AS (SELECT d.*, c.* EXCLUDE (ax, az, ay) FROM d JOIN c ON id % 3 = k)"""


@query(
    "cross_validate_linear",
    "T01",
    f"""WITH {_FOLDS_SQL} SELECT CAST(k AS INTEGER) AS fold, count(*) AS rows, {sql_rnd('sqrt(avg(power(y - (b0 + b1 * x + b2 * z), 2)))', 'rmse', 5)} FROM v GROUP BY 1""",
)
def cv_linear(t: Tables) -> DataFrame:
    """Folds by key and plain least squares: fits, routing of rows and scores against the normal equations."""
    _, scores = ML.cross_validate(_model_rows(t), ["x1", "doy"], "y", _keyed(), _plain)
    return rounded(scores, ["fold", "rows"], 5)


@query(
    "hurdle_magnitude",
    "T03",
    f"""WITH {_MODEL_SQL}, p AS (SELECT id, x, z, greatest(y - 200, 0) AS y FROM d), g AS (SELECT unnest([0, 1, 2]) AS k),
    tr AS (SELECT k, x, z, y FROM p JOIN g ON id % 3 <> k WHERE y > 0), {_least_squares('c', 'tr')}
    SELECT id, CAST(k AS INTEGER) AS fold, {sql_rnd('b0 + b1 * x + b2 * z', 'magnitude', 5)} FROM p JOIN c ON id % 3 = k""",
)
def magnitude(t: Tables) -> DataFrame:
    """The second stage of the hurdle: learnt from positive rows only, predicted for every row out of fold."""
    rows = _model_rows(t).withColumn("y", F.greatest(F.col("y") - 200, F.lit(0.0)))
    out = ML.fit_hurdle(rows, ["x1", "doy"], "y", _keyed(), regressor=_plain)
    return out.select("id", "fold", rnd("magnitude", digits=5))


@query(
    "multi_seed_refit_linear",
    "T04",
    f"""WITH {_MODEL_SQL}, l AS (SELECT id, day, x, z, ln(1 + greatest(y, 0)) AS y, ln(1 + greatest(y, 0)) AS w FROM d),
    tr AS (SELECT 0 AS k, x, z, y FROM l WHERE day < DATE '{B.CUT}'), {_least_squares('c', 'tr')},
    o AS (SELECT sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz, sum(x * y) AS xy, sum(z * y) AS zy FROM tr),
    q AS (SELECT id, b0 + b1 * x + b2 * z AS p1, (xy * ozz - zy * xz) / (oxx * ozz - xz * xz) * x + (zy * oxx - xy * xz) / (oxx * ozz - xz * xz) * z AS p2
      FROM l, (SELECT b0, b1, b2 FROM c), (SELECT xx AS oxx, zz AS ozz, xz, xy, zy FROM o) WHERE day >= DATE '{B.CUT}')
    SELECT id, {sql_rnd('greatest(exp((p1 + p2) / 2) - 1, 0)', 'prediction', 5)}, {sql_rnd('abs(p1 - p2) / sqrt(2)', 'seed_std', 5)} FROM q""",
)
def refits(t: Tables) -> DataFrame:
    """Two different fits stand in for two seeds (with and without an intercept): their mean in log space and its spread."""
    rows = _model_rows(t)
    train, test = rows.filter(F.col("day") < B.CUT), rows.filter(F.col("day") >= B.CUT)
    out, _ = ML.multi_seed_refit(train, test, ["x1", "doy"], "y", (1, 2), lambda s: _plain().setFitIntercept(s == 1))
    return out.select("id", rnd("prediction", digits=5), rnd("seed_std", digits=5))


@query("shuffled_labels", "T05", f"WITH {_MODEL_SQL} SELECT {sql_rnd('y', 'shuffled')}, count(*) AS times FROM d GROUP BY 1")
def shuffled(t: Tables) -> DataFrame:
    """The null importances' labels are the labels in another order: none is lost, none comes twice."""
    done = ML.shuffle_label(_model_rows(t), "id", "y", 3, "_shuffled")
    return done.groupBy(rnd("_shuffled", "shuffled")).agg(F.count(F.lit(1)).alias("times"))


@query(
    "shift_verdict",
    "D04",
    f"""WITH {B.PREDICTIONS}, w AS (SELECT (day >= DATE '{B.CUT}')::INT AS y, (dayofyear(day) + 60 * (id % 7)) / 1000 AS s FROM pred),
    r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM w),
    a AS (SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1.0) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y))) AS auc,
      power(sum(s) FILTER (y = 0), 2) / sum(s * s) FILTER (y = 0) AS ess, count(*) FILTER (y = 0) AS n FROM r)
    SELECT {sql_rnd('auc', 'auc')}, {sql_rnd('ess', 'ess')}, {sql_rnd('ess / n', 'ess_ratio')},
      CASE WHEN auc < 0.6 THEN 'similar' WHEN auc < 0.8 THEN 'moderate shift' WHEN ess / n < 0.05 THEN 'severe shift, do not weight' ELSE 'severe shift, weights usable' END AS verdict FROM a""",
)
def verdict(t: Tables) -> DataFrame:
    """What adversarial validation makes of out-of-fold probabilities, here given ones."""
    s = (F.dayofyear("day") + 60 * F.pmod("id", F.lit(7))) / 1000
    rows = B.predictions(t).select((F.col("day") >= F.lit(B.CUT).cast("date")).cast("int").alias("y"), s.alias("s"))
    return rounded(ML.shift_verdict(rows, "y", "s"), ["verdict"])


@query(
    "ablation_verdict_linear",
    "T06 T01",
    f"""WITH {_FOLDS_SQL}, s AS (SELECT k, sqrt(avg(power(y - (b0 + b1 * x + b2 * z), 2))) AS f, sqrt(avg(power(y - (z0 + z1 * z), 2))) AS level, sqrt(avg(power(y - (x0 + x1 * x), 2))) AS calendar FROM v GROUP BY 1),
    l AS (SELECT unnest(['level', 'calendar']) AS dropped, unnest([level - f, calendar - f]) AS d FROM s),
    m AS (SELECT dropped, count(*) AS pairs, avg(d) AS m, stddev_samp(d) / sqrt(count(*)) AS se FROM l GROUP BY 1)
    SELECT dropped, pairs, {sql_rnd('m', 'mean_delta', 4)}, {sql_rnd('se', 'se', 4)},
      CASE WHEN m > greatest(2 * se, 0.01) THEN 'useful' WHEN m < -greatest(2 * se, 0.01) THEN 'harmful' ELSE 'undecided' END AS verdict FROM m""",
)
def ablation_linear(t: Tables) -> DataFrame:
    """Paired deltas of three least-squares models over folds by key."""
    scores = ML.ablation_scores(_model_rows(t), {"level": ["x1"], "calendar": ["doy"]}, "y", _keyed(), model=lambda s: _plain())
    return rounded(ML.ablation_verdict(scores, 0.01), ["dropped", "pairs", "verdict"], 4)


@query("cross_validate", "T01")
def cv(t: Tables) -> DataFrame:
    rows, features = ML.with_missing_flags(_model_rows(t), ["x1", "x2", "doy"])
    _, scores = ML.cross_validate(rows, features, "y", _split(t))
    return rounded(scores, ["fold", "rows"])


@query(
    "regime_experts",
    "T02",
    f"WITH {B.PREDICTIONS} SELECT cold, CASE WHEN cold = 1 THEN 'cold' ELSE 'warm' END AS expert, count(*) AS rows FROM pred WHERE day >= DATE '{B.CUT}' GROUP BY 1, 2",
)
def experts(t: Tables) -> DataFrame:
    """Every test row is predicted once, by the expert of its own regime."""
    rows = _model_rows(t)
    train, test = rows.filter(F.col("day") < B.CUT), rows.filter(F.col("day") >= B.CUT)
    out = ML.regime_experts(train, test, "y", "cold", ["x1", "doy"], ["x1"])
    return out.groupBy("cold", "expert").agg(F.count(F.lit(1)).alias("rows"))


@query("fit_hurdle", "T03")
def hurdle(t: Tables) -> DataFrame:
    rows = _model_rows(t).withColumn("y", F.greatest(F.col("y") - 200, F.lit(0.0)))
    out = ML.fit_hurdle(rows, ["x1", "doy"], "y", _split(t))
    return out.select("id", "fold", rnd("probability", digits=4), rnd("magnitude", digits=4))


@query("multi_seed_refit", "T04 B08")
def seeds(t: Tables) -> DataFrame:
    rows = _model_rows(t)
    train, test = rows.filter(F.col("day") < B.CUT), rows.filter(F.col("day") >= B.CUT)
    out, _ = ML.multi_seed_refit(train, test, ["x1", "doy"], "y", (1, 2))
    return out.select("id", rnd("prediction", digits=4), rnd("seed_std", digits=4))


@query("null_importance_filter", "T05")
def nulls(t: Tables) -> DataFrame:
    return rounded(
        ML.null_importance_filter(_model_rows(t), "id", ["x1", "x2", "doy"], "y"),
        ["feature", "kept"], 4,
    )


@query("ablation_verdict", "T06 T01")
def ablation(t: Tables) -> DataFrame:
    scores = ML.ablation_scores(_model_rows(t), {"level": ["x1"], "calendar": ["doy"]}, "y", _split(t))
    return rounded(ML.ablation_verdict(scores, 0.01), ["dropped", "pairs", "verdict"], 4)


# ---- streaming ------------------------------------------------------------------------------------------------------


def _run_to_table(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    path, ckpt = shared_folder(t.spark, name), shared_folder(t.spark, f"{name}-ckpt")
    q = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", ckpt)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


def _event_stream(t: Tables) -> DataFrame:
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


@query(
    "stream_daily_rollup",
    "X01 A04",
    f"""SELECT ts::DATE AS day, event_type, {sql_rnd('avg(value)', 'value_mean')}, {sql_rnd('sum(value)', 'value_sum')}, {sql_rnd('max(value)', 'value_max')}, count(*) AS rows
    FROM events WHERE ts::DATE + 1 <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""",
)
def stream_rollup(t: Tables) -> DataFrame:
    """The last day stays open behind the watermark."""
    out = _run_to_table(t, ST.stream_daily_rollup(_event_stream(t), "ts", ["event_type"], "value"), "rollup")
    return rounded(out, ["day", "event_type", "rows"])


@query(
    "stream_event_state",
    "X02 W05 W06",
    f"""WITH {B.DENSE_USER}, e AS (SELECT entity, day, amount, max(CASE WHEN amount > 0 THEN day END) OVER (PARTITION BY entity ORDER BY day) AS l, sum((amount <= 0)::INT) OVER (PARTITION BY entity ORDER BY day) AS k FROM dense)
    SELECT entity, day, CAST(day - l AS INTEGER) AS days_since_event, CAST(sum((amount > 0)::INT) OVER (PARTITION BY entity, k ORDER BY day) AS INTEGER) AS event_run FROM e""",
)
def stream_state(t: Tables) -> DataFrame:
    """Three micro-batches by date, and a fourth that comes too late and changes nothing."""
    path = shared_folder(t.spark, "dense")
    dense = B.dense_user_day(t).select("entity", "day", "amount")
    part = F.pmod(F.unix_date("day"), F.lit(10))
    edges = dense.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    cuts = [edges.a + (edges.b - edges.a) * k / 3 for k in range(1, 3)]
    for k, inside in enumerate((F.col("day") <= cuts[0], F.col("day").between(cuts[0] + timedelta(days=1), cuts[1]), F.col("day") > cuts[1], part == 0)):
        dense.filter(inside).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01 if k else 0)  # files are taken in the order of their times
    stream = t.spark.readStream.schema(dense.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _run_to_table(t, ST.stream_event_state(stream, "entity", "day", "amount"), "state").filter("late = 0").drop("late")


@query(
    "stream_revisions",
    "X03 J16 S07",
    f"""WITH a AS (SELECT user_id, ts::DATE AS day, max(value) AS v, (ts::DATE >= DATE '2024-01-20')::INT AS is_forecast, 1 AS version FROM events GROUP BY 1, 2),
    b AS (SELECT user_id, ts::DATE AS day, min(value) AS v, (ts::DATE >= DATE '2024-01-25')::INT AS is_forecast, 2 AS version FROM events WHERE ts >= DATE '2024-01-15' GROUP BY 1, 2),
    u AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY is_forecast, version DESC) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
    SELECT user_id, day, {sql_rnd('v', 'v')}, is_forecast, version FROM u WHERE r = 1""",
)
def stream_revise(t: Tables) -> DataFrame:
    """Two files arrive as two micro-batches; archive beats forecast, newer beats older."""
    path, out, ckpt = (shared_folder(t.spark, n) for n in ("feed", "revised", "revised-ckpt"))
    keys = ["user_id", F.to_date("ts").alias("day")]
    a = t.events.groupBy(*keys).agg(F.max("value").alias("v")).select(
        "*", (F.col("day") >= "2024-01-20").cast("int").alias("is_forecast"), F.lit(1).alias("version")
    )
    b = t.events.filter(F.col("ts") >= "2024-01-15").groupBy(*keys).agg(F.min("value").alias("v")).select(
        "*", (F.col("day") >= "2024-01-25").cast("int").alias("is_forecast"), F.lit(2).alias("version")
    )
    a.coalesce(1).write.parquet(path)
    b.coalesce(1).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(path)
    ST.start_revisions(stream, out, ckpt, ["user_id", "day"], "day").awaitTermination()
    return rounded(ST.read_revised(t.spark, out), ["user_id", "day", "is_forecast", "version"])
