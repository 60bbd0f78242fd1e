"""Encodings, splits, transforms, scores and reports over prediction tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.scale import average_rank
from panelforge.functions import transforms as TR
from panelforge.operators import encode as E
from panelforge.operators import metrics as M
from panelforge.operators import splits as V
from panelforge.plans import bases as B
from panelforge.plans.registry import Tables, query, rnd, rounded, sql_rnd

_TT = f"tr AS (SELECT * FROM orders WHERE o_orderdate < DATE '{B.CUT}'), te AS (SELECT * FROM orders WHERE o_orderdate >= DATE '{B.CUT}')"


def _tt(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.orders.filter(F.col("o_orderdate") < B.CUT), t.orders.filter(F.col("o_orderdate") >= B.CUT)


# ---- encodings ------------------------------------------------------------------------------------------------------


@query(
    "frequency_encode",
    "E01",
    f"""WITH d AS (SELECT doc_id, nullif(lang, 'es') AS lang, source FROM documents), tr AS (SELECT * FROM d WHERE source <> 'src3' AND coalesce(lang, '') <> 'fr'),
    f AS (SELECT lang, count(*) / (SELECT count(*) FROM tr) AS s FROM tr WHERE lang IS NOT NULL GROUP BY 1)
    SELECT doc_id, {sql_rnd('CASE WHEN d.lang IS NOT NULL THEN coalesce(s, 0) END', 'lang_frequency')} FROM d LEFT JOIN f ON f.lang = d.lang""",
)
def freq(t: Tables) -> DataFrame:
    """Spanish is NULL here and French is unseen in train: NULL stays NULL, unseen is 0."""
    d = t.documents.select("doc_id", F.nullif(F.col("lang"), F.lit("es")).alias("lang"), "source")
    train = d.filter((F.col("source") != "src3") & (F.coalesce("lang", F.lit("")) != "fr"))
    return E.frequency_encode(train, d, "lang").select("doc_id", rnd("lang_frequency"))


@query(
    "count_encode",
    "E02",
    """WITH d AS (SELECT doc_id, nullif(lang, 'es') AS lang FROM documents), n AS (SELECT lang, count(*) AS n FROM d GROUP BY 1)
    SELECT doc_id, n AS lang_count FROM d JOIN n ON n.lang IS NOT DISTINCT FROM d.lang""",
)
def counted(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.nullif(F.col("lang"), F.lit("es")).alias("lang"))
    return E.count_encode(d, d, "lang").select("doc_id", "lang_count")


@query(
    "oof_target_encode",
    "E03",
    f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 5 AS fold, o_totalprice AS y FROM orders),
    p AS (SELECT f.fold, avg(y) AS prior FROM (SELECT DISTINCT fold FROM o) f JOIN o ON o.fold <> f.fold GROUP BY 1),
    c AS (SELECT o_custkey, fold, sum(y) AS s, count(*) AS n FROM o GROUP BY 1, 2), k AS (SELECT o_custkey, sum(s) AS s, sum(n) AS n FROM c GROUP BY 1)
    SELECT o_orderkey, {sql_rnd('(k.s - c.s + 20 * prior) / (k.n - c.n + 20)', 'encoded', 3)} FROM o JOIN c USING (o_custkey, fold) JOIN k USING (o_custkey) JOIN p USING (fold)""",
)
def oof(t: Tables) -> DataFrame:
    o = t.orders.withColumn("fold", F.pmod("o_orderkey", F.lit(5)))
    return E.oof_target_encode(o, "o_custkey", "o_totalprice", "fold", "encoded").select(
        "o_orderkey", rnd("encoded", digits=3)
    )


@query(
    "oof_target_encode_nulls",
    "E03",
    f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 > 0 THEN o_custkey END AS c, o_orderkey % 5 AS fold, o_totalprice AS y FROM orders),
    p AS (SELECT f.fold, avg(y) AS prior FROM (SELECT DISTINCT fold FROM o) f JOIN o ON o.fold <> f.fold GROUP BY 1),
    g AS (SELECT c, fold, sum(y) AS s, count(*) AS n FROM o GROUP BY 1, 2), k AS (SELECT c, sum(s) AS s, sum(n) AS n FROM g GROUP BY 1)
    SELECT o_orderkey, {sql_rnd('CASE WHEN c IS NULL THEN prior ELSE (k.s - g.s + 20 * prior) / (k.n - g.n + 20) END', 'encoded', 3)} FROM o LEFT JOIN g USING (c, fold) LEFT JOIN k USING (c) JOIN p USING (fold)""",
)
def oof_nulls(t: Tables) -> DataFrame:
    """Customers without a known category get the prior."""
    o = t.orders.withColumns({"fold": F.pmod("o_orderkey", F.lit(5)), "c": F.when(F.pmod("o_custkey", F.lit(7)) > 0, F.col("o_custkey"))})
    return E.oof_target_encode(o, "c", "o_totalprice", "fold", "encoded").select("o_orderkey", rnd("encoded", digits=3))


@query(
    "target_encode_test_nulls",
    "E03",
    f"""WITH {_TT}, k AS (SELECT CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS c, o_totalprice AS y FROM tr), c AS (SELECT c, sum(y) AS s, count(*) AS n FROM k WHERE c IS NOT NULL GROUP BY 1)
    SELECT o_orderkey, {sql_rnd('(coalesce(s, 0) + 20 * (SELECT avg(y) FROM k)) / (coalesce(n, 0) + 20)', 'encoded', 3)}
    FROM te LEFT JOIN c ON c.c = CASE WHEN o_custkey % 3 > 0 THEN o_custkey END""",
)
def te_nulls(t: Tables) -> DataFrame:
    train, test = (x.withColumn("c", F.when(F.pmod("o_custkey", F.lit(3)) > 0, F.col("o_custkey"))) for x in _tt(t))
    return E.target_encode_test(train, test, "c", "o_totalprice", "encoded").select("o_orderkey", rnd("encoded", digits=3))


@query(
    "target_encode_test",
    "E03",
    f"""WITH {_TT}, c AS (SELECT o_custkey, sum(o_totalprice) AS s, count(*) AS n FROM tr GROUP BY 1)
    SELECT o_orderkey, {sql_rnd('(coalesce(s, 0) + 20 * (SELECT avg(o_totalprice) FROM tr)) / (coalesce(n, 0) + 20)', 'encoded', 3)} FROM te LEFT JOIN c USING (o_custkey)""",
)
def te_test(t: Tables) -> DataFrame:
    train, test = _tt(t)
    return E.target_encode_test(train, test, "o_custkey", "o_totalprice", "encoded").select(
        "o_orderkey", rnd("encoded", digits=3)
    )


_FOLDS_SQL = """m AS (SELECT max(o_orderdate) AS hi FROM orders),
  w AS (SELECT k, hi - (5 - k) * INTERVAL 365 DAY AS up, hi - (6 - k) * INTERVAL 365 DAY AS lo FROM m, (VALUES (1), (2), (3), (4), (5)) v(k)),
  fold AS (SELECT k AS fold, min(o_orderdate) AS valid_start, max(o_orderdate) AS valid_end FROM w JOIN orders ON o_orderdate > lo AND o_orderdate <= up GROUP BY 1)"""


def _folds(t: Tables) -> list[V.Fold]:
    return V.purged_time_folds(t.orders, "o_orderdate", timedelta(days=30), 5, timedelta(days=365))[0]


@query(
    "oof_target_encode_purged",
    "E03 V01",
    f"""WITH {_FOLDS_SQL}, fit AS (SELECT fold, o_orderpriority AS c, o_totalprice AS y FROM fold JOIN orders ON o_orderdate <= valid_start - INTERVAL 31 DAY),
    p AS (SELECT fold, avg(y) AS prior FROM fit GROUP BY 1), g AS (SELECT fold, c, sum(y) AS s, count(*) AS n FROM fit GROUP BY 1, 2)
    SELECT o_orderkey, {sql_rnd('(coalesce(s, 0) + 20 * prior) / (coalesce(n, 0) + 20)', 'encoded', 3)}
    FROM orders LEFT JOIN fold f ON o_orderdate BETWEEN valid_start AND valid_end LEFT JOIN p ON p.fold = f.fold LEFT JOIN g ON g.fold = f.fold AND g.c = o_orderpriority""",
)
def oof_purged(t: Tables) -> DataFrame:
    bounds = V.fold_table(t.orders, _folds(t)).withColumn(
        "train_end", F.col("train_before") - F.expr("INTERVAL 1 DAY")
    )
    out = E.oof_target_encode_purged(
        t.orders, bounds, "o_orderdate", "o_orderpriority", "o_totalprice", "encoded", uncovered="null"
    )
    return out.select("o_orderkey", rnd("encoded", digits=3))


@query(
    "category_codes",
    "E04",
    """WITH tr AS (SELECT * FROM part WHERE p_size < 40 AND p_brand <> 'Brand#3'), b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM tr))
    SELECT p_partkey, CAST(code AS INTEGER) AS p_brand_code FROM part LEFT JOIN b USING (p_brand)""",
)
def codes(t: Tables) -> DataFrame:
    train = t.part.filter((F.col("p_size") < 40) & (F.col("p_brand") != "Brand#3"))
    return E.encode_categories(train, t.part, "p_brand").select("p_partkey", F.col("p_brand_code").cast("int"))


@query(
    "cold_sample_weights",
    "E05",
    f"""WITH {B.PREDICTIONS}, n AS (SELECT count(*) FILTER (cold = 1) AS c, count(*) FILTER (cold = 0) AS w FROM pred)
    SELECT id, {sql_rnd('CASE WHEN cold = 1 AND c > 0 AND w > 0 THEN 0.2216 / (1 - 0.2216) * w / c ELSE 1 END', 'weight')} FROM pred, n""",
)
def cold_weights(t: Tables) -> DataFrame:
    return E.cold_sample_weights(B.predictions(t), "cold").select("id", rnd("weight"))


# ---- splits ---------------------------------------------------------------------------------------------------------


@query(
    "purged_time_split",
    "V01 V03",
    f"""WITH {_FOLDS_SQL} SELECT fold::INT AS fold, valid_start, valid_end, (SELECT count(*) FROM orders WHERE o_orderdate < valid_start - INTERVAL 30 DAY) AS train_rows,
      (SELECT count(*) FROM orders WHERE o_orderdate BETWEEN valid_start AND valid_end) AS valid_rows, 0::BIGINT AS shared_keys FROM fold""",
)
def purged(t: Tables) -> DataFrame:
    folds = _folds(t)
    roles = V.fold_roles(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", folds)
    report = V.assert_folds(roles, "o_orderkey").drop("fingerprint")
    return report.join(F.broadcast(V.fold_table(t.orders, folds)), "fold").drop("train_before")


@query(
    "equal_count_time_split",
    "V01",
    """WITH o AS (SELECT o_orderdate AS t, row_number() OVER (ORDER BY o_orderdate) - 1 AS p, count(*) OVER () AS n FROM orders),
    b AS (SELECT k, (SELECT max(t) FROM o WHERE p = n * k // 5) AS s FROM (VALUES (1), (2), (3), (4)) v(k)),
    w AS (SELECT k, s, lead(s) OVER (ORDER BY k) AS e FROM b)
    SELECT k::INT AS fold, s AS valid_start, (SELECT max(t) FROM o WHERE t >= s AND (e IS NULL OR t < e)) AS valid_end,
      (SELECT count(*) FROM o WHERE t < s - INTERVAL 10 DAY) AS train_rows, (SELECT count(*) FROM o WHERE t >= s AND (e IS NULL OR t < e)) AS valid_rows FROM w""",
)
def equal_count(t: Tables) -> DataFrame:
    folds, _ = V.purged_time_folds(t.orders, "o_orderdate", timedelta(days=10), 4)
    roles = V.fold_roles(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", folds)
    counts = roles.groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("train_rows"), F.count_if(F.col("role") == "valid").alias("valid_rows")
    )
    return counts.join(F.broadcast(V.fold_table(t.orders, folds)), "fold").drop("train_before")


@query(
    "forecast_geometry",
    "V02",
    f"""WITH {_TT}, g AS (SELECT (SELECT max(o_orderdate)::DATE FROM tr) AS train_end, min(o_orderdate)::DATE AS test_start, max(o_orderdate)::DATE AS test_end FROM te WHERE o_orderdate >= DATE '{B.CUT}' + 10)
    SELECT (test_end - train_end)::INT AS horizon_days, (test_start - train_end - 1)::INT AS gap_days, 0 AS interleaved, train_end, test_start, test_end FROM g""",
)
def geometry(t: Tables) -> DataFrame:
    train, test = _tt(t)
    later = test.filter(F.col("o_orderdate") >= F.date_add(F.lit(B.CUT).cast("date"), 10))
    return V.forecast_geometry(train, later, "o_orderdate")


@query("group_folds", "V04", "SELECT o_custkey, 1::BIGINT AS folds, count(*) AS rows FROM orders GROUP BY 1")
def group_folds(t: Tables) -> DataFrame:
    """Every customer must stay in one of five folds."""
    f = V.hash_folds(t.orders, ["o_custkey"], 5)
    return f.groupBy("o_custkey").agg(F.count_distinct("fold").alias("folds"), F.count(F.lit(1)).alias("rows"))


@query(
    "stratified_folds",
    "V04",
    """WITH n AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)
    SELECT p AS o_orderpriority, k::INT AS fold, n // 5 + (k < n % 5)::BIGINT AS rows FROM n CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(k)""",
)
def stratified(t: Tables) -> DataFrame:
    """Fold sizes differ by at most one inside every class."""
    f = V.stratified_folds(t.orders, ["o_orderkey"], "o_orderpriority", 5)
    return f.groupBy("o_orderpriority", "fold").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "suggest_scheme",
    "V05",
    """SELECT 'orders' AS "table", 'TimeSeriesSplit' AS scheme, 'o_orderdate' AS time_column FROM orders LIMIT 1""",
)
def scheme(t: Tables) -> DataFrame:
    s = V.suggest_scheme(t.orders, "o_totalprice")
    return t.spark.createDataFrame(
        [("orders", s.scheme, s.time_column)], '`table` string, scheme string, time_column string'
    )


# ---- transforms -----------------------------------------------------------------------------------------------------


@query(
    "target_transforms",
    "F17 F18",
    f"""SELECT o_orderkey, {sql_rnd('ln(1 + o_totalprice)', 'log_y')}, {sql_rnd('o_totalprice', 'back_log', 4)}, {sql_rnd('sqrt(o_totalprice)', 'sqrt_y')},
      {sql_rnd('o_totalprice', 'back_sqrt', 4)}, {sql_rnd('ln(1 + o_totalprice) - ln(1 + o_custkey)', 'offset_y')}, {sql_rnd('ln(1 + o_totalprice)', 'offset_back')} FROM orders""",
)
def transforms(t: Tables) -> DataFrame:
    y = F.col("o_totalprice")
    off = TR.offset_target(y, "o_custkey")
    return t.orders.select(
        "o_orderkey",
        rnd(TR.log_target(y), "log_y"),
        rnd(TR.inverse_log_target(TR.log_target(y)), "back_log", 4),
        rnd(TR.sqrt_target(y), "sqrt_y"),
        rnd(TR.inverse_sqrt_target(TR.sqrt_target(y)), "back_sqrt", 4),
        rnd(off, "offset_y"),
        rnd(TR.add_offset_back(off, "o_custkey"), "offset_back"),
    )


@query(
    "postprocess_predictions",
    "F19",
    """SELECT c_custkey, CAST(round_even(least(greatest(c_acctbal, 0.0), 9000.0), 0) AS DOUBLE) + 0.0 AS p FROM customer""",
)
def post(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", (TR.postprocess("c_acctbal", 0.0, 9000.0, True) + 0.0).alias("p"))


@query(
    "postprocess_report",
    "F19",
    "SELECT count(*) AS rows, count(*) FILTER (c_acctbal < 0) AS raised, count(*) FILTER (c_acctbal > 9000) AS lowered FROM customer",
)
def post_report(t: Tables) -> DataFrame:
    return TR.postprocess_report(t.customer, "c_acctbal", 0.0, 9000.0)


@query(
    "soften_outliers",
    "F20",
    f"""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sql_rnd('0.38 * l_extendedprice + 0.62 * least(l_extendedprice, b + 0.1 * (b - a))', 'soft', 7)} FROM lineitem JOIN q USING (l_returnflag)""",
)
def soften(t: Tables) -> DataFrame:
    """Three groups hold all rows, the exact quartiles come from distributed positions."""
    out = TR.soften_outliers(t.lineitem, "l_extendedprice", ["l_returnflag"], "soft", iqr_factor=0.1)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rnd("soft", digits=7))


@query(
    "percentile_rank",
    "W17",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      {sql_rnd('(rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0) / count(*) OVER ()', 'pct')} FROM lineitem""",
)
def pct_rank(t: Tables) -> DataFrame:
    """Fifty distinct quantities share all rows: ties are collapsed before anything is ordered."""
    out = average_rank(t.lineitem, "l_quantity", "pct", pct=True)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", rnd("pct"))


# ---- scores ---------------------------------------------------------------------------------------------------------


@query(
    "regression_metrics",
    "M01 M02",
    f"""WITH {B.PREDICTIONS} SELECT segment, {sql_rnd('sqrt(avg(power(truth - m3, 2)))', 'rmse')}, {sql_rnd('avg(abs(truth - m3))', 'mae')},
      {sql_rnd('sqrt(avg(power(ln(1 + greatest(m3, 0)) - ln(1 + truth), 2)))', 'rmsle')}, {sql_rnd('1 - sum(power(truth - m3, 2)) / (var_pop(truth) * count(*))', 'r2')},
      {sql_rnd('avg(abs((truth - m3) / truth)) * 100', 'mape')}, {sql_rnd('avg((abs(truth) >= 1e-9)::INT)', 'mape_coverage')},
      {sql_rnd('avg(abs(truth - m3) / ((abs(truth) + abs(m3)) / 2)) * 100', 'smape')}, {sql_rnd('avg(abs(truth))', 'zero_mae')} FROM pred GROUP BY 1""",
)
def regression(t: Tables) -> DataFrame:
    names = ("rmse", "mae", "rmsle", "r2", "mape", "mape_coverage", "smape")
    return B.predictions(t).groupBy("segment").agg(
        *[rnd(M.metric(n, "truth", "m3"), n) for n in names], rnd(M.zero_baseline("mae", "truth"), "zero_mae")
    )


_PROBA = """cls AS (SELECT doc_id, quality AS y, 1 / (1 + exp(-(ln(1 + n_chars) - 7 + quality))) AS p FROM labels JOIN documents USING (doc_id))"""


def _proba(t: Tables) -> DataFrame:
    z = F.log1p("n_chars") - 7 + F.col("quality")
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), (1 / (1 + F.exp(-z))).alias("p")
    )


@query(
    "classification_metrics",
    "M03",
    f"""WITH {_PROBA} SELECT {sql_rnd('-avg(y * ln(p) + (1 - y) * ln(1 - p))', 'logloss')}, {sql_rnd('avg(((p >= 0.5)::INT = y)::INT)', 'accuracy')},
      {sql_rnd('2.0 * count(*) FILTER (p >= 0.5 AND y = 1) / (2.0 * count(*) FILTER (p >= 0.5 AND y = 1) + count(*) FILTER (p >= 0.5 AND y = 0) + count(*) FILTER (p < 0.5 AND y = 1))', 'f1')} FROM cls""",
)
def classification(t: Tables) -> DataFrame:
    return _proba(t).agg(*[rnd(c, n) for n, c in M.class_metrics("y", "p").items()])


@query(
    "auc",
    "M03",
    f"""WITH x AS (SELECT (l_returnflag = 'R')::INT AS y, l_quantity AS s FROM lineitem), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM x)
    SELECT {sql_rnd('(sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1.0) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y)))', 'auc')}, CAST(sum(y) AS BIGINT) AS positives, CAST(count(*) - sum(y) AS BIGINT) AS negatives FROM r""",
)
def roc(t: Tables) -> DataFrame:
    x = t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("s"))
    return rounded(M.auc(x, "y", "s"), ["positives", "negatives"])


@query(
    "regime_score",
    "M04",
    f"""WITH {B.PREDICTIONS}, e AS (SELECT cold, power(ln(1 + greatest(m3, 0)) - ln(1 + truth), 2) AS e FROM pred), s AS (SELECT sqrt(avg(e)) AS o, sqrt(avg(e) FILTER (cold = 0)) AS w, sqrt(avg(e) FILTER (cold = 1)) AS c FROM e)
    SELECT {sql_rnd('o', 'overall')}, {sql_rnd('w', 'warm')}, {sql_rnd('c', 'cold')}, {sql_rnd('sqrt((1 - 0.2216) * w * w + 0.2216 * c * c)', 'reweighted')} FROM s""",
)
def regime(t: Tables) -> DataFrame:
    return rounded(M.regime_score(B.predictions(t), "truth", "m3", "cold"), [])


@query(
    "weighted_rmsle",
    "M04",
    f"""WITH {B.PREDICTIONS} SELECT fold::INT AS fold, {sql_rnd('sqrt(sum((1 + cold) * power(ln(1 + truth) - ln(1 + greatest(m3, 0)), 2)) / sum(1 + cold))', 'score')} FROM pred GROUP BY 1""",
)
def weighted(t: Tables) -> DataFrame:
    p = B.predictions(t).withColumn("w", F.col("cold") + 1)
    return p.groupBy("fold").agg(rnd(M.weighted_rmsle("truth", "m3", "w"), "score"))


_THRESH = f"""{_PROBA}, g AS (SELECT 0.01 + (0.99 - 0.01) * i / 199 AS threshold FROM range(200) r(i) UNION SELECT 0.5),
  s AS (SELECT threshold, 2.0 * count(*) FILTER (p >= threshold AND y = 1) AS tp2, count(*) FILTER (p >= threshold AND y = 0) + count(*) FILTER (p < threshold AND y = 1) AS bad,
    avg(((p >= threshold)::INT = y)::INT) AS acc FROM g CROSS JOIN cls GROUP BY 1)"""


@query(
    "threshold_table",
    "M05",
    f"WITH {_THRESH} SELECT {sql_rnd('threshold', 'threshold')}, {sql_rnd('coalesce(tp2 / nullif(tp2 + bad, 0), 0)', 'f1')}, {sql_rnd('acc', 'accuracy')} FROM s",
)
def thresholds(t: Tables) -> DataFrame:
    return rounded(M.threshold_table(_proba(t), "y", "p"), [])


@query(
    "best_threshold",
    "M05",
    f"""WITH {_THRESH}, f AS (SELECT threshold, coalesce(tp2 / nullif(tp2 + bad, 0), 0) AS f1 FROM s), m AS (SELECT max(f1) AS m FROM f),
    b AS (SELECT threshold, f1 FROM f, m WHERE m - f1 <= 1e-8 + 1e-5 * m ORDER BY abs(threshold - 0.5), threshold LIMIT 1)
    SELECT {sql_rnd('threshold', 'best_threshold')}, {sql_rnd('f1', 'best_score')}, {sql_rnd('(SELECT f1 FROM f WHERE threshold = 0.5)', 'score_at_half')} FROM b""",
)
def threshold(t: Tables) -> DataFrame:
    return rounded(M.best_threshold(_proba(t), "y", "p"), [])


@query(
    "multiplier_scan",
    "M06",
    f"""WITH {B.PREDICTIONS}, s AS (SELECT round(0.9 + 0.01 * i, 6) AS m, avg(abs(truth - m1 * round(0.9 + 0.01 * i, 6))) AS s FROM pred CROSS JOIN range(16) r(i) GROUP BY 1)
    SELECT {sql_rnd('m', 'multiplier')}, {sql_rnd('s', 'score')}, (s = (SELECT min(s) FROM s))::INT AS best FROM s""",
)
def multipliers(t: Tables) -> DataFrame:
    return rounded(M.multiplier_scan(B.predictions(t), "truth", "m1"), ["best"])


@query(
    "error_by_segment",
    "M07",
    f"""WITH {B.PREDICTIONS} SELECT entity, count(*) AS rows, {sql_rnd('avg(abs(truth - m3))', 'mae')}, {sql_rnd('avg(truth)', 'truth_mean')}, {sql_rnd('avg(m3)', 'pred_mean')}, {sql_rnd('avg(m3 - truth)', 'bias')}
    FROM pred GROUP BY 1 HAVING count(*) >= 12""",
)
def by_segment(t: Tables) -> DataFrame:
    return rounded(M.error_by_segment(B.predictions(t), ["entity"], "truth", "m3", min_count=12), ["entity", "rows"])


@query(
    "bootstrap_point",
    "M08",
    f"""WITH {B.PREDICTIONS}, e AS (SELECT entity, sum((power(m2 - truth, 2) - power(m1 - truth, 2)) / 1e6) AS d, count(*) AS n FROM pred GROUP BY 1)
    SELECT {sql_rnd('sum(d) / sum(n)', 'dmse')}, {sql_rnd('avg((d < 0)::INT)', 'improved_entities')}, {sql_rnd('sum(CASE WHEN d < 0 THEN n ELSE 0 END) / sum(n)', 'improved_rows')}, count(*) AS entities FROM e""",
)
def gate_point(t: Tables) -> DataFrame:
    """The part of the gate that does not depend on the draw."""
    p = B.predictions(t)
    a, b = F.col("m1") - F.col("truth"), F.col("m2") - F.col("truth")
    rows = p.withColumns({"ea": a * a / 1e6, "eb": b * b / 1e6})
    out = M.bootstrap_gate(rows, "entity", "ea", "eb")
    return rounded(out.select("dmse", "improved_entities", "improved_rows", "entities"), ["entities"])


@query("bootstrap_gate", "M08")
def gate(t: Tables) -> DataFrame:
    """Rows-only: the draw is a hash of Spark's; the point estimate is tested against plain SQL in the tests."""
    p = B.predictions(t)
    a, b = F.col("m1") - F.col("truth"), F.col("m2") - F.col("truth")
    return M.bootstrap_gate(p.withColumns({"ea": a * a, "eb": b * b}), "entity", "ea", "eb")


@query(
    "calibration_bins",
    "M09",
    f"""WITH {B.PREDICTIONS}, e AS (SELECT list_sort(list_distinct([{', '.join(f'quantile_cont(m3, {i / 10})' for i in range(11))}])) AS e FROM pred),
    b AS (SELECT greatest(len(list_filter(e, lambda x: x < m3)), 1)::INT AS bin, m3, truth FROM pred, e)
    SELECT bin, count(*) AS rows, {sql_rnd('avg(m3)', 'pred_mean')}, {sql_rnd('avg(truth)', 'truth_mean')}, {sql_rnd('avg(m3) - avg(truth)', 'gap')} FROM b GROUP BY 1""",
)
def bins(t: Tables) -> DataFrame:
    return rounded(M.calibration_bins(B.predictions(t), "truth", "m3"), ["bin", "rows"])


@query(
    "calibration_slope",
    "M10",
    f"""WITH {B.PREDICTIONS}, s AS (SELECT cold, count(*) AS rows, regr_slope(truth, m2) AS a, regr_intercept(truth, m2) AS b, var_pop(m2) / 1e6 AS v FROM pred GROUP BY 1)
    SELECT cold, rows, {sql_rnd('a', 'slope')}, {sql_rnd('b', 'intercept', 3)}, {sql_rnd('v', 'pred_var', 3)}, {sql_rnd('CASE WHEN a < 1 THEN power(1 - a, 2) * v ELSE 0 END', 'possible_gain', 3)} FROM s""",
)
def slope(t: Tables) -> DataFrame:
    out = M.calibration_slope(B.predictions(t), "truth", "m2", ["cold"])
    return out.select(
        "cold", "rows", rnd("slope"), rnd("intercept", digits=3), rnd(F.col("pred_var") / 1e6, "pred_var", 3),
        rnd(F.col("possible_gain") / 1e6, "possible_gain", 3),
    )


@query(
    "cross_block_shrinkage",
    "M10",
    f"""WITH {B.PREDICTIONS}, k AS (SELECT DISTINCT fold, cold FROM pred), f AS (SELECT k.fold, k.cold, count(*) AS n, regr_slope(truth, m3) AS a, regr_intercept(truth, m3) AS b
      FROM k JOIN pred p ON p.fold <> k.fold AND p.cold = k.cold GROUP BY 1, 2)
    SELECT fold::INT AS fold, cold, n AS other_rows, {sql_rnd('CASE WHEN n >= 100 THEN a END', 'slope', 5)}, {sql_rnd('CASE WHEN n >= 100 THEN b END', 'intercept', 1)} FROM f""",
)
def shrinkage(t: Tables) -> DataFrame:
    out = M.cross_block_shrinkage(B.predictions(t), "truth", "m3", "fold", "cold")
    return out.select("fold", "cold", "other_rows", rnd("slope", digits=5), rnd("intercept", digits=1))


@query(
    "fold_score_table",
    "M11",
    f"""WITH {B.PREDICTIONS}, s AS (SELECT fold::VARCHAR AS fold, sqrt(avg(power(truth - m3, 2))) AS s FROM pred GROUP BY 1)
    SELECT fold, {sql_rnd('s', 'score')} FROM s UNION ALL SELECT 'mean', {sql_rnd('avg(s)', 'score')} FROM s UNION ALL SELECT 'std', {sql_rnd('stddev_pop(s)', 'score')} FROM s
    UNION ALL SELECT 'all rows', {sql_rnd('sqrt(avg(power(truth - m3, 2)))', 'score')} FROM pred""",
)
def fold_scores(t: Tables) -> DataFrame:
    return rounded(M.fold_score_table(B.predictions(t), "fold", "truth", "m3"), ["fold"])


@query(
    "business_impact",
    "M12",
    f"""WITH {B.PREDICTIONS}, s AS (SELECT avg(abs(m3 - truth)) AS m, avg(abs((SELECT avg(truth) FROM pred) - truth)) AS b, sum(greatest(m3 - truth, 0)) AS o, sum(greatest(truth - m3, 0)) AS u, count(*) AS n FROM pred)
    SELECT {sql_rnd('m', 'model_mae', 4)}, {sql_rnd('b', 'baseline_mae', 4)}, {sql_rnd('(b - m) / b * 100', 'improvement_pct', 4)}, {sql_rnd('o', 'over_total', 1)}, {sql_rnd('u', 'under_total', 1)},
      {sql_rnd('(b - m) * n', 'saved_units', 1)}, {sql_rnd('(b - m) * n * 2', 'saved_cost', 1)} FROM s""",
)
def impact(t: Tables) -> DataFrame:
    out = M.business_impact(B.predictions(t), "truth", "m3", unit_cost=2.0)
    return out.select(
        *[rnd(c, digits=4) for c in ("model_mae", "baseline_mae", "improvement_pct")],
        *[rnd(c, digits=1) for c in ("over_total", "under_total", "saved_units", "saved_cost")],
    )


@query(
    "prediction_timeline",
    "M13",
    f"""WITH {B.PREDICTIONS} SELECT date_trunc('week', day)::DATE AS period, {sql_rnd('avg(truth)', 'truth_mean', 7)}, {sql_rnd('avg(m3)', 'pred_mean', 7)}, count(*) AS rows FROM pred GROUP BY 1""",
)
def timeline(t: Tables) -> DataFrame:
    return rounded(M.prediction_timeline(B.predictions(t), "day", "truth", "m3", "week"), ["period", "rows"], 7)


@query(
    "seed_variance",
    "M16",
    f"""WITH {B.PREDICTIONS}, v AS (SELECT cold, (SELECT var_samp(x) FROM (SELECT unnest([ln(1 + m1), ln(1 + m2), ln(1 + truth)]) AS x)) AS v FROM pred)
    SELECT coalesce(cold::VARCHAR, 'all') AS regime, count(*) AS rows, {sql_rnd('avg(v)', 'run_variance', 9)}, {sql_rnd('avg(v) * 3', 'seed_variance', 9)}, {sql_rnd('avg(v)', 'mse_k3', 9)}, {sql_rnd('avg(v) / 2', 'mse_k6', 9)}, {sql_rnd('avg(v) / 3', 'mse_k9', 9)}
    FROM v GROUP BY GROUPING SETS ((cold), ())""",
)
def seeds(t: Tables) -> DataFrame:
    return rounded(M.seed_variance(B.predictions(t), ["m1", "m2", "truth"], "cold", 3), ["regime", "rows"], 9)


@query(
    "error_decomposition",
    "M17",
    f"""WITH {B.PREDICTIONS}, e AS (SELECT entity, ln(1 + truth) - ln(1 + greatest(m3, 0)) AS e FROM pred), m AS (SELECT e, avg(e) OVER (PARTITION BY entity) AS t, avg(e) OVER () AS g FROM e)
    SELECT {sql_rnd('avg(e * e)', 'mse')}, {sql_rnd('max(g) * max(g)', 'bias_sq')}, {sql_rnd('avg(power(t - g, 2))', 'between_entity')}, {sql_rnd('avg(power(e - t, 2))', 'within_entity')} FROM m""",
)
def decomposition(t: Tables) -> DataFrame:
    return rounded(M.error_decomposition(B.predictions(t), "entity", "truth", "m3"), [])


@query(
    "error_concentration",
    "M18",
    f"""WITH {B.PREDICTIONS}, r AS (SELECT entity, power(ln(1 + truth) - ln(1 + greatest(m3, 0)), 2) AS e FROM pred), g AS (SELECT entity, sum(e) AS e FROM r GROUP BY 1),
    gr AS (SELECT e, row_number() OVER (ORDER BY e DESC) AS k, count(*) OVER () AS n FROM g), rr AS (SELECT e, row_number() OVER (ORDER BY e DESC) AS k, count(*) OVER () AS n FROM r)
    SELECT 'entity' AS unit, q::DOUBLE AS worst_share, {sql_rnd('sum(e) FILTER (k <= greatest(1, floor(n * q::DOUBLE))) / sum(e)', 'error_share')} FROM gr CROSS JOIN (VALUES (0.01), (0.05), (0.10), (0.25)) v(q) GROUP BY 2
    UNION ALL SELECT 'row', q::DOUBLE, {sql_rnd('sum(e) FILTER (k <= greatest(1, floor(n * q::DOUBLE))) / sum(e)', 'error_share')} FROM rr CROSS JOIN (VALUES (0.01), (0.10)) v(q) GROUP BY 2""",
)
def concentration(t: Tables) -> DataFrame:
    return rounded(M.error_concentration(B.predictions(t), "entity", "truth", "m3"), ["unit"])


@query(
    "error_by_value_band",
    "M18",
    f"""WITH {B.PREDICTIONS}, e AS (SELECT CASE WHEN truth <= 0 THEN '<=0' WHEN truth < 50000 THEN '0..50000' WHEN truth < 200000 THEN '50000..200000' ELSE '>=200000' END AS band, ln(1 + truth) - ln(1 + greatest(m3, 0)) AS e FROM pred)
    SELECT band, count(*) AS rows, {sql_rnd('avg(e)', 'bias')}, {sql_rnd('avg(e * e)', 'mse')}, {sql_rnd('sum(e * e) / (SELECT sum(e * e) FROM e)', 'error_share')}, {sql_rnd('count(*) / (SELECT count(*) FROM e)', 'row_share')} FROM e GROUP BY 1""",
)
def bands(t: Tables) -> DataFrame:
    out = M.error_by_value_band(B.predictions(t), "truth", "m3", (0, 50000, 200000))
    return rounded(out, ["band", "rows"])
