"""Blending and post-processing of prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import blend as BL
from panelforge.operators import metrics as M
from panelforge.operators import postprocess as PP
from panelforge.plans import bases as B
from panelforge.plans.registry import Tables, query, rnd, rounded, sql_rnd

MEMBERS = ["m2", "m3", "m4"]


def members(t: Tables) -> DataFrame:
    """Predictions with a fourth member; m4 covers orders above 5,000 only."""
    p = F.col("truth")
    return B.predictions(t).withColumn(
        "m4", F.when(p > 5000, p * 0.8 + 30000 * F.cos(F.col("id").cast("double")))
    )


MEM = f"""{B.PREDICTIONS}, mem AS (SELECT *, CASE WHEN truth > 5000 THEN truth * 0.8 + 30000 * cos(CAST(id AS DOUBLE)) END AS m4 FROM pred),
  cov AS (SELECT * FROM mem WHERE m4 IS NOT NULL)"""


@query("common_coverage", "B12", f"WITH {MEM} SELECT id, (m4 IS NOT NULL)::INT AS covered FROM mem")
def coverage(t: Tables) -> DataFrame:
    return members(t).select("id", BL.common_coverage(MEMBERS))


@query(
    "correlation_matrix",
    "B01",
    f"WITH {MEM}, l AS (SELECT id, unnest(['m2', 'm3', 'm4']) AS k, unnest([m2, m3, m4]) AS v FROM cov) "
    f"SELECT x.k AS a, y.k AS b, {sql_rnd('corr(x.v, y.v)', 'correlation')} FROM l x JOIN l y ON x.id = y.id GROUP BY 1, 2",
)
def correlations(t: Tables) -> DataFrame:
    return rounded(BL.correlation_matrix(members(t), MEMBERS), ["a", "b"])


_GRAM = f"""{MEM}, g AS (SELECT count(*) AS n, avg(m2 * m2) AS a22, avg(m3 * m3) AS a33, avg(m4 * m4) AS a44, avg(m2 * m3) AS a23, avg(m2 * m4) AS a24,
    avg(m3 * m4) AS a34, avg(m2 * truth) AS b2, avg(m3 * truth) AS b3, avg(m4 * truth) AS b4, avg(truth * truth) AS c FROM cov)"""


def _mse(w2: str, w3: str, w4: str) -> str:
    s = f"({w2} + {w3} + {w4})"
    return (
        f"((({w2}) * ({w2}) * a22 + ({w3}) * ({w3}) * a33 + ({w4}) * ({w4}) * a44 + 2 * ({w2}) * ({w3}) * a23 + 2 * ({w2}) * ({w4}) * a24 "
        f"+ 2 * ({w3}) * ({w4}) * a34) / ({s} * {s}) - 2 * (({w2}) * b2 + ({w3}) * b3 + ({w4}) * b4) / {s} + c)"
    )


def _as_table(t: Tables, weights: dict[str, float]) -> DataFrame:
    return t.spark.createDataFrame([(m, round(w, 6)) for m, w in weights.items()], "member string, weight double")


@query(
    "hill_climb_weights",
    "B02",
    f"""WITH RECURSIVE {_GRAM}, h AS (
      SELECT 0 AS it, (r = 1)::INT::DOUBLE AS w2, (r = 2)::INT::DOUBLE AS w3, (r = 3)::INT::DOUBLE AS w4, s FROM (
        SELECT CASE WHEN s2 <= s3 AND s2 <= s4 THEN 1 WHEN s3 <= s4 THEN 2 ELSE 3 END AS r, least(s2, s3, s4) AS s FROM (
          SELECT {_mse('1', '0', '0')} AS s2, {_mse('0', '1', '0')} AS s3, {_mse('0', '0', '1')} AS s4 FROM g))
      UNION ALL
      SELECT it + 1, w2 + 0.01 * (r = 1)::INT, w3 + 0.01 * (r = 2)::INT, w4 + 0.01 * (r = 3)::INT, best FROM (
        SELECT it, w2, w3, w4, s, least(s2, s3, s4) AS best, CASE WHEN s2 <= s3 AND s2 <= s4 THEN 1 WHEN s3 <= s4 THEN 2 ELSE 3 END AS r FROM (
          SELECT it, w2, w3, w4, s, {_mse('w2 + 0.01', 'w3', 'w4')} AS s2, {_mse('w2', 'w3 + 0.01', 'w4')} AS s3, {_mse('w2', 'w3', 'w4 + 0.01')} AS s4 FROM h, g
          WHERE it < 200)) WHERE best < s)
    , f AS (SELECT * FROM h ORDER BY it DESC LIMIT 1)
    SELECT 'm2' AS member, {sql_rnd('w2 / (w2 + w3 + w4)', 'weight')} FROM f UNION ALL SELECT 'm3', {sql_rnd('w3 / (w2 + w3 + w4)', 'weight')} FROM f
    UNION ALL SELECT 'm4', {sql_rnd('w4 / (w2 + w3 + w4)', 'weight')} FROM f""",
)
def hill(t: Tables) -> DataFrame:
    return _as_table(t, BL.hill_climb_weights(members(t), MEMBERS, "truth"))


def _climb(name: str, key: str, scored: str) -> str:
    """Recursive climb by 0.01 on the mean absolute error, one for every `key`. `scored` turns the errors (key, r, mae, fold) of
    a candidate into its score `sc`."""
    blend = " + ".join(f"w{k} / (w2 + w3 + w4) * m{k}" for k in (2, 3, 4))
    return f"""{name}0 AS (
      SELECT {key}, r AS b, sc AS s FROM (
        SELECT {key}, r, {scored} AS sc FROM (
          SELECT {key}, r, fold, avg(abs(truth - CASE r WHEN 1 THEN m2 WHEN 2 THEN m3 ELSE m4 END)) AS mae, count(*) AS n
          FROM {name}_rows, (VALUES (1), (2), (3)) v(r) GROUP BY {key}, r, fold) GROUP BY {key}, r)
      QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY sc, r) = 1),
    {name} AS (
      SELECT {key}, 0 AS it, b, 0 AS c2, 0 AS c3, 0 AS c4, s FROM {name}0
      UNION ALL
      SELECT {key}, it + 1, b, c2 + (r = 1)::INT, c3 + (r = 2)::INT, c4 + (r = 3)::INT, sc FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY sc, r) AS place FROM (
          SELECT {key}, it, b, c2, c3, c4, r, s, {scored} AS sc FROM (
            SELECT {key}, it, b, c2, c3, c4, r, s, fold, avg(abs(truth - ({blend}))) AS mae, count(*) AS n FROM (
              SELECT *, (b = 1)::INT + 0.01::DOUBLE * (c2 + (r = 1)::INT) AS w2, (b = 2)::INT + 0.01::DOUBLE * (c3 + (r = 2)::INT) AS w3,
                (b = 3)::INT + 0.01::DOUBLE * (c4 + (r = 3)::INT) AS w4
              FROM {name}, (VALUES (1), (2), (3)) v(r) WHERE it < 200) JOIN {name}_rows USING ({key})
            GROUP BY {key}, it, b, c2, c3, c4, r, s, fold)
          GROUP BY {key}, it, b, c2, c3, c4, r, s))
      WHERE place = 1 AND sc < s),
    {name}_end AS (
      SELECT {key}, (b = 1)::INT + 0.01::DOUBLE * c2 AS w2, (b = 2)::INT + 0.01::DOUBLE * c3 AS w3, (b = 3)::INT + 0.01::DOUBLE * c4 AS w4
      FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY it DESC) = 1)"""


@query(
    "hill_climb_mae_stable",
    "B02",
    f"""WITH RECURSIVE {MEM}, h_rows AS (SELECT 0 AS one, fold, truth, m2, m3, m4 FROM cov), {_climb('h', 'one', 'avg(mae) + 0.5 * stddev_pop(mae)')}
    SELECT unnest(['m2', 'm3', 'm4']) AS member, round(unnest([w2, w3, w4]) / (w2 + w3 + w4), 6) AS weight FROM h_end""",
)
def hill_mae(t: Tables) -> DataFrame:
    """Climbing on MAE with a penalty on the spread over folds."""
    w = BL.hill_climb_weights(
        members(t), MEMBERS, "truth", "mae", fold="fold", stability_penalty=0.5
    )
    return _as_table(t, w)


@query(
    "best_mixture",
    "B02",
    f"""WITH {MEM}, p AS (SELECT truth, m2, m3, (truth - m2) / nullif(m3 - m2, 0) AS t, abs(m3 - m2) AS w FROM cov),
    g AS (SELECT t, sum(w) AS w FROM p WHERE t IS NOT NULL GROUP BY 1), c AS (SELECT t, sum(w) OVER (ORDER BY t) AS upto, sum(w) OVER () AS total FROM g),
    b AS (SELECT greatest(least(min(t), 1), 0) AS t FROM c WHERE upto >= total / 2)
    SELECT {sql_rnd('max(b.t)', 'share')}, {sql_rnd('avg(abs(truth - (m2 + b.t * (m3 - m2))))', 'mae')} FROM p, b""",
)
def mixture(t: Tables) -> DataFrame:
    """The share of m3 beside m2 with the least mean absolute error, exactly."""
    covered = members(t).filter(BL.common_coverage(MEMBERS, "_c") == 1)
    share, error = BL.best_step(covered, F.col("m2").cast("double"), F.col("m3").cast("double"), "truth")
    return t.spark.createDataFrame([(round(share, 6), round(error, 6))], "share double, mae double")


@query("line_search_weights", "B02")
def searched(t: Tables) -> DataFrame:
    """Rows-only: three members by exact line searches; the tests compare with a grid, and `best_mixture` has a twin."""
    return _as_table(t, BL.line_search_weights(members(t), MEMBERS, "truth"))


@query(
    "greedy_forward_selection",
    "B03",
    f"""WITH RECURSIVE {_GRAM}, h AS (
      SELECT 0 AS it, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3, 0.0::DOUBLE AS w4, 1e300::DOUBLE AS s
      UNION ALL
      SELECT it + 1, w2 + (r = 1)::INT, w3 + (r = 2)::INT, w4 + (r = 3)::INT, best FROM (
        SELECT it, w2, w3, w4, s, least(s2, s3, s4) AS best, CASE WHEN s2 <= s3 AND s2 <= s4 THEN 1 WHEN s3 <= s4 THEN 2 ELSE 3 END AS r FROM (
          SELECT it, w2, w3, w4, s, {_mse('w2 + 1', 'w3', 'w4')} AS s2, {_mse('w2', 'w3 + 1', 'w4')} AS s3, {_mse('w2', 'w3', 'w4 + 1')} AS s4 FROM h, g
          WHERE it < 30)) WHERE best < s)
    , f AS (SELECT * FROM h ORDER BY it DESC LIMIT 1), u AS (SELECT unnest(['m2', 'm3', 'm4']) AS member, unnest([w2, w3, w4]) / (w2 + w3 + w4) AS w FROM f)
    SELECT member, {sql_rnd('w', 'weight')} FROM u WHERE w > 0""",
)
def greedy(t: Tables) -> DataFrame:
    return _as_table(t, BL.greedy_forward_selection(members(t), MEMBERS, "truth"))


@query(
    "prune_by_correlation",
    "B04",
    f"""WITH {MEM}, r AS (SELECT k, row_number() OVER (ORDER BY e) AS p FROM (SELECT 'm1' AS k, sqrt(avg(power(m1 - truth, 2))) AS e FROM cov UNION ALL SELECT 'm2', sqrt(avg(power(m2 - truth, 2))) FROM cov
        UNION ALL SELECT 'm3', sqrt(avg(power(m3 - truth, 2))) FROM cov UNION ALL SELECT 'm4', sqrt(avg(power(m4 - truth, 2))) FROM cov)),
    l AS (SELECT id, unnest(['m1', 'm2', 'm3', 'm4']) AS k, unnest([m1, m2, m3, m4]) AS v FROM cov),
    c AS (SELECT x.k AS a, y.k AS b, abs(corr(x.v, y.v)) AS c FROM l x JOIN l y ON x.id = y.id GROUP BY 1, 2),
    k1 AS (SELECT k FROM r WHERE p = 1), k2 AS (SELECT k FROM k1 UNION ALL SELECT k FROM r WHERE p = 2 AND (SELECT max(c) FROM c WHERE a = r.k AND b IN (SELECT k FROM k1)) <= 0.99),
    k3 AS (SELECT k FROM k2 UNION ALL SELECT k FROM r WHERE p = 3 AND (SELECT max(c) FROM c WHERE a = r.k AND b IN (SELECT k FROM k2)) <= 0.99),
    k4 AS (SELECT k FROM k3 UNION ALL SELECT k FROM r WHERE p = 4 AND (SELECT max(c) FROM c WHERE a = r.k AND b IN (SELECT k FROM k3)) <= 0.99)
    SELECT k AS member FROM k4""",
)
def pruned(t: Tables) -> DataFrame:
    """m1 and m2 are linear in the truth and correlate perfectly, only the better of the two stays."""
    kept = BL.prune_by_correlation(members(t), ["m1", "m2", "m3", "m4"], "truth")
    return t.spark.createDataFrame([(m,) for m in kept], "member string")


@query(
    "power_mean_blend",
    "B05",
    f"""WITH {MEM} SELECT id, {sql_rnd('(2 * m2 + greatest(m3, 0)) / 3', 'plain', 4)}, {sql_rnd('exp((2 * ln(greatest(m2, 1e-9)) + ln(greatest(m3, 1e-9))) / 3)', 'geometric', 4)},
      {sql_rnd('power((2 * power(greatest(m2, 0), 0.5) + power(greatest(m3, 0), 0.5)) / 3, 2)', 'root', 4)}, {sql_rnd('sqrt((2 * power(greatest(m2, 0), 2) + power(greatest(m3, 0), 2)) / 3)', 'square', 4)} FROM mem""",
)
def power(t: Tables) -> DataFrame:
    w = {"m2": 2.0, "m3": 1.0}
    rows = members(t).withColumn("m3", F.greatest("m3", F.lit(0.0)))
    return rows.select(
        "id",
        *[rnd(BL.power_mean_blend(w, p), n, 4) for n, p in (("plain", 1.0), ("geometric", 0.0), ("root", 0.5), ("square", 2.0))],
    )


@query(
    "tune_power_mean",
    "B05",
    f"""WITH {MEM}, s AS (SELECT 0.5::DOUBLE AS p, avg(abs(truth - power((power(greatest(m2, 0), 0.5) + power(greatest(m3, 0), 0.5)) / 2, 2))) AS score FROM mem UNION ALL SELECT 1, avg(abs(truth - (m2 + m3) / 2)) FROM mem
      UNION ALL SELECT 2, avg(abs(truth - sqrt((power(greatest(m2, 0), 2) + power(greatest(m3, 0), 2)) / 2))) FROM mem)
    SELECT p, {sql_rnd('score', 'score', 4)}, (score = (SELECT min(score) FROM s))::INT AS best FROM s""",
)
def tuned(t: Tables) -> DataFrame:
    return rounded(BL.tune_power_mean(members(t), {"m2": 1.0, "m3": 1.0}, "truth"), ["p", "best"], 4)


@query(
    "median_blend",
    "B06",
    f"""WITH {MEM}, l AS (SELECT id, unnest([m1, m2, m3, truth]) AS v, unnest([0.1, 0.4, 0.3, 0.2]) AS w, unnest([1, 2, 3, 4]) AS i FROM mem),
    c AS (SELECT id, v, sum(w) OVER (PARTITION BY id ORDER BY v, i) AS c, row_number() OVER (PARTITION BY id ORDER BY v, i) AS r FROM l),
    f AS (SELECT id, min(r) FILTER (c >= 0.5 - 1e-12) AS r FROM c GROUP BY 1),
    x AS (SELECT c.id, max(c.v) FILTER (c.r = f.r) AS a, max(c.v) FILTER (c.r = f.r + 1) AS b, max(c.c) FILTER (c.r = f.r) AS cc FROM c JOIN f ON f.id = c.id GROUP BY 1)
    SELECT x.id, {sql_rnd('median(v)', 'plain', 5)}, {sql_rnd('max(CASE WHEN abs(cc - 0.5) <= 1e-12 THEN (a + b) / 2 ELSE a END)', 'weighted', 5)} FROM x JOIN l ON l.id = x.id GROUP BY 1""",
)
def medians(t: Tables) -> DataFrame:
    names = ["m1", "m2", "m3", "truth"]
    w = dict(zip(names, (0.1, 0.4, 0.3, 0.2), strict=True))
    return members(t).select(
        "id", rnd(BL.median_blend(names), "plain", 5), rnd(BL.median_blend(names, w), "weighted", 5)
    )


_RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"


@query(
    "rank_average",
    "B07 W17",
    f"WITH {MEM}, r AS (SELECT id, {_RANK.format(c='m2')} AS a, {_RANK.format(c='m3')} AS b FROM mem) SELECT id, {sql_rnd('(3 * a + b) / 4', 'blend')} FROM r",
)
def ranked(t: Tables) -> DataFrame:
    return BL.rank_average(members(t), ["m2", "m3"], [3, 1]).select("id", rnd("blend"))


@query(
    "blend_tables",
    "B07",
    f"WITH {MEM} SELECT id, {sql_rnd('(m1 + m2 + 2 * m3) / 4', 'prediction', 5)} FROM mem",
)
def blended(t: Tables) -> DataFrame:
    p = members(t)
    tables = [p.select("id", F.col(m).alias("prediction")) for m in ("m1", "m2", "m3")]
    return rounded(BL.blend_tables(tables, "id", "prediction", [1, 1, 2]), ["id"], 5)


@query(
    "seed_batch_mean",
    "B08",
    f"WITH {MEM} SELECT id, {sql_rnd('exp((3 * ln(1 + m1) + 6 * ln(1 + m2)) / 9) - 1', 'prediction', 4)} FROM mem",
)
def seeds(t: Tables) -> DataFrame:
    return members(t).select("id", rnd(BL.seed_batch_mean({"m1": 3, "m2": 6}), "prediction", 4))


@query(
    "stack_oof",
    "B09",
    f"""WITH {MEM}, k AS (SELECT DISTINCT fold FROM mem), s AS (SELECT k.fold, count(*) AS n, avg(m2) AS x, avg(m3) AS z, avg(truth) AS y,
        count(*) * covar_pop(m2, m2) + 1 AS xx, count(*) * covar_pop(m3, m3) + 1 AS zz, count(*) * covar_pop(m2, m3) AS xz, count(*) * covar_pop(m2, truth) AS xy, count(*) * covar_pop(m3, truth) AS zy
      FROM k JOIN mem p ON p.fold <> k.fold GROUP BY 1),
    b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS a2 FROM s)
    SELECT id, {sql_rnd('a1 * m2 + a2 * m3 + y - a1 * x - a2 * z', 'stacked', 4)} FROM mem JOIN b USING (fold)""",
)
def stacked(t: Tables) -> DataFrame:
    rows, _ = BL.stack_oof(members(t), ["m2", "m3"], "truth", "fold")
    return rows.select("id", rnd("stacked", digits=4))


@query(
    "nested_blend",
    "B10 B02",
    f"""WITH RECURSIVE {MEM}, y AS (SELECT DISTINCT fold FROM cov), h_rows AS (SELECT y.fold AS upto, 0 AS fold, truth, m2, m3, m4 FROM cov JOIN y ON cov.fold < y.fold),
    {_climb('h', 'upto', 'sum(mae * n) / sum(n)')}
    SELECT CAST(c.fold AS INTEGER) AS fold, count(*) AS rows, {sql_rnd('avg(abs(truth - (m2 * (w2 / (w2 + w3 + w4)) + m3 * (w3 / (w2 + w3 + w4)) + m4 * (w4 / (w2 + w3 + w4)))))', 'blend')},
      {sql_rnd('avg(abs(truth - m2))', 'single_m2')}, {sql_rnd('avg(abs(truth - m3))', 'single_m3')}, {sql_rnd('avg(abs(truth - m4))', 'single_m4')},
      {sql_rnd('max(w2 / (w2 + w3 + w4))', 'weight_m2')}, {sql_rnd('max(w3 / (w2 + w3 + w4))', 'weight_m3')}, {sql_rnd('max(w4 / (w2 + w3 + w4))', 'weight_m4')}
    FROM cov c JOIN h_end ON h_end.upto = c.fold GROUP BY c.fold""",
)
def nested(t: Tables) -> DataFrame:
    """Weights climb on the MAE of all earlier years and are scored on the next one."""
    return rounded(BL.nested_blend(members(t), MEMBERS, "truth", "fold"), ["fold", "rows"])


_LOGS = f"""{MEM}, lg AS (SELECT ln(1 + greatest(m1, 0)) AS b, ln(1 + greatest(m2, 0)) - ln(1 + greatest(m1, 0)) AS d2, ln(1 + greatest(m3, 0)) - ln(1 + greatest(m1, 0)) AS d3, ln(1 + truth) AS y FROM mem)"""


@query(
    "gram_projection",
    "B11",
    f"""WITH {_LOGS}, g AS (SELECT avg(d2 * d2) AS a, avg(d3 * d3) AS c, avg(d2 * d3) AS b, avg(power(y - b, 2)) AS m0, avg(power(y - b - d2, 2)) AS m2, avg(power(y - b - d3, 2)) AS m3 FROM lg),
    p AS (SELECT *, (m0 + a - m2) / 2 AS p2, (m0 + c - m3) / 2 AS p3 FROM g), k AS (SELECT *, (p2 * c - p3 * b) / (a * c - b * b) AS k2, (p3 * a - p2 * b) / (a * c - b * b) AS k3 FROM p)
    SELECT {sql_rnd('k2', 'm2', 5)}, {sql_rnd('k3', 'm3', 5)}, {sql_rnd('1 - k2 - k3', 'base', 5)}, {sql_rnd('sqrt(greatest(m0 - p2 * k2 - p3 * k3, 0))', 'rmsle', 5)} FROM k""",
)
def projection(t: Tables) -> DataFrame:
    logs, s = _scored_logs(t)
    w = BL.score_projection(logs, s)
    row = [(round(w["m2"], 5), round(w["m3"], 5), round(w["m1"], 5), round(w["rmsle"], 5))]
    return t.spark.createDataFrame(row, "m2 double, m3 double, base double, rmsle double")


def _scored_logs(t: Tables, names: tuple[str, ...] = ("m1", "m2", "m3")) -> tuple[DataFrame, dict[str, float]]:
    p = members(t)
    logs = p.select(*[PP.log_of(m).alias(m) for m in names])
    return logs, p.agg(*[M.metric("rmsle", "truth", m).alias(m) for m in names]).first().asDict()


@query(
    "score_step",
    "B11",
    f"""WITH {_LOGS}, g AS (SELECT avg(d3 * d3) AS q, avg(power(y - b, 2)) AS m0, avg(power(y - b - d3, 2)) AS m3 FROM lg)
    SELECT {sql_rnd('(q - m3 + m0) / (2 * q)', 'step', 5)}, {sql_rnd('sqrt(m0 - power(q - m3 + m0, 2) / (4 * q))', 'rmsle', 5)} FROM g""",
)
def score_step(t: Tables) -> DataFrame:
    """How far to go from m1 towards m3."""
    w = BL.score_projection(*_scored_logs(t, ("m1", "m3")))
    return t.spark.createDataFrame([(round(w["m3"], 5), round(w["rmsle"], 5))], "step double, rmsle double")


@query(
    "rounded_score_range",
    "B11",
    f"""WITH {_LOGS}, g AS (SELECT avg(d2 * d2) AS a, avg(d3 * d3) AS c, avg(d2 * d3) AS b, avg(power(y - b, 2)) AS m0, avg(power(y - b - d2, 2)) AS m2, avg(power(y - b - d3, 2)) AS m3 FROM lg),
    e AS (SELECT *, unnest([-0.001, 0.001]) AS e0 FROM g), f AS (SELECT *, unnest([-0.001, 0.001]) AS e2 FROM e), h AS (SELECT *, unnest([-0.001, 0.001]) AS e3 FROM f),
    v AS (SELECT power(sqrt(m0) + e0, 2) AS s0, power(sqrt(m2) + e2, 2) AS s2, power(sqrt(m3) + e3, 2) AS s3, a, b, c FROM h),
    x AS (SELECT sqrt(greatest(s0 + 1.5 * (s2 - s0 - a) - 0.2 * (s3 - s0 - c) + 2.25 * a + 0.04 * c - 0.6 * b, 0)) AS r FROM v)
    SELECT {sql_rnd('min(r)', 'low', 5)}, {sql_rnd('max(r)', 'high', 5)} FROM x""",
)
def score_range(t: Tables) -> DataFrame:
    """Weights -0.3, 1.5 and -0.2; the twin tries every corner."""
    logs, s = _scored_logs(t)
    low, high = BL.rounded_score_range(BL.pairwise_distances(logs, list(s)), [-0.3, 1.5, -0.2], list(s.values()), 0.001)
    return t.spark.createDataFrame([(round(low, 5), round(high, 5))], "low double, high double")


# ---- post-processing ------------------------------------------------------------------------------------------------

_CAP = "(entity % 500 + 50)"


def with_cap(t: Tables) -> DataFrame:
    return members(t).withColumn("cap", (F.pmod("entity", F.lit(500)) + 50).cast("double"))


@query(
    "shrink_cold",
    "B13",
    f"""WITH {MEM}, r AS (SELECT id, cold, m3, ln(1 + greatest(m3, 0)) - ln(1 + {_CAP}) AS r, ln(1 + {_CAP}) AS c FROM mem)
    SELECT id, {sql_rnd('CASE WHEN cold = 1 THEN greatest(exp((SELECT avg(r) FROM r WHERE cold = 1) + 0.6 * (r - (SELECT avg(r) FROM r WHERE cold = 1)) + c) - 1, 0) ELSE m3 END', 'prediction', 4)} FROM r""",
)
def cold_shrink(t: Tables) -> DataFrame:
    return PP.shrink_cold(with_cap(t), "m3", "cap", "cold", "prediction").select("id", rnd("prediction", digits=4))


@query(
    "rescale_day_profile",
    "B14 A29",
    f"""WITH {B.DENSE_USER}, p AS (SELECT entity, day, ln(2 + amount) AS lg, day - min(day) OVER (PARTITION BY entity) AS age, count(*) OVER (PARTITION BY entity) AS n FROM dense),
    m AS (SELECT day, avg(lg) AS m FROM p WHERE age >= 2 AND n >= 20 GROUP BY 1), e AS (SELECT p.*, coalesce(m - (SELECT avg(m) FROM m), 0) AS e FROM p LEFT JOIN m USING (day))
    SELECT entity, day, {sql_rnd('greatest(exp(lg + 0.2 * (e - (SELECT avg(e) FROM e))) - 1, 0)', 'prediction', 4)} FROM e""",
)
def day_profile(t: Tables) -> DataFrame:
    """The panel is balanced, so the twin's day effects are plain means."""
    p = B.dense_user_day(t).withColumn("amount", F.col("amount") + 1)
    out = PP.rescale_day_profile(p, "entity", "day", "amount", "prediction", 1.2, 2, 20)
    return out.select("entity", "day", rnd("prediction", digits=4))


@query(
    "regime_shift",
    "B15",
    f"""WITH {MEM} SELECT id, {sql_rnd('greatest(exp(ln(1 + greatest(m3, 0)) + CASE WHEN cold = 1 THEN 0.1 WHEN fold = 2000 THEN -0.05 ELSE 0.01 END) - 1, 0)', 'prediction', 4)} FROM mem""",
)
def shift(t: Tables) -> DataFrame:
    masks = [(F.col("cold") == 1, 0.1), ((F.col("cold") != 1) & (F.col("fold") == 2000), -0.05)]
    return members(t).select("id", rnd(PP.regime_shift("m3", masks, 0.01), "prediction", 4))


@query(
    "event_day_correction",
    "B16 W18",
    f"""WITH {MEM}, e AS (SELECT id, m2, CASE WHEN fold = 1999 AND cold = 1 THEN -0.4 WHEN fold = 1999 THEN 0.3 WHEN cold = 1 THEN -0.4 WHEN segment = '1-URGENT' THEN 0.2 ELSE 0 END AS s FROM mem)
    SELECT id, {sql_rnd('CASE WHEN s = 0 THEN m2 ELSE greatest(exp(ln(1 + m2) + s) - 1, 0) END', 'prediction', 4)} FROM e""",
)
def event_correction(t: Tables) -> DataFrame:
    groups = [
        (F.col("fold") == 1999, 0.3),
        (F.col("cold") == 1, -0.4),
        (F.col("segment") == "1-URGENT", 0.2),
    ]
    return with_cap(t).select("id", rnd(PP.event_day_correction("m2", "cap", groups), "prediction", 4))


_LIFE = f"""{B.DENSE_USER}, e AS (SELECT entity, day, amount, max(CASE WHEN amount > 0 THEN day END) OVER (PARTITION BY entity) AS lp FROM dense),
  life AS (SELECT entity, count(*) FILTER (lp IS NULL OR day > lp) AS tail, avg((amount <= 0)::INT) AS zs FROM e GROUP BY 1)"""


def life(t: Tables) -> DataFrame:
    from panelforge.operators.profiles import entity_summaries

    p = B.dense_user_day(t).withColumn("cap", F.lit(1.0))
    lv = entity_summaries(p, "entity", "day", "amount", "cap").level
    return lv.select("entity", F.col("tail_zero_run").alias("tail"), F.col("zero_share").alias("zs"), F.col("last_row_age"))


@query(
    "zero_dead_entities",
    "B17 A15",
    f"WITH {_LIFE} SELECT entity, (CASE WHEN tail * 14 >= 14 AND zs * 9 >= 0.9 THEN 0 ELSE 100 END)::DOUBLE AS prediction FROM life",
)
def dead(t: Tables) -> DataFrame:
    rows = life(t).select(
        "entity", (F.col("tail") * 14).alias("tail"), F.lit(20).alias("age"), (F.col("zs") * 9).alias("zs"), F.lit(100.0).alias("p")
    )
    return rows.select("entity", PP.zero_dead("p", "tail", "age", "zs").alias("prediction"))


_NAIVE = f"""{MEM}, n AS (SELECT id, dayofyear(day) % 123 AS h, ln(1 + truth) AS y, ln(1 + m2) AS a, ln(1 + greatest(m3, 0)) AS b FROM mem),
  s AS (SELECT least(floor(h / 15), 7)::INT AS bucket, count(*) AS rows, sum((a - b) * (y - b)) AS p, sum(power(a - b, 2)) AS q FROM n GROUP BY 1),
  w AS (SELECT bucket, rows, least(greatest(CASE WHEN rows < 500 OR q <= 0 THEN 0.5 ELSE p / q END, 0), 1) AS w FROM s)"""


def naive_rows(t: Tables) -> DataFrame:
    return members(t).select(
        "id", F.pmod(F.dayofyear("day"), F.lit(123)).alias("h"), "truth", PP.log_of("m2").alias("a"), PP.log_of("m3").alias("b")
    )


@query("naive_weights", "B18", f"WITH {_NAIVE} SELECT bucket, rows, {sql_rnd('w', 'weight')} FROM w")
def naive_w(t: Tables) -> DataFrame:
    return rounded(PP.naive_weights(naive_rows(t), "h", PP.HORIZON_EDGES, "truth", "a", "b"), ["bucket", "rows"])


@query(
    "naive_blend",
    "B18",
    f"WITH {_NAIVE} SELECT id, {sql_rnd('w * a + (1 - w) * b', 'log_prediction')} FROM n JOIN w ON w.bucket = least(floor(h / 15), 7)",
)
def naive(t: Tables) -> DataFrame:
    rows = naive_rows(t)
    w = PP.naive_weights(rows, "h", PP.HORIZON_EDGES, "truth", "a", "b")
    return PP.naive_blend(rows, w, "h", PP.HORIZON_EDGES, "a", "b", "log_prediction").select("id", rnd("log_prediction"))


_HURDLE = """hur AS (SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE 0 END AS y,
    1 / (1 + exp(-(sin(CAST(event_id AS DOUBLE)) + CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE -1 END))) AS p, value * 0.9 + 1 AS m FROM events)"""


def hurdle_rows(t: Tables) -> DataFrame:
    hit = F.col("event_type").isin("purchase", "signup")
    z = F.sin(F.col("event_id").cast("double")) + F.when(hit, 1).otherwise(-1)
    return t.events.select(
        "event_id",
        F.when(hit, F.col("value")).otherwise(0.0).alias("y"),
        (1 / (1 + F.exp(-z))).alias("p"),
        (F.col("value") * 0.9 + 1).alias("m"),
        F.pmod("user_id", F.lit(4)).alias("fold"),
    )


@query(
    "hurdle_combination",
    "B19",
    f"WITH {_HURDLE} SELECT event_id, {sql_rnd('p * m', 'expected')}, {sql_rnd('CASE WHEN p >= 0.6 THEN m ELSE 0 END', 'thresholded')} FROM hur",
)
def hurdles(t: Tables) -> DataFrame:
    return hurdle_rows(t).select("event_id", rnd(PP.hurdle("p", "m"), "expected"), rnd(PP.hurdle("p", "m", 0.6), "thresholded"))


@query(
    "tune_hurdle",
    "B19",
    f"""WITH {_HURDLE}, g AS (SELECT 0.01 + (0.99 - 0.01) * i / 199 AS t FROM range(200) r(i)), s AS (SELECT t, avg(abs(y - CASE WHEN p >= t THEN m ELSE 0 END)) AS s FROM g CROSS JOIN hur GROUP BY 1),
    b AS (SELECT t, s FROM s ORDER BY round(s, 9), t LIMIT 1)
    SELECT {sql_rnd('t', 'best_threshold')}, {sql_rnd('s', 'best_score')}, {sql_rnd('(SELECT avg(abs(y - CASE WHEN p >= 0.5 THEN m ELSE 0 END)) FROM hur)', 'score_at_half')},
      {sql_rnd('(SELECT avg(abs(y - p * m)) FROM hur)', 'score_expected')}, {sql_rnd('(SELECT avg(abs(y)) FROM hur)', 'score_all_zero')} FROM b""",
)
def hurdle_tuning(t: Tables) -> DataFrame:
    return rounded(PP.tune_hurdle(hurdle_rows(t), "y", "p", "m"), [])


@query(
    "ladder_quantile",
    "B20",
    f"""WITH {_HURDLE}, q AS (SELECT event_id, m, CASE WHEN 1 - 0.5 / p > 0 THEN 1 - 0.5 / p END AS q FROM hur)
    SELECT event_id, {sql_rnd('q', 'q')}, {sql_rnd('''CASE WHEN q IS NULL THEN 0 WHEN q <= 0.1 THEN m * 0.5 WHEN q <= 0.5 THEN m * 0.5 + m * 0.5 * (q - 0.1) / 0.4
      WHEN q <= 0.9 THEN m + m * (q - 0.5) / 0.4 ELSE 2 * m END''', 'prediction')} FROM q""",
)
def ladder(t: Tables) -> DataFrame:
    rows = hurdle_rows(t).withColumns({"l": F.col("m") * 0.5, "h": F.col("m") * 2})
    return rows.select(
        "event_id", rnd(PP.mae_optimal_quantile("p"), "q"), rnd(PP.quantile_from_ladder("p", {0.1: "l", 0.5: "m", 0.9: "h"}), "prediction")
    )


@query(
    "calibrate_probability_grid",
    "B21",
    f"""WITH {_HURDLE}, h AS (SELECT event_id, user_id % 4 AS fold, round(p, 2) AS p, (y > 0)::INT AS y FROM hur JOIN events USING (event_id)), f AS (SELECT DISTINCT fold FROM h),
    g AS (SELECT f.fold, h.p, sum(y) AS s, count(*) AS n, row_number() OVER (PARTITION BY f.fold ORDER BY h.p) AS i FROM f JOIN h ON h.fold <> f.fold GROUP BY 1, 2),
    c AS (SELECT fold, p, i, sum(s) OVER w AS s1, sum(n) OVER w AS n1, sum(s) OVER w - s AS s0, sum(n) OVER w - n AS n0 FROM g WINDOW w AS (PARTITION BY fold ORDER BY i)),
    m AS (SELECT o.fold, o.p, a.i, min((b.s1 - a.s0) / (b.n1 - a.n0)) AS least FROM c o JOIN c a ON a.fold = o.fold AND a.i <= o.i JOIN c b ON b.fold = o.fold AND b.i >= o.i GROUP BY 1, 2, 3),
    iso AS (SELECT fold, p, max(least) AS q FROM m GROUP BY 1, 2)
    SELECT event_id, h.fold, {sql_rnd('h.p', 'p')}, {sql_rnd('q', 'calibrated')} FROM h JOIN iso ON iso.fold = h.fold AND iso.p = h.p""",
)
def calibrated_grid(t: Tables) -> DataFrame:
    """Probabilities in steps of 0.01, so that SQL can state the isotonic fit as the largest of least means of runs."""
    grid = hurdle_rows(t).withColumn("p", F.round("p", 2))
    rows, _ = PP.calibrate_probability(grid, "p", "y", "fold", "calibrated")
    return rows.select("event_id", "fold", rnd("p"), rnd("calibrated"))


@query("calibrate_probability", "B21")
def calibrated(t: Tables) -> DataFrame:
    """Rows-only: pooled violators are MLlib's; the tests check monotone fits and the Brier score."""
    rows, _ = PP.calibrate_probability(hurdle_rows(t), "p", "y", "fold", "calibrated")
    return rows.select("event_id", "fold", rnd("p"), rnd("calibrated"))


_RES = f"""{MEM}, r AS (SELECT id, fold, segment, m3, ln(1 + truth) - ln(1 + greatest(m3, 0)) AS e FROM mem)"""


def residuals(t: Tables) -> DataFrame:
    return members(t).select(
        "id", "fold", "segment", "entity", "m3", (F.log1p("truth") - PP.log_of("m3")).alias("e")
    )


@query(
    "group_residual_offset",
    "B22",
    f"""WITH {_RES}, c AS (SELECT id, fold, segment, e - avg(e) OVER (PARTITION BY fold) AS e FROM r), g AS (SELECT fold, segment, sum(e) AS s, count(*) AS n FROM c GROUP BY 1, 2),
    o AS (SELECT a.fold, a.segment, a.n, coalesce(sum(b.s) / sum(b.n) * sum(b.n) / (sum(b.n) + 200), 0) AS d FROM g a LEFT JOIN g b ON b.segment = a.segment AND b.fold <> a.fold GROUP BY 1, 2, 3),
    f AS (SELECT fold, segment, d - sum(d * n) OVER (PARTITION BY fold) / sum(n) OVER (PARTITION BY fold) AS d FROM o)
    SELECT id, {sql_rnd('least(greatest(d, -0.002), 0.002)', 'offset')} FROM r JOIN f USING (fold, segment)""",
)
def group_offset(t: Tables) -> DataFrame:
    out = PP.group_residual_offset(residuals(t), "fold", "segment", "e", "offset", clip=0.002)
    return out.select("id", rnd("offset"))


_QS = ", ".join(f"quantile_cont(m3, {i / 8})" for i in range(1, 8))


@query(
    "quantile_bin_offset",
    "B22",
    f"""WITH {_RES}, c AS (SELECT id, fold, m3, e - avg(e) OVER (PARTITION BY fold) AS e FROM r), q AS (SELECT fold AS b, [{_QS}] AS q FROM c GROUP BY 1),
    x AS (SELECT b, len(list_filter(q, lambda v: v <= m3)) AS bin, sum(e) / (count(*) + 200) AS d FROM c JOIN q ON b <> fold GROUP BY 1, 2),
    o AS (SELECT id, fold, coalesce(d, 0) AS d FROM (SELECT id, fold, len(list_filter(q, lambda v: v <= m3)) AS k FROM c JOIN q ON b = fold) LEFT JOIN x ON x.b = fold AND x.bin = k)
    SELECT id, {sql_rnd('d - avg(d) OVER (PARTITION BY fold)', 'offset')} FROM o""",
)
def bin_offset(t: Tables) -> DataFrame:
    out = PP.quantile_bin_offset(residuals(t), "fold", "m3", "e", "offset", bins=8)
    return out.select("id", rnd("offset"))


def _edges(bins: int) -> str:
    return ", ".join(f"quantile_cont(m3, {i / bins})" for i in range(1, bins))


@query(
    "quantile_bin_offset_40",
    "B22",
    f"""WITH {_RES}, c AS (SELECT id, fold, m3, e - avg(e) OVER (PARTITION BY fold) AS e FROM r), q AS (SELECT fold AS b, [{_edges(40)}] AS q FROM c GROUP BY 1),
    x AS (SELECT b, len(list_filter(q, lambda v: v <= m3)) AS bin, sum(e) / (count(*) + 200) AS d FROM c JOIN q ON b <> fold GROUP BY 1, 2),
    o AS (SELECT id, fold, coalesce(d, 0) AS d FROM (SELECT id, fold, len(list_filter(q, lambda v: v <= m3)) AS k FROM c JOIN q ON b = fold) LEFT JOIN x ON x.b = fold AND x.bin = k)
    SELECT id, {sql_rnd('d - avg(d) OVER (PARTITION BY fold)', 'offset')} FROM o""",
)
def bin_offset_40(t: Tables) -> DataFrame:
    """At the operator's own number of bins; `quantile_bin_offset` has 8."""
    out = PP.quantile_bin_offset(residuals(t), "fold", "m3", "e", "offset")
    return out.select("id", rnd("offset"))


@query(
    "group_effects",
    "B22",
    f"""WITH {_RES} SELECT segment, {sql_rnd('(avg(e) - (SELECT avg(e) FROM r)) * count(*) / (count(*) + 200.0)', 'effect', 8)} FROM r GROUP BY 1""",
)
def effects(t: Tables) -> DataFrame:
    return rounded(PP.group_effects(residuals(t), "segment", "e"), ["segment"], 8)


@query(
    "entity_shrinkage",
    "B23",
    f"""WITH {MEM}, r AS (SELECT id, ln(1 + greatest(m3, 0)) AS r, avg(ln(1 + greatest(m3, 0))) OVER (PARTITION BY entity) AS t, avg(ln(1 + greatest(m3, 0))) OVER () AS m FROM mem)
    SELECT id, {sql_rnd('m + 0.8 * (t - m) + (r - t)', 'between_shrunk')}, {sql_rnd('t + 0.7 * (r - t)', 'within_shrunk')} FROM r""",
)
def shrunk(t: Tables) -> DataFrame:
    rows = members(t).select("id", "entity", PP.log_of("m3").alias("r"))
    a = PP.shrink_between(rows, "entity", "r", "between_shrunk", 0.8)
    return PP.shrink_within(a, "entity", "r", "within_shrunk", 0.7).select(
        "id", rnd("between_shrunk"), rnd("within_shrunk")
    )


@query(
    "zero_hedge",
    "B23 A15",
    f"WITH {_LIFE} SELECT entity, {sql_rnd('5 - CASE WHEN zs >= 0.1 AND tail >= 1 THEN 0.3 ELSE 0 END', 'value')} FROM life",
)
def hedge(t: Tables) -> DataFrame:
    return life(t).withColumn("v", F.lit(5.0)).select("entity", rnd(PP.zero_hedge("v", "zs", "tail", 0.3, 0.1, 1), "value"))
