"""Scores, threshold and multiplier searches, segment reports, calibration and error anatomy.

Every score is an aggregate expression, so any number of candidates and groups fits in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.core.exprs import safe_div
from panelforge.core.scale import exact_quantiles, value_positions

GREATER_IS_BETTER = {"r2", "auc", "f1", "accuracy"}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _log_clip(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def metric(name: str, truth: str | Column, pred: str | Column, epsilon: float = 1e-9) -> Column:
    """Aggregate expression of a row metric: rmse, rmsle, mae, r2, mape, mape_coverage, smape."""
    y, p = _c(truth), _c(pred)
    e = y - p
    if name == "rmse":
        return F.sqrt(F.avg(e * e))
    if name == "mae":
        return F.avg(F.abs(e))
    if name == "rmsle":
        safe = F.when(y < 0, F.raise_error(F.lit("rmsle needs truth >= 0")).cast("double")).otherwise(F.log1p(y))
        d = _log_clip(p) - safe
        return F.sqrt(F.avg(d * d))
    if name == "r2":
        both = y.isNotNull() & p.isNotNull()
        return 1.0 - F.sum(e * e) / F.nullif(
            F.var_pop(F.when(both, y)) * F.count(F.when(both, y)), F.lit(0.0)
        )
    if name == "mape":
        used = F.abs(y) >= epsilon
        return F.avg(F.when(used, F.abs(e / F.when(used, y)))) * 100
    if name == "mape_coverage":
        return F.avg((F.abs(y) >= epsilon).cast("double"))
    if name == "smape":
        den = (F.abs(y) + F.abs(p)) / 2
        return F.avg(F.when(den >= epsilon, F.abs(e) / F.when(den >= epsilon, den)).otherwise(0.0)) * 100
    raise ValueError(f"unknown metric {name}")


def zero_baseline(name: str, truth: str | Column) -> Column:
    """The metric of predicting zero everywhere."""
    return metric(name, truth, F.lit(0.0))


def class_metrics(truth: str, proba: str, threshold: float = 0.5) -> dict[str, Column]:
    """log loss (probabilities clipped to 1e-15), accuracy and F1 as aggregate expressions."""
    y, p = F.col(truth).cast("double"), F.col(proba)
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0 - 1e-15))
    hit = p >= threshold
    tp = F.count_if(hit & (y == 1))
    fp = F.count_if(hit & (y == 0))
    fn = F.count_if(~hit & (y == 1))
    return {
        "logloss": -F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q)),
        "accuracy": F.avg((hit.cast("double") == y).cast("double")),
        "f1": F.coalesce(safe_div(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0)),
    }


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve from rank sums with shared ranks for ties. Ranks are those of distinct scores, placed by
    distributed positions."""
    per = df.filter(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(
        F.col(score).cast("double").alias("_s")
    ).agg(F.count_if(F.col(truth) == 1).alias("_pos"))
    rows = df.filter(F.col(score).isNotNull() & F.col(truth).isNotNull()).select(F.col(score).alias("_s"))
    pos = value_positions(rows, "_s")
    j = per.join(pos, "_s").agg(
        F.sum(F.col("_pos") * (F.col("_lo") + 1 + F.col("_hi")) / 2.0).alias("r"),
        F.sum("_pos").cast("double").alias("p"),
        F.max("_total").cast("double").alias("n"),
    )
    p, n = F.col("p"), F.col("n")
    return j.select(
        safe_div(F.col("r") - p * (p + 1) / 2, p * (n - p)).alias("auc"),
        p.cast("bigint").alias("positives"),
        (n - p).cast("bigint").alias("negatives"),
    )


def weighted_rmsle(truth: str, pred: str, weight: str) -> Column:
    d = _log_clip(F.col(truth)) - _log_clip(F.col(pred))
    return F.sqrt(F.sum(F.col(weight) * d * d) / F.nullif(F.sum(F.when(d.isNotNull(), F.col(weight))), F.lit(0.0)))


def regime_score(df: DataFrame, truth: str, pred: str, cold: str, cold_share: float = 0.2216) -> DataFrame:
    """Overall, warm and cold RMSLE, and the two combined in square space at the target cold share."""
    is_cold = F.col(cold) == 1

    def score(cond: Column | None) -> Column:
        y = F.col(truth) if cond is None else F.when(cond, F.col(truth))
        return metric("rmsle", y, F.col(pred))

    s = df.agg(score(None).alias("overall"), score(~is_cold).alias("warm"), score(is_cold).alias("cold"))
    return s.withColumn(
        "reweighted",
        F.sqrt(F.lit(1 - cold_share) * F.col("warm") * F.col("warm") + F.lit(cold_share) * F.col("cold") * F.col("cold")),
    )


def threshold_table(df: DataFrame, truth: str, proba: str, steps: int = 200) -> DataFrame:
    """F1 and accuracy at every threshold of the grid 0.01..0.99 plus 0.5.

    Rows fall once into the grid cell of their probability; the curve is a running sum over at most steps + 2 cells.
    """
    grid = sorted({0.01 + (0.99 - 0.01) * i / (steps - 1) for i in range(steps)} | {0.5})
    edges = F.array(*[F.lit(g) for g in grid])
    cells = (
        df.filter(F.col(truth).isNotNull() & F.col(proba).isNotNull())
        .withColumn("_g", edges)
        .withColumn("_cell", F.size(F.filter("_g", lambda g: g <= F.col(proba))))
        .groupBy("_cell")
        .agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    )
    # one row, at most steps + 2 entries
    hist = cells.agg(F.collect_list(F.struct("_cell", "p", "n")).alias("h"))
    rows = hist.select(F.col("h"), F.posexplode(edges).alias("i", "threshold"))

    def total(field: str, above: bool) -> Column:
        keep = F.filter("h", lambda x: (x["_cell"] > F.col("i")) if above else (x["_cell"] <= F.col("i")))
        return F.aggregate(F.transform(keep, lambda x: x[field]), F.lit(0).cast("bigint"), lambda a, x: a + x)

    t = rows.select(
        "threshold",
        total("p", True).alias("tp"),
        total("n", True).alias("fp"),
        total("p", False).alias("fn"),
        total("n", False).alias("tn"),
    )
    return t.select(
        "threshold",
        F.coalesce(safe_div(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"),
        safe_div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
    )


def best_threshold(df: DataFrame, truth: str, proba: str, by: str = "f1", steps: int = 200) -> DataFrame:
    """The best threshold; scores within 1e-8 + 1e-5 of the best count as ties and the one nearest to 0.5 wins."""
    table = threshold_table(df, truth, proba, steps)
    top = table.agg(F.max(by).alias("m")).scalar()
    near = table.withColumn("_m", top).filter(F.col("_m") - F.col(by) <= 1e-8 + 1e-5 * F.abs(F.col("_m")))
    at_half = table.filter(F.col("threshold") == 0.5).agg(F.max(by).alias("h")).scalar()
    return near.agg(
        F.min_by(F.struct("threshold", F.col(by).alias("s")), F.struct(F.abs(F.col("threshold") - 0.5), "threshold")).alias("b")
    ).select(F.col("b.threshold").alias("best_threshold"), F.col("b.s").alias("best_score")).withColumn(
        "score_at_half", at_half
    )


MULTIPLIERS = tuple(round(0.90 + 0.01 * i, 6) for i in range(16))


def multiplier_scan(
    df: DataFrame, truth: str, pred: str, by: str = "mae", grid: Sequence[float] = MULTIPLIERS
) -> DataFrame:
    """Score of every multiplier of the predictions (1.0 always included) in one aggregate."""
    values = sorted({round(float(g), 6) for g in grid} | {1.0})
    scores = df.agg(*[metric(by, truth, F.col(pred) * F.lit(m)).alias(f"s{i}") for i, m in enumerate(values)])
    items = [F.struct(F.lit(m).alias("multiplier"), F.col(f"s{i}").alias("score")) for i, m in enumerate(values)]
    table = scores.select(F.inline(F.array(*items)))
    better = F.col("score") if by not in GREATER_IS_BETTER else -F.col("score")
    best = table.agg(F.min_by("multiplier", F.struct(better, "multiplier")).alias("b")).scalar()
    return table.withColumn("_b", best).select(
        "multiplier", "score", (F.col("multiplier") == F.col("_b")).cast("int").alias("best")
    )


def error_by_segment(
    df: DataFrame, segment: Sequence[str], truth: str, pred: str, by: str = "mae", min_count: int = 20
) -> DataFrame:
    y, p = F.col(truth), F.col(pred)
    known = df
    for s in segment:
        known = known.filter(F.col(s).isNotNull())
    return (
        known.groupBy(*segment)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            metric(by, truth, pred).alias(by),
            F.avg(y).alias("truth_mean"),
            F.avg(p).alias("pred_mean"),
            F.avg(p - y).alias("bias"),
        )
        .filter(F.col("rows") >= min_count)
    )


# Cumulative probabilities of the Poisson distribution with mean 1, counts 0..12.
POISSON_ONE_CDF = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020, 0.9999998885745217,
    0.9999999899522336, 0.9999999991683892, 0.9999999999364022,
)


def bootstrap_gate(
    df: DataFrame,
    entity: str,
    base_error: str,
    new_error: str,
    replicates: int = 1000,
    seed: int = 7,
    min_improved: float = 0.60,
) -> DataFrame:
    """Entity-clustered bootstrap of the change in mean squared error: interval, share of improved entities and rows, and
    the pass rule (interval below zero and enough entities improved).

    Entities enter each replicate with a Poisson(1) count drawn from a hash of entity, replicate and seed, so no
    resampling moves data: map-side sums per replicate, then one row per replicate.
    """
    change = F.col(new_error) - F.col(base_error)
    per = df.groupBy(entity).agg(F.sum(change).alias("d"), F.count(F.lit(1)).cast("double").alias("n"))
    u = F.pmod(F.xxhash64(F.col(entity), F.col("r"), F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    count = F.lit(0)
    for edge in POISSON_ONE_CDF:
        count = count + (u >= edge).cast("int")
    drawn = per.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("k", count)
    dist = (
        drawn.filter(F.col("k") > 0)
        .groupBy("r")
        .agg(safe_div(F.sum(F.col("k") * F.col("d")), F.sum(F.col("k") * F.col("n"))).alias("x"))
    )
    ci = dist.agg(
        F.percentile("x", F.lit(0.025)).alias("ci_low"),
        F.percentile("x", F.lit(0.975)).alias("ci_high"),
        F.avg((F.col("x") < 0).cast("double")).alias("p_improved"),
    )
    point = per.agg(
        F.struct(
            safe_div(F.sum("d"), F.sum("n")).alias("dmse"),
            F.avg((F.col("d") < 0).cast("double")).alias("improved_entities"),
            safe_div(F.sum(F.when(F.col("d") < 0, F.col("n")).otherwise(0.0)), F.sum("n")).alias("improved_rows"),
            F.count(F.lit(1)).alias("entities"),
        ).alias("p")
    ).scalar()
    out = ci.withColumn("_p", point).select("_p.*", "ci_low", "ci_high", "p_improved")
    return out.withColumn(
        "passed",
        ((F.col("ci_low") < 0) & (F.col("ci_high") < 0) & (F.col("improved_entities") >= min_improved)).cast("int"),
    )


def calibration_bins(df: DataFrame, truth: str, pred: str, bins: int = 10) -> DataFrame:
    """Rows, mean prediction, mean truth and gap per quantile bin of the prediction; equal edges merge. The edges are
    exact quantiles from distributed positions."""
    names = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(df, pred, names).select(
        F.array_sort(F.array_distinct(F.array(*names))).alias("e")
    ).scalar()
    # bin i is (e[i-1], e[i]], the first one closed on both sides
    binned = df.filter(F.col(pred).isNotNull()).withColumn("_e", edges).withColumn(
        "bin", F.greatest(F.size(F.filter("_e", lambda e: e < F.col(pred))), F.lit(1))
    )
    return binned.groupBy("bin").agg(
        F.count(truth).alias("rows"),
        F.avg(pred).alias("pred_mean"),
        F.avg(truth).alias("truth_mean"),
    ).withColumn("gap", F.col("pred_mean") - F.col("truth_mean"))


def calibration_slope(df: DataFrame, truth: str, pred: str, regime: Sequence[str]) -> DataFrame:
    """Slope and intercept of truth on prediction per regime, variance of the prediction and the error a slope below 1
    would save."""
    both = F.col(truth).isNotNull() & F.col(pred).isNotNull()
    s = df.filter(both).groupBy(*regime).agg(
        F.count(F.lit(1)).alias("rows"),
        F.regr_slope(truth, pred).alias("slope"),
        F.regr_intercept(truth, pred).alias("intercept"),
        F.var_pop(pred).alias("pred_var"),
    )
    gain = F.when(F.col("slope") < 1, F.pow(1 - F.col("slope"), 2) * F.col("pred_var")).otherwise(0.0)
    return s.withColumn("possible_gain", gain)


def cross_block_shrinkage(
    df: DataFrame, truth: str, pred: str, block: str, regime: str, min_rows: int = 100
) -> DataFrame:
    """Slope and intercept per (block, regime) fitted on the other blocks: sums of everything minus the block's own."""
    x, y = F.col(pred), F.col(truth)
    per = (
        df.filter(x.isNotNull() & y.isNotNull())
        .groupBy(block, regime)
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.sum(x).alias("sx"),
            F.sum(y).alias("sy"),
            F.sum(x * x).alias("sxx"),
            F.sum(x * y).alias("sxy"),
        )
    )
    names = ("n", "sx", "sy", "sxx", "sxy")
    tot = per.groupBy(regime).agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    o = per.join(tot, regime).select(block, regime, *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in names])
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(
        F.col("n") >= min_rows, safe_div(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), det)
    )
    return o.select(
        block,
        regime,
        F.col("n").cast("bigint").alias("other_rows"),
        slope.alias("slope"),
        safe_div(F.col("sy") - slope * F.col("sx"), F.col("n")).alias("intercept"),
    )


def fold_score_table(df: DataFrame, fold: str, truth: str, pred: str, by: str = "rmse") -> DataFrame:
    """One row per fold, their mean and standard deviation (ddof 0), and the score of all rows together."""
    s = df.groupingSets([[F.col(fold)], []], F.col(fold)).agg(
        metric(by, truth, pred).alias("score"), F.grouping(fold).alias("_all")
    )
    folds = s.filter(F.col("_all") == 0).select(F.col(fold).cast("string").alias("fold"), "score")
    spread = folds.agg(
        F.inline(
            F.array(
                F.struct(F.lit("mean").alias("fold"), F.avg("score").alias("score")),
                F.struct(F.lit("std").alias("fold"), F.stddev_pop("score").alias("score")),
            )
        )
    )
    whole = s.filter(F.col("_all") == 1).select(F.lit("all rows").alias("fold"), "score")
    return folds.unionByName(spread).unionByName(whole)


def business_impact(df: DataFrame, truth: str, pred: str, baseline: str | None = None, unit_cost: float = 1.0) -> DataFrame:
    """Model and baseline MAE (baseline: the overall mean unless a column is given), improvement, over / under totals."""
    base = F.col(baseline) if baseline else df.agg(F.avg(truth).alias("m")).scalar()
    r = F.col(pred) - F.col(truth)
    s = df.withColumn("_base", base).agg(
        F.avg(F.abs(r)).alias("model_mae"),
        F.avg(F.abs(F.col("_base") - F.col(truth))).alias("baseline_mae"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("over_total"),
        F.coalesce(F.sum(F.when(r < 0, -r)), F.lit(0.0)).alias("under_total"),
        F.count(F.lit(1)).alias("rows"),
    )
    saved = (F.col("baseline_mae") - F.col("model_mae")) * F.col("rows")
    return s.select(
        "model_mae",
        "baseline_mae",
        F.coalesce(
            safe_div((F.col("baseline_mae") - F.col("model_mae")) * 100, "baseline_mae"), F.lit(0.0)
        ).alias("improvement_pct"),
        "over_total",
        "under_total",
        saved.alias("saved_units"),
        (saved * F.lit(float(unit_cost))).alias("saved_cost"),
    )


def prediction_timeline(df: DataFrame, time: str, truth: str, pred: str, period: str = "day") -> DataFrame:
    return (
        df.filter(F.col(time).isNotNull())
        .groupBy(F.to_date(F.date_trunc(period, time)).alias("period"))
        .agg(F.avg(truth).alias("truth_mean"), F.avg(pred).alias("pred_mean"), F.count(F.lit(1)).alias("rows"))
    )


def seed_variance(
    df: DataFrame, runs: Sequence[str], regime: str, seeds_per_run: int = 1, ks: Sequence[int] = (3, 6, 9)
) -> DataFrame:
    """Mean over rows of the variance (ddof 1) of log1p predictions between runs, scaled to one seed, and projected
    sigma^2 / k, per regime and for all rows."""
    if len(runs) < 2:
        raise ValueError("at least two runs are needed")
    logs = [F.log1p(F.col(r)) for r in runs]
    mean = sum(logs[1:], logs[0]) / float(len(runs))
    var = sum([(x - mean) * (x - mean) for x in logs[1:]], (logs[0] - mean) * (logs[0] - mean)) / float(len(runs) - 1)
    s = df.withColumn("_v", var).groupingSets([[F.col(regime)], []], F.col(regime)).agg(
        F.avg("_v").alias("run_variance"), F.count(F.lit(1)).alias("rows"), F.grouping(regime).alias("_all")
    )
    sigma2 = F.col("run_variance") * seeds_per_run
    return s.select(
        F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(regime).cast("string")).alias("regime"),
        "rows",
        "run_variance",
        sigma2.alias("seed_variance"),
        *[(sigma2 / float(k)).alias(f"mse_k{k}") for k in ks],
    )


def error_decomposition(df: DataFrame, entity: str, truth: str, pred: str) -> DataFrame:
    """Log-space MSE = bias^2 + between-entity + within-entity, from three sums per entity."""
    e = _log_clip(F.col(truth)) - _log_clip(F.col(pred))
    per = df.withColumn("_e", e).groupBy(entity).agg(
        F.sum("_e").alias("s"), F.sum(F.col("_e") * F.col("_e")).alias("ss"), F.count("_e").alias("n")
    )
    t = per.agg(
        F.sum("s").alias("S"),
        F.sum("ss").alias("SS"),
        F.sum("n").alias("N"),
        F.sum(F.col("s") * F.col("s") / F.nullif(F.col("n").cast("double"), F.lit(0.0))).alias("B"),
    )
    mean = F.col("S") / F.col("N")
    return t.select(
        (F.col("SS") / F.col("N")).alias("mse"),
        (mean * mean).alias("bias_sq"),
        (F.col("B") / F.col("N") - mean * mean).alias("between_entity"),
        ((F.col("SS") - F.col("B")) / F.col("N")).alias("within_entity"),
    )


def _top_share(values: DataFrame, value: str, shares: Sequence[float], label: str) -> DataFrame:
    """Share of the total held by the largest int(n * q) values (at least one), from positions."""
    pos = value_positions(values, value)
    total = F.sum(F.col(value) * (F.col("_hi") - F.col("_lo")))
    aggs = []
    for q in shares:
        k = F.greatest(F.lit(1), F.floor(F.col("_total") * F.lit(float(q))))
        inside = F.greatest(F.lit(0), F.col("_hi") - F.greatest(F.col("_lo"), F.col("_total") - k))
        aggs.append(safe_div(F.sum(F.col(value) * inside), total).alias(f"q{q:g}"))
    one = pos.agg(*aggs)
    items = [
        F.struct(F.lit(label).alias("unit"), F.lit(float(q)).alias("worst_share"), F.col(f"`q{q:g}`").alias("error_share"))
        for q in shares
    ]
    return one.select(F.inline(F.array(*items)))


def error_concentration(
    df: DataFrame,
    entity: str,
    truth: str,
    pred: str,
    entity_shares: Sequence[float] = (0.01, 0.05, 0.10, 0.25),
    row_shares: Sequence[float] = (0.01, 0.10),
) -> DataFrame:
    """Share of the squared log error carried by the worst entities and the worst rows."""
    e = _log_clip(F.col(truth)) - _log_clip(F.col(pred))
    rows = df.select(entity, (e * e).alias("e2"))
    per = rows.groupBy(entity).agg(F.sum("e2").alias("e2"))
    return _top_share(per, "e2", entity_shares, "entity").unionByName(_top_share(rows, "e2", row_shares, "row"))


def error_by_value_band(df: DataFrame, truth: str, pred: str, edges: Sequence[float] = (0, 10, 100)) -> DataFrame:
    """Rows, bias, MSE, and shares of error and rows by band of the true value: at most the first edge, then below each
    next edge, then the rest."""
    y = F.col(truth)
    band = F.when(y <= edges[0], F.lit(f"<={edges[0]:g}"))
    for lo, hi in zip(edges, edges[1:], strict=False):
        band = band.when(y < hi, F.lit(f"{lo:g}..{hi:g}"))
    band = band.otherwise(F.lit(f">={edges[-1]:g}"))
    e = _log_clip(y) - _log_clip(F.col(pred))
    per = df.withColumns({"band": band, "_e": e}).groupBy("band").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("_e").alias("bias"),
        F.avg(F.col("_e") * F.col("_e")).alias("mse"),
        F.sum(F.col("_e") * F.col("_e")).alias("_s"),
    )
    t = per.agg(F.struct(F.sum("_s").alias("s"), F.sum("rows").alias("n")).alias("t")).scalar()
    return per.withColumn("_t", t).select(
        "band", "rows", "bias", "mse", safe_div("_s", "_t.s").alias("error_share"), safe_div("rows", "_t.n").alias("row_share")
    )
