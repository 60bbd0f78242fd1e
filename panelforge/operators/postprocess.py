"""Post-processing of prediction tables: shrinkage, shifts, day profiles, dead entities, hurdles and calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.exprs import safe_div
from panelforge.core.scale import bucket_of, cut_lineage, day_table, exact_quantiles, join_checked, range_buckets, written
from panelforge.operators.aggregates import two_way_effects
from panelforge.operators.metrics import metric


def log_of(pred: str | Column) -> Column:
    p = F.col(pred) if isinstance(pred, str) else pred
    return F.log1p(F.greatest(p, F.lit(0.0)))


def back(log_value: Column) -> Column:
    return F.greatest(F.expm1(log_value), F.lit(0.0))


def shrink_cold(df: DataFrame, pred: str, capacity: str, cold: str, out: str, beta: float = 0.60) -> DataFrame:
    """Cold rows move towards the cold mean in offset space; warm rows keep their value bit for bit."""
    offset = log_of(pred) - F.log1p(F.col(capacity))
    mean = df.filter(F.col(cold) == 1).agg(F.avg(offset).alias("m")).scalar()
    moved = F.col("_m") + F.lit(beta) * (offset - F.col("_m")) + F.log1p(F.col(capacity))
    return (
        df.withColumn("_m", mean)
        .withColumn(out, F.when(F.col(cold) == 1, back(moved)).otherwise(F.col(pred)))
        .drop("_m")
    )


def rescale_day_profile(
    df: DataFrame,
    entity: str,
    day: str,
    pred: str,
    out: str,
    factor: float,
    min_age: int = 7,
    min_rows: int = 60,
) -> DataFrame:
    """Adds (factor - 1) times the centred day effect of the log predictions. The effect is fitted on entities with
    enough rows, leaving out their first days."""
    rows = Window.partitionBy(entity)
    d = F.to_date(day)
    marked = df.withColumns(
        {
            "_lg": log_of(pred),
            "_age": F.datediff(d, F.min(d).over(rows)),
            "_n": F.count(F.lit(1)).over(rows),
        }
    )
    clean = marked.filter((F.col("_age") >= min_age) & (F.col("_n") >= min_rows)).select(
        entity, d.alias("_day"), "_lg"
    )
    effects = two_way_effects(clean, entity, "_day", "_lg")
    joined = marked.withColumn("_day", d).join(day_table(effects), "_day", "left")
    joined = joined.withColumn("_e", F.coalesce("day_effect", F.lit(0.0)))
    centre = joined.agg(F.avg("_e").alias("c")).scalar()
    return (
        joined.withColumn("_c", centre)
        .withColumn(out, back(F.col("_lg") + F.lit(factor - 1.0) * (F.col("_e") - F.col("_c"))))
        .drop("_lg", "_age", "_n", "_day", "day_effect", "_e", "_c")
    )


def regime_shift(pred: str, shifts: Sequence[tuple[Column, float]], default: float = 0.0) -> Column:
    """Constant log shift per disjoint mask, `default` elsewhere; overlapping masks fail the query."""
    hits = F.lit(0)
    for mask, _ in shifts:
        hits = hits + F.coalesce(mask, F.lit(False)).cast("int")
    delta = F.lit(float(default))
    for mask, d in reversed(list(shifts)):
        delta = F.when(F.coalesce(mask, F.lit(False)), F.lit(float(d))).otherwise(delta)
    return F.when(hits > 1, F.raise_error(F.lit("regime masks overlap")).cast("double")).otherwise(
        back(log_of(pred) + delta)
    )


def event_day_correction(pred: str, capacity: str, groups: Sequence[tuple[Column, float]]) -> Column:
    """Log-offset shift of the row's groups; where groups overlap the largest amplitude wins, the earlier one on a tie."""
    options = F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(mask, F.lit(False)),
                    F.struct(F.lit(abs(s)).alias("a"), F.lit(-i).alias("o"), F.lit(float(s)).alias("s")),
                )
                for i, (mask, s) in enumerate(groups)
            ]
        )
    )
    shift = F.coalesce(F.array_max(options)["s"], F.lit(0.0))
    cap = F.log1p(F.col(capacity))
    return F.when(shift == 0, F.col(pred)).otherwise(back(log_of(pred) - cap + shift + cap))


def zero_dead(pred: str, tail_zero_run: str, last_row_age: str, zero_share: str) -> Column:
    dead = (F.col(tail_zero_run) >= 14) & (F.col(last_row_age) >= 14) & (F.col(zero_share) >= 0.9)
    return F.when(F.coalesce(dead, F.lit(False)), F.lit(0.0)).otherwise(F.col(pred))


# Horizon bucket edges in days.
HORIZON_EDGES = (0, 15, 30, 45, 60, 75, 90, 105, 123)


def horizon_bucket(horizon: str, edges: Sequence[float]) -> Column:
    """Index of the half-open bucket [edge_i, edge_i+1); outside values go to the first or last one."""
    h = F.col(horizon)
    out = F.lit(0)
    for e in edges[1:-1]:
        out = out + (h >= e).cast("int")
    return out


def naive_weights(
    df: DataFrame, horizon: str, edges: Sequence[float], truth: str, recent: str, level: str, min_rows: int = 500
) -> DataFrame:
    """Per horizon bucket the w in [0, 1] that minimises (y - (w * recent + (1 - w) * level))^2 in log space; 0.5 below
    `min_rows` pairs."""
    y = log_of(truth)
    a, b = F.col(recent), F.col(level)
    inside = (F.col(horizon) >= edges[0]) & (F.col(horizon) < edges[-1])
    ok = df.filter(a.isNotNull() & b.isNotNull() & inside).withColumn("bucket", horizon_bucket(horizon, edges))
    sums = ok.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((a - b) * (y - b)).alias("_p"),
        F.sum((a - b) * (a - b)).alias("_q"),
    )
    w = F.when((F.col("rows") < min_rows) | (F.col("_q") <= 0), F.lit(0.5)).otherwise(safe_div("_p", "_q"))
    found = sums.withColumn("weight", F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))).select("bucket", "rows", "weight")
    spark = df.sparkSession
    every = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(found, "bucket", "left").select(
        "bucket", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("weight", F.lit(0.5)).alias("weight")
    )


def naive_blend(
    df: DataFrame, weights: DataFrame, horizon: str, edges: Sequence[float], recent: str, level: str, out: str
) -> DataFrame:
    # one weight per bucket of a caller-given list
    w = F.broadcast(weights.select(F.col("bucket").alias("_b"), F.col("weight").alias("_w")))
    joined = df.withColumn("_b", horizon_bucket(horizon, edges)).join(w, "_b", "left")
    return joined.withColumn(
        out, F.col("_w") * F.col(recent) + (1.0 - F.col("_w")) * F.col(level)
    ).drop("_b", "_w")


# ---- hurdle ---------------------------------------------------------------------------------------------------------


def hurdle(probability: str, magnitude: str, threshold: float | None = None) -> Column:
    """Expected value p * m, or m where p reaches the threshold."""
    m = F.greatest(F.col(magnitude).cast("double"), F.lit(0.0))
    if threshold is None:
        return F.col(probability) * m
    return F.when(F.col(probability) >= F.lit(float(threshold)), m).otherwise(F.lit(0.0))


def tune_hurdle(df: DataFrame, truth: str, probability: str, magnitude: str, steps: int = 200) -> DataFrame:
    """MAE of every threshold 0.01..0.99 from one histogram, the best (smallest) one, and the scores at 0.5, of the
    expected value and of all zeros."""
    grid = [0.01 + (0.99 - 0.01) * i / (steps - 1) for i in range(steps)]
    edges = F.array(*[F.lit(g) for g in grid])
    y, m = F.col(truth), F.greatest(F.col(magnitude).cast("double"), F.lit(0.0))
    cells = (
        df.withColumn("_g", edges)
        .withColumn("_cell", F.size(F.filter("_g", lambda g: g <= F.col(probability))))
        .groupBy("_cell")
        .agg(
            F.sum(F.abs(y - m)).alias("hit"),
            F.sum(F.abs(y)).alias("miss"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    # at most steps + 1 cells from here on
    hist = cells.agg(F.collect_list(F.struct("_cell", "hit", "miss", "n")).alias("h"))
    rows = hist.select("h", F.posexplode(edges).alias("i", "threshold"))

    def total(field: str, above: bool | None) -> Column:
        keep = (
            F.col("h")
            if above is None
            else F.filter("h", lambda x: (x["_cell"] > F.col("i")) if above else (x["_cell"] <= F.col("i")))
        )
        return F.aggregate(F.transform(keep, lambda x: x[field].cast("double")), F.lit(0.0), lambda a, x: a + x)

    table = rows.select("threshold", ((total("hit", True) + total("miss", False)) / total("n", None)).alias("mae"))
    best = table.agg(F.min_by(F.struct("threshold", "mae"), F.struct("mae", "threshold")).alias("b"))
    others = df.agg(
        F.struct(
            metric("mae", truth, hurdle(probability, magnitude, 0.5)).alias("score_at_half"),
            metric("mae", truth, hurdle(probability, magnitude)).alias("score_expected"),
            metric("mae", truth, F.lit(0.0)).alias("score_all_zero"),
        ).alias("o")
    ).scalar()
    return best.withColumn("_o", others).select(
        F.col("b.threshold").alias("best_threshold"), F.col("b.mae").alias("best_score"), "_o.*"
    )


def mae_optimal_quantile(probability: str | Column) -> Column:
    """q* = 1 - 0.5 / p; NULL where it is not positive."""
    p = F.col(probability) if isinstance(probability, str) else probability
    q = F.when(p > 0, 1.0 - 0.5 / F.when(p > 0, p))
    return F.when(q > 0, q)


def quantile_from_ladder(probability: str, ladder: Mapping[float, str]) -> Column:
    """The ladder interpolated at q*, clipped to its range; 0 where the optimal prediction is 0."""
    levels = sorted(ladder)
    q = mae_optimal_quantile(probability)
    value = F.col(ladder[levels[-1]]).cast("double")
    for lo, hi in reversed(list(zip(levels, levels[1:], strict=False))):
        a, b = F.col(ladder[lo]), F.col(ladder[hi])
        value = F.when(q <= hi, a + (b - a) * (q - F.lit(lo)) / F.lit(hi - lo)).otherwise(value)
    value = F.when(q <= levels[0], F.col(ladder[levels[0]])).otherwise(value)
    return F.when(q.isNull(), F.lit(0.0)).otherwise(F.greatest(value, F.lit(0.0)))


def calibrate_probability(
    df: DataFrame, probability: str, target: str, fold: str, out: str
) -> tuple[DataFrame, dict]:
    """Isotonic calibration of each fold on the other folds, with the Brier score before and after.

    Rows collapse to one weighted point per distinct probability and fold before MLlib fits; a fold whose
    other folds hold one class keeps its probabilities.
    """
    from pyspark.ml.regression import IsotonicRegression

    y = (F.col(target) > 0).cast("double")
    points = cut_lineage(
        df.filter(F.col(probability).isNotNull() & F.col(target).isNotNull())
        .groupBy(fold, F.col(probability).cast("double").alias("features"))
        .agg(F.avg(y).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    )
    folds = sorted(r[fold] for r in points.select(fold).distinct().collect())
    parts = []
    for f in folds:
        mine = points.filter(F.col(fold) == F.lit(f)).select(fold, "features")
        rest = points.filter(F.col(fold) != F.lit(f))
        span = rest.agg(F.sum(F.col("label") * F.col("weight")).alias("p"), F.sum("weight").alias("n")).first()
        if not span["n"] or span["p"] in (0.0, span["n"]):
            parts.append(mine.withColumn(out, F.col("features")))
            continue
        model = IsotonicRegression(featuresCol="features", labelCol="label", weightCol="weight").fit(rest)
        fitted = model.setPredictionCol("_p").transform(mine)
        parts.append(
            fitted.select(fold, "features", F.least(F.greatest("_p", F.lit(0.0)), F.lit(1.0)).alias(out))
        )
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    keyed = df.withColumn("features", F.col(probability).cast("double"))
    done = join_checked(keyed, table, [fold, "features"]).drop("features")
    a, b = F.col(probability) - y, F.col(out) - y
    s = done.agg(F.avg(a * a).alias("before"), F.avg(b * b).alias("after")).first()
    return done, {"brier_before": s["before"], "brier_after": s["after"], "improved": s["after"] < s["before"]}


# ---- residual corrections -------------------------------------------------------------------------------------------


def group_residual_offset(
    df: DataFrame, block: str, group: str, residual: str, out: str, n0: float = 200.0, clip: float = 0.5
) -> DataFrame:
    """Leave-one-block-out mean residual of the row's group, shrunk by n / (n + n0), centred in the block and clipped.
    Residuals are centred in their own block first. All of it happens on the (block, group) table."""
    per = cut_lineage(df.groupBy(block, group).agg(F.sum(residual).alias("s"), F.count(residual).alias("n")))
    # one row per block
    blocks = F.broadcast(per.groupBy(block).agg((F.sum("s") / F.sum("n")).alias("_bm")))
    centred = per.join(blocks, block).withColumn("c", F.col("s") - F.col("n") * F.col("_bm")).drop("_bm")
    groups = centred.groupBy(group).agg(F.sum("c").alias("_gc"), F.sum("n").alias("_gn"))
    both = centred.join(groups, group)
    other_c, other_n = F.col("_gc") - F.col("c"), F.col("_gn") - F.col("n")
    raw = both.withColumn("d", F.when(other_n > 0, other_c / (other_n + n0)).otherwise(0.0))
    means = F.broadcast(raw.groupBy(block).agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("_dm")))
    table = raw.join(means, block).select(
        block, group, F.least(F.greatest(F.col("d") - F.col("_dm"), F.lit(-clip)), F.lit(clip)).alias(out)
    )
    return join_checked(df, table, [block, group])


def quantile_bin_offset(
    df: DataFrame, block: str, pred: str, residual: str, out: str, bins: int = 40, n0: float = 200.0
) -> DataFrame:
    """The same correction by prediction quantile bin: each block's own quantile edges, the other blocks' residuals.

    Edges and predictions are merged once, in ranges of the prediction. Running sums over all rows, read at a block's edges,
    give what all blocks have in each of its bins; its own part is taken off. A row's own bin is the number of its block's
    edges so far. No row is copied for another block, and neither the plan nor the driver knows how many blocks there are.
    """
    names = {f"q{i}": i / bins for i in range(1, bins)}
    buckets = range_buckets(df.sparkSession)
    value = F.coalesce(F.col(pred).cast("double"), F.lit(float("-inf")))  # without a prediction: below all edges
    sketch = F.percentile_approx(F.col(pred).cast("double"), [i / buckets for i in range(1, buckets)], 10 * buckets)
    bounds = cut_lineage(df.agg(sketch.alias("_bounds")))  # one row

    def ranged(rows: DataFrame) -> DataFrame:
        return bucket_of(rows.crossJoin(F.broadcast(bounds)), "_v", "_bounds", buckets, "_range")

    quantiles = exact_quantiles(df, pred, names, [block])
    edges = quantiles.select(block, F.posexplode(F.array(*[F.col(n) for n in names])).alias("_k", "_v")).filter("_v IS NOT NULL")
    edges = cut_lineage(ranged(edges.withColumn("_k", F.col("_k") + 1)))
    mean_by_block = df.groupBy(block).agg(F.avg(residual).alias("_mr"))
    rows = join_checked(df.filter(F.col(block).isNotNull()), mean_by_block, [block])
    rows = ranged(rows.withColumns({"_v": value, "_e": F.col(residual) - F.col("_mr")})).drop("_mr")

    # a row's bin: its block's edges at or below it (an edge comes before the rows on it)
    both = rows.withColumn("_k", F.lit(None).cast("int"))
    both = both.unionByName(edges.select(*[c if c in edges.columns else F.lit(None).cast(t).alias(c) for c, t in both.dtypes]))
    along = Window.partitionBy(block, "_range").orderBy("_v", F.col("_k").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    per_range = edges.groupBy(block, "_range").agg(F.max("_k").alias("_upto"))
    # one row per range that has edges of the block
    starts = per_range.select(block, F.col("_range").alias("_from"), "_upto")
    placed = both.withColumn("_inside", F.max("_k").over(along)).filter(F.col("_k").isNull()).drop("_k")
    ladder = starts.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("_from", "_upto"))).alias("_ladder"))
    placed = join_checked(placed, ladder, [block])
    before = F.array_max(F.transform(F.filter("_ladder", lambda x: x["_from"] < F.col("_range")), lambda x: x["_upto"]))
    placed = placed.withColumn("_bin", F.coalesce("_inside", before, F.lit(0))).drop("_inside", "_ladder", "_range", "_v")
    placed = cut_lineage(placed)
    own = placed.groupBy(block, "_bin").agg(F.sum("_e").alias("_own_s"), F.count("_e").alias("_own_n"))

    # what all blocks have below each edge
    sums = rows.groupBy("_range", "_v").agg(F.sum("_e").alias("_s"), F.count("_e").alias("_n"))
    merged = sums.withColumns({block: F.lit(None).cast(dict(df.dtypes)[block]), "_k": F.lit(None).cast("int")})
    merged = merged.unionByName(edges.withColumns({"_s": F.lit(None).cast("double"), "_n": F.lit(None).cast("long")}))
    below = Window.partitionBy("_range").orderBy("_v", F.col("_k").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    per = sums.groupBy("_range").agg(F.sum("_s").alias("_rs"), F.sum("_n").alias("_rn"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    ahead = F.sequence(F.lit(0), F.lit(buckets - 1))
    every = df.sparkSession.range(1).select(F.explode(ahead).alias("_range")).join(per, "_range", "left")
    offsets = every.select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(o) for c, o in (("_rs", "_os"), ("_rn", "_on"))))
    at = merged.withColumns({"_s": F.sum("_s").over(below), "_n": F.sum("_n").over(below)}).filter(F.col("_k").isNotNull())
    at = join_checked(at, offsets, ["_range"]).select(
        block, "_k", (F.coalesce("_s", F.lit(0.0)) + F.col("_os")).alias("_s"), (F.coalesce("_n", F.lit(0)) + F.col("_on")).alias("_n")
    )
    whole = per.agg(F.struct(F.sum("_rs").alias("s"), F.sum("_rn").alias("n")).alias("t")).scalar()
    floor = mean_by_block.filter(F.col(block).isNotNull()).select(block, F.lit(0).alias("_k"), F.lit(0.0).alias("_s"), F.lit(0).cast("long").alias("_n"))
    steps = floor.unionByName(at).withColumn("_t", whole)
    upward = Window.partitionBy(block).orderBy("_k")  # `bins` rows
    table = steps.select(
        block,
        F.col("_k").alias("_bin"),
        (F.coalesce(F.lead("_s").over(upward), F.col("_t.s")) - F.col("_s")).alias("_all_s"),
        (F.coalesce(F.lead("_n").over(upward), F.col("_t.n")) - F.col("_n")).alias("_all_n"),
    )
    table = table.join(own, [block, "_bin"], "left").na.fill(0, ["_own_s", "_own_n"])
    others = F.col("_all_n") - F.col("_own_n")
    table = table.select(block, "_bin", F.when(others > 0, (F.col("_all_s") - F.col("_own_s")) / (others + n0)).otherwise(0.0).alias("_d"))
    joined = join_checked(placed.drop("_e"), table, [block, "_bin"]).withColumn("_d", F.coalesce("_d", F.lit(0.0)))
    centre = joined.groupBy(block).agg(F.avg("_d").alias("_c"))
    return join_checked(joined, centre, [block]).withColumn(out, F.col("_d") - F.col("_c")).drop("_bin", "_d", "_c")


def group_effects(df: DataFrame, group: str, residual: str, k: float = 200.0) -> DataFrame:
    """(group mean - overall mean) * n / (n + k) per group."""
    per = df.groupBy(group).agg(F.sum(residual).alias("s"), F.count(residual).alias("n"))
    overall = per.agg((F.sum("s") / F.sum("n")).alias("m")).scalar()
    return per.withColumn("_m", overall).select(
        group, ((safe_div("s", "n") - F.col("_m")) * (F.col("n") / (F.col("n") + F.lit(k)))).alias("effect")
    )


def _entity_mean(rows: DataFrame, entity: str, value: str) -> DataFrame:
    """Rows with their entity's mean. `rows` are read twice, so callers write them first: otherwise a task computes its input
    twice in one go, four times when two of these follow each other, and holds the sorts and maps of all copies at once."""
    return rows.join(rows.groupBy(entity).agg(F.avg(value).alias("_tm")), entity)


def shrink_between(df: DataFrame, entity: str, value: str, out: str, beta: float) -> DataFrame:
    """Entity means move towards the overall mean; deviations inside the entity stay."""
    rows = written(df, "entity-rows")
    mean = rows.agg(F.avg(value).alias("m")).scalar()
    j = _entity_mean(rows, entity, value).withColumn("_m", mean)
    return j.withColumn(
        out, F.col("_m") + F.lit(beta) * (F.col("_tm") - F.col("_m")) + (F.col(value) - F.col("_tm"))
    ).drop("_m", "_tm")


def shrink_within(df: DataFrame, entity: str, value: str, out: str, beta: float) -> DataFrame:
    """Rows move towards their entity's mean."""
    j = _entity_mean(written(df, "entity-rows"), entity, value)
    return j.withColumn(out, F.col("_tm") + F.lit(beta) * (F.col(value) - F.col("_tm"))).drop("_tm")


def zero_hedge(value: str, zero_share: str, tail_zero_run: str, kappa: float, min_share: float, min_run: int) -> Column:
    """Minus kappa in log space for rows of nearly dead entities."""
    near = (F.col(zero_share) >= min_share) & (F.col(tail_zero_run) >= min_run)
    return F.when(F.coalesce(near, F.lit(False)), F.col(value) - F.lit(float(kappa))).otherwise(F.col(value))
