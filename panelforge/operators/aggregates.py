"""Group statistics, structure, hierarchical means, fixed effects and event studies."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.exprs import null_if_any_null, require_columns, safe_div, time_order
from panelforge.core.scale import average_rank, cut_lineage, day_table, exact_quantiles, join_checked

_SIMPLE = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def _refuse_target(values: Sequence[str], target: str | None) -> None:
    if target is not None and target in values:
        raise ValueError(f"{target} is the target: use the fold-safe encoders instead of group statistics")


def group_statistics(
    df: DataFrame,
    group: Sequence[str],
    values: Sequence[str],
    target: str | None,
    aggregations: Sequence[str] = ("mean", "std", "min", "max", "median"),
    reference: DataFrame | None = None,
) -> DataFrame:
    """Statistics of each group joined back, with deviation, ratio (NULL for mean 0) and z-score (NULL for std <= 0)."""
    _refuse_target(values, target)
    require_columns(df, [*group, *values])
    source = reference if reference is not None else df
    label = "_".join(group)
    aggs = [
        _SIMPLE[a](v).alias(f"{v}_by_{label}_{a}") for v in values for a in aggregations if a in _SIMPLE
    ]
    known = source
    for g in group:
        known = known.filter(F.col(g).isNotNull())
    stats = known.groupBy(*group).agg(*(aggs or [F.count(F.lit(1)).alias("_n")]))
    if "median" in aggregations:
        for v in values:
            medians = exact_quantiles(known, v, {f"{v}_by_{label}_median": 0.5}, list(group))
            stats = stats.join(medians, list(group), "left")
    out = join_checked(df, stats, list(group))
    new: dict[str, Column] = {}
    for v in values:
        if "mean" in aggregations:
            mean = F.col(f"{v}_by_{label}_mean")
            new[f"{v}_{label}_diff"] = F.col(v) - mean
            new[f"{v}_{label}_ratio"] = safe_div(v, mean)
            if "std" in aggregations:
                std = F.col(f"{v}_by_{label}_std")
                new[f"{v}_{label}_z"] = F.when(std > 0, (F.col(v) - mean) / F.nullif(std, F.lit(0.0)))
    return out.withColumns(new).drop("_n") if new else out.drop("_n")


def target_free_aggregates(
    train: DataFrame,
    test: DataFrame,
    group: Sequence[str],
    values: Sequence[str],
    target: str | None,
    aggregations: Sequence[str] = ("mean", "std", "min", "max", "median"),
) -> tuple[DataFrame, DataFrame]:
    """The same statistics of train and test together, attached to both."""
    cols = [*group, *values]
    both = train.select(*cols).unionByName(test.select(*cols))
    return (
        group_statistics(train, group, values, target, aggregations, both),
        group_statistics(test, group, values, target, aggregations, both),
    )


def district_structure(
    entities: DataFrame, entity: str, district: str, capacity: str, population: DataFrame | None = None
) -> DataFrame:
    """Per distinct entity: its district's entity count, total and median capacity, the entity's average-tie percentile
    rank and share, and people per entity and per capacity unit when a population table is given."""
    one = entities.groupBy(entity).agg(
        F.min(district).alias(district), F.min(F.col(capacity).cast("double")).alias(capacity)
    )
    totals = one.groupBy(district).agg(
        F.count(F.lit(1)).alias("district_entities"), F.sum(capacity).alias("district_capacity")
    )
    medians = exact_quantiles(one, capacity, {"district_capacity_median": 0.5}, [district])
    per_district = totals.join(medians, district, "left")
    if population is not None:
        per_district = per_district.join(population, district, "left")
    ranked = average_rank(one, capacity, "capacity_pct", [district], pct=True)
    out = join_checked(ranked, per_district, [district])
    new = {
        "capacity_share": safe_div(capacity, "district_capacity"),
        "capacity_over_median": safe_div(capacity, "district_capacity_median"),
    }
    if population is not None:
        new["people_per_entity"] = safe_div("population", "district_entities")
        new["people_per_capacity"] = safe_div("population", "district_capacity")
    return out.withColumns(new)


def month_index(day: str | Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def previous_month_features(
    df: DataFrame, value: str, entity: Sequence[str], time: str, horizon: int, prefix: str | None = None
) -> DataFrame:
    """Total, mean, maximum, event and empty days of the last calendar month that ends at least `horizon` days back, and
    its value on the same day of month. Months are reached by range frames over the month number inside each entity, so
    the rows are neither joined nor moved again."""
    if horizon < 1:
        raise ValueError("horizon must be >= 1")
    p = f"{prefix or value}_{'' if horizon == 1 else f'h{horizon}_'}month"
    day = F.to_date(time)
    back = month_index(day) - month_index(F.date_sub(day, horizon - 1)) + 1
    rows = df.withColumns(
        {"_month": month_index(day), "_dom": F.dayofmonth(day), "_back": back, "_v": F.col(value).cast("double")}
    )
    v = F.col("_v")
    by_month = Window.partitionBy(*entity).orderBy("_month")
    by_dom = Window.partitionBy(*entity, "_dom").orderBy("_month")
    # months between a row's own and the one it asks for: as many as `horizon` - 1 days can pass, and one more
    asked = range(1, 3 + (horizon - 2) // 28) if horizon > 1 else range(1, 2)

    def at(value_of) -> Column:
        return null_if_any_null(entity, F.coalesce(*[F.when(F.col("_back") == k, value_of(k)) for k in asked]))

    def month(agg: Column):
        return lambda k: agg.over(by_month.rangeBetween(-k, -k))

    seen = month(F.count(F.lit(1)))
    new = {
        f"{p}_total": at(lambda k: F.when(seen(k) > 0, F.coalesce(month(F.sum(v))(k), F.lit(0.0)))),
        f"{p}_mean": at(lambda k: safe_div(month(F.sum(v))(k), month(F.count(v))(k))),
        f"{p}_max": at(month(F.max(v))),
        f"{p}_event_days": at(lambda k: F.when(seen(k) > 0, month(F.count(F.when(v > 0, 1)))(k))),
        f"{p}_empty_days": at(lambda k: F.when(seen(k) > 0, month(F.count(F.when(v == 0, 1)))(k))),
        f"{p}_same_day": at(lambda k: F.sum(v).over(by_dom.rangeBetween(-k, -k))),
    }
    return rows.withColumns(new).drop("_month", "_dom", "_back", "_v")


def mass_event_features(
    df: DataFrame,
    value: str,
    entity: Sequence[str],
    time: str,
    horizon: int,
    threshold: float = 0.5,
    prefix: str | None = None,
) -> DataFrame:
    """Share of entities with an event on the day `horizon` calendar days back, its 7-day mean, and a mass-event flag.
    The share of the row's own day is never published."""
    if horizon < 1 or not 0 < threshold <= 1:
        raise ValueError("horizon must be >= 1 and threshold in (0, 1]")
    p = f"{prefix or value}_{'' if horizon == 1 else f'h{horizon}_'}mass"
    day = F.to_date(time)
    per = (
        df.filter(F.col(time).isNotNull())
        .groupBy(day.alias("_d"), *entity)
        .agg(F.max(F.coalesce(F.col(value) > 0, F.lit(False)).cast("double")).alias("_e"))
        .groupBy("_d")
        .agg(F.avg("_e").alias("_share"))
    )
    span = per.agg(F.explode(F.sequence(F.min("_d"), F.max("_d"))).alias("_d"))
    dense = span.join(per, "_d", "left")
    # one partition on purpose: one row per calendar day
    w = Window.partitionBy(F.lit(0)).orderBy("_d")
    lagged = F.lag("_share", horizon).over(w)
    seven = F.avg("_share").over(w.rowsBetween(-(horizon + 6), -horizon))
    shares = dense.select(F.col("_d"), lagged.alias(f"{p}_share"), seven.alias(f"{p}_share_mean7"))
    return (
        df.withColumn("_d", day)
        .join(day_table(shares), "_d", "left")
        .withColumn(f"{p}_flag", (F.col(f"{p}_share") >= threshold).cast("int"))
        .drop("_d")
    )


def stratum_weights(
    valid: DataFrame, test: DataFrame, strata: Sequence[str], cap: float = 20.0, weight: str = "weight"
) -> tuple[DataFrame, DataFrame]:
    """Post-stratification: weight = test share over validation share of the row's stratum, scaled to mean 1, capped,
    scaled again. Also a one-row diagnosis: strata, effective sample share, capped share, uncovered test share.

    Everything but the final attach happens on the table of strata, never on rows.
    """
    v = valid.groupBy(*strata).agg(F.count(F.lit(1)).alias("_nv"))
    t = test.groupBy(*strata).agg(F.count(F.lit(1)).alias("_nt"))
    both = v.join(t, list(strata), "full").select(
        *strata, F.coalesce("_nv", F.lit(0)).alias("_nv"), F.coalesce("_nt", F.lit(0)).alias("_nt")
    )
    totals = both.agg(F.sum("_nv").alias("nv"), F.sum("_nt").alias("nt"))
    tv, tt = totals.select("nv").scalar(), totals.select("nt").scalar()
    raw = both.withColumns({"_tv": tv, "_tt": tt}).withColumn(
        "_w", F.coalesce(safe_div(F.col("_nt") / F.col("_tt"), F.col("_nv") / F.col("_tv")), F.lit(0.0))
    )
    mean1 = raw.agg(safe_div(F.sum(F.col("_w") * F.col("_nv")), F.sum("_nv")).alias("m")).scalar()
    scaled = raw.withColumn("_m1", mean1).withColumn("_u", safe_div("_w", "_m1"))
    capped = scaled.withColumn("_c", F.least("_u", F.lit(float(cap))))
    mean2 = capped.agg(safe_div(F.sum(F.col("_c") * F.col("_nv")), F.sum("_nv")).alias("m")).scalar()
    final = capped.withColumn("_m2", mean2).withColumn(weight, safe_div("_c", "_m2"))
    w, n = F.col(weight), F.col("_nv")
    diagnosis = final.agg(
        F.sum("_nv").alias("n"),
        F.count_if(n > 0).alias("strata"),
        safe_div(F.sum(w * n) * F.sum(w * n), F.sum(w * w * n) * F.sum("_nv")).alias("ess_ratio"),
        safe_div(F.sum(F.when(F.col("_u") > cap, n).otherwise(0)), F.sum("_nv")).alias("capped"),
        safe_div(F.sum(F.when(n == 0, F.col("_nt")).otherwise(0)), F.max("_tt")).alias("uncovered"),
    )
    table = final.filter(n > 0).select(*strata, weight)
    return join_checked(valid, table, list(strata)), diagnosis


def hierarchical_means(
    fit: DataFrame,
    apply: DataFrame,
    value: str,
    levels: Sequence[Sequence[str]],
    strengths: Sequence[float],
    out: str = "eb_mean",
) -> DataFrame:
    """Empirical-Bayes means from coarse to fine: (sum + m * parent) / (n + m), starting at the global mean. A group
    without fit rows keeps its parent's value. The fit rows are read once; coarser levels sum the finest table."""
    finest = list(dict.fromkeys(k for lv in levels for k in lv))
    cells = cut_lineage(fit.groupBy(*finest).agg(F.sum(value).alias("_s"), F.count(value).alias("_n")))
    grand = cells.agg(safe_div(F.sum("_s"), F.sum("_n")).alias("m")).scalar()
    res = apply.withColumn(out, grand)
    for i, (lv, m) in enumerate(zip(levels, strengths, strict=True)):
        table = cells.groupBy(*lv).agg(F.sum("_s").alias(f"_s{i}"), F.sum("_n").alias(f"_n{i}"))
        res = join_checked(res, table, list(lv))
        s, n = F.coalesce(f"_s{i}", F.lit(0.0)), F.coalesce(f"_n{i}", F.lit(0))
        res = res.withColumn(out, (s + F.lit(float(m)) * F.col(out)) / (n + F.lit(float(m)))).drop(f"_s{i}", f"_n{i}")
    return res


def one_way_day_effect(df: DataFrame, entity: str, day: str, value: str) -> DataFrame:
    """Mean by day of the deviation from the entity mean, centred over days."""
    means = df.groupBy(entity).agg(F.avg(value).alias("_m"))
    # joins on the entity key; adaptive execution splits a hot entity
    dev = df.join(means, entity).groupBy(day).agg(F.avg(F.col(value) - F.col("_m")).alias("day_effect"))
    centre = dev.agg(F.avg("day_effect").alias("c")).scalar()
    return dev.withColumn("_c", centre).select(day, (F.col("day_effect") - F.col("_c")).alias("day_effect"))


def _day_sums(cells: DataFrame, entity: str, day: str, effects: DataFrame | None) -> dict:
    """Per day the sums that the entities leave over. Without effects: right side, diagonal and rows of the day system; with
    them: the system applied to the effects. The entity means are taken out inside the entity partition, without a shuffle,
    and one partial sum per day is shuffled."""
    own = Window.partitionBy(entity)
    if effects is None:
        left = F.col("_s") - F.col("_n") * F.sum("_s").over(own) / F.sum("_n").over(own)
        kept = F.col("_n") - F.col("_n") * F.col("_n") / F.sum("_n").over(own)
        rows = cells.withColumns({"_left": left, "_kept": kept}).groupBy(day)
        found = rows.agg(F.sum("_left").alias("left"), F.sum("_kept").alias("kept")).collect()
        return {r[day]: (r["left"], r["kept"]) for r in found}
    part = F.col("_n") * F.col("_p")
    joined = cells.join(day_table(effects), day).withColumn("_part", part)
    left = F.col("_part") - F.col("_n") * F.sum("_part").over(own) / F.sum("_n").over(own)
    found = joined.withColumn("_left", left).groupBy(day).agg(F.sum("_left").alias("left")).collect()
    return {r[day]: r["left"] for r in found}


def two_way_effects(df: DataFrame, entity: str, day: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """Day effects of value ~ mu + entity + day by least squares, centred over days.

    Rows collapse to (entity, day) cells, partitioned by entity and held while the steps run; a lost executor's part is
    computed again from the rows. Without the entity means, which follow from the day effects, a system with one equation
    per calendar day is left. Conjugate gradients solve it: a step applies the system to one vector over days, by sums inside
    the entity partitions, and the driver keeps four such vectors (36,525 numbers a century). Steps end when the residual is
    `tolerance` times the right side; badly connected panels take more of them, not more tolerance. Days without values get
    NULL. In a panel that falls apart, each part is centred on its own rows before all days are centred together.
    """
    cells = df.groupBy(entity, F.to_date(day).alias(day)).agg(F.sum(value).cast("double").alias("_s"), F.count(value).alias("_n"))
    cells = cells.repartition(entity).persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession
    schema = cells.select(day).schema.add("_p", "double")
    try:
        used = cells.filter("_n > 0")
        system = _day_sums(used, entity, day, None)
        days = sorted(system)
        right = np.array([system[d][0] for d in days])
        diagonal = np.array([system[d][1] for d in days])
        scale = np.where(diagonal > 1e-9, diagonal, 1.0)  # a day whose entities have no other day is alone: its effect is 0

        def applied(p: np.ndarray) -> np.ndarray:
            found = _day_sums(used, entity, day, spark.createDataFrame(list(zip(days, p.tolist(), strict=True)), schema))
            return np.array([found[d] for d in days])

        effect, residual = np.zeros(len(days)), right
        ready = residual / scale
        direction, weight = ready, float(residual @ ready)
        target, best, stuck = tolerance * float(np.linalg.norm(right)), np.inf, 0
        while (size := float(np.linalg.norm(residual))) > target:
            stuck = 0 if size < 0.999 * best else stuck + 1
            best = min(best, size)
            if stuck > 50:  # as exact as the sums are
                warnings.warn(f"day effects left a residual of {size:g}, {size / max(target, 1e-300):.1g} times the tolerance", stacklevel=2)
                break
            turned = applied(direction)
            if not (bend := float(direction @ turned)) > 0:
                break
            length = weight / bend
            effect, residual = effect + length * direction, residual - length * turned
            ready = residual / scale
            before, weight = weight, float(residual @ ready)
            direction = ready + weight / before * direction
        effect = effect - effect.mean() if len(effect) else effect
        found = dict(zip(days, effect.tolist(), strict=True))
        every = [(r[day], found.get(r[day])) for r in cells.select(day).distinct().collect()]  # one row per calendar day
        return spark.createDataFrame(every, cells.select(day).schema.add("day_effect", "double"))
    finally:
        cells.unpersist()


def cluster_slope(df: DataFrame, x: str, y: str, cluster: str) -> DataFrame:
    """Slope, its cluster-robust standard error and the intercept of y ~ x. Five sums per cluster are enough: the
    residual scores of a cluster are linear in them."""
    u, r = F.col(x).cast("double"), F.col(y).cast("double")
    per = (
        df.filter(u.isNotNull() & r.isNotNull())
        .groupBy(cluster)
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.sum(u).alias("su"),
            F.sum(u * u).alias("suu"),
            F.sum(r).alias("sr"),
            F.sum(u * r).alias("sur"),
        )
    )
    names = ("n", "su", "suu", "sr", "sur")
    t = per.agg(*[F.sum(c).alias(c) for c in names])
    det = F.col("n") * F.col("suu") - F.col("su") * F.col("su")
    fit = t.select(
        F.struct(
            ((F.col("n") * F.col("sur") - F.col("su") * F.col("sr")) / F.nullif(det, F.lit(0.0))).alias("b1"),
            ((F.col("suu") * F.col("sr") - F.col("su") * F.col("sur")) / F.nullif(det, F.lit(0.0))).alias("b0"),
            (F.col("n") / F.nullif(det, F.lit(0.0))).alias("i11"),
            (-F.col("su") / F.nullif(det, F.lit(0.0))).alias("i01"),
        ).alias("fit")
    ).scalar()
    f = per.withColumn("_fit", fit)
    b0, b1 = F.col("_fit.b0"), F.col("_fit.b1")
    s0 = F.col("sr") - b0 * F.col("n") - b1 * F.col("su")
    s1 = F.col("sur") - b0 * F.col("su") - b1 * F.col("suu")
    # row 1 of the inverse times the cluster's score
    lever = F.col("_fit.i01") * s0 + F.col("_fit.i11") * s1
    return f.agg(
        F.max(b1).alias("slope"),
        F.sqrt(F.sum(lever * lever)).alias("slope_se"),
        F.max(b0).alias("intercept"),
        F.count(F.lit(1)).alias("clusters"),
    )


def tail_summary(
    df: DataFrame, entity: str, time: str, value: str, offset: str, cut: str | None = None, last: int = 60, min_rows: int = 10
) -> DataFrame:
    """Per entity before the cut: first and last day, rows, positive rows, maximum, maximum and count of the last 60
    rows, largest internal gap, and the mean offset of the last 60 positive rows (needs 10)."""
    rows = df if cut is None else df.filter(F.to_date(time) < F.lit(cut).cast("date"))
    day = F.to_date(time)
    w = time_order([entity], time)
    newest = Window.partitionBy(entity).orderBy(F.col(time).desc_nulls_last())
    positive = F.col(value) > 0
    marked = rows.withColumns(
        {
            "_gap": F.datediff(day, F.lag(day).over(w)),
            "_back": F.row_number().over(newest),
            "_pos_back": F.sum(positive.cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    recent = F.col("_back") <= last
    anchor = positive & (F.col("_pos_back") <= last)
    return marked.groupBy(entity).agg(
        F.max(day).alias("last_day"),
        F.min(day).alias("first_day"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(positive).alias("positive_rows"),
        F.max(value).alias("max_value"),
        F.max(F.when(recent, F.col(value))).alias("recent_max"),
        F.count_if(recent).alias("recent_rows"),
        F.coalesce(F.max("_gap"), F.lit(0)).alias("largest_gap"),
        F.when(F.count_if(anchor) >= min_rows, F.avg(F.when(anchor, F.col(offset)))).alias("anchor_offset"),
        F.count_if(anchor).alias("anchor_rows"),
    )


def ewma_level(
    df: DataFrame, entity: str, time: str, value: str, cut: str, half_life: float, keys: DataFrame | None = None
) -> DataFrame:
    """Level per entity at a cut, weights 0.5^(age / half_life). Entities in `keys` without history get the overall
    mean."""
    past = df.filter(F.to_date(time) < F.lit(cut).cast("date")).filter(F.col(value).isNotNull())
    age = F.datediff(F.lit(cut).cast("date"), F.to_date(time))
    w = F.pow(F.lit(0.5), age / F.lit(float(half_life)))
    levels = past.groupBy(entity).agg(safe_div(F.sum(w * F.col(value)), F.sum(w)).alias("level"))
    if keys is None:
        return levels
    overall = past.agg(F.avg(value).alias("m")).scalar()
    return (
        keys.select(entity)
        .distinct()
        .join(levels, entity, "left")
        .withColumn("_all", overall)
        .select(entity, F.coalesce("level", "_all").alias("level"))
    )


def reactivation(
    df: DataFrame, entity: str, time: str, value: str, quiet: tuple[str, str], later: tuple[str, str]
) -> DataFrame:
    """One row: entities whose mean is zero in the quiet window, how many of them are seen, positive and still zero in
    the later one, and the positive share."""
    day = F.to_date(time)
    a, b = F.col(value), day
    per = df.groupBy(entity).agg(
        F.avg(F.when(b.between(*[F.lit(x).cast("date") for x in quiet]), a)).alias("_a"),
        F.avg(F.when(b.between(*[F.lit(x).cast("date") for x in later]), a)).alias("_b"),
    )
    return per.filter(F.col("_a") == 0).agg(
        F.count(F.lit(1)).alias("quiet"),
        F.count("_b").alias("seen_later"),
        F.count_if(F.col("_b") > 0).alias("woken"),
        F.count_if(F.col("_b") == 0).alias("still_zero"),
        safe_div(F.count_if(F.col("_b") > 0), F.count(F.lit(1))).alias("woken_share"),
    )


def load_transfer_study(
    df: DataFrame,
    entity: str,
    location: str,
    time: str,
    value: str,
    window: int = 28,
    min_days: int = 20,
    salts: int = 8,
) -> DataFrame:
    """Event study of births: what happens to the settled members of a location when new entities appear there.

    One event per (location, first day of new entities). Settled members were there more than `window` days before;
    their mean levels in the `window` days before and after the event are summed, and the log ratio is compared with the
    same ratio of the entities that exist since the first day. A member's two means change only on days when one of its
    rows enters or leaves a window, so they are worked out there, once per stretch of days between two changes, and the
    stretches are added up per location and day before anything is shuffled: a member never meets single events.
    `salts` is no longer needed and kept for callers.
    """
    day = F.to_date(time)
    valid = df.filter(F.col(value).isNotNull())
    rows = valid.groupBy(entity, location, day.alias("_day")).agg(F.sum(value).alias("_v"))
    first = rows.groupBy(entity, location).agg(F.min("_day").alias("_first"))
    lo = valid.agg(F.min(day).alias("b")).scalar()
    hi = valid.agg(F.max(day).alias("b")).scalar()
    births = (
        first.withColumns({"_lo": lo, "_hi": hi})
        .filter((F.date_sub("_first", window) >= F.col("_lo")) & (F.date_add("_first", window) <= F.col("_hi")))
        .groupBy(location, F.col("_first").alias("birth_day"))
        .agg(F.count(F.lit(1)).alias("n_new"))
    )
    # the days of a row and those on which it enters or leaves the window after or before an event
    known = rows.filter(F.col(entity).isNotNull() & F.col(location).isNotNull() & F.col("_day").isNotNull())
    at = F.unix_date("_day")
    changes = [F.struct((at + k).alias("_at"), F.lit(None).cast("double").alias("_v"), F.lit(0).alias("_n")) for k in (-window, 1, window + 1)]
    itself = F.struct(at.alias("_at"), F.col("_v").cast("double").alias("_v"), F.lit(1).alias("_n"))
    marks = known.select(entity, location, F.inline(F.array(itself, *changes)))
    marks = marks.groupBy(entity, location, "_at").agg(F.sum("_v").alias("_v"), F.sum("_n").alias("_n"))
    # one partition holds a member's marks, at most four per calendar day
    member = Window.partitionBy(entity, location).orderBy("_at")
    before, after = member.rangeBetween(-window, -1), member.rangeBetween(1, window)
    seen = F.min(F.when(F.col("_n") > 0, F.col("_at"))).over(Window.partitionBy(entity, location))
    stretches = marks.select(
        location,
        "_at",
        F.lead("_at").over(member).alias("_next"),
        seen.alias("_first"),
        F.sum("_n").over(before).alias("_nb"),
        F.sum("_n").over(after).alias("_na"),
        F.avg("_v").over(before).alias("_b"),
        F.avg("_v").over(after).alias("_a"),
    ).fillna(0, ["_nb", "_na"])
    settled = stretches.filter(
        (F.col("_nb") >= min_days) & (F.col("_na") >= min_days) & (F.col("_nb") + F.col("_na") > 0) & (F.col("_at") > F.col("_first") + window)
    ).withColumns({"_from": F.col("_at"), "_to": F.least(F.col("_next") - 1, F.unix_date(hi) - window)})
    totals = (
        settled.filter(F.col("_from") <= F.col("_to"))
        .select(location, "_b", "_a", F.explode(F.sequence("_from", "_to")).alias("_on"))
        .groupBy(location, "_on")
        .agg(F.count(F.lit(1)).alias("n_settled"), F.sum("_b").alias("before_total"), F.sum("_a").alias("after_total"))
        .select(location, F.date_from_unix_date("_on").alias("birth_day"), "n_settled", "before_total", "after_total")
    )
    # one row per location and birth day, asked for twice below
    events = cut_lineage(births.join(totals, [location, "birth_day"]).filter(F.col("before_total") > 0))
    # control: entities present since the first day, one total per calendar day
    always = first.withColumn("_lo", lo).filter(F.col("_first") == F.col("_lo")).select(entity, location)
    control = rows.join(always, [entity, location], "left_semi").groupBy("_day").agg(F.sum("_v").alias("_c"))
    days = events.select("birth_day").distinct().select(
        "birth_day", F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("_off")
    )
    days = days.filter(F.col("_off") != 0).withColumn("_day", F.date_add("birth_day", F.col("_off")))
    # a day of the window on which no control entity reports counts as zero
    ratio = (
        days.join(control, "_day", "left")
        .groupBy("birth_day")
        .agg(
            F.avg(F.when(F.col("_off") < 0, F.coalesce("_c", F.lit(0.0)))).alias("_cb"),
            F.avg(F.when(F.col("_off") > 0, F.coalesce("_c", F.lit(0.0)))).alias("_ca"),
        )
        .select("birth_day", F.when((F.col("_cb") > 0) & (F.col("_ca") > 0), F.ln(F.col("_ca") / F.nullif(F.col("_cb"), F.lit(0.0)))).alias("control"))
    )
    y = F.ln(F.greatest("after_total", F.lit(1e-6)) / F.col("before_total"))
    return events.join(day_table(ratio), "birth_day", "left").withColumns(
        {"log_ratio": y, "effect": y - F.col("control")}
    )
