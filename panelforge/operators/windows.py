"""Horizon-safe history features over (entity, day) panels.

A row may only see target-derived values at least `horizon` rows back. All windows of one operator share one partition
and order, so Spark sorts once; a partition holds one entity's history, at most one row per day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelforge.core.exprs import null_if_any_null, require_columns, safe_div, time_order, unique_guard

_AGGREGATES = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


def _check_horizon(horizon: int) -> None:
    if isinstance(horizon, bool) or not isinstance(horizon, int) or horizon < 1:
        raise ValueError(f"horizon must be an integer >= 1, got {horizon!r}")


def _tag(horizon: int) -> str:
    return "" if horizon == 1 else f"h{horizon}_"


def _frame(w: WindowSpec, first: int, last: int) -> WindowSpec:
    return w.rowsBetween(first, last)


def lag_offsets(
    value: str, horizon: int, shifts: Sequence[int] | None, lags: Sequence[int] | None
) -> list[tuple[int, str]]:
    """(row offset, output name): absolute `shifts` must reach the horizon; `lags` count from the horizon on."""
    _check_horizon(horizon)
    if (shifts is None) == (lags is None):
        raise ValueError("give either shifts or lags")
    if not (shifts or lags):
        raise ValueError("no offsets given")
    if shifts is not None:
        low = [s for s in shifts if s < horizon]
        if low:
            raise ValueError(f"shifts {low} are shorter than the horizon {horizon}")
        return [(s, f"{value}_shift{s}") for s in shifts]
    if min(lags) < 1:
        raise ValueError("lags start at 1")
    return [(horizon + k - 1, f"{value}_{_tag(horizon)}lag{k}") for k in lags]


def lag_features(
    df: DataFrame,
    value: str,
    entity: Sequence[str],
    time: str,
    horizon: int,
    shifts: Sequence[int] | None = None,
    lags: Sequence[int] | None = None,
) -> DataFrame:
    require_columns(df, [value, *entity, time])
    w = time_order(entity, time)
    offsets = lag_offsets(value, horizon, shifts, lags)
    guarded = unique_guard(df, entity, time)
    return guarded.withColumns(
        {name: null_if_any_null(entity, F.lag(value, k).over(w)) for k, name in offsets}
    )


def rolling_features(
    df: DataFrame,
    value: str,
    entity: Sequence[str],
    time: str,
    horizon: int,
    windows: Sequence[int],
    aggregations: Sequence[str] = ("mean", "std", "min", "max"),
) -> DataFrame:
    """Statistics over the `w` rows that end `horizon` rows back."""
    _check_horizon(horizon)
    w = time_order(entity, time)
    guarded = unique_guard(df, entity, time)
    new = {}
    for size in windows:
        frame = _frame(w, -(horizon + size - 1), -horizon)
        for agg in aggregations:
            new[f"{value}_{_tag(horizon)}roll{size}_{agg}"] = null_if_any_null(
                entity, _AGGREGATES[agg](F.col(value)).over(frame)
            )
    return guarded.withColumns(new)


def expanding_features(
    df: DataFrame,
    value: str,
    entity: Sequence[str],
    time: str,
    horizon: int,
    aggregations: Sequence[str] = ("mean", "std"),
) -> DataFrame:
    """Statistics over all rows up to `horizon` rows back."""
    _check_horizon(horizon)
    frame = time_order(entity, time).rowsBetween(Window.unboundedPreceding, -horizon)
    guarded = unique_guard(df, entity, time)
    return guarded.withColumns(
        {
            f"{value}_expanding_{a}": null_if_any_null(entity, _AGGREGATES[a](F.col(value)).over(frame))
            for a in aggregations
        }
    )


# Exponent range of one decay segment. 2**480 times any sane value stays inside a double, and what is two segments
# back carries a factor below 2**-480.
_SEGMENT_HALF_LIVES = 480


def event_decay_features(
    df: DataFrame,
    value: str,
    entity: Sequence[str],
    time: str,
    horizon: int,
    half_lives: Sequence[float] = (3.0, 14.0),
) -> DataFrame:
    """D[j] = x[j] + 2^(-days/half_life) * D[j-1], published `horizon` rows later, for the event flag and the value.

    The recursion telescopes into a running sum of x * 2^(t/half_life). The exponent restarts every segment of
    480 half-lives; a range frame over the segment number carries the two segments before.
    """
    _check_horizon(horizon)
    if not half_lives or min(half_lives) <= 0:
        raise ValueError("half_lives must be positive")
    w = time_order(entity, time)
    by_entity = Window.partitionBy(*entity)
    day = F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date"))
    x = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    work = unique_guard(df, entity, time).withColumns(
        {
            "_t": day - F.min(day).over(by_entity),
            "_value": x,
            "_event": (x > 0).cast("double"),
        }
    )
    new = {}
    drop = ["_t", "_value", "_event"]
    for i, half in enumerate(half_lives):
        length = max(1, int(half * _SEGMENT_HALF_LIVES))
        seg, inside = f"_seg{i}", f"_in{i}"
        work = work.withColumns(
            {seg: F.floor(F.col("_t") / length), inside: F.pmod(F.col("_t"), F.lit(length))}
        )
        drop += [seg, inside]
        within = Window.partitionBy(*entity, seg).orderBy(F.col(time).asc_nulls_last())
        running = within.rowsBetween(Window.unboundedPreceding, 0)
        by_seg = Window.partitionBy(*entity).orderBy(seg)
        fade = F.pow(F.lit(2.0), -F.col(inside) / F.lit(float(half)))
        for kind, source in (("event", "_event"), ("value", "_value")):
            grow = F.col(source) * F.pow(F.lit(2.0), F.col(inside) / F.lit(float(half)))
            # a past segment's terms, decayed to that segment's end
            at_end = F.col(source) * F.pow(F.lit(2.0), (F.col(inside) - length) / F.lit(float(half)))
            one_back = F.coalesce(F.sum(at_end).over(by_seg.rangeBetween(-1, -1)), F.lit(0.0))
            two_back = F.coalesce(F.sum(at_end).over(by_seg.rangeBetween(-2, -2)), F.lit(0.0))
            carried = one_back + two_back * F.lit(2.0 ** (-length / half))
            raw = f"_raw_{kind}{i}"
            work = work.withColumn(raw, (F.sum(grow).over(running) + carried) * fade)
            drop.append(raw)
            new[f"{value}_{_tag(horizon)}decay{half:g}d_{kind}"] = null_if_any_null(
                [*entity, time], F.lag(raw, horizon).over(w)
            )
    return work.withColumns(new).drop(*drop)


def days_since_event(
    df: DataFrame, value: str, entity: Sequence[str], time: str, horizon: int
) -> DataFrame:
    """Calendar days since the last visible row with value > 0, and a flag for "never seen one"."""
    _check_horizon(horizon)
    w = time_order(entity, time)
    event_day = F.when(F.col(value) > 0, F.to_date(time))
    # last_value instead of max: the frame end moves, the running state is one date
    last = F.last(event_day, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -horizon))
    guarded = unique_guard(df, entity, time).withColumn("_last", null_if_any_null([*entity, time], last))
    tag = _tag(horizon)
    return guarded.withColumns(
        {
            f"{value}_{tag}days_since_event": F.datediff(F.to_date(time), F.col("_last")),
            f"{value}_{tag}never_event": F.col("_last").isNull().cast("int"),
        }
    ).drop("_last")


def run_length(condition: Column, entity: Sequence[str], time: str) -> tuple[Column, Column]:
    """Pieces of a gaps-and-islands counter: the island number, and the counter given that number as `_island`."""
    w = time_order(entity, time)
    hit = F.coalesce(condition, F.lit(False))
    island = F.sum((~hit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy(*entity, "_island").orderBy(F.col(time).asc_nulls_last())
    counter = F.sum(hit.cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return island, counter


def with_run_length(df: DataFrame, condition: Column, entity: Sequence[str], time: str, out: str) -> DataFrame:
    """Adds the length of the current run of rows that meet `condition` (0 where it fails or is NULL)."""
    island, counter = run_length(condition, entity, time)
    return df.withColumn("_island", island).withColumn(out, counter).drop("_island")


def consecutive_extreme_days(
    df: DataFrame, value: str, entity: Sequence[str], time: str, threshold: float, above: bool = True
) -> DataFrame:
    v = F.col(value).cast("double")
    cond = v > threshold if above else v < threshold
    return with_run_length(df, cond, entity, time, f"{value}_run_{'above' if above else 'below'}")


def calendar_rolling(
    df: DataFrame, value: str, entity: Sequence[str], time: str, horizon: int, days: int, aggregation: str = "mean"
) -> DataFrame:
    """Rolling statistic over calendar days instead of rows, for panels with gaps."""
    _check_horizon(horizon)
    day = F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*entity).orderBy("_d").rangeBetween(-(horizon + days - 1), -horizon)
    return (
        df.withColumn("_d", day)
        .withColumn(f"{value}_{_tag(horizon)}cal{days}_{aggregation}", _AGGREGATES[aggregation](F.col(value)).over(w))
        .drop("_d")
    )


def boundary_flags(df: DataFrame, entity: Sequence[str], time: str) -> DataFrame:
    """Entry / exit (a gap of more than one day before / after) and birth / death (first / last row) flags."""
    w = time_order(entity, time)
    day = F.to_date(time)
    before = F.datediff(day, F.lag(day).over(w))
    after = F.datediff(F.lead(day).over(w), day)
    return df.withColumns(
        {
            "entry": (before.isNull() | (before > 1)).cast("int"),
            "exit": (after.isNull() | (after > 1)).cast("int"),
            "birth": F.lag(day).over(w).isNull().cast("int"),
            "death": F.lead(day).over(w).isNull().cast("int"),
        }
    )


def age_features(frames: Sequence[DataFrame], entity: Sequence[str], time: str) -> list[DataFrame]:
    """Days since the entity was first seen in any of the frames, and a first-day flag."""
    seen = frames[0].select(*entity, time)
    for f in frames[1:]:
        seen = seen.unionByName(f.select(*entity, time))
    first = seen.groupBy(*entity).agg(F.min(F.to_date(time)).alias("_first"))
    out = []
    for f in frames:
        age = F.datediff(F.to_date(time), F.col("_first"))
        out.append(
            f.join(first, list(entity), "left")
            .withColumn("age", age)
            .withColumn("first_day", (F.col("age") == 0).cast("int"))
            .drop("_first")
        )
    return out


def paired_history_features(
    train: DataFrame,
    test: DataFrame,
    value: str,
    entity: Sequence[str],
    time: str,
    horizon: int,
    shifts: Sequence[int],
    windows: Sequence[int],
    aggregations: Sequence[str] = ("mean",),
    flag: str = "is_test",
) -> DataFrame:
    """Lags and rolling windows on the joined train + test axis. Test targets are NULL, bridge rows fill the days
    between the two and leave again; a test that starts before train ends fails the query."""
    from panelforge.operators.panel import bridge_days

    base = [*entity, time]
    a = train.select(*base, F.col(value).cast("double").alias(value), F.lit(0).alias(flag))
    b = test.select(*base, F.lit(None).cast("double").alias(value), F.lit(1).alias(flag))
    bridge = bridge_days(train, test, entity, time, flag).select(
        *base, F.lit(None).cast("double").alias(value), F.lit(2).alias(flag)
    )
    train_end = train.agg(F.max(F.to_date(time)).alias("b")).scalar()
    b = b.withColumn("_end", train_end).filter(
        F.assert_true(F.to_date(time) > F.col("_end"), F.lit("test starts before train ends")).isNull()
    )
    axis = a.unionByName(b.drop("_end")).unionByName(bridge)
    w = time_order(entity, time)
    axis = unique_guard(axis, entity, time)
    new = {f"{value}_shift{s}": F.lag(value, s).over(w) for s, _ in lag_offsets(value, horizon, shifts, None)}
    for size in windows:
        for agg in aggregations:
            new[f"{value}_{_tag(horizon)}roll{size}_{agg}"] = _AGGREGATES[agg](F.col(value)).over(
                _frame(w, -(horizon + size - 1), -horizon)
            )
    return axis.withColumns(new).filter(F.col(flag) < 2)


def recency_activity_weights(
    df: DataFrame,
    value: str,
    entity: Sequence[str],
    time: str,
    start: float = 0.05,
    end: float = 0.95,
    activity_window: int = 28,
    activity_floor: float = 0.25,
    out: str = "weight",
) -> DataFrame:
    """Linear ramp over the position in the entity's history, times floor + (1 - floor) * recent share of event days."""
    if not 0 <= start <= end or not 0 <= activity_floor <= 1 or activity_window < 1:
        raise ValueError("need 0 <= start <= end, a floor in [0, 1] and a window of at least one row")
    w = time_order(entity, time)
    size = F.count(F.lit(1)).over(Window.partitionBy(*entity))
    position = F.row_number().over(w) - 1
    active = F.avg(F.coalesce(F.col(value) > 0, F.lit(False)).cast("double")).over(_frame(w, -(activity_window - 1), 0))
    ramp = F.when(
        size > 1, F.lit(start) + F.lit(end - start) * position / F.greatest(size - 1, F.lit(1))
    ).otherwise(F.lit(end))
    return df.withColumn(out, ramp * (F.lit(activity_floor) + F.lit(1.0 - activity_floor) * active))


def event_day_groups(df: DataFrame, train: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """Context of a row inside its entity's prediction span: age, days remaining, empty days before it (-1 on the first
    row), empty days since the training history (NULL for a new entity), how many entities start on the same day, and
    whether the median value of the 14 days before the last one is positive (1 when there are none)."""
    w = time_order([entity], time)
    all_rows = Window.partitionBy(entity)
    day = F.to_date(time)
    rows = df.withColumns(
        {
            "_first": F.min(day).over(all_rows),
            "_last": F.max(day).over(all_rows),
            "gap": F.coalesce(F.datediff(day, F.lag(day).over(w)) - 1, F.lit(-1)),
        }
    ).withColumns({"age": F.datediff(day, "_first"), "remaining": F.datediff("_last", day)})
    last_seen = train.groupBy(entity).agg(F.max(F.to_date(time)).alias("_train_last"))
    tail = F.when(F.col("remaining").between(1, 14), F.col(value).cast("double"))
    per = (
        rows.groupBy(entity)
        .agg(F.min("_first").alias("_start"), F.percentile(tail, F.lit(0.5)).alias("_tail"))
        .join(last_seen, entity, "left")
    )
    starts = per.groupBy("_start").agg(F.count(F.lit(1)).alias("batch"))
    per = per.join(starts, "_start", "left").select(
        entity,
        "batch",
        F.col("_train_last").isNull().cast("int").alias("is_new"),
        F.col("_train_last"),
        F.coalesce((F.col("_tail") > 0).cast("int"), F.lit(1)).alias("alive"),
    )
    return (
        rows.join(per, entity, "left")
        .withColumn("gap_before", F.datediff(day, "_train_last") - 1)
        .drop("_first", "_last", "_train_last")
    )


def season_direction(
    df: DataFrame, value: str, entity: Sequence[str], time: str, short: int = 14, long: int = 60, min_rows: int = 5
) -> DataFrame:
    """Short minus long rolling mean (current row included), NULL below `min_rows` observations in either window."""
    w = time_order(entity, time)

    def gated(size: int) -> Column:
        frame = _frame(w, -(size - 1), 0)
        return F.when(F.count(value).over(frame) >= min_rows, F.avg(value).over(frame))

    return df.withColumn(f"{value}_direction", gated(short) - gated(long))


def presence_features(df: DataFrame, entity: Sequence[str], time: str) -> DataFrame:
    """Per entity inside the frame's window: days, first and last offset, span, fill ratio and window share."""
    day = F.to_date(time)
    lo = df.agg(F.min(day).alias("b")).scalar()
    hi = df.agg(F.max(day).alias("b")).scalar()
    per = df.groupBy(*entity).agg(
        F.count(F.lit(1)).alias("days"), F.min(day).alias("_a"), F.max(day).alias("_b")
    )
    span = F.datediff("_b", "_a") + 1
    return (
        per.withColumns({"_lo": lo, "_hi": hi})
        .withColumns(
            {
                "first_offset": F.datediff("_a", "_lo"),
                "last_offset": F.datediff("_b", "_lo"),
                "span": span,
                "fill_ratio": safe_div("days", span),
                "window_share": safe_div("days", F.datediff("_hi", "_lo") + 1),
            }
        )
        .drop("_a", "_b", "_lo", "_hi")
    )
