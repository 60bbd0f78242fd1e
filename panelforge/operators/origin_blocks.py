"""Rolling-origin blocks from elementary intervals.

All bounds of all blocks (summary and label windows, the recent windows, the same days a year earlier) cut time into
elementary intervals. A row belongs to one interval and is read into moments that add up: counts, sums and sums of
products per (entity, interval, weekday, month). A block is the sum of its intervals, so the number of blocks multiplies
small rows of moments, never the rows of the panel.

Two summaries don't add up, quantiles and the run of zeros at the end. They are taken from the days of the entity, one
array per entity that all blocks read in place.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.exprs import safe_div
from panelforge.core.scale import bucket_of, cut_lineage
from panelforge.operators.columns import capacity_bucket
from panelforge.operators.profiles import (
    DEAD_AFTER_ROWS,
    RECENT_WINDOWS,
    SEASON_MIN_DAYS,
    SUMMER_MONTHS,
    WINTER_MONTHS,
    attach_group_levels,
    attach_group_profiles,
    log_target,
)

_EPOCH = dt.date(1970, 1, 1)
_DAY = dt.timedelta(days=1)
_SUMS = ("n", "ny", "sy", "syy", "st", "stt", "sty", "zeros", "n_target", "s_target")


@dataclass(frozen=True)
class Block:
    """A rolling-origin block: summaries from [summary_start, summary_end], labels in [label_start, label_end]."""

    name: str
    summary_start: str
    summary_end: str
    label_start: str
    label_end: str

    def __post_init__(self) -> None:
        if self.summary_end >= self.label_start:
            raise ValueError(f"block {self.name}: the summary window reaches into the label window")


@dataclass(frozen=True)
class Intervals:
    """Days at which an interval begins, and the windows of each block that has rows in both of its windows."""

    cuts: list[dt.date]
    windows: dict[str, dict[str, tuple[dt.date, dt.date]]]

    def holds(self, k: int, window: tuple[dt.date, dt.date]) -> bool:
        """Interval k: the days from cuts[k - 1] up to the day before cuts[k]; 0 and the last one have no end."""
        return 0 < k < len(self.cuts) and window[0] <= self.cuts[k - 1] and self.cuts[k] <= window[1] + _DAY

    def table(self, df: DataFrame, inside: str, negate: bool = False, flags: Sequence[str] = ()) -> DataFrame:
        """(block, _interval, flags): the intervals inside a window of each block, or outside of it. One row per block and
        interval at most, so it is marked for broadcast."""
        rows = [
            (name, k, *(self.holds(k, windows[f]) for f in flags))
            for name, windows in self.windows.items()
            for k in range(len(self.cuts) + 1)
            if self.holds(k, windows[inside]) != negate
        ]
        schema = "block string, _interval int" + "".join(f", {f} boolean" for f in flags)
        return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def elementary_intervals(df: DataFrame, time: str, blocks: Sequence[Block]) -> Intervals:
    """One pass over the distinct days finds the first and last day of each window that occur."""
    days = df.select(F.to_date(time).alias("d")).distinct()
    ends = []
    for b in blocks:
        for start, end in ((b.summary_start, b.summary_end), (b.label_start, b.label_end)):
            inside = F.when(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.col("d"))
            ends += [F.min(inside), F.max(inside)]
    found = list(days.agg(*ends).first()) if blocks else []
    windows: dict[str, dict[str, tuple[dt.date, dt.date]]] = {}
    for i, b in enumerate(blocks):
        f0, f1, l0, l1 = found[4 * i : 4 * i + 4]
        if f0 is None or l0 is None:
            continue
        year = dt.timedelta(days=365)
        windows[b.name] = {
            "fit": (f0, f1),
            "label": (l0, l1),
            "last_year": (max(f0, l0 - year), min(f1, l1 - year)),
            **{f"last{n}": (max(f0, f1 - (n - 1) * _DAY), f1) for n in RECENT_WINDOWS},
        }
    used = [w for named in windows.values() for w in named.values() if w[0] <= w[1]]
    return Intervals(sorted({w[0] for w in used} | {w[1] + _DAY for w in used}), windows)


def _with_interval(df: DataFrame, time: str, intervals: Intervals) -> DataFrame:
    """Every row with its one interval; rows without a day belong to none."""
    bounds = F.array(*[F.lit((c - _DAY - _EPOCH).days) for c in intervals.cuts]).cast("array<int>")
    dated = df.withColumn("_day", F.to_date(time)).filter(F.col("_day").isNotNull())
    numbered = dated.withColumns({"_dayno": F.unix_date("_day"), "_bounds": bounds})
    return bucket_of(numbered, "_dayno", "_bounds", len(intervals.cuts) + 1, "_interval")


def label_rows(df: DataFrame, time: str, blocks: Sequence[Block]) -> DataFrame:
    """The label rows of every block with its name; a row in several label windows comes once for each."""
    intervals = elementary_intervals(df, time, blocks)
    rows = _with_interval(df, time, intervals).join(intervals.table(df, "label"), "_interval")
    return rows.drop("_interval", "_day", "_dayno")


def _moments(rows: DataFrame, entity: str, target: str, capacity: str, district: str, degree_columns: Sequence[str]) -> DataFrame:
    """One row per (entity, district, bucket, interval, weekday, month)."""
    y, t, known = F.col("_y"), F.col("_dayno").cast("double"), F.col("_y").isNotNull()
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count("_y").alias("ny"),
        F.sum("_y").alias("sy"),
        F.sum(y * y).alias("syy"),
        F.sum(F.when(known, t)).alias("st"),
        F.sum(F.when(known, t * t)).alias("stt"),
        F.sum(t * y).alias("sty"),
        F.sum(F.coalesce(F.col(target) <= 0, F.lit(False)).cast("double")).alias("zeros"),
        F.count(target).alias("n_target"),
        F.sum(F.col(target).cast("double")).alias("s_target"),
        F.min("_day").alias("first_day"),
        F.max("_day").alias("last_day"),
        F.min(F.struct(F.col("_day").alias("d"), F.col(capacity).cast("double").alias("c"))).alias("cap"),
    ]
    for i, c in enumerate(degree_columns):
        x = F.when(known, F.col(c).cast("double"))
        both = x.isNotNull()
        aggs += [
            F.count(x).alias(f"dn{i}"),
            F.sum(x).alias(f"dx{i}"),
            F.sum(x * x).alias(f"dxx{i}"),
            F.sum(F.when(both, y)).alias(f"dy{i}"),
            F.sum(x * y).alias(f"dxy{i}"),
            F.slice(F.collect_set(x), 1, 3).alias(f"dset{i}"),  # three different values are all that is asked for
        ]
    return rows.groupBy(entity, district, "_bucket", "_interval", "_dow", "_moy").agg(*aggs)


def _slope(n: str | Column, x: Column, xx: Column, y: Column, xy: Column) -> Column:
    n = (F.col(n) if isinstance(n, str) else n).cast("double")
    return (n * xy - x * y) / F.nullif(n * xx - x * x, F.lit(0.0))


def _levels(cells: DataFrame, rows: DataFrame, intervals: Intervals, entity: str, degree_columns: Sequence[str]) -> DataFrame:
    """(block, entity) summaries: intervals of the summary window added up."""
    month = F.col("_moy")
    summer, winter = month.isin(*SUMMER_MONTHS), month.isin(*WINTER_MONTHS)
    adding = [F.sum(c).alias(c) for c in _SUMS]
    adding += [F.sum(F.when(when, F.col(c))).alias(f"{c}_{season}") for season, when in (("s", summer), ("w", winter)) for c in ("n", "ny", "sy")]
    adding += [F.max("last_day").alias("last_day"), F.min("cap").alias("cap")]
    degrees = [f"{c}{i}" for i in range(len(degree_columns)) for c in ("dn", "dx", "dxx", "dy", "dxy")]
    adding += [F.sum(c).alias(c) for c in degrees]
    sets = [F.array_distinct(F.flatten(F.collect_list(f"dset{i}"))).alias(f"dset{i}") for i in range(len(degree_columns))]
    each = cells.groupBy(entity, "_interval").agg(*adding, *sets)

    recent = [f"last{n}" for n in RECENT_WINDOWS]
    spans = intervals.table(cells, "fit", flags=["last_year", *recent])
    sums = [F.sum(c).alias(c) for c in (*_SUMS, *degrees)]
    sums += [F.coalesce(F.sum(f"{c}_{s}"), F.lit(0)).alias(f"{c}_{s}") for s in "sw" for c in ("n", "ny")]
    sums += [F.sum(f"sy_{s}").alias(f"sy_{s}") for s in "sw"]
    sums += [F.max("last_day").alias("last_day"), F.min("cap").alias("cap"), *sets]
    for w in ("last_year", *recent):
        sums += [F.coalesce(F.sum(F.when(F.col(w), F.col(c))), F.lit(0)).alias(f"{c}_{w}") for c in ("n", "ny", "sy", "zeros")]
    a = each.join(spans, "_interval").groupBy("block", entity).agg(*sums)

    mean = safe_div("sy", "ny")
    summer_mean, winter_mean = safe_div("sy_s", "ny_s"), safe_div("sy_w", "ny_w")
    out = a.join(_of_days(rows, intervals, entity), ["block", entity]).join(_ends(rows, intervals), "block")
    columns = {
        "log_mean": mean,
        "log_std": F.when(F.col("ny") > 0, F.sqrt(F.greatest(safe_div("syy", "ny") - mean * mean, F.lit(0.0)))),
        "days": F.col("n"),
        "zero_share": F.col("zeros") / F.col("n"),
        "load_factor": safe_div(safe_div("s_target", "n_target"), F.col("cap.c") * 24.0),
        "trend": F.when(F.col("ny") >= 3, _slope("ny", F.col("st"), F.col("stt"), F.col("sy"), F.col("sty"))),
        "last_row_age": F.datediff("_f1", "last_day"),
        "last_year_log_mean": safe_div("sy_last_year", "ny_last_year"),
        "last_year_zero_share": safe_div("zeros_last_year", "n_last_year"),
        "last_year_days": F.nullif("n_last_year", F.lit(0)),
        "season_amplitude": F.when((F.col("n_s") >= SEASON_MIN_DAYS) & (F.col("n_w") >= SEASON_MIN_DAYS), summer_mean - winter_mean),
        "season_days": F.least("n_s", "n_w"),
    }
    for w in recent:
        columns |= {f"log_{w}": safe_div(f"sy_{w}", f"ny_{w}"), f"{w}_days": F.col(f"n_{w}")}
    for i, c in enumerate(degree_columns):
        slope = _slope(f"dn{i}", *(F.col(f"{k}{i}") for k in ("dx", "dxx", "dy", "dxy")))
        columns[f"slope_{c}"] = F.when((F.col(f"dn{i}") >= 3) & (F.size(f"dset{i}") >= 3), slope)
    kept = ["tail_zero_run", "log_median", "log_p10", "log_p90"]
    level = out.select("block", entity, *kept, *(v.alias(k) for k, v in columns.items()))
    return level.withColumns(
        {
            "dead": (F.col("tail_zero_run") >= DEAD_AFTER_ROWS).cast("int"),
            "spread": F.col("log_p90") - F.col("log_p10"),
            "drift": F.col("log_last14") - F.col("log_mean"),
        }
    )


def _ends(df: DataFrame, intervals: Intervals) -> DataFrame:
    """First and last days of both windows, a row per block."""
    rows = [(name, *w["label"], *w["fit"]) for name, w in intervals.windows.items()]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "block string, _l0 date, _l1 date, _f0 date, _f1 date"))


def _of_days(rows: DataFrame, intervals: Intervals, entity: str) -> DataFrame:
    """(block, entity): quantiles and the rows after the last positive one, from one array of days per entity."""
    spans = {name: w["fit"] for name, w in intervals.windows.items()}
    schema = f"block string, {entity} {rows.schema[entity].dataType.simpleString()}, tail_zero_run long, log_median double, log_p10 double, log_p90 double"
    if not spans:
        return rows.sparkSession.createDataFrame([], schema)
    first, last = min(a for a, _ in spans.values()), max(b for _, b in spans.values())
    day = F.struct(F.col("_day").alias("d"), F.col("_y").alias("y"), (F.col("_positive")).alias("p"))
    days = rows.filter(F.col("_day").between(F.lit(first), F.lit(last))).groupBy(entity).agg(F.collect_list(day).alias("_days"))

    def part(name: str, a: dt.date, b: dt.date) -> Column:
        return F.struct(F.lit(name).alias("block"), F.filter("_days", lambda x: x.d.between(F.lit(a), F.lit(b))).alias("_own"))

    each = days.select(entity, F.inline(F.array(*[part(n, *w) for n, w in spans.items()]))).filter(F.size("_own") > 0)
    positive = F.filter("_own", lambda x: x.p)
    each = each.withColumns(
        {"_last": F.array_max(F.transform(positive, lambda x: x.d)), "_ys": F.sort_array(F.filter(F.transform("_own", lambda x: x.y), lambda v: v.isNotNull()))}
    )
    after = F.size(F.filter("_own", lambda x: F.col("_last").isNull() | (x.d > F.col("_last"))))

    def quantile(p: float) -> Column:
        at = (F.size("_ys") - 1) * F.lit(p)
        low = F.floor(at).cast("int")
        under, over = F.get("_ys", low), F.get("_ys", F.least(low + 1, F.size("_ys") - 1))
        return under + (over - under) * (at - low)

    named = {"log_median": 0.5, "log_p10": 0.1, "log_p90": 0.9}
    return each.select("block", entity, after.cast("long").alias("tail_zero_run"), *(quantile(p).alias(n) for n, p in named.items()))


def _deviations(outside: DataFrame, entity: str) -> DataFrame:
    """(block, entity): mean deviation by weekday and by month as arrays, and the spread of the weekdays."""

    def mean_of(key: str, k: int) -> Column:
        own = F.col(key) == k
        return safe_div(F.sum(F.when(own, F.col("sy"))), F.sum(F.when(own, F.col("ny")))) - F.max("_mean")

    table = outside.groupBy("block", entity).agg(
        F.array(*[mean_of("_dow", k) for k in range(7)]).alias("_dows"), F.array(*[mean_of("_moy", k) for k in range(1, 13)]).alias("_moys")
    )
    known = F.filter("_dows", lambda x: x.isNotNull())
    table = table.withColumn("_known", known).withColumn("_middle", safe_div(F.aggregate("_known", F.lit(0.0), lambda s, x: s + x), F.size("_known")))
    spread = F.sqrt(safe_div(F.aggregate("_known", F.lit(0.0), lambda s, x: s + (x - F.col("_middle")) * (x - F.col("_middle"))), F.size("_known")))
    return table.withColumn("dow_amplitude", spread).drop("_known", "_middle")


def rolling_origin_blocks(
    df: DataFrame,
    blocks: Sequence[Block],
    entity: str,
    time: str,
    target: str,
    capacity: str,
    district: str,
    degree_columns: Sequence[str] = (),
) -> DataFrame:
    """All training blocks in one job: label rows with summaries from before the label window, profiles from everything
    outside it, group fallbacks, presence, horizon day and densities. Blocks without label or summary rows give none."""
    names = df.columns
    # the (cheap) panel is read for its days, its moments, its label rows and the days of its entities
    df = cut_lineage(df)
    intervals = elementary_intervals(df, time, blocks)
    rows = _with_interval(df, time, intervals).withColumns(
        {
            "_y": F.when(F.col(target).isNotNull(), log_target(target)),
            "_positive": F.coalesce(F.col(target) > 0, F.lit(False)),
            "_bucket": capacity_bucket(capacity),
            "_dow": F.weekday("_day"),
            "_moy": F.month("_day"),
        }
    )
    cells = cut_lineage(_moments(rows, entity, target, capacity, district, degree_columns))

    place = ["block", entity, district, "_bucket", "_moy", "_dow"]
    outside = cells.select(entity, district, "_bucket", "_interval", "_moy", "_dow", "sy", "ny").join(intervals.table(df, "label", negate=True), "_interval")
    outside = outside.groupBy(*place).agg(F.sum("sy").alias("sy"), F.sum("ny").alias("ny"))
    own = Window.partitionBy("block", entity)
    outside = cut_lineage(outside.withColumn("_mean", safe_div(F.sum("sy").over(own), F.sum("ny").over(own))))

    present = cells.join(intervals.table(df, "label"), "_interval").groupBy("block", entity)
    present = present.agg(F.sum("n").alias("present_days"), F.min("first_day").alias("_first"), F.max("last_day").alias("_last"))
    summaries = _levels(cells, rows, intervals, entity, degree_columns).withColumn("_seen", F.lit(1))
    known = present.join(summaries, ["block", entity], "left").join(_deviations(outside, entity), ["block", entity], "left")

    out = rows.select(*names, "_day", "_interval", "_dow", "_moy").join(intervals.table(df, "label"), "_interval").drop("_interval")
    out = out.join(known, ["block", entity]).join(_ends(df, intervals), "block")
    cold = F.col("_seen").isNull()
    span_days = F.datediff("_last", "_first") + 1
    summary_days = F.datediff("_f1", "_f0") + 1
    out = out.withColumns(
        {
            "cold": cold.cast("int"),
            "dow_deviation": F.when(~cold, F.get("_dows", F.col("_dow"))),
            "month_deviation": F.when(~cold, F.get("_moys", F.col("_moy") - 1)),
            "dow_amplitude": F.when(~cold, F.col("dow_amplitude")),
            "present_first": F.datediff("_first", "_l0"),
            "present_last": F.datediff("_last", "_l0"),
            "present_span": span_days,
            "present_fill": F.col("present_days") / span_days,
            "present_share": F.col("present_days") / (F.datediff("_l1", "_l0") + 1),
            "summary_days": summary_days,
            "summary_fill": F.col("days") / summary_days,
            "horizon_day": F.datediff("_day", "_f1"),
        }
    ).drop("_day", "_dow", "_moy", "_dows", "_moys", "_first", "_last", "_seen", "_l0", "_l1", "_f0", "_f1")

    fits = cells.join(intervals.table(df, "fit"), "_interval").groupBy("block", district, "_bucket")
    fits = cut_lineage(fits.agg(F.sum("sy").alias("_s"), F.sum("ny").alias("_n"), F.sum("n").alias("_rows")).withColumnRenamed("_bucket", "bucket"))
    groups = outside.groupBy("block", district, F.col("_bucket").alias("bucket"), "_moy", "_dow")
    groups = cut_lineage(groups.agg(F.sum(F.col("sy") - F.col("ny") * F.col("_mean")).alias("_s"), F.sum("ny").alias("_n")))
    out = attach_group_levels(out, fits, capacity, district, ["block"])
    return attach_group_profiles(out, groups, time, capacity, district, ["block"])


def keep_clear_blocks(df: DataFrame, blocks: Sequence[Block], target_block: Block) -> DataFrame:
    """Drops the rows of blocks whose label window overlaps the target block's."""
    clear = [
        b.name for b in blocks if b.label_end < target_block.label_start or b.label_start > target_block.label_end
    ]
    return df.filter(F.col("block").isin(clear))
