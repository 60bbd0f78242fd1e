"""Event log to dense panel, grid snapping, coverage and row bridging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.exprs import require_columns, safe_div

Day = str | date | Column


#: Rows of a dense panel in one task, about, so that a task's sorts and windows don't grow with the table.
TASK_ROWS = 1 << 18

FREQUENCIES = ("hour", "day", "week", "month")


def step_number(time: str | Column, freq: str) -> Column:
    """Number of the grid step a time lies in: hours, days, weeks (from Monday) or months, counted in the session's zone."""
    t = F.col(time) if isinstance(time, str) else time
    if freq == "hour":
        return F.floor(F.unix_timestamp(t.cast("timestamp")) / 3600)
    day = F.to_date(t)
    if freq == "day":
        return F.unix_date(day).cast("long")
    if freq == "week":
        return F.floor((F.unix_date(day) - 4) / 7)
    if freq == "month":
        return (F.year(day) * 12 + F.month(day) - 1).cast("long")
    raise ValueError(f"freq is one of {FREQUENCIES}")


def step_label(number: str | Column, freq: str) -> Column:
    """The time a grid step goes by: its hour, its day, its Monday, or the last day of its month."""
    n = F.col(number) if isinstance(number, str) else number
    if freq == "hour":
        return F.timestamp_seconds(n * 3600)
    if freq == "month":
        return F.last_day(F.make_date(F.floor(n / 12).cast("int"), (F.pmod(n, F.lit(12)) + 1).cast("int"), F.lit(1)))
    return F.date_from_unix_date((n * 7 + 4 if freq == "week" else n).cast("int"))


def _bound(df: DataFrame, agg: Column, given: Day | None) -> Column:
    """A fixed grid bound, or the aggregate over the frame as a scalar subquery (one row by construction)."""
    if given is None:
        return df.agg(agg.alias("b")).scalar()
    return given if isinstance(given, Column) else F.lit(str(given)).cast("date")


def snap_to_step(time: str | Column, step: str, origin: Column | None = None) -> Column:
    """Last grid point <= time. `step` is day, hour, minute, week, month or '<n> seconds|minutes|hours'."""
    t = F.col(time) if isinstance(time, str) else time
    parts = step.split()
    if len(parts) == 1:
        return F.date_trunc(step, t)
    size = int(parts[0]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[parts[1].rstrip("s")]
    seconds = F.unix_timestamp(t.cast("timestamp"))
    start = F.lit(0) if origin is None else F.unix_timestamp(origin.cast("timestamp"))
    return F.timestamp_seconds(start + F.floor((seconds - start) / F.lit(size)) * F.lit(size))


def densify_panel(
    df: DataFrame,
    entity: Sequence[str],
    time: str,
    sums: Sequence[str],
    firsts: Mapping[str, str] | None = None,
    fill: float | None = 0.0,
    start: Day | None = None,
    end: Day | None = None,
    flag: str = "is_filled",
    freq: str = "day",
) -> DataFrame:
    """Every entity gets every step between the grid bounds: every day, or every hour, week or month end.

    Cells are summed first (map-side combine, so a hot entity costs one row per step after it). The missing steps
    then come from exploding the gap to the next seen one inside each entity: one shuffle by entity, no grid join, and the
    result is already partitioned for the windows that follow. One pass over the log finds the bounds and about how many
    rows the grid has, which sets the number of partitions. `firsts` maps a column to the column whose
    smallest value picks the row it is taken from. `fill` None keeps absent measures NULL.
    """
    require_columns(df, [*entity, time, *sums])
    firsts = dict(firsts or {})
    valid = df.filter(F.col(time).isNotNull())
    for k in entity:
        valid = valid.filter(F.col(k).isNotNull())
    valid = valid.withColumn(time, step_number(time, freq))
    ends = (F.min(time) if start is None else F.max(step_number(_bound(valid, F.min(time), start), freq)),
            F.max(time) if end is None else F.max(step_number(_bound(valid, F.max(time), end), freq)))
    grid = valid.agg(ends[0].alias("lo"), ends[1].alias("hi"), F.approx_count_distinct(F.struct(*entity)).alias("n")).first()
    lo, hi = (F.lit(b).cast("long") for b in (grid.lo, grid.hi))
    cells_of_grid = 0 if grid.lo is None or grid.hi is None else grid.n * max(grid.hi - grid.lo + 1, 0)
    inside = valid.withColumn("_lo", lo).withColumn("_hi", hi).filter(F.col(time).between(F.col("_lo"), F.col("_hi")))
    aggs = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums]
    aggs += [F.min_by(c, o).alias(c) for c, o in firsts.items()]
    cells = inside.groupBy(*entity, time).agg(*aggs, F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))

    # by number: adaptive execution would merge partitions by the bytes of the seen cells, and a task then hold all the rows
    # that come of them
    cells = cells.repartition(1 + cells_of_grid // TASK_ROWS, *entity)
    w = Window.partitionBy(*entity).orderBy(time)
    is_first = F.lag(time).over(w).isNull()
    until = F.coalesce(F.lead(time).over(w) - 1, F.col("_hi"))
    since = F.when(is_first, F.col("_lo")).otherwise(F.col(time))
    spans = cells.withColumn("_since", since).withColumn("_until", until)
    rows = spans.withColumn("_step", F.explode(F.sequence("_since", "_until")))
    seen = F.col("_step") == F.col(time)
    empty = F.lit(None).cast("double") if fill is None else F.lit(float(fill))
    return rows.select(
        *entity,
        step_label("_step", freq).alias(time),
        *[F.when(seen, F.col(c)).otherwise(empty).alias(c) for c in sums],
        *[F.when(seen, F.col(c)).alias(c) for c in firsts],
        F.when(seen, 0).otherwise(1).alias(flag),
    )


def panel_coverage(df: DataFrame, entity: Sequence[str], time: str, freq: str = "day") -> DataFrame:
    """One row: entities, grid steps, expected and present cells, and their ratio."""
    valid = df.filter(F.col(time).isNotNull())
    for k in entity:
        valid = valid.filter(F.col(k).isNotNull())
    cells = valid.select(*entity, step_number(time, freq).alias("_d")).distinct()
    per_entity = cells.groupBy(*entity).agg(
        F.count(F.lit(1)).alias("_cells"), F.min("_d").alias("_a"), F.max("_d").alias("_b")
    )
    one = per_entity.agg(
        F.count(F.lit(1)).alias("entity_count"),
        (F.max("_b") - F.min("_a") + 1).alias("time_steps"),
        F.sum("_cells").alias("actual_rows"),
    )
    expected = F.col("entity_count") * F.col("time_steps")
    return one.select(
        "entity_count",
        "time_steps",
        expected.alias("expected_rows"),
        "actual_rows",
        safe_div("actual_rows", expected).alias("coverage"),
    )


def bridge_days(
    train: DataFrame, test: DataFrame, entity: Sequence[str], time: str, flag: str, freq: str = "day"
) -> DataFrame:
    """Rows for the steps between the end of train and the start of test, one per entity seen in test, so that shifting
    by rows equals shifting by steps. Callers drop them again by `flag`."""
    after = train.agg((F.max(step_number(time, freq)) + 1).alias("b")).scalar()
    before = test.agg((F.min(step_number(time, freq)) - 1).alias("b")).scalar()
    keys = test.select(*entity).distinct().withColumn("_a", after)
    keys = keys.withColumn("_b", before).filter(F.col("_a") <= F.col("_b"))
    steps = keys.withColumn("_step", F.explode(F.sequence("_a", "_b")))
    return steps.select(*entity, step_label("_step", freq).alias(time), F.lit(1).alias(flag))


def duration_panel(
    log: DataFrame,
    key: str,
    started: str,
    ended: str,
    key_expr: Column | None = None,
    zone: str = "Europe/Istanbul",
) -> DataFrame:
    """Outage log to a dense daily panel: count and minutes per normalised key on the local start day."""
    minutes = (F.unix_timestamp(ended) - F.unix_timestamp(started)) / 60.0
    rows = log.select(
        (F.col(key) if key_expr is None else key_expr).alias(key),
        F.to_date(F.from_utc_timestamp(F.col(started).cast("timestamp"), zone)).alias("day"),
        minutes.alias("minutes"),
        F.lit(1.0).alias("outages"),
    ).filter(F.col("minutes") >= 0)
    return densify_panel(rows, [key], "day", ["minutes", "outages"])


def reference_panel(
    log: DataFrame,
    reference: DataFrame,
    key: Sequence[str],
    day: str,
    sums: Sequence[str],
    count_name: str = "events",
    covered: str = "covered_day",
) -> DataFrame:
    """Dense panel over the keys of `reference`, not over the keys that happen to occur in the log. `covered` is 1 on
    days for which any key has a record."""
    cells = log.groupBy(*key, F.to_date(day).alias(day)).agg(
        F.count(F.lit(1)).alias(count_name), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums]
    )
    days = cells.select(day).distinct().withColumn("_covered", F.lit(1))
    lo = log.agg(F.min(F.to_date(day)).alias("b")).scalar()
    hi = log.agg(F.max(F.to_date(day)).alias("b")).scalar()
    grid = (
        reference.select(*key)
        .distinct()
        .withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .select(*key, F.explode(F.sequence("_lo", "_hi")).alias(day))
    )
    out = grid.join(cells, [*key, day], "left").join(days, day, "left")
    return out.select(
        *key,
        day,
        F.coalesce(count_name, F.lit(0)).alias(count_name),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in sums],
        F.coalesce("_covered", F.lit(0)).alias(covered),
    )


def mask_history(
    df: DataFrame, entity: str, columns: Sequence[str], share: float, seed: int = 0, cold: str = "cold"
) -> DataFrame:
    """Hides history columns of a seeded share of entities, to train for entities without history. The choice is a
    function of entity and seed (the first 32 bits of an MD5 any engine can compute), so a recomputed task makes the same one."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(entity).cast("string")))
    hit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10000 < F.lit(int(round(share * 10000)))
    marked = df.withColumn("_hit", hit)
    hidden = {c: F.when(~F.col("_hit"), F.col(c)) for c in columns}
    return marked.withColumns({**hidden, cold: F.col("_hit").cast("int")}).drop("_hit")
