"""Structured Streaming forms of the hourly roll-up, the days-since-event state and late revisions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelforge.sources.partitions import merge_partitions, read_current


def stream_daily_rollup(
    stream: DataFrame, time: str, keys: Sequence[str], value: str, delay: str = "1 hour"
) -> DataFrame:
    """Daily mean, sum, maximum and count per key; a day is emitted once the watermark has passed its end."""
    timed = stream.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", delay)
    daily = timed.groupBy(F.window("_ts", "1 day"), *keys).agg(
        F.avg(value).alias(f"{value}_mean"),
        F.sum(value).alias(f"{value}_sum"),
        F.max(value).alias(f"{value}_max"),
        F.count(F.lit(1)).alias("rows"),
    )
    return daily.select(F.to_date("window.start").alias("day"), *keys, f"{value}_mean", f"{value}_sum", f"{value}_max", "rows")


_STATE = "last_event long, last_day long, run long"


def stream_event_state(
    stream: DataFrame, entity: str, day: str, value: str, out_type: str = "long", ttl_ms: int | None = None
) -> DataFrame:
    """Days since the last event (value > 0) and the length of the current run of event days, per entity and day.

    Input rows are (entity, day, value) with one row per entity and day; the state of an entity is three numbers. Rows of
    a batch are ordered by day inside the entity and handled as arrays. A day at or before the last one seen comes out
    with `late` = 1 and without values, so that nothing disappears. With `ttl_ms` the state of an entity that sends
    nothing for that long is dropped, and its next day counts as its first.
    """
    schema = f"{entity} {out_type}, {day} date, days_since_event int, event_run int, late int"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_event, last_day, run = state.get if state.exists else (-1, -1, 0)
        rows = pd.concat(list(frames)).sort_values(day, kind="stable")
        days = pd.to_datetime(rows[day])
        n = (days.to_numpy().astype("datetime64[D]").astype("int64")) + 719_163  # day 1 is 1 January of year 1
        late = n <= np.concatenate([[last_day], np.maximum.accumulate(n)[:-1]])
        late |= n <= last_day
        on_time, hit = n[~late], (rows[value].to_numpy(dtype="float64", na_value=np.nan) > 0)[~late]
        since, length = np.zeros(0, "int64"), np.zeros(0, "int64")
        if len(on_time):
            events = np.maximum.accumulate(np.where(hit, on_time, last_event))
            since = np.where(events < 0, -1, on_time - events)
            place = np.arange(len(on_time))
            before = np.concatenate([[last_day], on_time[:-1]])
            went_on = np.concatenate([[run > 0], hit[:-1]]) & (on_time == before + 1)
            starts = np.where(hit & ~went_on, place, np.iinfo("int64").min)
            starts[0] = -run if hit[0] and went_on[0] else starts[0]
            length = np.where(hit, place - np.maximum.accumulate(starts) + 1, 0)
            state.update((int(events[-1]), int(on_time[-1]), int(length[-1])))
        elif state.exists:
            state.update((last_event, last_day, run))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        out = pd.DataFrame({entity: key[0], day: days.dt.date.to_numpy(), "late": late.astype("int32")})
        for name, values in (("days_since_event", since), ("event_run", length)):
            column = np.full(len(n), -1, "int64")
            column[~late] = values
            out[name] = pd.array(column, dtype="Int32")
            out.loc[column < 0, name] = pd.NA
        yield out[[entity, day, "days_since_event", "event_run", "late"]]

    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy(entity).applyInPandasWithState(update, schema, _STATE, "append", timeout)


def revise(current: DataFrame, batch: DataFrame, keys: Sequence[str], flag: str = "is_forecast", order: str = "version") -> DataFrame:
    """Archive rows (flag 0) beat forecast rows, newer versions beat older ones. One aggregate per key."""
    rest = [c for c in current.columns if c not in keys]
    both = current.unionByName(batch.select(*current.columns))
    ranked = F.struct(F.col(flag).alias("_f"), (-F.col(order)).alias("_o"), F.struct(*rest).alias("row"))
    best = both.groupBy(*keys).agg(F.min(ranked).alias("_r"))
    return best.select(*keys, "_r.row.*").select(*current.columns)


def read_revised(spark: SparkSession, path: str) -> DataFrame:
    return read_current(spark, path)


def start_revisions(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    day: str,
    flag: str = "is_forecast",
    order: str = "version",
) -> StreamingQuery:
    """Merges each micro-batch into a table kept by `day` (one of the keys). Only the days of the batch are read and written;
    readers see a batch as a whole. A batch that is run again after it was merged changes nothing."""
    if day not in keys:
        raise ValueError(f"{day} must be one of the keys")

    def apply(batch: DataFrame, number: int) -> None:
        merge_partitions(batch, path, day, lambda now, new: revise(now, new, keys, flag, order), f"{checkpoint}:{number}")

    return (
        stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
