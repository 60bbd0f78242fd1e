"""Operators whose work must grow with their input: results against plain loops, and what bounds the work."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import aggregates as A
from panelforge.functions import transforms as TR
from panelforge.operators import panel as P
from panelforge.operators import spatial as SP
from panelforge.operators import windows as W

DAY0 = dt.date(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def study(rows, window, least):
    """Event study by loops over (entity, location, day, value) rows."""
    held = {}
    for e, loc, d, v in rows:
        if v is not None:
            held[e, loc, d] = held.get((e, loc, d), 0.0) + v
    first = {}
    for e, loc, d in held:
        first[e, loc] = min(d, first.get((e, loc), d))
    days = [d for *_, d in held]
    lo, hi = min(days), max(days)
    born = {}
    for (_, loc), d in first.items():
        if d - window >= lo and d + window <= hi:
            born[loc, d] = born.get((loc, d), 0) + 1
    out = {}
    for (loc, b), n in born.items():
        settled, before, after = 0, 0.0, 0.0
        for (e, at), f in first.items():
            if None in (e, at) or at != loc or f >= b - window:
                continue
            x = [v for (i, j, d), v in held.items() if (i, j) == (e, loc) and b - window <= d < b]
            y = [v for (i, j, d), v in held.items() if (i, j) == (e, loc) and b < d <= b + window]
            if x + y and len(x) >= least and len(y) >= least:
                settled, before, after = settled + 1, before + (sum(x) / len(x) if x else 0.0), after + (sum(y) / len(y) if y else 0.0)
        if settled and before > 0:
            out[loc, b] = (n, settled, round(before, 6), round(after, 6), round(math.log(max(after, 1e-6) / before), 6))
    return out


@pytest.mark.parametrize(("window", "least"), [(5, 1), (8, 2), (3, 0)])
def test_event_study_adds_up_stretches(spark, monkeypatch, window, least):
    rng = random.Random(window)
    start = {e: rng.randrange(40) for e in range(30)}
    rows = [(e, e % 3, d, rng.choice([0.0, 1.5, 2.25])) for e in range(30) for d in range(start[e], 60) if rng.random() < 0.4]
    rows += rows[:5] + [(None, 1, 20, 1.0), (3, None, 20, 1.0), (4, 1, 25, None)]
    asked = []
    cut = A.cut_lineage
    monkeypatch.setattr(A, "cut_lineage", lambda df: asked.append(df) or cut(df))
    df = spark.createDataFrame([(e, loc, DAY0 + dt.timedelta(days=d), v) for e, loc, d, v in rows], "e int, l int, d date, v double")
    got = {
        (r.l, (r.birth_day - DAY0).days): (r.n_new, r.n_settled, round(r.before_total, 6), round(r.after_total or 0.0, 6), round(r.log_ratio, 6))
        for r in A.load_transfer_study(df, "e", "l", "d", "v", window, least).collect()
    }
    assert got == study(rows, window, least)
    # members and events meet once, after the members of a location were added up
    assert plan(asked[0]).count("Join") == 1


def test_pairs_are_not_broadcast_or_merged_into_few_tasks(spark):
    rng = random.Random(2)
    points = spark.createDataFrame([(i, rng.uniform(38, 40), rng.uniform(30, 33)) for i in range(300)], "k int, lat double, lon double")
    sites = points.filter("k < 40").withColumnRenamed("k", "s")
    pairs = SP.distance_pairs(sites, points, "s", "k", 60.0)
    all_pairs = sites.select("s", F.col("lat").alias("a"), F.col("lon").alias("o")).crossJoin(points).filter(SP.haversine_km(F.col("a"), F.col("o"), F.col("lat"), F.col("lon")) <= 60.0)
    assert sorted(pairs.select("s", "k").collect()) == sorted(all_pairs.select("s", "k").collect())
    ran = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in ran and "SortMergeJoin" in ran
    assert pairs.rdd.getNumPartitions() >= 64


def test_intensities_leave_the_cover_where_it_is(spark, monkeypatch):
    rng = random.Random(3)
    joined = []
    join = SP.spread_join
    monkeypatch.setattr(SP, "spread_join", lambda *a: joined.append(join(*a)) or joined[-1])
    events = spark.createDataFrame([(rng.uniform(38, 40), rng.uniform(30, 33), DAY0, 1.0) for _ in range(400)], "lat double, lon double, day date, w double")
    sites = spark.createDataFrame([(i, rng.uniform(38, 40), rng.uniform(30, 33)) for i in range(20)], "k int, lat double, lon double")
    out = SP.daily_point_intensity(events, sites, "k", "day", (25, 50), "w")
    out.collect()
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in joined]
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)


def test_the_first_radius_leaves_few_places_in_a_cell(spark):
    places = spark.range(4000).select((F.lit(36.0) + F.col("id") % 80 / 40).alias("p_lat"), (F.lit(26.0) + F.floor(F.col("id") / 80) / 25).alias("p_lon"), F.col("id").alias("k"))
    asked = []
    start = SP._start_radius
    with pytest.MonkeyPatch.context() as m:
        m.setattr(SP, "_start_radius", lambda df, km, crowd: asked.append((crowd, start(df, km, crowd))) or asked[-1][1])
        SP.nearest_neighbours(places.withColumnsRenamed({"p_lat": "lat", "p_lon": "lon"}), "k", k=3, max_distance_km=120.0)
    crowd, radius = asked[0]
    cells = places.withColumns(SP.point_cell("p_lat", "p_lon", radius)).groupBy("_band", "_cell").count()
    assert crowd <= 64 and cells.agg(F.max("count")).first()[0] <= crowd


def test_a_dense_panel_has_as_many_partitions_as_its_rows_need(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_ROWS", 1000)
    rows = spark.range(400).select((F.col("id") % 100).alias("e"), F.date_add(F.lit(DAY0), (F.col("id") * 7 % 90).cast("int")).alias("d"), F.lit(1.0).alias("v"))
    dense = P.densify_panel(rows, ["e"], "d", ["v"])
    n = dense.count()
    assert n == 100 * 90 and dense.agg(F.sum("v")).first()[0] == 400.0
    out = W.consecutive_extreme_days(dense, "v", ["e"], "d", 1.0, above=False)
    assert 8 <= out.rdd.getNumPartitions() <= 12


@pytest.mark.parametrize("horizon", [1, 7, 45])
def test_months_back_without_a_join(spark, horizon):
    rng = random.Random(horizon)
    rows = [(e, DAY0 + dt.timedelta(days=d), rng.choice([None, 0.0, 1.0, 2.5])) for e in (1, 2, None) for d in range(150) if rng.random() < 0.7]
    rows += rows[:3]
    out = A.previous_month_features(spark.createDataFrame(rows, "e int, d date, v double"), "v", ["e"], "d", horizon)
    assert "Join" not in plan(out)
    p = f"v_{'' if horizon == 1 else f'h{horizon}_'}month"
    for r in out.collect():
        at = r.d - dt.timedelta(days=horizon - 1)
        y, m = divmod(at.year * 12 + at.month - 2, 12)
        month = [(d, v) for e, d, v in rows if r.e is not None and e == r.e and (d.year, d.month - 1) == (y, m)]
        known = [v for _, v in month if v is not None]
        same = [v for d, v in month if d.day == r.d.day and v is not None]
        want = (sum(known), sum(known) / len(known) if known else None, max(known, default=None), sum(v > 0 for v in known), sum(v == 0 for v in known)) if month else (None,) * 5
        got = tuple(r[f"{p}_{k}"] for k in ("total", "mean", "max", "event_days", "empty_days"))
        assert [x if x is None else round(x, 9) for x in got] == [x if x is None else round(x, 9) for x in want]
        assert r[f"{p}_same_day"] == (sum(same) if same else None)


def test_a_group_with_all_rows_is_spread(spark):
    df = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    out = TR.soften_outliers(df, "v", ["g"], "soft")
    assert "_salt" in plan(out) and out.count() == 1000
    assert out.agg(F.max("soft")).first()[0] == 999.0
