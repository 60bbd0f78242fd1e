"""The distributed primitives against plain pandas, with a hot group and a hot value holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.core.scale import average_rank, exact_quantiles, join_checked, salted_join, value_positions
from panelforge.operators import spatial as SP


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 6000
    g = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 20, n).astype(str))
    v = np.where(rng.random(n) < 0.35, 7.0, np.round(rng.normal(0, 50, n), 2))
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v})
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_exact_quantiles_by_group(skewed):
    pdf, df = skewed
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.937, "e": 1.0}
    got = exact_quantiles(df, "v", probs, ["g"], buckets=16).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["v"].quantile(list(probs.values())).unstack().sort_index()
    assert np.allclose(got[list(probs)].to_numpy(), want.to_numpy())


def test_exact_quantiles_overall(skewed):
    pdf, df = skewed
    got = exact_quantiles(df, "v", {"m": 0.5, "p": 0.99}).first()
    assert np.isclose(got["m"], pdf["v"].quantile(0.5)) and np.isclose(got["p"], pdf["v"].quantile(0.99))


@pytest.mark.parametrize("by", [(), ("g",)])
def test_average_rank(skewed, by):
    pdf, df = skewed
    got = average_rank(df, "v", "r", by, pct=True, buckets=32).toPandas().sort_values("id")
    ref = pdf.groupby("g")["v"] if by else pdf["v"]
    assert np.allclose(got["r"].to_numpy(), ref.rank(pct=True).to_numpy())


def test_rank_keeps_null_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 2.0), (4, 5.0)], "id int, v double")
    got = {r["id"]: r["r"] for r in average_rank(df, "v", "r").collect()}
    assert got == {1: 1.5, 2: None, 3: 1.5, 4: 3.0}


def test_positions_do_not_depend_on_the_bounds(skewed):
    _, df = skewed
    a = value_positions(df, "v", buckets=4).orderBy("v").collect()
    b = value_positions(df, "v", buckets=100).orderBy("v").collect()
    assert a == b


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, skewed, how):
    _, df = skewed
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("3", 3), ("zz", 4)], "g string, w int")
    got = salted_join(df, right, ["g"], 5, how)
    want = df.join(right, ["g"], how)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_salting_refuses_outer_joins(skewed):
    _, df = skewed
    with pytest.raises(ValueError):
        salted_join(df, df, ["g"], 2, "full")


def test_join_checked_runs_nothing_and_broadcasts_by_size_only(skewed, spark):
    _, df = skewed
    table = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    spark.sparkContext.setJobGroup("planning", "")
    joined = join_checked(df, table, ["g"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    small = joined.select("id", "n").orderBy("id").collect()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert join_checked(df, table, ["g"]).select("id", "n").orderBy("id").collect() == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _brute_knn(pdf, k, km):
    rows = []
    for a in pdf.itertuples():
        d = []
        for b in pdf.itertuples():
            if a.key == b.key:
                continue
            p1, p2 = np.radians(a.lat), np.radians(b.lat)
            h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(b.lon - a.lon) / 2) ** 2
            x = 2 * SP.EARTH_KM * np.arcsin(min(1.0, np.sqrt(h)))
            if x <= km:
                d.append((x, b.key))
        for i, (x, o) in enumerate(sorted(d)[:k]):
            rows.append((a.key, o, i + 1))
    return sorted(rows)


def test_nearest_neighbours_with_a_crowded_place(spark):
    """A third of the keys share one spot, others lie near a pole, on the date line, or alone."""
    rng = np.random.default_rng(5)
    pts = [(i, 38.0, 27.0) for i in range(30)]
    pts += [(100 + i, 38 + rng.normal(0, 0.05), 27 + rng.normal(0, 0.05)) for i in range(30)]
    pts += [(200 + i, rng.uniform(36, 42), rng.uniform(26, 45)) for i in range(25)]
    pts += [(300, 10.0, 179.9), (301, 10.1, -179.9), (302, 89.9, 10.0), (303, 89.9, -170.0), (304, -45.0, 0.0)]
    pdf = pd.DataFrame(pts, columns=["key", "lat", "lon"])
    got = SP.nearest_neighbours(spark.createDataFrame(pdf), "key", k=3, max_distance_km=120.0, crowd=5)
    rows = sorted((r["key"], r["neighbour"], r["neighbour_rank"]) for r in got.collect())
    assert rows == _brute_knn(pdf, 3, 120.0)


def test_radius_join_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    ev = pd.DataFrame({"lat": rng.uniform(36, 42, 300), "lon": rng.uniform(26, 45, 300), "day": pd.Timestamp("2024-01-01")})
    ev = pd.concat([ev, pd.DataFrame({"lat": [39.0] * 100, "lon": [30.0] * 100, "day": pd.Timestamp("2024-01-01")})])
    site = pd.DataFrame({"k": range(15), "lat": rng.uniform(36, 42, 15), "lon": rng.uniform(26, 45, 15)})
    got = SP.daily_point_intensity(spark.createDataFrame(ev), spark.createDataFrame(site), "k", "day", (25, 100)).toPandas()
    for s in site.itertuples():
        p1, p2 = np.radians(s.lat), np.radians(ev["lat"].to_numpy())
        h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(ev["lon"].to_numpy() - s.lon) / 2) ** 2
        d = 2 * SP.EARTH_KM * np.arcsin(np.sqrt(h))
        row = got[got["k"] == s.k]
        for r in (25, 100):
            n = row[f"event_count_r{r}"].fillna(0).sum() if len(row) else 0
            assert n == (d <= r).sum()


def test_sorted_index(skewed):
    from panelforge.core.scale import sorted_index

    pdf, df = skewed
    got = sorted_index(df, ["v", "id"], "n").orderBy("n").toPandas()
    assert got["n"].tolist() == list(range(len(pdf)))
    assert got["id"].tolist() == pdf.sort_values(["v", "id"])["id"].tolist()
