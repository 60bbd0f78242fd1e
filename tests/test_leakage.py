"""Features may not move when the target they must not see moves."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import aggregates as A
from panelforge.operators import origin_blocks as OB
from panelforge.operators import profiles as PR
from panelforge.operators import spatial as SP
from panelforge.operators import windows as W
from panelforge.operators.encode import oof_target_encode

H = 5


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    days = pd.date_range("2024-01-01", periods=80)
    rows = [(f"e{i}", d.date(), float(max(0.0, rng.normal(2, 3)))) for i in range(4) for d in days]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["entity", "day", "y"])).cache()


def features(df):
    df = W.lag_features(df, "y", ["entity"], "day", H, shifts=[H, 9])
    df = W.rolling_features(df, "y", ["entity"], "day", H, [7], ["mean", "max", "median"])
    df = W.expanding_features(df, "y", ["entity"], "day", H)
    df = W.event_decay_features(df, "y", ["entity"], "day", H)
    df = W.days_since_event(df, "y", ["entity"], "day", H)
    df = A.previous_month_features(df, "y", ["entity"], "day", H)
    df = A.mass_event_features(df, "y", ["entity"], "day", H)
    edges = df.sparkSession.createDataFrame(
        [("e0", "e1", 5.0), ("e1", "e2", 9.0), ("e2", "e0", 3.0)], "entity string, neighbour string, distance_km double"
    )
    return SP.neighbour_target_lag(df, edges, "entity", "day", "y", H, weight_by_distance=True)


def table(df):
    return df.drop("y").orderBy("entity", "day").toPandas()


@pytest.mark.parametrize("cut", ["2024-02-05", "2024-03-01"])
def test_the_last_horizon_days_are_invisible(panel, cut):
    """Changing every target from cut - H + 1 on leaves all features up to the cut as they are."""
    from_day = (dt.date.fromisoformat(cut) - dt.timedelta(days=H - 1)).isoformat()
    moved = panel.withColumn("y", F.when(F.col("day") >= from_day, F.col("y") * 1000 + 7).otherwise(F.col("y")))
    a = table(features(panel).filter(F.col("day") <= cut))
    b = table(features(moved).filter(F.col("day") <= cut))
    pd.testing.assert_frame_equal(a, b)


def test_the_day_at_the_horizon_is_visible(panel):
    cut = "2024-02-05"
    from_day = (dt.date.fromisoformat(cut) - dt.timedelta(days=H)).isoformat()
    moved = panel.withColumn("y", F.when(F.col("day") >= from_day, F.col("y") * 1000 + 7).otherwise(F.col("y")))
    a = table(features(panel).filter(F.col("day") == cut))
    b = table(features(moved).filter(F.col("day") == cut))
    assert not a.equals(b)


def test_profiles_ignore_the_apply_target(panel):
    rows = panel.withColumns({"cap": F.lit(250.0), "district": F.substring("entity", 2, 1)})
    fit, app = rows.filter(F.col("day") < "2024-03-01"), rows.filter(F.col("day") >= "2024-03-01")

    def build(a):
        s = PR.entity_summaries(fit, "entity", "day", "y", "cap")
        out = PR.add_group_levels(PR.apply_summaries(a, s, "day"), fit, "y", "cap", "district")
        return table(PR.add_group_profiles(out, fit, "entity", "day", "y", "cap", "district"))

    pd.testing.assert_frame_equal(build(app), build(app.withColumn("y", F.col("y") * 1000)))


def test_blocks_ignore_their_own_labels(panel):
    rows = panel.withColumns({"cap": F.lit(250.0), "district": F.substring("entity", 2, 1)})
    blocks = [OB.Block("b", "2024-01-01", "2024-02-10", "2024-02-15", "2024-03-05")]
    inside = F.col("day").between("2024-02-15", "2024-03-05")
    moved = rows.withColumn("y", F.when(inside, F.col("y") * 1000).otherwise(F.col("y")))
    a, b = (table(OB.rolling_origin_blocks(r, blocks, "entity", "day", "y", "cap", "district")) for r in (rows, moved))
    pd.testing.assert_frame_equal(a, b)


def test_an_overlapping_block_is_refused():
    with pytest.raises(ValueError):
        OB.Block("b", "2024-01-01", "2024-02-15", "2024-02-15", "2024-03-05")


def test_cold_entities_keep_null(panel):
    rows = panel.withColumn("cap", F.lit(100.0))
    s = PR.entity_summaries(rows.filter("entity <> 'e3'"), "entity", "day", "y", "cap")
    out = PR.apply_summaries(rows, s, "day").filter("entity = 'e3'").select("cold", "log_mean", "dow_deviation").distinct()
    assert [tuple(r) for r in out.collect()] == [(1, None, None)]


def test_target_encoding_ignores_the_own_fold(panel):
    rows = panel.withColumn("fold", F.pmod(F.dayofmonth("day"), F.lit(4)))
    moved = rows.withColumn("y", F.when(F.col("fold") == 2, F.col("y") * 1000).otherwise(F.col("y")))
    a, b = (
        oof_target_encode(r, "entity", "y", "fold", "enc").filter("fold = 2").select("entity", "day", "enc").orderBy("entity", "day").toPandas()
        for r in (rows, moved)
    )
    assert np.allclose(a["enc"], b["enc"])


def test_decay_equals_the_recursion(spark):
    rng = np.random.default_rng(2)
    days = np.cumsum(rng.integers(1, 40, 400))
    vals = rng.random(400)
    pdf = pd.DataFrame({"entity": "a", "day": [dt.date(2000, 1, 1) + dt.timedelta(days=int(d)) for d in days], "y": vals})
    got = W.event_decay_features(spark.createDataFrame(pdf), "y", ["entity"], "day", 1, [2.0]).orderBy("day").toPandas()
    d = [vals[0]]
    for j in range(1, 400):
        d.append(vals[j] + 2.0 ** (-(days[j] - days[j - 1]) / 2.0) * d[-1])
    assert np.allclose(got["y_decay2d_value"].to_numpy()[1:], np.array(d)[:-1], rtol=1e-9)
