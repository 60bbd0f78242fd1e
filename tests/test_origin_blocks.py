"""Blocks added up from elementary intervals against summaries fitted on the rows of each block."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import origin_blocks as OB
from panelforge.operators import profiles as PR

BLOCKS = [
    OB.Block("a", "2023-02-01", "2024-01-31", "2024-02-01", "2024-03-15"),
    OB.Block("b", "2023-01-01", "2024-02-20", "2024-03-01", "2024-04-30"),  # overlaps the label window of a
    OB.Block("c", "2024-01-01", "2024-01-03", "2024-01-04", "2024-01-20"),
    OB.Block("no labels", "2023-01-01", "2024-02-20", "2030-03-01", "2030-04-30"),
    OB.Block("no summaries", "2020-01-01", "2020-02-20", "2024-03-01", "2024-04-30"),
]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    out = []
    for e in range(9):
        cap = float(rng.choice([30.0, 250.0, 1000.0]))
        for d in range(0, 480):
            day = dt.date(2023, 1, 5) + dt.timedelta(days=d)
            if rng.random() < 0.25 or (e == 7 and d < 400) or (e == 8 and d > 60):
                continue
            y = None if rng.random() < 0.05 else 0.0 if (e == 3 and d > 300) or rng.random() < 0.2 else float(rng.gamma(2, 5))
            out.append((f"e{e}", day, y, cap if rng.random() > 0.1 else cap * 2, f"d{e % 3}", float(rng.integers(0, 4)) if e else 1.0))
    out += [("e9", dt.date(2024, 2, 5), 3.0, None, "d9", None), ("e1", None, 3.0, 30.0, "d1", 1.0)]
    out += [("e5", dt.date(2023, 5, 5), 4.0, 30.0, "d2", 1.0)] * 2  # repeated rows
    return spark.createDataFrame(out, "entity string, day date, y double, cap double, district string, degree double").cache()


def fitted(rows, b):
    inside = F.col("day").between(b.label_start, b.label_end)
    labels, outside = rows.filter(inside), rows.filter(~inside)
    fit = rows.filter(F.col("day").between(b.summary_start, b.summary_end))
    l0, l1 = labels.agg(F.min("day"), F.max("day")).first()
    f0, f1 = fit.agg(F.min("day"), F.max("day")).first()
    if l0 is None or f0 is None:
        return None
    s = PR.entity_summaries(fit, "entity", "day", "y", "cap", outside, (F.lit(l0), F.lit(l1)), ["degree"])
    out = PR.apply_summaries(labels, s, "day")
    out = PR.add_group_levels(out, fit, "y", "cap", "district")
    out = PR.add_group_profiles(out, outside, "entity", "day", "y", "cap", "district")
    frame = out.toPandas().assign(block=b.name)
    place = frame.groupby("entity")["day"]
    frame["present_days"] = place.transform("size")
    frame["present_first"] = place.transform("min").map(lambda d: (d - l0).days)
    frame["present_last"] = place.transform("max").map(lambda d: (d - l0).days)
    frame["present_span"] = frame["present_last"] - frame["present_first"] + 1
    frame["present_fill"] = frame["present_days"] / frame["present_span"]
    frame["present_share"] = frame["present_days"] / ((l1 - l0).days + 1)
    frame["summary_days"] = (f1 - f0).days + 1
    frame["summary_fill"] = frame["days"] / frame["summary_days"]
    frame["horizon_day"] = frame["day"].map(lambda d: (d - f1).days)
    return frame


def ordered(frame):
    frame = frame[sorted(frame.columns)].sort_values(["block", "entity", "day", "y", "cap"])
    return frame.reset_index(drop=True)


def test_blocks_equal_fits_of_their_rows(rows):
    got = OB.rolling_origin_blocks(rows, BLOCKS, "entity", "day", "y", "cap", "district", ["degree"]).toPandas()
    want = pd.concat([f for b in BLOCKS if (f := fitted(rows, b)) is not None])
    assert set(got["block"]) == {"a", "b", "c"} and set(got.columns) == set(want.columns)
    assert (got["cold"] == 1).any() and got["slope_degree"].notna().any() and got["dead"].eq(1).any()
    pd.testing.assert_frame_equal(ordered(got), ordered(want), check_dtype=False, rtol=1e-7, atol=1e-7)


def test_a_row_lies_in_one_interval(rows):
    intervals = OB.elementary_intervals(rows, "day", BLOCKS)
    placed = OB._with_interval(rows, "day", intervals)
    assert placed.count() == rows.filter("day IS NOT NULL").count()
    for k, low, high in placed.groupBy("_interval").agg(F.min("_day"), F.max("_day")).collect():
        assert k == 0 or low >= intervals.cuts[k - 1]
        assert k == len(intervals.cuts) or high < intervals.cuts[k]


def test_no_block_multiplies_the_rows(rows):
    """Twice the blocks: the same scans of rows, and nothing explodes them."""
    more = [*BLOCKS[:2], *(OB.Block(f"x{i}", b.summary_start, b.summary_end, b.label_start, b.label_end) for i, b in enumerate(BLOCKS[:2]))]
    plans = [OB.rolling_origin_blocks(rows, b, "entity", "day", "y", "cap", "district")._jdf.queryExecution().optimizedPlan().toString() for b in (BLOCKS[:2], more)]
    assert plans[0].count("LogicalRDD") == plans[1].count("LogicalRDD")
    assert "explode" not in plans[1]


def test_label_rows(rows):
    got = {(r.block, r.n) for r in OB.label_rows(rows, "day", BLOCKS).groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {(b.name, rows.filter(F.col("day").between(b.label_start, b.label_end)).count()) for b in BLOCKS[:3]}
    assert got == want


def test_no_rows(rows):
    assert OB.rolling_origin_blocks(rows.limit(0), BLOCKS, "entity", "day", "y", "cap", "district").count() == 0
    assert OB.rolling_origin_blocks(rows, [], "entity", "day", "y", "cap", "district").count() == 0
