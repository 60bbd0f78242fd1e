"""Physical plans: scans read what they need, windows share one shuffle, nothing multiplies tables."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelforge.operators import windows as W
from panelforge.plans import bases as B
from panelforge.plans.registry import Tables


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = plan(t.lineitem.filter(F.col("l_quantity") > 10).groupBy("l_suppkey").agg(F.sum("l_quantity")))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in p
    assert "GreaterThan(l_quantity,10.0)" in p


def test_all_windows_of_a_panel_share_one_shuffle(spark, sf_dir):
    """Cells are combined once by (entity, day) and moved once by entity; lags, rolling and decay add nothing."""
    df = B.dense_supplier_day(Tables(spark, sf_dir))
    base = plan(df).count("Exchange hashpartitioning") or plan(df).count("Exchange (")
    wide = W.lag_features(df, "qty", ["entity"], "day", 7, shifts=[7])
    wide = W.rolling_features(wide, "qty", ["entity"], "day", 7, [7, 28])
    wide = W.days_since_event(wide, "qty", ["entity"], "day", 7)
    wide = W.event_decay_features(wide, "qty", ["entity"], "day", 7)
    p = plan(wide)
    assert (p.count("Exchange hashpartitioning") or p.count("Exchange (")) == base


@pytest.mark.parametrize(
    "name",
    ["flagship_panel_forecast", "entity_level_summary", "holiday_features", "radius_intensity", "calibration_bins",
     "mass_event_features", "load_transfer_study", "percentile_rank", "stratum_weights", "missing_ranges"],
)
def test_no_cartesian_products(spark, sf_dir, name):
    p = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_calendar_joins_do_not_move_the_facts(spark, sf_dir):
    p = plan(entry.queries()["holiday_features"](spark, sf_dir))
    assert "BroadcastHashJoin" in p and "SortMergeJoin LeftOuter" not in p.split("Scan parquet")[0]
