"""Registered queries against their SQL twins. ALL_QUERIES=1 runs every one, otherwise a spread over the families."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelforge.plans.registry import COVERS
from scripts.check import TABLES, canon

SPREAD = """flagship_panel_forecast densify_panel panel_coverage bridge_rows duration_panel rescue_number parse_dates id_pattern
lag_features rolling_features expanding_features event_decay event_decay_long_history days_since_event
consecutive_extreme_days physical_derivatives paired_history holiday_features fasting_month_features school_features
extended_calendar exposure_interactions group_statistics wind_pressure_daily entity_level_summary rolling_origin_blocks
district_structure previous_month_features mass_event_features stratum_weights cluster_slope load_transfer_study
attach_external monthly_attribute seam_merge replacement_pairs nearest_neighbours radius_intensity neighbour_target_lag
id_difference robustness_trim join_key reason_taxonomy align_keys diagnose_join frequency_encode oof_target_encode
oof_target_encode_purged purged_time_split equal_count_time_split stratified_folds auc threshold_table calibration_bins
error_concentration hill_climb_weights greedy_forward_selection median_blend rank_average tune_hurdle ladder_quantile
group_residual_offset quantile_bin_offset profile_flags leakage_report validate_predictions read_dialect_table
contracted_publish missing_ranges write_predictions stream_daily_rollup stream_event_state stream_revisions""".split()

NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SPREAD


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf_dir, duck, name):
    got = canon(entry.queries()[name](spark, sf_dir).toPandas())
    want = canon(duck.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want)


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_inventory_is_covered():
    ids = {i for c in COVERS.values() for i in c.split()}
    wanted = (
        [f"S{n:02}" for n in (1, 2, 5, 6, 7, 8, 9, 10, 12)]
        + [f"Q{n:02}" for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16, 17, 18, 19, 20)]
        + [f"J{n:02}" for n in range(1, 25)]
        + [f"A{n:02}" for n in range(1, 35)]
        + [f"W{n:02}" for n in range(1, 20)]
        + [f"K{n:02}" for n in range(1, 6)]
        + [f"U{n:02}" for n in range(1, 6)]
        + [f"F{n:02}" for n in range(1, 22)]
        + [f"X{n:02}" for n in range(1, 4)]
        + [f"E{n:02}" for n in range(1, 6)]
        + [f"V{n:02}" for n in range(1, 8)]
        + [f"M{n:02}" for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 16, 17, 18)]
        + [f"B{n:02}" for n in range(1, 24)]
        + [f"D{n:02}" for n in range(1, 13)]
        + [f"T{n:02}" for n in range(1, 7)]
    )
    assert not [w for w in wanted if w not in ids]
