"""Split queries without a gap: every supplier day takes part, and the twins agree."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelforge.plans import bases as B
from panelforge.plans.registry import Tables
from scripts.check import canon


@pytest.mark.parametrize("name", ["target_free_aggregates_whole", "age_features_whole", "event_day_groups_whole"])
def test_no_day_is_missing(spark, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    days = B.supplier_day(Tables(spark, sf_dir)).filter(F.col("day") >= B.CUT)
    assert got.count() == days.count()
    assert got.agg(F.min("day")).first()[0] == days.agg(F.min("day")).first()[0]
    sql = entry.oracle_sql()[name]
    assert "+ 30" not in sql
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{sf_dir}/lineitem.parquet')")
    assert canon(got.toPandas()).equals(canon(con.execute(sql).df()))
