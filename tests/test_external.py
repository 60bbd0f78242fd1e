"""Attaching sources runs no job; the report has the match rates, and judging it warns and fails."""

import datetime as dt
import warnings

import pytest
from pyspark.sql import functions as F

from panelforge.operators import joins as J


@pytest.fixture
def panel(spark):
    return spark.range(100).select(F.col("id").alias("key"), F.expr("date_add(date'2024-01-01', int(id % 30))").alias("day"))


def source(spark, n, name, year=2024):
    return spark.range(n).select(F.col("id").alias("key"), (F.col("id") * 2).alias(name), F.lit(dt.date(year, 1, 1)).alias("seen"))


def family(name, table, column, gated=True):
    def attach(df):
        return J.attach_many_to_one(df, table.drop("seen"), ["key"], family=name)[0]

    return J.Family(name, attach, (table, "seen") if gated else None)


def jobs(spark, build):
    spark.sparkContext.setJobGroup("building", "building")
    try:
        out = build()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("building"))
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")


def test_building_runs_no_job(spark, panel):
    families = [family("weather", source(spark, 80, "w"), "w"), family("solar", source(spark, 30, "s"), "s"),
                family("fires", source(spark, 50, "f", 1990), "f"), J.Family("water", None)]
    (out, report), n = jobs(spark, lambda: J.attach_external(panel, "day", families))
    assert n == 0
    got = {r.family: (r.state, r.columns, r.match_rate, r.reason) for r in report.collect()}
    assert got == {"weather": ("attached", 1, 0.8, ""), "solar": ("attached", 1, 0.3, ""), "fires": ("skipped", 0, None, "no common year"), "water": ("skipped", 0, None, "no source")}
    assert out.count() == 100 and out.filter("w IS NOT NULL").count() == 80
    with pytest.warns(UserWarning, match=r"solar: only 30.0%"):
        assert J.judge_external(report) == {"weather": 0.8, "solar": 0.3}


def test_one_join_runs_no_job(spark, panel):
    (out, rate), n = jobs(spark, lambda: J.attach_many_to_one(panel, source(spark, 80, "w").drop("seen"), ["key"]))
    assert n == 0 and out.count() == 100
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert J.judge_match_rate(rate) == 0.8


def test_a_source_without_a_match_is_an_error(spark, panel):
    strange = source(spark, 5, "w").withColumn("key", F.col("key") + 1000)
    out, report = J.attach_external(panel, "day", [family("weather", strange, "w")])
    with pytest.raises(J.NoMatchError, match="weather"):
        J.judge_external(report)
    alone, _ = J.attach_many_to_one(panel, strange.drop("seen"), ["key"])
    with pytest.raises(Exception, match="no row of the panel"):
        alone.collect()


def test_no_rows(spark, panel):
    empty = panel.limit(0)
    out, report = J.attach_external(empty, "day", [family("weather", source(spark, 5, "w"), "w", gated=False)])
    assert out.count() == 0 and report.first()["match_rate"] is None
    assert J.attach_many_to_one(empty, source(spark, 5, "w").drop("seen"), ["key"])[0].count() == 0
    assert J.attach_external(panel, "day", [])[1].count() == 0
