"""Wrong input fails loudly."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelforge.core.scale import shared_folder
from panelforge.functions import text as TX
from panelforge.functions.transforms import log_target
from panelforge.operators import columns as C
from panelforge.operators import joins as J
from panelforge.operators import splits as V
from panelforge.operators import windows as W
from panelforge.operators.metrics import metric
from panelforge.sources import publish as P


@pytest.fixture(scope="module")
def doubled(spark):
    return spark.sql("SELECT 'a' AS e, DATE '2024-01-01' AS d, 1.0D AS y UNION ALL SELECT 'a', DATE '2024-01-01', 2.0D")


def test_duplicate_days_fail(doubled):
    with pytest.raises((PySparkException, Py4JJavaError), match="duplicate"):
        W.lag_features(doubled, "y", ["e"], "d", 1, shifts=[1]).collect()


@pytest.mark.parametrize("h", [0, -1, True, 1.5])
def test_bad_horizon(doubled, h):
    with pytest.raises(ValueError):
        W.rolling_features(doubled, "y", ["e"], "d", h, [3])


def test_shift_below_horizon():
    with pytest.raises(ValueError):
        W.lag_offsets("y", 7, [3], None)
    assert W.lag_offsets("y", 7, None, [1, 2]) == [(7, "y_h7_lag1"), (8, "y_h7_lag2")]
    assert W.lag_offsets("y", 1, None, [1]) == [(1, "y_lag1")]


def test_null_keys_get_no_history(spark):
    df = spark.sql(
        "SELECT CAST(NULL AS STRING) AS e, DATE '2024-01-01' AS d, 1.0D AS y UNION ALL SELECT NULL, DATE '2024-01-02', 2.0D"
    )
    assert all(r["y_shift1"] is None for r in W.lag_features(df, "y", ["e"], "d", 1, shifts=[1]).collect())


def test_colliding_columns(spark):
    a = spark.sql("SELECT 1 AS k, 2 AS v")
    with pytest.raises(ValueError):
        J.attach_many_to_one(a, spark.sql("SELECT 1 AS k, 3 AS v"), ["k"])
    out, rate = J.attach_many_to_one(a, spark.sql("SELECT 9 AS k, 3 AS w"), ["k"])
    with pytest.raises(Exception, match="no row of the panel"):
        out.collect()
    with pytest.raises(J.NoMatchError):
        J.judge_match_rate(rate)


def test_publication_contract(spark):
    path = shared_folder(spark, "contract")
    df = spark.range(10)
    with pytest.raises(KeyError):
        P.publish(df, path, ["nope"], 1, "s")
    with pytest.raises(ValueError):
        P.publish(df, path, ["id"], 11, "s")
    P.publish(df, path, ["id"], 10, "s")
    assert P.read_published(spark, path, ["id"], 10, "s").count() == 10
    with pytest.raises(ValueError):
        P.publish(spark.range(3), path, ["id"], 4, "s")
    assert P.read_published(spark, path, ["id"], 10, "s").count() == 10  # the refused version changed nothing
    P.publish(spark.range(20), path, ["id"], 10, "s")
    current = P.read_published(spark, path, ["id"], 20, "s")
    version = current.inputFiles()[0].rsplit("/", 1)[0]
    spark.range(3).write.mode("append").parquet(version)
    with pytest.raises(ValueError):
        P.read_published(spark, path, ["id"], 1, "s")


def test_ambiguous_dates(spark):
    df = spark.sql("SELECT '03/04/2024' AS t UNION ALL SELECT '05/06/2024'")
    assert C.date_order(df, "t").first()[0] == "ambiguous"
    with pytest.raises((PySparkException, Py4JJavaError)):
        C.parse_dates(df, "t", "d").collect()


def test_number_rescue_refuses_text(spark):
    df = spark.sql("SELECT 'abc' AS t UNION ALL SELECT 'def' UNION ALL SELECT '1,5'")
    with pytest.raises((PySparkException, Py4JJavaError)):
        C.rescue_number(df, "t", "n").collect()


def test_domain_checks(spark):
    df = spark.sql("SELECT -2.0D AS y, 1.0D AS p")
    with pytest.raises((PySparkException, Py4JJavaError)):
        df.select(log_target("y")).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        df.agg(metric("rmsle", "y", "p")).collect()


def test_embargo_rules(spark):
    df = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-03-01')) AS d")
    with pytest.raises(ValueError):
        V.purged_time_folds(df, "d", timedelta(days=-1))
    with pytest.raises(ValueError):
        V.purged_time_folds(df, "d", timedelta(days=400), 3, timedelta(days=10))


@settings(max_examples=8, deadline=None)
@given(embargo=st.integers(0, 20), span=st.integers(3, 25), n=st.integers(1, 4))
def test_folds_keep_the_embargo(spark, embargo, span, n):
    df = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-06-30')) AS d")
    folds, _ = V.purged_time_folds(df, "d", timedelta(days=embargo), n, timedelta(days=span))
    for f in folds:
        assert f.valid_start - f.train_before == timedelta(days=embargo)
        assert f.valid_end - f.valid_start < timedelta(days=span)
    for a, b in zip(folds, folds[1:], strict=False):
        assert a.valid_end < b.valid_start
    assert folds[-1].valid_end == datetime(2024, 6, 30)


@pytest.mark.parametrize(
    "raw,key",
    [
        ("  İZMİR  ", "izmir"), ("KARABAĞLAR", "karabaglar"), ("Iğdır", "igdir"), ("Şi̇şli", "si̇sli"),
        ("Köprübaşı / Manisa", "koprubasi / manisa"), ("c" + "̧" + "an", "can"), ("a  b c", "a b c"),
    ],
)
def test_join_key(spark, raw, key):
    got = spark.createDataFrame([(raw,)], "x string").select(TX.join_key("x")).first()[0]
    assert got == key


def test_alphabet_order(spark):
    words = ["zebra", "çam", "cam", "ışık", "iğne", "hasat", "ördek", "okul", "3x"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r["w"] for r in TX.alphabet_sorted(df, "w").collect()]
    assert got == ["cam", "çam", "hasat", "ışık", "iğne", "okul", "ördek", "zebra", "3x"]


def test_normalized_names():
    assert TX.normalized_names(["Toplam Tutar", "TOPLAM TUTAR", "İl/İlçe", "2024", "%"]) == [
        "toplam_tutar", "toplam_tutar_2", "il_ilce", "c_2024", "column",
    ]


def test_calendars_refuse_days_they_do_not_cover(spark):
    from panelforge.functions import calendar as K

    df = spark.createDataFrame([("2010-10-29",), (None,)], "day string").withColumn("day", F.to_date("day"))
    for add in (K.add_holiday_features, K.add_fasting_month_features):
        with pytest.raises(Exception, match="the calendar covers 1995 to 2001, not 2010"):
            add(df, "day", 1995, 2001).collect()
        assert add(df, "day", 2009, 2011).count() == 2
    holiday = K.add_holiday_features(df, "day", 2009, 2011).filter("day IS NOT NULL").first()
    assert holiday["holiday"] == 1


def test_a_source_without_any_match_is_an_error(spark):
    from panelforge.operators import joins as J

    panel = spark.createDataFrame([("a", "2025-03-01")], "key string, day string").withColumn("day", F.to_date("day"))
    annual = spark.createDataFrame([("zz", 2024, 1.0)], "key string, year int, v double")
    with pytest.raises(Exception, match="no row of the panel found a match"):
        J.add_annual_attribute(panel, annual, "key", "day", "year", ["v"]).collect()
    monthly = spark.createDataFrame([("zz", 2024, 3, 1.0)], "key string, year int, month int, v double")
    with pytest.raises(Exception, match="no row of the panel found a match"):
        J.add_monthly_attribute(panel, monthly, "key", "day", "year", "month", ["v"]).collect()
    profile = spark.createDataFrame([("zz", 3, 1.0)], "key string, month int, v double")
    with pytest.raises(Exception, match="no row of the panel found a match"):
        J.add_month_profile(panel, profile, "key", "day", "month", ["v"]).collect()


def test_the_year_gate_knows_the_lag(spark):
    from panelforge.operators import joins as J

    panel = spark.createDataFrame([("a", "2025-03-01")], "key string, day string").withColumn("day", F.to_date("day"))
    source = spark.createDataFrame([("a", "2024-06-01", 2024, 1.0)], "key string, day string, year int, v double")
    source = source.withColumn("day", F.to_date("day"))

    def attach(df):
        return J.add_annual_attribute(df, source.select("key", "year", "v"), "key", "day", "year", ["v"], year_lag=1)

    lagged = J.Family("tourism_annual", attach, (source, "day"), year_lag=1)
    out, report = J.attach_external(panel, "day", [lagged])
    assert report.first()["state"] == "attached" and out.first()["annual_v"] == 1.0
    _, report = J.attach_external(panel, "day", [J.Family("tourism_annual", attach, (source, "day"))])
    assert report.first()["state"] == "skipped"


def test_monotone_flag_does_not_depend_on_row_order(spark):
    from panelforge.operators.quality import monotone_columns

    rows = [(1, 5), (1, 3), (2, 6), (2, 5), (3, 9)]
    found = set()
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "day int, v int").coalesce(1)
        found.add(monotone_columns(df, ["v"], "day").first()["monotone"])
    assert len(found) == 1


def test_upsert_refuses_other_columns(spark):
    from panelforge.sources.publish import upsert

    with pytest.raises(ValueError, match="columns differ"):
        upsert(spark.range(2), spark.range(2).withColumn("x", F.lit(1)), ["id"])
