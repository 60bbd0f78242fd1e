"""Stored tables by buckets: joins and aggregates on the key leave the stored side where it is."""

import re

import pytest
from pyspark.sql import functions as F

from panelforge.core.scale import shared_folder
from panelforge.operators import joins as J
from panelforge.sources import buckets as BK


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def table(spark):
    return spark.range(4000).select((F.col("id") % 997).alias("entity"), F.concat(F.lit("n"), F.col("id")).alias("name"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def branches(plan):
    """For every scan, the exchanges above it up to the first join."""
    lines = plan.splitlines()
    depth = [len(re.match(r"[\s:|+\-]*", x).group()) for x in lines]
    out = {}
    for i, line in enumerate(lines):
        if "FileScan" in line or "Range (" in line:
            above, at = [], depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < at:
                    at = depth[j]
                    if "Join" in lines[j]:
                        break
                    above.append(lines[j])
            out[line.strip(" :+-")[:30] + str(i)] = sum("Exchange" in x for x in above)
    return out


def test_the_stored_side_is_not_shuffled(spark, table, no_broadcast):
    path = shared_folder(spark, "stored")
    BK.store_bucketed(table, path, ["entity"], buckets=6, bloom=["entity"])
    stored = BK.open_bucketed(spark, path)
    panel = spark.range(3000).select((F.col("id") % 1200).alias("entity"), F.col("id").alias("row"))
    out, _ = J.attach_many_to_one(panel, stored, ["entity"], check=False)
    counted = branches(plan_of(out))
    scans = [n for k, n in counted.items() if "FileScan" in k]
    assert scans == [0] and [n for k, n in counted.items() if "Range" in k] == [1]
    again, _ = J.attach_many_to_one(out, stored.withColumnRenamed("name", "second"), ["entity"], check=False)
    assert plan_of(again).count("Exchange hashpartitioning") == 1  # a second join on the key moves nothing
    plain, _ = J.attach_many_to_one(panel, table, ["entity"], check=False)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_aggregates_by_the_key_need_no_exchange(spark, table):
    stored = BK.store_bucketed(table, shared_folder(spark, "stored"), ["entity"], buckets=5)
    assert "Exchange" not in plan_of(stored.groupBy("entity").count())


def test_another_session_opens_the_table(spark, table):
    path = shared_folder(spark, "stored")
    BK.store_bucketed(table, path, ["entity"], buckets=4)
    name = BK._table_name(spark.read.json(f"{path}.layout").first()["version"])
    spark.sql(f"DROP TABLE {name}")  # what a session knows that has not written the table: nothing
    opened = BK.open_bucketed(spark, path)
    assert sorted(map(tuple, opened.collect())) == sorted(map(tuple, table.collect()))
    assert "Exchange" not in plan_of(opened.groupBy("entity").count())


def test_a_new_version_replaces_the_last(spark, table):
    path = shared_folder(spark, "stored")
    BK.store_bucketed(table, path, ["entity"], buckets=4)
    BK.store_bucketed(table.limit(0), path, ["entity"], buckets=4)
    assert BK.open_bucketed(spark, path).count() == 0
    with pytest.raises(KeyError):
        BK.store_bucketed(table, path, ["nothing"])
