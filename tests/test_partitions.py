"""Merges into tables kept by day: what they read, what they write, and what readers see."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.core.scale import shared_folder
from panelforge.sources import partitions as PT
from panelforge.sources.publish import upsert
from panelforge.streaming import rollup as ST

SCHEMA = "day date, k int, v double"
JAN = [dt.date(2024, 1, d) for d in range(1, 11)]


def rows(spark, *items):
    return spark.createDataFrame([(d, k, float(v)) for d, k, v in items], SCHEMA)


@pytest.fixture
def table(spark):
    path = shared_folder(spark, "kept")
    PT.upsert_partitions(rows(spark, *[(d, k, d.day) for d in JAN for k in range(3)]), path, ["day", "k"], "day")
    return path


def result(df):
    return sorted((r.day, r.k, r.v) for r in df.collect())


def test_upsert_equals_the_plain_one(spark, table):
    new = rows(spark, (JAN[2], 1, 99), (JAN[2], 7, 98), (JAN[9], 0, 97), (dt.date(2024, 2, 1), 0, 96))
    want = result(upsert(PT.read_current(spark, table), new, ["day", "k"]))
    PT.upsert_partitions(new, table, ["day", "k"], "day")
    assert result(PT.read_current(spark, table)) == want


def test_a_merge_of_one_day_reads_one_day(spark, table):
    seen = []

    def combine(now, batch):
        seen.append(now)
        return upsert(now, batch, ["day", "k"])

    done = PT.merge_partitions(rows(spark, (JAN[4], 1, 50)), table, "day", combine)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    files = {r[0] for r in seen[0].select(F.input_file_name()).distinct().collect()}
    assert files and all("_version=0/day=2024-01-05/" in f for f in files)
    assert [v for k, v in sorted(done.live.items()) if v == 1] == [1] and done.live["2024-01-05"] == 1
    assert len(done.live) == 10


def test_a_failed_merge_is_not_seen(spark, table):
    before = result(PT.read_current(spark, table))
    fails = F.udf(lambda v: 1 / 0, "double")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        PT.merge_partitions(rows(spark, (JAN[0], 0, 5)), table, "day", lambda now, new: new.withColumn("v", fails("v")))
    assert result(PT.read_current(spark, table)) == before
    PT.upsert_partitions(rows(spark, (JAN[0], 0, 5)), table, ["day", "k"], "day")  # its repetition overwrites what it left
    assert (JAN[0], 0, 5.0) in result(PT.read_current(spark, table))


def test_files_without_a_manifest_are_not_seen(spark, table):
    before = result(PT.read_current(spark, table))
    rows(spark, (JAN[0], 0, 5)).write.partitionBy("day").parquet(f"{table}/data/_version=1")
    assert result(PT.read_current(spark, table)) == before


def test_a_repeated_merge_is_skipped(spark, table):
    calls = []

    def combine(now, batch):
        calls.append(1)
        return now.unionByName(batch)

    for _ in range(3):
        PT.merge_partitions(rows(spark, (JAN[1], 5, 5)), table, "day", combine, mark="batch 4")
    assert len(calls) == 1 and PT.read_current(spark, table).filter("k = 5").count() == 1


def test_null_days_and_emptied_partitions(spark, table):
    PT.upsert_partitions(rows(spark, (None, 1, 1), (None, 2, 2)), table, ["day", "k"], "day")
    PT.upsert_partitions(rows(spark, (None, 2, 3)), table, ["day", "k"], "day")
    got = sorted((r.k, r.v) for r in PT.read_current(spark, table).filter("day IS NULL").collect())
    assert got == [(1, 1.0), (2, 3.0)]
    PT.merge_partitions(rows(spark, (JAN[3], 0, 0)), table, "day", lambda now, new: now.limit(0))
    assert PT.read_current(spark, table).filter(F.col("day") == JAN[3]).count() == 0
    assert PT.read_current(spark, table).count() == 29


def test_superseded_versions_can_go(spark, table):
    PT.upsert_partitions(rows(spark, (JAN[4], 1, 50), (None, 1, 1)), table, ["day", "k"], "day")
    PT.upsert_partitions(rows(spark, (JAN[4], 1, 51), (None, 1, 2)), table, ["day", "k"], "day")
    before = result(PT.read_current(spark, table).filter("day IS NOT NULL"))
    assert PT.drop_superseded(spark, table) == 3 + 2  # that day twice, the null day once, two manifests
    assert result(PT.read_current(spark, table).filter("day IS NOT NULL")) == before
    assert PT.drop_superseded(spark, table) == 0


def test_no_rows_and_wrong_tables(spark, table):
    before = result(PT.read_current(spark, table))
    PT.upsert_partitions(rows(spark), table, ["day", "k"], "day")
    assert result(PT.read_current(spark, table)) == before
    with pytest.raises(ValueError, match="kept by"):
        PT.upsert_partitions(rows(spark).withColumn("more", F.lit(1)), table, ["day", "k"], "day")
    with pytest.raises(ValueError, match="no merge"):
        PT.read_current(spark, shared_folder(spark, "nothing"))
    empty = shared_folder(spark, "empty")
    PT.upsert_partitions(rows(spark), empty, ["day", "k"], "day")
    assert PT.read_current(spark, empty).count() == 0


def test_a_stream_that_starts_again(spark):
    """A second run of the stream merges what is new only; a lost checkpoint merges all batches again, to the same rows."""
    feed, out, ckpt = (shared_folder(spark, n) for n in ("feed", "revised", "ckpt"))
    schema = "user_id int, day date, v double, is_forecast int, version int"

    def send(*items):
        spark.createDataFrame(list(items), schema).coalesce(1).write.mode("append").parquet(feed)

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
        ST.start_revisions(stream, out, checkpoint, ["user_id", "day"], "day").awaitTermination()
        return sorted(map(tuple, ST.read_revised(spark, out).collect()))

    send((1, JAN[0], 1.0, 0, 1), (1, JAN[1], 2.0, 1, 1))
    run(ckpt)
    assert PT.current_manifest(spark, out).merge == 0
    send((1, JAN[1], 3.0, 0, 2), (1, JAN[0], 9.0, 1, 2))  # an archive row replaces a forecast, a forecast replaces nothing
    want = [(1, JAN[0], 1.0, 0, 1), (1, JAN[1], 3.0, 0, 2)]
    assert run(ckpt) == want and PT.current_manifest(spark, out).merge == 1
    assert run(ckpt) == want and PT.current_manifest(spark, out).merge == 1
    assert run(shared_folder(spark, "other")) == want
