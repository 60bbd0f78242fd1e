"""Primitives that stay flat when one key or value holds a large share of the rows.

A broadcast hint appears in one place only: `day_table` for tables with one row per calendar day. All other joins are
left to statistics and adaptive execution.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F



def range_buckets(spark: SparkSession) -> int:
    """Ranges for ordered work: as many as shuffle partitions, so that a cluster sized for its data cuts it finely. 4096 is
    what the two rounds of comparisons in `bucket_of` can hold in one compiled method; a range is ordered by an external
    sort, so more rows in it cost time, not memory."""
    return max(64, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one inside the warehouse, which every executor of a
    cluster reaches as well. Never a machine-local temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, for tables written on the way. It is removed when the session's JVM ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to a new table in the shared folder and reads them back: later jobs start from files, also after
    an executor is lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: a lost executor costs a read, not the whole lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))
    return df.checkpoint()


def bucket_of(df: DataFrame, value: str, bounds: str, buckets: int, out: str) -> DataFrame:
    """Number of bounds below the value, by a coarse and a fine round of comparisons that stay inside codegen (a lambda
    over the array would be interpreted)."""
    fine = 1
    while fine * fine < buckets:
        fine *= 2
    coarse = -(-buckets // fine)
    v = F.col(value)

    def below(i: Column | int) -> Column:
        return F.coalesce((F.get(F.col(bounds), i if isinstance(i, Column) else F.lit(i)) < v).cast("int"), F.lit(0))

    first = reduce(lambda x, y: x + y, [below(i * fine + fine - 1) for i in range(coarse)], F.lit(0))
    start = F.col("_coarse") * fine
    second = reduce(lambda x, y: x + y, [below(start + j) for j in range(fine - 1)], F.lit(0))
    return df.withColumn("_coarse", first).withColumn(out, start + second).drop("_coarse", bounds)


def value_positions(
    df: DataFrame, value: str, by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """One row per (by, distinct value) with its sorted positions: `_lo` rows sort before it, `_hi - _lo` rows tie
    with it and the group has `_total` rows. Rows with a NULL value or a NULL group key are left out.

    Equal values collapse in a map-side combine. The distinct values are cut into ranges by a mergeable sketch, ordered
    inside each range, and shifted by the ranges before it, so no task ever sorts a whole group. The bounds only steer
    the work; the positions are exact whatever the sketch returns.
    """
    by = list(by)
    buckets = buckets or range_buckets(df.sparkSession)
    probs = [i / buckets for i in range(1, buckets)]
    rows = df.filter(F.col(value).isNotNull())
    for k in by:
        rows = rows.filter(F.col(k).isNotNull())
    counts = (
        rows.select(*by, F.col(value).cast("double").alias("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    )
    # sketched from the rows in a map-side pass: a value that repeats only doubles some bounds
    sketch = F.percentile_approx(F.col(value).cast("double"), probs, 10 * buckets)
    if by:
        ranged = counts.join(rows.groupBy(*by).agg(sketch.alias("_bounds")), by)
    else:
        ranged = counts.withColumn("_bounds", rows.agg(sketch.alias("b")).scalar())
    ranged = bucket_of(ranged, "_v", "_bounds", buckets, "_bucket")

    inside = Window.partitionBy(*by, "_bucket").orderBy("_v")
    # at most `buckets` rows per group from here on
    per_range = ranged.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_range_n"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = per_range.select(
        *by,
        "_bucket",
        (F.sum("_range_n").over(group.orderBy("_bucket")) - F.col("_range_n")).alias("_before"),
        F.sum("_range_n").over(group).alias("_total"),
    )
    ranked = ranged.withColumn("_inside_hi", F.sum("_n").over(inside))
    return ranked.join(before, [*by, "_bucket"]).select(
        *by,
        F.col("_v").alias(value),
        (F.col("_before") + F.col("_inside_hi") - F.col("_n")).alias("_lo"),
        (F.col("_before") + F.col("_inside_hi")).alias("_hi"),
        "_total",
    )


def weighted_median(df: DataFrame, value: str, weight: str, buckets: int | None = None) -> DataFrame:
    """One row: the smallest value up to which at least half of the weight lies. Equal values collapse first, a sketch cuts
    them into ranges, and only the range in which half of the weight is passed is ordered."""
    buckets = buckets or range_buckets(df.sparkSession)
    rows = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    sums = rows.groupBy(F.col(value).cast("double").alias("_v")).agg(F.sum(weight).alias("_w"))
    sketch = rows.agg(F.percentile_approx(F.col(value).cast("double"), [i / buckets for i in range(1, buckets)], 10 * buckets).alias("b"))
    ranged = bucket_of(sums.withColumn("_bounds", sketch.scalar()), "_v", "_bounds", buckets, "_range")
    per = ranged.groupBy("_range").agg(F.sum("_w").alias("_rw"))  # one row per range
    every = Window.partitionBy(F.lit(0))
    upto = F.sum("_rw").over(every.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    crossed = per.select("_range", (upto - F.col("_rw")).alias("_before"), upto.alias("_upto"), (F.sum("_rw").over(every) / 2).alias("_half"))
    crossed = crossed.filter((F.col("_before") < F.col("_half")) & (F.col("_upto") >= F.col("_half")))
    inside = Window.partitionBy("_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = join_checked(ranged, crossed, ["_range"], "inner").withColumn("_sum", F.col("_before") + F.sum("_w").over(inside))
    # the last value of the range stands in where rounding leaves its sum short of one half
    return placed.agg(F.coalesce(F.min(F.when(F.col("_sum") >= F.col("_half"), F.col("_v"))), F.max("_v")).alias(value))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group for groups of any size; `probs` maps output name to probability."""
    pos = value_positions(df, value, by, buckets)
    aggs: list[Column] = []
    for i, p in enumerate(probs.values()):
        at = (F.col("_total") - 1) * F.lit(float(p))
        lower = F.floor(at)
        upper = F.least(lower + 1, F.col("_total") - 1)
        aggs += [
            F.max(F.when((F.col("_lo") <= lower) & (lower < F.col("_hi")), F.col(value))).alias(f"_a{i}"),
            F.max(F.when((F.col("_lo") <= upper) & (upper < F.col("_hi")), F.col(value))).alias(f"_b{i}"),
        ]
    aggs.append(F.max("_total").alias("_total"))
    found = pos.groupBy(*by).agg(*aggs)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        at = (F.col("_total") - 1) * F.lit(float(p))
        frac = at - F.floor(at)
        out.append((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * frac).alias(name))
    return found.select(*by, *out)


def average_rank(
    df: DataFrame,
    value: str,
    out: str,
    by: Sequence[str] = (),
    pct: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Adds the rank of `value` (ties share their mean rank, NULL stays NULL); `pct` divides by the group size."""
    pos = value_positions(df, value, by, buckets)
    rank = (F.col("_lo") + 1 + F.col("_hi")) / 2.0
    if pct:
        rank = rank / F.col("_total")
    ranks = pos.select(*by, F.col(value).alias("_rank_v"), rank.alias(out))
    # a value that fills much of the rows is one row on the right: adaptive execution splits the left partition
    return df.withColumn("_rank_v", F.col(value).cast("double")).join(ranks, [*by, "_rank_v"], "left").drop("_rank_v")


def sorted_index(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Numbers rows 0.. in the given order with a distributed sort. The sorted rows are written once, so the position
    inside a partition and the partition sizes (a few rows) belong to the same order."""
    done = cut_lineage(df.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = done.withColumns({"_part": F.shiftright("_id", 33), "_local": local})
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_size")
    # one row per partition of the sort
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))
    return placed.join(offsets, "_part").withColumn(out, F.col("_before") + F.col("_local")).drop(
        "_id", "_part", "_local", "_before"
    )


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int = 16, how: str = "inner"
) -> DataFrame:
    """Equi join for a many-to-many match whose left side may be dominated by one key: left rows are spread over
    `salts` tasks and the right rows are repeated once per salt. `how` is inner, left, left_semi or left_anti."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the repeated right side allows inner, left, left_semi and left_anti only")
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int = 1) -> DataFrame:
    """Inner join in which a key meets many rows on both sides, so that the pairs say how much work there is and the bytes
    of the sides do not. Both are dealt out by number, which adaptive execution does not merge into a few tasks, and
    joined by sorting: the right side may come out of an explode that statistics take for a small table, and a broadcast
    would pass it whole through the driver. `salts` spreads a crowded key as in `salted_join`."""
    keys = list(keys)
    if salts > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys.append("_salt")
    n = range_buckets(left.sparkSession)
    return left.repartition(n, *keys).join(right.repartition(n, *keys).hint("merge"), keys).drop("_salt")


def join_checked(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Joins a per-key table whose size depends on the data. No hint and no job: adaptive execution measures the table
    in bytes when it runs, broadcasts it below the session's threshold, and otherwise splits the partitions of a hot key;
    salting would multiply a table already known to be large."""
    return left.join(right, list(keys), how)


def day_table(df: DataFrame) -> DataFrame:
    """Marks a table with one row per calendar day (a century is 36,525 rows) for broadcast."""
    return F.broadcast(df)
