"""Category encodings: shares, counts, code books and out-of-fold target means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.core.exprs import safe_div
from panelforge.core.scale import cut_lineage, join_checked, sorted_index

FREQUENCY_SUFFIX = "_frequency"


def frequency_encode(train: DataFrame, apply: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Train share of the category with NULL rows in the denominator; NULL stays NULL, unseen becomes 0."""
    out = out or column + FREQUENCY_SUFFIX
    total = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    shares = train.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).filter(F.col(column).isNotNull())
    shares = shares.withColumn("_total", total).select(column, safe_div("_n", "_total").alias("_share"))
    joined = join_checked(apply, shares, [column])
    return joined.withColumn(
        out, F.when(F.col(column).isNotNull(), F.coalesce("_share", F.lit(0.0)))
    ).drop("_share")


def count_encode(reference: DataFrame, apply: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Reference count of the category; NULL counts as a category of its own, unseen becomes 0."""
    out = out or f"{column}_count"
    key = {"_cat": F.coalesce(F.col(column).cast("string"), F.lit("")), "_null": F.col(column).isNull()}
    counts = reference.withColumns(key).groupBy("_cat", "_null").agg(F.count(F.lit(1)).alias(out))
    joined = join_checked(apply.withColumns(key), counts, ["_cat", "_null"])
    return joined.withColumn(out, F.coalesce(out, F.lit(0))).drop("_cat", "_null")


def code_book(train: DataFrame, column: str) -> DataFrame:
    """Sorted distinct train categories numbered from 0 by a distributed sort."""
    return sorted_index(train.filter(F.col(column).isNotNull()).select(column).distinct(), [column], "code")


def encode_categories(train: DataFrame, apply: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Code of the train code book; unseen and NULL are NULL."""
    out = out or f"{column}_code"
    return join_checked(apply, code_book(train, column).withColumnRenamed("code", out), [column])


def _smooth(total: Column, n: Column, prior: Column, strength: float) -> Column:
    return (total + prior * F.lit(float(strength))) / (n + F.lit(float(strength)))


def oof_target_encode(
    df: DataFrame, column: str, target: str, fold: str, out: str, smoothing: float = 20.0
) -> DataFrame:
    """Target mean of the other folds, smoothed towards their overall mean; a category they lack gets that mean.

    Disjoint folds: one pass builds (category, fold) cells, the fit side of a fold is all cells minus its own. Works on
    cells, whatever the number of rows. A NULL category says nothing: its rows get the prior.
    """
    key = {"_cat": F.coalesce(F.col(column).cast("string"), F.lit("")), "_null": F.col(column).isNull()}
    rows = df.withColumns(key)
    y = F.col(target).cast("double")
    cells = cut_lineage(
        rows.groupBy("_cat", "_null", fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    )
    folds = cells.groupBy(fold).agg(F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn"))
    total = cells.agg(F.struct(F.sum("_s").alias("s"), F.sum("_n").alias("n")).alias("t")).scalar()
    priors = folds.withColumn("_t", total).select(
        fold, safe_div(F.col("_t.s") - F.col("_fs"), F.col("_t.n") - F.col("_fn")).alias("_prior")
    )
    per_cat = cells.groupBy("_cat", "_null").agg(F.sum("_s").alias("_cs"), F.sum("_n").alias("_cn"))
    table = (
        cells.join(per_cat, ["_cat", "_null"])
        .join(priors, fold)
        .select(
            "_cat",
            "_null",
            fold,
            F.when(F.col("_null"), F.col("_prior"))
            .otherwise(_smooth(F.col("_cs") - F.col("_s"), F.col("_cn") - F.col("_n"), F.col("_prior"), smoothing))
            .alias(out),
        )
    )
    return join_checked(rows, table, ["_cat", "_null", fold]).drop("_cat", "_null")


def oof_target_encode_purged(
    df: DataFrame,
    folds: DataFrame,
    time: str,
    column: str,
    target: str,
    out: str,
    smoothing: float = 20.0,
    uncovered: str = "error",
) -> DataFrame:
    """Encoding for purged time folds (`fold`, `train_end`, `valid_start`, `valid_end`): a validation row sees only rows
    with time <= train_end of its fold. Fit sets overlap, so each row is counted in every fold that may train on it.

    `folds` is a fold-bounds table of a few rows. Rows in no validation window fail the query or get NULL.
    """
    if uncovered not in ("error", "null"):
        raise ValueError("uncovered is error or null")
    key = {"_cat": F.coalesce(F.col(column).cast("string"), F.lit("")), "_null": F.col(column).isNull()}
    rows = df.withColumns(key)
    bounds = [r.asDict() for r in folds.select("fold", "train_end", "valid_start", "valid_end").collect()]
    t = F.col(time)
    fits = F.array_compact(F.array(*[F.when(t <= F.lit(b["train_end"]), F.lit(b["fold"])) for b in bounds]))
    valid = F.coalesce(
        *[F.when(t.between(F.lit(b["valid_start"]), F.lit(b["valid_end"])), F.lit(b["fold"])) for b in bounds]
    )
    y = F.col(target).cast("double")
    cells = cut_lineage(
        rows.withColumn("_fold", F.explode(fits))
        .groupBy("_cat", "_null", "_fold")
        .agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    )
    priors = cells.groupBy("_fold").agg(safe_div(F.sum("_s"), F.sum("_n")).alias("_prior"))
    marked = rows.withColumn("_fold", valid)
    if uncovered == "error":
        marked = marked.filter(
            F.assert_true(F.col("_fold").isNotNull(), F.lit("rows without a validation fold")).isNull()
        )
    out_rows = join_checked(join_checked(marked, cells, ["_cat", "_null", "_fold"]), priors, ["_fold"])
    value = _smooth(F.coalesce("_s", F.lit(0.0)), F.coalesce("_n", F.lit(0)), F.col("_prior"), smoothing)
    value = F.when(F.col("_null"), F.col("_prior")).otherwise(value)
    return out_rows.withColumn(out, value).drop("_cat", "_null", "_fold", "_s", "_n", "_prior")


def target_encode_test(
    train: DataFrame, test: DataFrame, column: str, target: str, out: str, smoothing: float = 20.0
) -> DataFrame:
    """Encoding of test rows from all of train."""
    key = {"_cat": F.coalesce(F.col(column).cast("string"), F.lit("")), "_null": F.col(column).isNull()}
    y = F.col(target).cast("double")
    prior = train.agg(F.avg(y).alias("p")).scalar()
    cells = train.withColumns(key).groupBy("_cat", "_null").agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    joined = join_checked(test.withColumns(key), cells, ["_cat", "_null"]).withColumn("_prior", prior)
    value = _smooth(F.coalesce("_s", F.lit(0.0)), F.coalesce("_n", F.lit(0)), F.col("_prior"), smoothing)
    value = F.when(F.col("_null"), F.col("_prior")).otherwise(value)
    return joined.withColumn(out, value).drop("_cat", "_null", "_s", "_n", "_prior")


def cold_sample_weights(df: DataFrame, cold: str, target_share: float = 0.2216, out: str = "weight") -> DataFrame:
    """Weights that give cold rows `target_share` of the total; 1 everywhere when one side is empty."""
    counts = df.agg(
        F.struct(F.count_if(F.col(cold) == 1).alias("c"), F.count_if(F.col(cold) != 1).alias("w")).alias("n")
    ).scalar()
    factor = F.lit(target_share / (1.0 - target_share)) * safe_div("_n.w", "_n.c")
    usable = (F.col("_n.c") > 0) & (F.col("_n.w") > 0)
    return (
        df.withColumn("_n", counts)
        .withColumn(out, F.when(usable & (F.col(cold) == 1), factor).otherwise(F.lit(1.0)))
        .drop("_n")
    )


def category_overlap(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: share of test rows whose category occurs in train."""
    parts = []
    for c in columns:
        seen = train.filter(F.col(c).isNotNull()).select(c).distinct().withColumn("_s", F.lit(1))
        counted = test.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).join(seen, c, "left")
        parts.append(
            counted.agg(
                F.sum("_n").alias("test_rows"),
                F.coalesce(F.sum(F.when(F.col("_s") == 1, F.col("_n"))), F.lit(0)).alias("covered_rows"),
            ).select(
                F.lit(c).alias("column"),
                "test_rows",
                "covered_rows",
                safe_div("covered_rows", "test_rows").alias("overlap"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
