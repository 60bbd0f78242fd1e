"""Ordered reports: worst segments, robustness trims and sample alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.exprs import safe_div


def worst_segments(report: DataFrame, metric: str, n: int = 10, lower_is_better: bool = True) -> DataFrame:
    """The n worst rows of a segment report; the segment columns break ties."""
    order = F.col(metric).desc_nulls_last() if lower_is_better else F.col(metric).asc_nulls_last()
    rest = [F.col(c) for c in report.columns if c != metric]
    return report.orderBy(order, *rest).limit(n)


def trim_table(
    df: DataFrame, entity: str, base_error: str, new_error: str, ks: Sequence[int] = (0, 1, 5, 10, 25, 50)
) -> DataFrame:
    """Change of the mean squared error after removing the k most improved entities (lowest summed change), per k.

    Ties go by entity order.
    """
    change = F.col(new_error) - F.col(base_error)
    per = df.groupBy(entity).agg(F.sum(change).alias("_d"), F.count(F.lit(1)).alias("_n"))
    # every task keeps its first max(ks) entities, then those few are merged and numbered
    first = (
        per.orderBy("_d", entity).limit(max(max(ks), 1)).withColumn(
            "_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_d", entity))
        )
    )
    total = per.agg(F.struct(F.sum("_d").alias("d"), F.sum("_n").alias("n")).alias("t")).scalar()
    gone = first.agg(
        *[
            F.struct(
                F.coalesce(F.sum(F.when(F.col("_rank") <= k, F.col("_d"))), F.lit(0.0)).alias("d"),
                F.coalesce(F.sum(F.when(F.col("_rank") <= k, F.col("_n"))), F.lit(0)).alias("n"),
            ).alias(f"k{k}")
            for k in ks
        ]
    ).withColumn("_t", total)
    rows = F.array(*[F.struct(F.lit(k).alias("removed"), F.col(f"k{k}").alias("g")) for k in ks])
    return gone.select("_t", F.inline(rows)).select(
        "removed",
        safe_div(F.col("_t.d") - F.col("g.d"), F.col("_t.n") - F.col("g.n")).alias("delta_mse"),
        (F.col("_t.n") - F.col("g.n")).alias("rows_left"),
    )


def align_to_sample(predictions: DataFrame, sample: DataFrame, id_column: str, position: str) -> DataFrame:
    """Predictions with the sample's position column; repeated, missing or unknown ids fail the query."""
    p = predictions.groupBy(id_column).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min(c).alias(c) for c in predictions.columns if c != id_column],
    )
    j = sample.select(id_column, position).join(p, id_column, "full")
    ok = F.col("_n").isNotNull() & (F.col("_n") == 1) & F.col(position).isNotNull()
    return j.filter(F.assert_true(ok, F.lit("prediction ids are not exactly the sample ids")).isNull()).drop("_n")
