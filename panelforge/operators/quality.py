"""Column profiles, leakage, drift, source health and prediction-table gates. Every check is a report DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.exprs import safe_div
from panelforge.core.scale import average_rank, bucket_of, cut_lineage, range_buckets, value_positions
from panelforge.functions.text import has_combining_dot

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
TIMES = ("date", "timestamp", "timestamp_ntz")
# Fixed values of the flags.
ID_UNIQUE_RATIO = 0.98
HIGH_CARDINALITY = 100
MONOTONE_MIN_ROWS = 20
MONOTONE_MIN_VALUES = 3


def _is_numeric(ty: str) -> bool:
    return ty in NUMERIC or ty.startswith("decimal")


def _long(df: DataFrame, columns: Sequence[str], value: str, *extra: Column) -> DataFrame:
    """(column, v, extra...) rows, NULLs included."""
    structs = [F.struct(F.lit(c).alias("column"), F.col(c).cast(value).alias("v")) for c in columns]
    return df.select(F.inline(F.array(*structs)), *extra)


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per numeric column from its distinct values and their positions: count, distinct, exact quartiles,
    moments (bias-corrected skewness), zero and negative counts, whole-number flag. All columns share the jobs, and a
    value that fills a third of a column is one row."""
    pos = value_positions(_long(df, columns, "double"), "v", ["column"])
    n = F.col("_hi") - F.col("_lo")
    probs = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    aggs: list[Column] = [
        F.max("_total").alias("filled"),
        F.count(F.lit(1)).alias("distinct_filled"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        (F.sum(F.col("v") * n) / F.max("_total")).alias("mean"),
        F.sum(F.when(F.col("v") == 0, n).otherwise(0)).alias("zeros"),
        F.sum(F.when(F.col("v") < 0, n).otherwise(0)).alias("negatives"),
        F.bool_and(F.col("v") == F.floor("v")).alias("whole"),
    ]
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(p)
        lo = F.floor(at)
        hi = F.least(lo + 1, F.col("_total") - 1)
        a = F.max(F.when((F.col("_lo") <= lo) & (lo < F.col("_hi")), F.col("v")))
        b = F.max(F.when((F.col("_lo") <= hi) & (hi < F.col("_hi")), F.col("v")))
        frac = F.max(at) - F.floor(F.max(at))
        aggs.append((a + (b - a) * frac).alias(name))
    pos = cut_lineage(pos)
    base = pos.groupBy("column").agg(*aggs)
    # one row per column
    means = F.broadcast(base.select("column", "mean"))
    d = F.col("v") - F.col("mean")
    moments = pos.join(means, "column").groupBy("column").agg(
        F.sum(n * d * d).alias("_s2"), F.sum(n * d * d * d).alias("_s3")
    )
    k = F.col("filled").cast("double")
    g1 = safe_div(F.col("_s3") / k, F.pow(F.col("_s2") / k, 1.5))
    return (
        base.join(moments, "column")
        .withColumn("std", F.when(k > 1, F.sqrt(F.col("_s2") / F.when(k > 1, k - 1))))
        .withColumn("skew", F.when(k > 2, g1 * F.sqrt(k * (k - 1)) / F.when(k > 2, k - 2)))
        .drop("_s2", "_s3")
    )


def monotone_columns(df: DataFrame, columns: Sequence[str], order_by: str, buckets: int | None = None) -> DataFrame:
    """Per column whether it never falls (or never rises) along `order_by`, without sorting everything in one task: the
    order key is cut into ranges, as many as shuffle partitions by default, neighbours are compared inside a range and
    the ranges' ends are compared next. Rows with one key are ordered by all the columns, so the answer does not depend
    on the order in which rows are read."""
    buckets = buckets or range_buckets(df.sparkSession)
    key = F.col(order_by).cast("double") if _is_numeric(dict(df.dtypes)[order_by]) else F.unix_micros(
        F.col(order_by).cast("timestamp")
    ).cast("double")
    rows = df.select(key.alias("_k"), *[F.col(c).cast("double").alias(c) for c in columns])
    bounds = rows.agg(F.percentile_approx("_k", [i / buckets for i in range(1, buckets)], 2000).alias("b")).scalar()
    cut = bucket_of(rows.withColumn("_b", bounds), "_k", "_b", buckets, "_r")
    place = ["_k", *columns]
    w = Window.partitionBy("_r").orderBy(*place)
    stepped = cut.withColumns({f"_d_{c}": F.col(c) - F.lag(c).over(w) for c in columns})
    aggs = []
    for c in columns:
        aggs += [
            F.coalesce(F.bool_or(F.col(f"_d_{c}") < 0), F.lit(False)).alias(f"down_{c}"),
            F.coalesce(F.bool_or(F.col(f"_d_{c}") > 0), F.lit(False)).alias(f"up_{c}"),
            F.min_by(c, F.struct(*place)).alias(f"first_{c}"),
            F.max_by(c, F.struct(*place)).alias(f"last_{c}"),
        ]
    per = stepped.groupBy("_r").agg(*aggs)
    # at most `buckets` rows
    seq = Window.partitionBy(F.lit(0)).orderBy("_r")
    joined = per.withColumns({f"_j_{c}": F.col(f"first_{c}") - F.lag(f"last_{c}").over(seq) for c in columns})
    one = joined.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                (
                    ~(F.bool_or(F.col(f"down_{c}")) | F.coalesce(F.bool_or(F.col(f"_j_{c}") < 0), F.lit(False)))
                    | ~(F.bool_or(F.col(f"up_{c}")) | F.coalesce(F.bool_or(F.col(f"_j_{c}") > 0), F.lit(False)))
                ).alias("monotone"),
            ).alias(c)
            for c in columns
        ]
    )
    return one.select(F.inline(F.array(*[F.col(f"`{c}`") for c in columns])))


def profile_columns(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """One row per column: kind, missing, distinct (NULL counts as a value), statistics and flags joined by ` | `. The
    repeated-monotone flag needs `order_by`, a column that says in which order rows arrived."""
    types = dict(df.dtypes)
    numeric = [c for c, t in types.items() if _is_numeric(t)]
    other = [c for c in types if c not in numeric]
    n_rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    parts = []
    if numeric:
        prof = numeric_profile(df, numeric)
        mono = (
            monotone_columns(df, numeric, order_by)
            if order_by
            else prof.select("column", F.lit(False).alias("monotone"))
        )
        names = df.sparkSession.createDataFrame([(c,) for c in numeric], "column string")
        p = names.join(prof, "column", "left").join(mono, "column", "left").withColumn("_n", n_rows)
        filled = F.coalesce("filled", F.lit(0))
        missing = F.col("_n") - filled
        distinct = F.coalesce("distinct_filled", F.lit(0)) + (missing > 0).cast("int")
        ratio = safe_div(distinct, F.col("_n"))
        whole = F.coalesce("whole", F.lit(False))
        many = filled > 10
        flags = [
            F.when(distinct <= 1, "CONSTANT"),
            F.when((ratio >= ID_UNIQUE_RATIO) & whole, "ID_LIKE"),
            F.when(
                whole
                & F.coalesce("monotone", F.lit(False))
                & (F.col("_n") >= MONOTONE_MIN_ROWS)
                & (distinct >= MONOTONE_MIN_VALUES)
                & (ratio < ID_UNIQUE_RATIO),
                "REPEATED_MONOTONE",
            ),
            F.when(safe_div(missing, "_n") > 0.5, "MOSTLY_MISSING"),
            F.when(many & (F.abs("skew") > 3), "VERY_SKEWED"),
            F.when(many & (safe_div("zeros", filled) > 0.5), "ZERO_PILE"),
            F.when(many & (F.col("negatives") > 0) & (1 - safe_div("negatives", filled) > 0.95), "FEW_NEGATIVES"),
        ]
        parts.append(
            p.select(
                "column",
                F.lit("numeric").alias("kind"),
                missing.alias("missing"),
                distinct.alias("distinct"),
                "min", "p25", "median", "p75", "max", "mean", "std", "skew",
                F.array_join(F.array_compact(F.array(*flags)), " | ").alias("flags"),
            )
        )
    if other:
        long = _long(df, other, "string")
        values = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("_n"))
        per = values.groupBy("column").agg(
            F.sum("_n").alias("_rows"),
            F.sum(F.when(F.col("v").isNull(), F.col("_n")).otherwise(0)).alias("missing"),
            F.count(F.lit(1)).alias("distinct"),
            F.count("v").alias("_filled_distinct"),
            F.coalesce(F.bool_or(has_combining_dot("v")), F.lit(False)).alias("_dot"),
        )
        kinds = df.sparkSession.createDataFrame(
            [(c, "time" if types[c] in TIMES else "text" if types[c] == "string" else "category") for c in other],
            "column string, _ty string",
        )
        filled = F.col("_rows") - F.col("missing")
        kind = F.when(
            (F.col("_ty") == "text") & (safe_div("_filled_distinct", filled) <= 0.5), F.lit("category")
        ).otherwise(F.col("_ty"))
        q = kinds.join(per, "column").withColumn("kind", kind)
        cat = F.col("kind").isin("category", "text")
        flags = [
            F.when(F.col("distinct") <= 1, "CONSTANT"),
            F.when(cat & (safe_div("distinct", "_rows") >= ID_UNIQUE_RATIO), "ID_LIKE"),
            F.when(safe_div("missing", "_rows") > 0.5, "MOSTLY_MISSING"),
            F.when((F.col("kind") == "category") & (F.col("distinct") > HIGH_CARDINALITY), "HIGH_CARDINALITY"),
            F.when(cat & F.col("_dot"), "COMBINING_DOT"),
        ]
        null = F.lit(None).cast("double")
        parts.append(
            q.select(
                "column", "kind", "missing", "distinct",
                *[null.alias(c) for c in ("min", "p25", "median", "p75", "max", "mean", "std", "skew")],
                F.array_join(F.array_compact(F.array(*flags)), " | ").alias("flags"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """Task guess and shape of the target: more than 20 numeric values is a regression, 2 values binary, else multiclass."""
    numeric = _is_numeric(dict(df.dtypes)[target])
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(target).isNotNull()
    shape = counts.agg(
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("missing"),
        F.count(target).alias("distinct"),
        safe_div(F.min(F.when(known, F.col("n"))), F.sum(F.when(known, F.col("n")))).alias("rarest_share"),
    )
    task = F.when(F.lit(numeric) & (F.col("distinct") > 20), "regression").when(F.col("distinct") == 2, "binary")
    out = shape.withColumn("task", task.otherwise("multiclass"))
    if numeric:
        p = numeric_profile(df, [target]).select(
            F.struct(
                "min", "max", "mean", "median", "skew", safe_div("zeros", "filled").alias("zero_share")
            ).alias("p")
        ).scalar()
        out = out.withColumn("_p", p).select("missing", "distinct", "rarest_share", "task", "_p.*")
        advice = F.array_compact(
            F.array(
                F.when((F.col("task") == "regression") & (F.abs("skew") > 2), "log1p"),
                F.when((F.col("task") == "regression") & (F.col("zero_share") > 0.4), "two_stage"),
                F.when((F.col("task") != "regression") & (F.col("rarest_share") < 0.05), "stratify"),
            )
        )
        return out.withColumn("advice", F.array_join(advice, " | "))
    return out.withColumn("advice", F.when(F.col("rarest_share") < 0.05, "stratify").otherwise(F.lit("")))


def leakage_correlations(df: DataFrame, target: str, threshold: float = 0.95, min_rows: int = 30) -> DataFrame:
    """Pearson and Spearman correlation of every numeric column with the target, suspects marked."""
    types = dict(df.dtypes)
    columns = [c for c, t in types.items() if _is_numeric(t) and c != target]
    long = _long(df, columns, "double", F.col(target).cast("double").alias("y")).filter(
        F.col("v").isNotNull() & F.col("y").isNotNull()
    )
    ranked = average_rank(average_rank(long, "v", "rv", ["column"]), "y", "ry", ["column"])
    s = ranked.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.corr("v", "y").alias("pearson"), F.corr("rv", "ry").alias("spearman")
    ).filter(F.col("rows") >= min_rows)
    for c in ("pearson", "spearman"):
        s = s.withColumn(c, F.nanvl(F.col(c), F.lit(None).cast("double")))
    reason = F.when(F.abs("pearson") >= threshold, "pearson").when(F.abs("spearman") >= threshold, "spearman")
    return s.withColumn("suspect", reason)


def leakage_categories(df: DataFrame, target: str, threshold: float = 0.95, min_rows: int = 30) -> DataFrame:
    """Share of the target's variance a categorical column explains, from (column, level) sums."""
    columns = [c for c, t in dict(df.dtypes).items() if t in ("string", "boolean") and c != target]
    long = _long(df, columns, "string", F.col(target).cast("double").alias("y")).filter(
        F.col("v").isNotNull() & F.col("y").isNotNull()
    )
    mean = df.agg(F.avg(F.col(target).cast("double")).alias("m")).scalar()
    levels = (
        long.withColumn("_m", mean)
        .withColumn("y", F.col("y") - F.col("_m"))
        .groupBy("column", "v")
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    )
    per = levels.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("levels"),
        F.sum("s").alias("_s"),
        F.sum("q").alias("_q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("_b"),
    )
    total = F.col("_q") - F.col("_s") * F.col("_s") / F.col("rows")
    eta = 1 - safe_div(F.col("_q") - F.col("_b"), total)
    usable = (F.col("rows") >= min_rows) & (F.col("levels") >= 2) & (F.col("levels") <= F.col("rows") / 2) & (total > 0)
    return per.filter(usable).select(
        "column", F.col("rows").cast("bigint").alias("rows"), "levels", eta.alias("eta_squared"),
        F.when(eta >= threshold, "eta_squared").alias("suspect"),
    )


def leakage_report(
    train: DataFrame, target: str, test: DataFrame | None = None, time: str | None = None, threshold: float = 0.95
) -> DataFrame:
    """Findings (severity, check, column, value): correlation and category suspects, train-only columns, time overlap,
    near-unique columns and constants."""
    schema = ("severity", "check", "column", "value")
    spark = train.sparkSession
    parts: list[DataFrame] = []
    types = dict(train.dtypes)
    if _is_numeric(types[target]):
        c = leakage_correlations(train, target, threshold).filter(F.col("suspect").isNotNull())
        value = F.when(F.col("suspect") == "pearson", F.col("pearson")).otherwise(F.col("spearman"))
        parts.append(c.select(F.lit("critical"), "suspect", "column", value).toDF(*schema))
        if any(t in ("string", "boolean") for t in types.values()):
            e = leakage_categories(train, target, threshold).filter(F.col("suspect").isNotNull())
            parts.append(e.select(F.lit("critical"), "suspect", "column", "eta_squared").toDF(*schema))
    else:
        parts.append(
            spark.createDataFrame([("info", "target_not_numeric", target, None)], "a string, b string, c string, d double")
            .toDF(*schema)
        )
    if test is not None:
        gone = [("warning", "train_only", c, None) for c in train.columns if c != target and c not in test.columns]
        if gone:
            parts.append(spark.createDataFrame(gone, "a string, b string, c string, d double").toDF(*schema))
        if time and time in test.columns:
            end = train.agg(F.max(F.col(time).cast("timestamp")).alias("b")).scalar()
            t = test.agg(F.min(F.col(time).cast("timestamp")).alias("a")).withColumn("b", end)
            parts.append(
                t.select(
                    F.when(F.col("b") > F.col("a"), "critical").otherwise("info"),
                    F.when(F.col("b") > F.col("a"), "time_overlap").otherwise("clean_time_split"),
                    F.lit(time),
                    F.datediff("a", "b").cast("double"),
                ).toDF(*schema)
            )
    others = [c for c in train.columns if c != target]
    values = _long(train, others, "string").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    per = values.groupBy("column").agg(F.count(F.lit(1)).alias("u"), F.sum("n").alias("n"))
    ratio = safe_div("u", "n")
    parts.append(per.filter(ratio > 0.99).select(F.lit("warning"), F.lit("near_unique"), "column", ratio).toDF(*schema))
    parts.append(
        per.filter(F.col("u") <= 1).select(F.lit("info"), F.lit("constant"), "column", F.col("u").cast("double")).toDF(*schema)
    )
    return reduce(DataFrame.unionByName, parts)


# ---- sources --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SourceContract:
    """What a source must satisfy. `rules` are SQL conditions over aggregates of the source; `null_limits` overrides the
    2 % default."""

    name: str
    min_rows: int
    day: str | None = None
    starts_by: str | None = None
    ends_from: str | None = None
    key: str | None = None
    min_keys: int | None = None
    null_limits: Mapping[str, float] = field(default_factory=dict)
    rules: Mapping[str, str] = field(default_factory=dict)
    tolerance_days: int = 3


def source_health(df: DataFrame, contract: SourceContract) -> DataFrame:
    """Findings of one source from a single aggregate: one row per broken check, with the measured and allowed value."""
    c = contract
    rows = F.count(F.lit(1))
    checks: list[tuple[str, Column, Column, Column]] = [
        ("min_rows", rows < c.min_rows, rows.cast("double"), F.lit(float(c.min_rows)))
    ]
    if c.day:
        lo, hi = F.min(F.to_date(c.day)), F.max(F.to_date(c.day))
        if c.starts_by:
            late = F.datediff(lo, F.lit(c.starts_by).cast("date")).cast("double")
            checks.append(("starts_late", late > c.tolerance_days, late, F.lit(float(c.tolerance_days))))
        if c.ends_from:
            gap = F.datediff(F.lit(c.ends_from).cast("date"), hi).cast("double")
            checks.append(("ends_early", gap > c.tolerance_days, gap, F.lit(float(c.tolerance_days))))
    if c.key and c.min_keys:
        keys = F.count_distinct(F.col(c.key)).cast("double")
        checks.append(("min_keys", keys < c.min_keys, keys, F.lit(float(c.min_keys))))
    for col in df.columns:
        share = F.avg(F.col(col).isNull().cast("double"))
        limit = float(c.null_limits.get(col, 0.02))
        checks.append((f"null_share:{col}", share > limit, share, F.lit(limit)))
    for name, rule in c.rules.items():
        ok = F.coalesce(F.expr(rule), F.lit(False))
        checks.append((f"rule:{name}", ~ok, F.lit(None).cast("double"), F.lit(None).cast("double")))
    one = df.agg(
        *[
            F.struct(F.coalesce(bad, F.lit(True)).alias("bad"), got.alias("measured"), lim.alias("allowed")).alias(f"c{i}")
            for i, (_, bad, got, lim) in enumerate(checks)
        ]
    )
    items = [
        F.struct(
            F.lit(c.name).alias("source"), F.lit(name).alias("check"), F.col(f"c{i}.bad").alias("bad"),
            F.col(f"c{i}.measured").alias("measured"), F.col(f"c{i}.allowed").alias("allowed"),
        )
        for i, (name, *_) in enumerate(checks)
    ]
    return one.select(F.inline(F.array(*items))).filter("bad").drop("bad")


def source_alignment(
    sources: Mapping[str, tuple[DataFrame, str, str | None]], today: str, lag_days: int = 3, stale_days: int = 7
) -> DataFrame:
    """Per source (frame, day column, forecast flag or None): last day, last observed day, days behind the freshest
    source, days of forecast tail, and whether it lags or everything is stale."""
    parts = []
    for name, (df, day, flag) in sources.items():
        d = F.to_date(day)
        real = F.max(F.when(F.col(flag) == 0, d)) if flag else F.max(d)
        parts.append(df.agg(F.max(d).alias("last_day"), real.alias("last_observed")).select(F.lit(name).alias("source"), "*"))
    table = reduce(DataFrame.unionByName, parts)
    best = table.agg(F.max("last_day").alias("b")).scalar()
    out = table.withColumn("_best", best)
    return out.select(
        "source",
        "last_day",
        "last_observed",
        F.datediff("_best", "last_day").alias("days_behind"),
        F.datediff("last_day", "last_observed").alias("forecast_days"),
        (F.datediff("_best", "last_day") > lag_days).cast("int").alias("lagging"),
        (F.datediff(F.lit(today).cast("date"), "_best") > stale_days).cast("int").alias("all_stale"),
    )


def fill_pattern(df: DataFrame, columns: Sequence[str], day: str, test_days: int) -> DataFrame:
    """Filled share of each column before and inside the last `test_days` days, and its distinct values."""
    cut = F.date_sub(df.agg(F.max(F.to_date(day)).alias("b")).scalar(), test_days - 1)
    marked = df.withColumn("_test", F.to_date(day) >= cut)
    aggs = []
    for c in columns:
        filled = F.col(c).isNotNull().cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.avg(F.when(~F.col("_test"), filled)).alias("train_filled"),
                F.avg(F.when(F.col("_test"), filled)).alias("test_filled"),
            ).alias(c)
        )
    shares = marked.agg(*aggs).select(F.inline(F.array(*[F.col(f"`{c}`") for c in columns])))
    distinct = (
        _long(df, columns, "string").filter(F.col("v").isNotNull()).groupBy("column", "v").agg(F.lit(1).alias("x"))
        .groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    )
    return shares.join(distinct, "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))


def panel_horizon(sources: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """The source that ends first, and its last day: the panel cannot reach further."""
    parts = [df.agg(F.max(F.to_date(day)).alias("last_day")).select(F.lit(n).alias("source"), "last_day") for n, (df, day) in sources.items()]
    table = reduce(DataFrame.unionByName, parts).filter(F.col("last_day").isNotNull())
    return table.agg(F.min("last_day").alias("horizon"), F.min_by("source", F.struct("last_day", "source")).alias("limited_by"))


def external_coverage(
    sources: Mapping[str, tuple[DataFrame, str, str | None]], test: DataFrame, test_day: str
) -> DataFrame:
    """Per source: last day, days missing at the end of the test window, whether it covers it, and the forecast share of
    its rows inside the window."""
    lo = test.agg(F.min(F.to_date(test_day)).alias("b")).scalar()
    hi = test.agg(F.max(F.to_date(test_day)).alias("b")).scalar()
    parts = []
    for name, (df, day, flag) in sources.items():
        d = F.to_date(day)
        marked = df.withColumns({"_lo": lo, "_hi": hi})
        inside = d.between(F.col("_lo"), F.col("_hi"))
        share = F.avg(F.when(inside, F.col(flag).cast("double"))) if flag else F.lit(None).cast("double")
        parts.append(
            marked.agg(F.max(d).alias("last_day"), F.max("_hi").alias("_hi"), share.alias("forecast_share")).select(
                F.lit(name).alias("source"),
                "last_day",
                F.greatest(F.datediff("_hi", "last_day"), F.lit(0)).alias("missing_days"),
                (F.col("last_day") >= F.col("_hi")).cast("int").alias("covers"),
                "forecast_share",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def combined_gate(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    expected_keys: int,
    null_limit: float = 0.10,
    season: tuple[str, Sequence[int], Sequence[int]] | None = None,
) -> DataFrame:
    """Checks of a combined table: expected rows, duplicate keys, NULL shares at or above the limit, and a seasonal order
    (mean of a column over the first months above that over the second). One row per check with `ok`."""
    d = F.to_date(day)
    copies = df.groupBy(*keys, d.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    shape = copies.agg(
        F.sum("_n").alias("rows"),
        F.sum(F.col("_n") - 1).alias("dup"),
        (F.datediff(F.max("_d"), F.min("_d")) + 1).alias("days"),
    )
    expected = F.col("days") * expected_keys
    parts = [
        shape.select(
            F.inline(
                F.array(
                    F.struct(
                        F.lit("expected_rows").alias("check"), F.col("rows").cast("double").alias("measured"),
                        expected.cast("double").alias("limit"), (F.col("rows") == expected).cast("int").alias("ok"),
                    ),
                    F.struct(
                        F.lit("duplicate_keys").alias("check"), F.col("dup").cast("double").alias("measured"),
                        F.lit(0.0).alias("limit"), (F.col("dup") == 0).cast("int").alias("ok"),
                    ),
                )
            )
        )
    ]
    others = [c for c in df.columns if c not in (*keys, day)]
    nulls = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in others])
    parts.append(
        nulls.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(f"null_share:{c}").alias("check"), F.col(f"`{c}`").alias("measured"),
                            F.lit(null_limit).alias("limit"), (F.col(f"`{c}`") < null_limit).cast("int").alias("ok"),
                        )
                        for c in others
                    ]
                )
            )
        )
    )
    if season:
        c, high, low = season
        m = F.month(d)
        s = df.agg(F.avg(F.when(m.isin(*high), F.col(c))).alias("a"), F.avg(F.when(m.isin(*low), F.col(c))).alias("b"))
        parts.append(
            s.select(
                F.lit(f"season:{c}").alias("check"), F.col("a").alias("measured"), F.col("b").alias("limit"),
                F.coalesce(F.col("a") > F.col("b"), F.lit(False)).cast("int").alias("ok"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


# ---- prediction tables ----------------------------------------------------------------------------------------------


def validate_predictions(
    predictions: DataFrame, sample: DataFrame, id_column: str, value: str, allow_negative: bool = False
) -> DataFrame:
    """One row per check (columns, row count, missing and extra ids as multisets, NULL, infinite, negative, constant)
    with the count, its severity and `ok`."""
    missing_cols = [c for c in sample.columns if c not in predictions.columns]
    extra_cols = [c for c in predictions.columns if c not in sample.columns]
    # ids are compared through counts per id
    e = sample.groupBy(F.col(id_column).alias("_e")).agg(F.count(F.lit(1)).alias("_ne"))
    a = predictions.groupBy(F.col(id_column).alias("_a")).agg(F.count(F.lit(1)).alias("_na"))
    both = e.join(a, F.col("_e").eqNullSafe(F.col("_a")), "full")
    ne, na = F.coalesce("_ne", F.lit(0)), F.coalesce("_na", F.lit(0))
    ids = both.agg(
        F.struct(
            F.sum(F.greatest(ne - na, F.lit(0))).alias("missing"),
            F.sum(F.greatest(na - ne, F.lit(0))).alias("extra"),
            F.sum(ne).alias("want"),
        ).alias("i")
    ).scalar()
    v = F.col(value).cast("double")
    infinite = F.abs(v) == F.lit(float("inf"))
    bad = v.isNull() | F.isnan(v)
    fine = ~bad & ~infinite
    one = predictions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad).alias("nulls"),
        F.count_if(F.coalesce(infinite, F.lit(False))).alias("inf"),
        F.count_if(F.coalesce(fine & (v < 0), F.lit(False))).alias("neg"),
        F.min(F.when(fine, v)).alias("lo"),
        F.max(F.when(fine, v)).alias("hi"),
    ).withColumn("_i", ids)
    z = F.lit(0).cast("bigint")
    checks = [
        ("missing_columns", "error", F.lit(len(missing_cols)).cast("bigint")),
        ("extra_columns", "error", F.lit(len(extra_cols)).cast("bigint")),
        ("row_count_gap", "error", F.abs(F.col("rows") - F.col("_i.want"))),
        ("missing_ids", "error", F.col("_i.missing")),
        ("extra_ids", "error", F.col("_i.extra")),
        ("null_values", "error", F.col("nulls")),
        ("infinite_values", "error", F.col("inf")),
        ("negative_values", "warning", z if allow_negative else F.col("neg")),
        ("constant", "warning", F.coalesce((F.col("lo") == F.col("hi")).cast("bigint"), z)),
    ]
    items = [
        F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), c.alias("count"), (c == 0).cast("int").alias("ok"))
        for n, s, c in checks
    ]
    return one.select(F.inline(F.array(*items)))


def prediction_gate(
    predictions: DataFrame,
    sample: DataFrame,
    id_column: str,
    value: str,
    position: str,
    flags: DataFrame,
    cold: str,
    reference: DataFrame | None = None,
) -> DataFrame:
    """One row: rows, duplicate ids, rows out of sample order, NULL, negative and zero values, log means by regime, and the
    difference to a reference table; `passed` covers the hard checks."""
    dup = predictions.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).agg(
        F.struct(F.sum(F.col("n") - 1).alias("d")).alias("s")
    ).scalar()
    want = sample.agg(F.count(F.lit(1)).alias("n")).scalar()
    j = predictions.join(sample.select(id_column, F.col(position).alias("_pos")), id_column, "left").join(
        flags.select(id_column, F.col(cold).alias("_cold")), id_column, "left"
    )
    if reference is not None:
        j = j.join(reference.select(id_column, F.col(value).alias("_ref")), id_column, "left")
    v = F.col(value)
    lg = F.log1p(F.greatest(v, F.lit(0.0)))
    lg = F.when(v.isNotNull(), lg)
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(F.col("_pos") != F.col(position), F.lit(True))).alias("out_of_order"),
        F.count_if(v.isNull()).alias("nulls"),
        F.count_if(v < 0).alias("negatives"),
        F.count_if(v == 0).alias("zeros"),
        F.avg(lg).alias("log_mean"),
        F.avg(F.when(F.col("_cold") == 0, lg)).alias("log_mean_warm"),
        F.avg(F.when(F.col("_cold") == 1, lg)).alias("log_mean_cold"),
    ]
    if reference is not None:
        d = lg - F.log1p(F.greatest(F.col("_ref"), F.lit(0.0)))
        aggs += [
            F.avg(d).alias("ref_diff_mean"),
            F.max(F.abs(d)).alias("ref_diff_max"),
            F.count_if(F.abs(d) > 1e-9).alias("ref_changed"),
        ]
    out = j.agg(*aggs).withColumns({"_d": dup, "_want": want}).withColumn("duplicates", F.col("_d.d"))
    passed = (
        (F.col("rows") == F.col("_want"))
        & (F.col("out_of_order") == 0)
        & (F.col("nulls") == 0)
        & (F.col("negatives") == 0)
        & (F.col("duplicates") == 0)
    )
    return out.withColumn("passed", passed.cast("int")).drop("_d", "_want")


def duplicate_samples(df: DataFrame, entity: Sequence[str], time: str, limit: int = 2) -> DataFrame:
    """A few repeated (entity, time) pairs with their number of rows; empty when the panel is unique. The limit is the
    report's size."""
    return (
        df.groupBy(*entity, time)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
        .orderBy(F.col("copies").desc(), *entity, time)
        .limit(limit)
    )


def uniqueness_report(df: DataFrame, entity: Sequence[str], time: str) -> DataFrame:
    """One row: distinct pairs, repeated pairs and surplus rows."""
    per = df.groupBy(*entity, time).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("n") > 1).alias("repeated_pairs"),
        F.sum(F.col("n") - 1).alias("surplus_rows"),
    )
