"""The dataflow around model training with MLlib estimators: folds, out-of-fold predictions, regime experts, hurdles,
seed averages, null importances, ablation verdicts and adversarial validation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.core.exprs import safe_div
from panelforge.core.scale import cut_lineage, value_positions
from panelforge.operators.metrics import auc, metric
from panelforge.operators.splits import Fold

Stage = Callable[[], object]


def linear() -> LinearRegression:
    return LinearRegression(featuresCol="_features", labelCol="_label", predictionCol="_p", regParam=1e-6)


def boosted_trees(seed: int = 42, depth: int = 3, iterations: int = 10) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="_features", labelCol="_label", predictionCol="_p", maxDepth=depth, maxIter=iterations, seed=seed
    )


def logistic() -> LogisticRegression:
    return LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_p", probabilityCol="_prob")


def boosted_classifier(seed: int = 42, depth: int = 3, iterations: int = 10) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="_features", labelCol="_label", predictionCol="_p", maxDepth=depth, maxIter=iterations, seed=seed
    ).setProbabilityCol("_prob")


def feature_stages(features: Sequence[str]) -> tuple[list[str], list]:
    """Median imputation and an assembler; trees and linear models both need complete vectors."""
    filled = [f"_f_{c}" for c in features]
    imputer = Imputer(inputCols=list(features), outputCols=filled, strategy="median")
    return filled, [imputer, VectorAssembler(inputCols=filled, outputCol="_features")]


def with_missing_flags(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Features as doubles plus one flag per feature, because MLlib does not route missing values."""
    cols = {c: F.col(c).cast("double") for c in features}
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in features}
    return df.withColumns({**flags, **cols}), [*features, *flags]


def fit_model(df: DataFrame, features: Sequence[str], label: str | Column, model) -> PipelineModel:
    target = F.col(label) if isinstance(label, str) else label
    _, stages = feature_stages(features)
    rows = df.withColumn("_label", target.cast("double")).filter(F.col("_label").isNotNull())
    return Pipeline(stages=[*stages, model]).fit(rows)


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], out: str, proba: bool = False) -> DataFrame:
    done = model.transform(df)
    value = vector_to_array("_prob")[1] if proba else F.col("_p")
    keep = [c for c in df.columns if c != out]
    return done.select(*keep, value.alias(out))


def cross_validate(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    split: Sequence[tuple[object, Column, Column]],
    model: Stage = linear,
    out: str = "oof",
    proba: bool = False,
    by: str = "rmse",
) -> tuple[DataFrame, DataFrame]:
    """Fits per fold on its training rows and predicts its validation rows. `split` holds (fold, train condition, valid
    condition). Returns the out-of-fold rows (rows no fold validates are absent: that is the coverage) and the scores. The
    input is written once: every fold and every iteration of a fit reads it again."""
    return _cross_validate(cut_lineage(df), features, label, split, model, out, proba, by)


def _cross_validate(df, features, label, split, model=linear, out="oof", proba=False, by="rmse"):
    parts = []
    for name, train, valid in split:
        fitted = fit_model(df.filter(train), features, label, model())
        parts.append(predict(fitted, df.filter(valid), features, out, proba).withColumn("fold", F.lit(name)))
    oof = reduce(DataFrame.unionByName, parts)
    scores = oof.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), metric(by, label, out).alias(by))
    return oof, scores


def time_split(folds: Sequence[Fold], time: str) -> list[tuple[int, Column, Column]]:
    t = F.col(time).cast("timestamp_ntz")
    return [
        (f.number, t < F.lit(f.train_before), t.between(F.lit(f.valid_start), F.lit(f.valid_end))) for f in folds
    ]


def key_split(fold: str, k: int) -> list[tuple[int, Column, Column]]:
    return [(i, F.col(fold) != i, F.col(fold) == i) for i in range(k)]


def regime_experts(
    train: DataFrame,
    test: DataFrame,
    label: str,
    cold: str,
    warm_features: Sequence[str],
    cold_features: Sequence[str],
    model: Stage = linear,
    cold_train: Column | None = None,
    out: str = "prediction",
) -> DataFrame:
    """Two models with their own rows and features; every test row is predicted by the model of its own regime only.
    `cold_train` picks the rows the cold model learns from (cold or masked rows)."""
    train = cut_lineage(train)
    warm_model = fit_model(train.filter(F.col(cold) == 0), warm_features, label, model())
    cold_rows = train.filter(F.col(cold) == 1) if cold_train is None else train.filter(cold_train)
    cold_model = fit_model(cold_rows, cold_features, label, model())
    a = predict(warm_model, test.filter(F.col(cold) == 0), warm_features, out).withColumn("expert", F.lit("warm"))
    b = predict(cold_model, test.filter(F.col(cold) == 1), cold_features, out).withColumn("expert", F.lit("cold"))
    return a.unionByName(b)


def fit_hurdle(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    split: Sequence[tuple[object, Column, Column]],
    classifier: Stage = logistic,
    regressor: Stage = linear,
) -> DataFrame:
    """Classifier on y > 0 for all rows, regressor on positive rows; both predict every validation row out of fold."""
    df = cut_lineage(df)
    parts = []
    for name, train, valid in split:
        rows = df.filter(train)
        c = fit_model(rows, features, (F.col(label) > 0).cast("double"), classifier())
        r = fit_model(rows.filter(F.col(label) > 0), features, label, regressor())
        done = predict(c, df.filter(valid), features, "probability", proba=True)
        parts.append(predict(r, done, features, "magnitude").withColumn("fold", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def multi_seed_refit(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str,
    seeds: Sequence[int],
    model: Callable[[int], object] = boosted_trees,
    out: str = "prediction",
) -> tuple[DataFrame, DataFrame]:
    """One full fit per seed on log1p targets, averaged in log space; also the mean disagreement between seeds (standard
    deviation of the log predictions, ddof 1)."""
    train = cut_lineage(train)
    rows = test
    names = []
    for s in seeds:
        fitted = fit_model(train, features, F.log1p(F.greatest(F.col(label), F.lit(0.0))), model(s))
        name = f"_seed_{s}"
        rows = predict(fitted, rows, features, name)
        names.append(name)
    k = float(len(names))
    mean = reduce(lambda a, b: a + b, [F.col(n) for n in names]) / k
    done = rows.withColumn("_m", mean)
    var = reduce(lambda a, b: a + b, [(F.col(n) - F.col("_m")) * (F.col(n) - F.col("_m")) for n in names])
    done = done.withColumn("seed_std", F.sqrt(var / max(k - 1, 1.0)))
    done = done.withColumn(out, F.greatest(F.expm1("_m"), F.lit(0.0))).drop("_m", *names)
    return done, done.agg(F.avg("seed_std").alias("mean_seed_std"), F.count(F.lit(1)).alias("rows"))


def shuffle_label(df: DataFrame, key: str, label: str, seed: int, out: str) -> DataFrame:
    """A seeded permutation of the labels: rows and labels are placed by two different hashes of the key and meet at
    equal places. Places come from distributed positions, so nothing is sorted in one task."""
    a = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)).cast("double")
    b = F.pmod(F.xxhash64(F.col(key), F.lit(-seed - 1)), F.lit(1 << 52)).cast("double")
    hashed = df.withColumns({"_a": a, "_b": b})
    rows = hashed.join(value_positions(hashed, "_a").select("_a", F.col("_lo").alias("_at")), "_a")
    labels = hashed.select("_b", F.col(label).alias(out)).join(
        value_positions(hashed, "_b").select("_b", F.col("_lo").alias("_at")), "_b"
    )
    # two keys with one hash share a place; the smaller label then serves both
    one = labels.groupBy("_at").agg(F.min(out).alias(out))
    joined = rows.join(one, "_at", "left")
    return joined.withColumn(out, F.coalesce(out, F.col(label))).drop("_a", "_b", "_at")


def null_importance_filter(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    rounds: int = 5,
    percentile: float = 75.0,
    model: Callable[[int], object] = boosted_trees,
) -> DataFrame:
    """Importance of every feature against its importances under shuffled labels; kept when it exceeds the percentile of
    the latter."""
    from numpy import percentile as np_percentile

    def importance(rows: DataFrame, target: str, seed: int) -> list[float]:
        fitted = fit_model(rows, features, target, model(seed))
        return list(map(float, fitted.stages[-1].featureImportances.toArray()))

    data = cut_lineage(df.select(key, *features, label))
    real = importance(data, label, 1)
    nulls = []
    for r in range(rounds):
        shuffled = cut_lineage(shuffle_label(data, key, label, r + 1, "_shuffled"))
        nulls.append(importance(shuffled, "_shuffled", 1))
    out = []
    for i, f in enumerate(features):
        limit = float(np_percentile([n[i] for n in nulls], percentile))
        out.append((f, real[i], limit, int(real[i] > limit)))
    return df.sparkSession.createDataFrame(out, "feature string, importance double, null_limit double, kept int")


def ablation_scores(
    df: DataFrame,
    groups: Mapping[str, Sequence[str]],
    label: str,
    split: Sequence[tuple[object, Column, Column]],
    seeds: Sequence[int] = (1,),
    model: Callable[[int], object] = lambda s: linear(),
    by: str = "rmse",
) -> DataFrame:
    """Score per (dropped group, seed, fold), and of the full feature set under the name `none`."""
    df = cut_lineage(df)
    everything = [f for fs in groups.values() for f in fs]
    parts = []
    for dropped in ("none", *groups):
        kept = [f for f in everything if dropped == "none" or f not in groups[dropped]]
        for s in seeds:
            _, scores = _cross_validate(df, kept, label, split, lambda s=s: model(s), by=by)
            parts.append(
                scores.select(F.lit(dropped).alias("dropped"), F.lit(s).alias("seed"), "fold", F.col(by).alias("score"))
            )
    return reduce(DataFrame.unionByName, parts)


def ablation_verdict(scores: DataFrame, noise: float = 0.0, lower_is_better: bool = True) -> DataFrame:
    """Mean of the paired deltas against the full set, its standard error, and the verdict: a group is useful when
    dropping it hurts by more than two standard errors and the noise, harmful when it helps by that much."""
    full = scores.filter(F.col("dropped") == "none").select("seed", "fold", F.col("score").alias("_full"))
    sign = 1.0 if lower_is_better else -1.0
    pairs = scores.filter(F.col("dropped") != "none").join(full, ["seed", "fold"])
    per = pairs.groupBy("dropped").agg(
        F.count(F.lit(1)).alias("pairs"),
        (F.avg(F.col("score") - F.col("_full")) * sign).alias("mean_delta"),
        (F.stddev_samp(F.col("score") - F.col("_full")) / F.sqrt(F.count(F.lit(1)))).alias("se"),
    )
    limit = F.greatest(2 * F.coalesce("se", F.lit(0.0)), F.lit(float(noise)))
    verdict = (
        F.when(F.col("mean_delta") > limit, "useful").when(F.col("mean_delta") < -limit, "harmful").otherwise("undecided")
    )
    return per.withColumn("verdict", verdict)


def shift_verdict(oof: DataFrame, is_test: str, weight: str) -> DataFrame:
    """One row from out-of-fold probabilities of being a test row: AUC, effective size of the train rows weighted by them, its
    share of the rows, and what to make of it."""
    w = F.col(weight)
    ess = oof.filter(F.col(is_test) == 0).agg(
        F.struct(
            safe_div(F.sum(w) * F.sum(w), F.sum(w * w)).alias("ess"), F.count(F.lit(1)).alias("n")
        ).alias("e")
    ).scalar()
    score = auc(oof, is_test, weight).select("auc").withColumn("_e", ess)
    ratio = safe_div("_e.ess", "_e.n")
    verdict = (
        F.when(F.col("auc") < 0.6, "similar")
        .when(F.col("auc") < 0.8, "moderate shift")
        .when(ratio < 0.05, "severe shift, do not weight")
        .otherwise("severe shift, weights usable")
    )
    return score.select("auc", F.col("_e.ess").alias("ess"), ratio.alias("ess_ratio"), verdict.alias("verdict"))


def adversarial_validation(
    train: DataFrame,
    test: DataFrame,
    key: str,
    features: Sequence[str],
    folds: int = 3,
    seed: int = 42,
    model: Callable[[int], object] = boosted_classifier,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How well a classifier tells train rows from test rows, out of fold.

    Returns a one-row verdict (AUC, effective sample size of the density weights, text), importances per feature, and
    the train rows' weights.
    """
    shared = [c for c in features if c in train.columns and c in test.columns]
    if not shared:
        raise ValueError("no shared feature columns")
    a = train.select(key, *[F.col(c).cast("double").alias(c) for c in shared], F.lit(0).alias("_is_test"))
    b = test.select(key, *[F.col(c).cast("double").alias(c) for c in shared], F.lit(1).alias("_is_test"))
    both = a.unionByName(b).withColumn(
        "_fold", F.pmod(F.xxhash64(F.col(key), F.col("_is_test"), F.lit(seed)), F.lit(folds))
    )
    both = cut_lineage(both)
    parts, weights = [], [0.0] * len(shared)
    for i in range(folds):
        fitted = fit_model(both.filter(F.col("_fold") != i), shared, "_is_test", model(seed))
        parts.append(predict(fitted, both.filter(F.col("_fold") == i), shared, "weight", proba=True))
        last = fitted.stages[-1]
        got = last.featureImportances if hasattr(last, "featureImportances") else [abs(x) for x in last.coefficients]
        for j, x in enumerate(got.toArray() if hasattr(got, "toArray") else got):
            weights[j] += float(x) / folds
    oof = cut_lineage(reduce(DataFrame.unionByName, parts))
    mine = oof.filter(F.col("_is_test") == 0)
    one = shift_verdict(oof, "_is_test", "weight")
    top = train.sparkSession.createDataFrame(
        sorted(zip(shared, weights, strict=True), key=lambda p: -p[1]), "feature string, importance double"
    )
    return one, top, mine.select(key, "weight")
