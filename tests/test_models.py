"""Iterative and MLlib-backed operators against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import aggregates as A
from panelforge.operators import blend as BL
from panelforge.operators import metrics as M
from panelforge.operators import ml as ML
from panelforge.operators import postprocess as PP


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(4)
    n = 800
    y = rng.gamma(2, 50, n)
    pdf = pd.DataFrame(
        {"id": range(n), "e": rng.integers(0, 40, n), "fold": np.arange(n) % 4, "y": y, "a": y * 0.9 + rng.normal(0, 20, n),
         "b": y * 1.1 + rng.normal(0, 25, n), "c": np.full(n, y.mean())}
    )
    return pdf, spark.createDataFrame(pdf).cache()


def _climb(pdf, score, step, rounds):
    cols = ["a", "b", "c"]
    eye = np.eye(3)
    single = [score(eye[i]) for i in range(3)]
    w, best = eye[int(np.argmin(single))].copy(), min(single)
    for _ in range(rounds):
        s = [score(w + step * eye[i]) for i in range(3)]
        if min(s) >= best:
            break
        w, best = w + step * eye[int(np.argmin(s))], min(s)
    return dict(zip(cols, w / w.sum(), strict=True))


@pytest.mark.parametrize("by", ["rmse", "mae"])
def test_hill_climb(preds, by):
    pdf, df = preds
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy()

    def score(w):
        e = x @ (w / w.sum()) - y
        return np.sqrt((e**2).mean()) if by == "rmse" else np.abs(e).mean()

    got = BL.hill_climb_weights(df, ["a", "b", "c"], "y", by, iterations=12, step=0.1)
    want = _climb(pdf, score, 0.1, 12)
    assert all(np.isclose(got[k], want[k]) for k in want)


def test_hill_climb_with_penalty(preds):
    pdf, df = preds
    x, y, f = pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy(), pdf["fold"].to_numpy()

    def score(w):
        e = (x @ (w / w.sum()) - y) ** 2
        s = [np.sqrt(e[f == i].mean()) for i in range(4)]
        return np.mean(s) + 0.5 * np.std(s)

    got = BL.hill_climb_weights(df, ["a", "b", "c"], "y", "rmse", 12, 0.1, "fold", 0.5)
    want = _climb(pdf, score, 0.1, 12)
    assert all(np.isclose(got[k], want[k]) for k in want)


def test_two_way_effects(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0, 3, 12), rng.normal(0, 2, 20)
    rows = [(i, f"2024-01-{j + 1:02}", float(5 + a[i] + b[j] + rng.normal(0, 0.1))) for i in range(12) for j in range(20) if rng.random() < 0.8]
    pdf = pd.DataFrame(rows, columns=["e", "d", "v"])
    got = A.two_way_effects(spark.createDataFrame(pdf).withColumn("d", F.to_date("d")), "e", "d", "v").orderBy("d").toPandas()
    x = np.hstack([pd.get_dummies(pdf["e"]).to_numpy(float), pd.get_dummies(pdf["d"]).to_numpy(float)])
    coef = np.linalg.lstsq(x, pdf["v"].to_numpy(), rcond=None)[0][12:]
    assert np.allclose(got["day_effect"], coef - coef.mean(), atol=1e-4)


def test_bootstrap_gate(preds):
    pdf, df = preds
    rows = df.withColumns({"ea": F.pow(F.col("b") - F.col("y"), 2), "eb": F.pow(F.col("a") - F.col("y"), 2)})
    r = M.bootstrap_gate(rows, "e", "ea", "eb", replicates=300).first()
    d = (pdf["a"] - pdf["y"]) ** 2 - (pdf["b"] - pdf["y"]) ** 2
    per = d.groupby(pdf["e"]).sum()
    assert np.isclose(r["dmse"], d.mean()) and np.isclose(r["improved_entities"], (per < 0).mean())
    assert r["ci_low"] < r["dmse"] < r["ci_high"]
    rng = np.random.default_rng(0)
    n = pdf.groupby("e").size()
    draws = [per.iloc[i].sum() / n.iloc[i].sum() for i in (rng.integers(0, len(per), len(per)) for _ in range(2000))]
    spread = np.percentile(draws, 97.5) - np.percentile(draws, 2.5)
    assert abs((r["ci_high"] - r["ci_low"]) / spread - 1) < 0.35


def test_isotonic_calibration(spark):
    rng = np.random.default_rng(8)
    p = rng.random(3000)
    pdf = pd.DataFrame({"p": p, "y": (rng.random(3000) < p**2).astype(float), "fold": np.arange(3000) % 3})
    rows, s = PP.calibrate_probability(spark.createDataFrame(pdf), "p", "y", "fold", "q")
    got = rows.toPandas()
    assert len(got) == 3000 and s["improved"] and got["q"].between(0, 1).all()
    for _, g in got.groupby("fold"):
        assert (np.diff(g.sort_values("p")["q"]) >= -1e-12).all()


def test_shuffled_labels_are_a_permutation(preds):
    pdf, df = preds
    got = ML.shuffle_label(df, "id", "y", 3, "s").select("id", "y", "s").toPandas()
    assert len(got) == len(pdf) and np.allclose(np.sort(got["s"]), np.sort(pdf["y"]))
    assert abs(np.corrcoef(got["y"], got["s"])[0, 1]) < 0.15


def test_cross_validation_covers_each_row_once(preds):
    _, df = preds
    oof, scores = ML.cross_validate(df, ["a", "c"], "y", ML.key_split("fold", 4))
    assert oof.count() == 800 and oof.select("id").distinct().count() == 800 and scores.count() == 4


def test_experts_do_not_mix(preds):
    _, df = preds
    rows = df.withColumn("cold", (F.col("e") < 10).cast("int"))
    broken = rows.withColumn("y", F.when(F.col("cold") == 1, F.col("y") * 1e6).otherwise(F.col("y")))
    a, b = (ML.regime_experts(r, rows, "y", "cold", ["a"], ["a"]).filter("cold = 0").orderBy("id").toPandas() for r in (rows, broken))
    assert np.allclose(a["prediction"], b["prediction"])


def test_ablation_verdict(spark):
    rows = [("none", s, f, 1.0) for s in (1, 2) for f in (1, 2, 3)]
    rows += [("good", s, f, 1.2 + 0.01 * f) for s in (1, 2) for f in (1, 2, 3)]
    rows += [("bad", s, f, 0.7 + 0.01 * f) for s in (1, 2) for f in (1, 2, 3)]
    rows += [("noise", s, f, 1.0 + 0.05 * (f - 2)) for s in (1, 2) for f in (1, 2, 3)]
    df = spark.createDataFrame(rows, "dropped string, seed int, fold int, score double")
    got = {r["dropped"]: r["verdict"] for r in ML.ablation_verdict(df).collect()}
    assert got == {"good": "useful", "bad": "harmful", "noise": "undecided"}


def test_adversarial_verdicts(preds):
    _, df = preds
    a, b = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    same, _, _ = ML.adversarial_validation(a, b, "id", ["a", "y"], 2, model=lambda s: ML.boosted_classifier(s, 2, 3))
    assert same.first()["verdict"] == "similar"
    shifted = b.withColumn("a", F.col("a") + 500)
    far, top, _ = ML.adversarial_validation(a, shifted, "id", ["a", "y"], 2, model=lambda s: ML.boosted_classifier(s, 2, 3))
    assert far.first()["auc"] > 0.95 and top.first()["feature"] == "a"
