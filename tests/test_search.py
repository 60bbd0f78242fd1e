"""Conjugate gradients, exact line searches, merged bins, and texts classified once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.core.scale import weighted_median
from panelforge.functions import text as TX
from panelforge.operators import aggregates as A
from panelforge.operators import blend as BL
from panelforge.operators import postprocess as PP


def least_squares(pdf):
    x = np.hstack([pd.get_dummies(pdf["e"]).to_numpy(float), (days := pd.get_dummies(pdf["d"])).to_numpy(float)])
    coef = np.linalg.lstsq(x, pdf["v"].to_numpy(), rcond=None)[0][x.shape[1] - days.shape[1] :]
    return coef - coef.mean()


def test_effects_of_a_badly_connected_panel(spark):
    """A chain: every entity has two neighbouring days only, so alternating means move one day a round."""
    rng = np.random.default_rng(3)
    start = np.datetime64("2024-01-01")
    rows = [(i, str(start + i + k), float(3 + np.sin(i + k) * 5 + rng.normal(0, 0.1) + 10 * i)) for i in range(80) for k in (0, 1) for _ in range(1 + i % 3)]
    pdf = pd.DataFrame(rows, columns=["e", "d", "v"])
    got = A.two_way_effects(spark.createDataFrame(pdf).withColumn("d", F.to_date("d")), "e", "d", "v").orderBy("d").toPandas()
    assert np.allclose(got["day_effect"], least_squares(pdf), atol=1e-6)


def test_effects_with_gaps_nulls_and_lonely_days(spark):
    rows = [("a", "2024-01-01", 1.0), ("a", "2024-01-02", 3.0), ("b", "2024-01-02", 9.0), ("b", "2024-01-01", 7.5), ("c", "2024-01-09", 4.0), ("a", "2024-01-20", None)]
    df = spark.createDataFrame(rows, "e string, d string, v double").withColumn("d", F.to_date("d"))
    got = {str(r.d): r.day_effect for r in A.two_way_effects(df, "e", "d", "v").collect()}
    assert got["2024-01-20"] is None and got["2024-01-02"] - got["2024-01-01"] == pytest.approx(1.75)
    assert sum(v for v in got.values() if v is not None) == pytest.approx(0)
    assert A.two_way_effects(df.limit(0), "e", "d", "v").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_weighted_median(spark, seed):
    rng = np.random.default_rng(seed)
    v, w = np.round(rng.normal(0, 3, 700), 1), rng.random(700) * (rng.random(700) < 0.9)
    v[:200] = 0.5  # a value that holds much of the weight
    order = np.argsort(v, kind="stable")
    sums = np.cumsum(w[order])
    want = v[order][np.searchsorted(sums, sums[-1] / 2 * (1 - 1e-12))]
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": w}))
    assert weighted_median(df, "v", "w").first()[0] == want
    assert weighted_median(df.limit(0), "v", "w").first()[0] is None


@pytest.fixture(scope="module")
def blends(spark):
    rng = np.random.default_rng(11)
    y = rng.gamma(2, 30, 400)
    pdf = pd.DataFrame({"y": y, "a": y + rng.normal(0, 12, 400), "b": y * 0.8 + rng.normal(0, 9, 400), "c": y + rng.laplace(3, 20, 400), "f": np.arange(400) % 4})
    pdf.loc[:20, "b"] = pdf.loc[:20, "a"]  # rows on which the two agree
    return pdf, spark.createDataFrame(pdf).cache()


def test_best_step_is_the_least_error_of_the_line(blends):
    pdf, df = blends
    t, error = BL.best_step(df, F.col("a"), F.col("b"), "y")
    grid = np.linspace(0, 1, 5001)
    errors = np.abs(pdf["y"].to_numpy()[None] - (pdf["a"].to_numpy() + grid[:, None] * (pdf["b"] - pdf["a"]).to_numpy())).mean(1)
    assert error <= errors.min() + 1e-12 and error == pytest.approx(errors.min(), rel=1e-5) and t == pytest.approx(grid[errors.argmin()], abs=0.02)
    assert BL.best_step(df, F.col("a"), F.col("a"), "y")[0] == 0.0  # nowhere to go


def test_line_search_beats_a_grid_of_weights(blends):
    pdf, df = blends
    w = BL.line_search_weights(df, ["a", "b", "c"], "y")
    assert sum(w.values()) == pytest.approx(1) and min(w.values()) >= 0

    def mae(x):
        return np.abs(pdf["y"] - sum(x[i] * pdf[m] for i, m in enumerate("abc"))).mean()

    grid = min(mae((i / 40, j / 40, 1 - (i + j) / 40)) for i in range(41) for j in range(41 - i))
    assert mae(list(w.values())) < grid * 1.002


def test_climb_on_absolute_errors_needs_no_python_worker(blends):
    """The same weights as trying every step, and no Arrow or pandas node in the plans."""
    pdf, df = blends
    got = BL.hill_climb_weights(df, ["a", "b", "c"], "y", "mae", 40, 0.05, "f", 0.5)

    def score(w):
        w = w / w.sum()
        e = np.abs(pdf["y"] - w[0] * pdf["a"] - w[1] * pdf["b"] - w[2] * pdf["c"]).groupby(pdf["f"]).mean()
        return e.mean() + 0.5 * e.std(ddof=0)

    w = np.eye(3)[min(range(3), key=lambda i: score(np.eye(3)[i]))]
    for _ in range(40):
        trials = [w + 0.05 * np.eye(3)[i] for i in range(3)]
        best = min(trials, key=score)
        if not score(best) < score(w):
            break
        w = best
    assert np.allclose([got[m] for m in "abc"], w / w.sum())
    assert "pyarrow" not in open(BL.__file__).read()


def offsets_by_hand(pdf, bins, n0):
    e = pdf["r"] - pdf.groupby("b")["r"].transform("mean")
    out = pd.Series(0.0, index=pdf.index)
    for b, own in pdf.groupby("b"):
        known = own["p"].dropna()
        edges = np.quantile(known, [i / bins for i in range(1, bins)]) if len(known) else np.zeros(0)
        place = np.where(pdf["p"].isna(), 0, (edges[None] <= pdf["p"].to_numpy()[:, None]).sum(1))
        others = pdf["b"].notna() & (pdf["b"] != b)
        table = {k: e[others & (place == k)].sum() / (e[others & (place == k)].count() + n0) for k in range(bins)}
        d = pd.Series([table[k] if (others & (place == k)).any() else 0.0 for k in place[own.index]], index=own.index)
        out[own.index] = d - d.mean()
    return out


@pytest.mark.parametrize("bins", [4, 40])
def test_bins_of_all_blocks_at_once(spark, bins):
    rng = np.random.default_rng(bins)
    n = 900
    pdf = pd.DataFrame({"id": np.arange(n), "b": rng.integers(0, 6, n), "p": np.round(rng.gamma(2, 10, n), 1), "r": rng.normal(0, 1, n)})
    pdf.loc[pdf["b"] == 0, "p"] = 5.0  # one value only
    rows = [(int(i), int(b), None if j % 50 == 0 else float(p), None if j % 40 == 0 else float(r)) for j, (i, b, p, r) in enumerate(pdf.itertuples(index=False))]
    pdf = pd.DataFrame(rows, columns=["id", "b", "p", "r"]).astype({"p": float, "r": float})
    df = spark.createDataFrame(rows, "id int, b int, p double, r double")
    got = PP.quantile_bin_offset(df, "b", "p", "r", "o", bins=bins, n0=20.0).orderBy("id").toPandas()
    assert len(got) == n and np.allclose(got["o"], offsets_by_hand(pdf, bins, 20.0), atol=1e-9)


def test_the_plan_does_not_grow_with_the_blocks(spark):
    def plan(blocks):
        df = spark.range(400).select((F.col("id") % blocks).alias("b"), F.rand(1).alias("p"), F.rand(2).alias("r"))
        return len(PP.quantile_bin_offset(df, "b", "p", "r", "o", bins=5)._jdf.queryExecution().analyzed().toString())

    assert abs(plan(3) - plan(60)) < 200


def test_every_distinct_text_is_classified_once(spark):
    rows = spark.range(3000).select(F.concat(F.lit("Firtina nedeniyle kesinti "), (F.col("id") % 7).cast("string")).alias("reason"))
    rows = rows.unionByName(spark.createDataFrame([(None,), ("",), ("AĞAÇ devrildi",), ("Agac devrildi",)], "reason string"))
    classified = TX.classified_texts(rows, "reason")
    assert classified.count() == 10  # the NULL is the empty one
    plan = TX.add_reason_features(rows, "reason")._jdf.queryExecution().optimizedPlan().toString()
    chain = plan.index("CASE WHEN (trim(")
    assert "Aggregate [_text" in plan[chain:]  # the keyword chain stands above the grouping of texts
    got = {(r.reason, r.reason_family) for r in TX.add_reason_features(rows, "reason").distinct().collect()}
    assert ("AĞAÇ devrildi", "AGAC") in got and (None, "DIGER") in got and len(got) == 11
    report = {r.reason_family: r.rows for r in TX.reason_family_report(rows, "reason").collect()}
    assert report == {"HAVA": 3000, "AGAC": 2, "DIGER": 2}
