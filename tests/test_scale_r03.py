"""Steps that must not be computed again for every use of their rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import panelforge.functions.text as TX
import panelforge.operators.blend as BL
import panelforge.operators.postprocess as PP


def test_shrinking_twice_reads_its_rows_once(spark):
    rows = spark.range(60).select((F.col("id") % 7).alias("e"), F.sqrt("id").alias("r"), "id")
    rows = rows.withColumn("e", F.when(F.col("e") != 6, F.col("e")))
    done = PP.shrink_within(PP.shrink_between(rows, "e", "r", "b", 0.8), "e", "r", "w", 0.7)
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 1
    want = rows.toPandas()
    overall = want.r.mean()
    want = want.dropna(subset=["e"]).set_index("id").sort_index()
    mean = want.groupby("e").r.transform("mean")
    got = done.toPandas().set_index("id").sort_index()
    assert list(got.index) == list(want.index)
    np.testing.assert_allclose(got.b, overall + 0.8 * (mean - overall) + (want.r - mean))
    np.testing.assert_allclose(got.w, mean + 0.7 * (want.r - mean))


def test_families_are_counted_from_one_classification(spark):
    rows = spark.createDataFrame([("Kablo koptu",), ("KABLO",), ("hasar; trafo",), (None,), ("İS MAKİNESİ é",), ("_",)], "reason string")
    report = TX.reason_family_report(rows, "reason")
    assert "subquery" not in report._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.reason_family: (r.rows, r.fault, r.percent) for r in report.collect()}
    assert got == {"KABLO": (2, 1, 33.33), "UCUNCU_SAHIS": (2, 1, 33.33), "DIGER": (2, 1, 33.33)}


def test_every_keyword_has_its_first_family(spark):
    words = [w for *_, some in TX.REASON_FAMILIES for w in some]
    texts = ["", None, "  ", "3xsahis", "nothing", *[f" {w}" for w in words], *[f"x {b} {a}" for a, b in zip(words, words[1:])]] * 9

    def first(text):
        return next((code for _, code, _, some in TX.REASON_FAMILIES if any(w in (text or "") for w in some)), 0)

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = df.select("i", TX.reason_code(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [first(t) for t in texts]


def test_folds_share_the_passes_of_their_climbs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    y = rng.normal(50, 9, 900)
    x = np.stack([y + rng.normal(0, s, 900) for s in (3.0, 3.2, 5.0)])
    fold = np.arange(900) % 4
    rows = [(*map(float, x[:, i]), float(y[i]), int(fold[i])) for i in range(900)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 0)], "a double, b double, c double, y double, f int")
    passes = []
    before = BL.absolute_errors
    monkeypatch.setattr(BL, "absolute_errors", lambda *args: passes.append(len(args[-1])) or before(*args))
    got = {r["fold"]: r for r in BL.nested_blend(df, ["a", "b", "c"], "y", "f").collect()}
    assert sorted(got) == [1, 2, 3] and sum(r["rows"] for r in got.values()) == 675
    monkeypatch.undo()
    alone = 0
    for f, r in got.items():
        calls = []
        monkeypatch.setattr(BL, "absolute_errors", lambda *args, calls=calls: calls.append(1) or before(*args))
        w = BL.hill_climb_weights(df.filter(F.col("f") < f), ["a", "b", "c"], "y", "mae")
        monkeypatch.undo()
        alone += len(calls)
        mine = fold == f
        weights = np.array([w[m] for m in "abc"])
        np.testing.assert_allclose([r[f"weight_{m}"] for m in "abc"], weights)
        assert r["blend"] == pytest.approx(np.abs(y - weights @ x)[mine].mean())
    assert len(passes) < alone


def test_absolute_errors_by_fold(spark):
    rows = [(1.0, 2.0, 5.0, None), (2.0, 0.0, 1.0, "x"), (4.0, 4.0, 4.0, "x")]
    df = spark.createDataFrame(rows, "a double, b double, y double, f string")
    got = BL.absolute_errors(df, ["a", "b"], "y", "f", np.array([[1.0, 0.0], [0.5, 0.5]]))
    assert {f: (s.tolist(), n) for f, (s, n) in got.items()} == {None: ([4.0, 3.5], 1), "x": ([1.0, 0.0], 2)}
