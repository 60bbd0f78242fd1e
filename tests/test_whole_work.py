"""Registered queries do the work that their operators do by default."""

import inspect

import numpy as np
import pytest

import __spark_entry__ as entry
from panelforge.operators import blend as BL
from panelforge.operators import ml as ML
from panelforge.operators import postprocess as PP


class Called(Exception):
    pass


@pytest.mark.parametrize(
    ("query", "module", "operator", "names"),
    [
        ("hill_climb_mae_stable", BL, "hill_climb_weights", ["iterations", "step"]),
        ("nested_blend", BL, "nested_blend", ["iterations"]),
        ("quantile_bin_offset_40", PP, "quantile_bin_offset", ["bins"]),
        ("adversarial_validation", ML, "adversarial_validation", ["folds", "model"]),
        ("multi_seed_refit", ML, "multi_seed_refit", ["model"]),
        ("null_importance_filter", ML, "null_importance_filter", ["rounds", "model"]),
    ],
)
def test_defaults(spark, sf_dir, monkeypatch, query, module, operator, names):
    signature = inspect.signature(getattr(module, operator))

    def called(*args, **kwargs):
        given = signature.bind(*args, **kwargs).arguments
        raise Called([n for n in names if n in given and given[n] != signature.parameters[n].default])

    monkeypatch.setattr(module, operator, called)
    with pytest.raises(Called) as e:
        entry.queries()[query](spark, sf_dir)
    assert e.value.args[0] == []


def test_mae_climb_with_penalty_over_many_steps(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(10, 3, 400)
    x = np.stack([y + rng.normal(0, s, 400) for s in (1.0, 1.1, 2.0)])
    fold = [None if i % 4 == 0 else i % 4 for i in range(400)]
    rows = [(*map(float, x[:, i]), float(y[i]), fold[i]) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, fold int")
    groups = [np.array([f == g for f in fold]) for g in (None, 1, 2, 3)]

    def score(w):
        e = np.abs(y - (w / w.sum()) @ x)
        s = [e[g].mean() for g in groups]
        return np.mean(s) + 0.5 * np.std(s)

    start = np.eye(3)[np.argmin([score(w) for w in np.eye(3)])]
    w, now = start, score(start)
    steps = 0
    for steps in range(200):
        trials = [w + 0.01 * u for u in np.eye(3)]
        scores = [score(t) for t in trials]
        if not min(scores) < now:
            break
        w, now = trials[int(np.argmin(scores))], min(scores)
    assert steps > 12
    got = BL.hill_climb_weights(df, ["a", "b", "c"], "y", "mae", fold="fold", stability_penalty=0.5)
    assert [got[m] for m in "abc"] == pytest.approx(list(w / w.sum()), abs=1e-9)
