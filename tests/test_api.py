import numpy as np
import pytest

from polyspec import api


def test_single_steps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = x @ [1, 2] + rng.normal(size=300)
    rows = [(float(a), float(b), float(c), 1.0, int(c > 0), float(1 / (1 + np.exp(-c)))) for (a, b), c in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, y double, const double, t int, p double")
    full = api.simple_ols(df, "y", ["a", "b", "const"])
    design = np.c_[x, np.ones(300)]
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.allclose(full["b"], want) and np.allclose(api.stripped_ols(df, "y", ["a", "const", "b"])["b"], want)
    assert np.isclose(full["aic"], 6 - 2 * full["ll"])
    one = api.logistic_regression_sm(df, "t", ["a", "b", "const"])
    two = api.logistic_regression_sm(df, "t", ["a", "b"], add_const=True)
    assert np.allclose(one["b"], two["b"], atol=1e-6) and one["converged"]
    assert 0 < api.mcfadden_r2(df, "t", "p", 0.5) < 1 and api.calculate_imv_score(df, "t", "p") > 0
    assert api.pseudo_r2(df, "t", "p", 0.5) > 0
    with pytest.raises(ValueError):
        api.simple_ols(df.limit(0), "y", ["a"])
    with pytest.raises(ValueError):
        api.pseudo_r2(df.where("t = 1"), "t", "p", 1.0)


def test_entry_points_agree():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70 and "ols_full_specs" in o
