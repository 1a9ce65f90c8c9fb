import numpy as np
import pytest

from polyspec.functions import stats
from polyspec.operators import inference, moments, ols
from polyspec.plans import space


def direct(x, y):
    """Least squares by QR, with plain formulas."""
    n, k = x.shape
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / (n - k))
    ll = -n / 2 * (np.log(2 * np.pi) + np.log(e @ e / n) + 1)
    return b, se, ll, 1 - e.var() / y.var()


def gram_of(v):
    w = np.c_[v, np.ones(len(v))]
    return w.T @ w


@pytest.fixture
def sample():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    return x, x @ [1.0, -0.5, 0.2] + rng.normal(size=200) + 3


def test_gram_fit_equals_direct_fit(sample):
    x, y = sample
    g = gram_of(np.c_[y, x])[None]
    r = ols.fit(g, [1, 2, 3, 4], 0)
    b, se, ll, r2 = direct(np.c_[x, np.ones(len(x))], y)
    assert np.allclose(r["b"][0], b) and np.allclose(r["se"][0], se) and np.isclose(r["ll"][0], ll)
    assert np.isclose(r["r2"][0], 1 - (1 - r2) * 199 / 196)
    assert np.isclose(r["aic"][0], 8 - 2 * ll) and np.isclose(r["bic"][0], 4 * np.log(200) - 2 * ll) and np.isclose(r["hqic"][0], 8 * np.log(np.log(200)) - 2 * ll)


def test_null_outcome_by_algebra(sample):
    x, y = sample
    g = gram_of(np.c_[y, x])[None]
    r = ols.fit(g, [1, 2, 4], 0, full=False, y_star=(1, 0.7))
    b, se, *_ = direct(np.c_[x[:, :2], np.ones(len(x))], y - 0.7 * x[:, 0])
    assert np.allclose(r["b"][0], b) and np.allclose(r["se"][0], se)


def test_likelihood_gain_is_free_of_scale(sample):
    x, y = sample
    one, ten = (ols.fit(gram_of(np.c_[k * y, x])[None], [1, 4], 0) for k in (1, 10))
    assert np.isclose(one["ll_gain"][0], ten["ll_gain"][0]) and not np.isclose(one["ll"][0], ten["ll"][0])


def test_singular_columns_survive():
    rng = np.random.default_rng(1)
    y = rng.normal(size=50)
    g = gram_of(np.c_[y, np.ones(50), np.ones(50)])
    r = ols.fit(g[None], [1, 2], 0)
    assert r["singular"][0] and np.isfinite(r["b"]).all() and np.isclose(r["b"][0].sum(), y.mean())
    assert ols.collinear_pairs(gram_of(np.c_[y, 2 * y + 1, rng.normal(size=50)]), [0, 1, 3], ["a", "b", "1"]) == [("b", "a")]


def test_repeating_rows_leaves_coefficients(sample):
    x, y = sample
    g = gram_of(np.c_[y, x])
    assert np.allclose(ols.fit(g[None], [1, 2, 4], 0)["b"], ols.fit(2 * g[None], [1, 2, 4], 0)["b"])


def test_folds_add_up_and_match_predictions(sample):
    x, y = sample
    v = np.c_[y, x]
    folds = np.stack([gram_of(v[i::4]) for i in range(4)])
    assert np.allclose(folds.sum(0), gram_of(v))
    for metric in ("rmse", "pseudo-r2"):
        got = ols.fold_metric(folds.sum(0), folds, [1, 2, 3, 4], 0, metric)
        for i in range(4):
            test = np.arange(200) % 4 == i
            design = np.c_[x, np.ones(200)]
            b = np.linalg.lstsq(design[~test], y[~test], rcond=None)[0]
            sse = np.sum((y[test] - design[test] @ b) ** 2)
            want = np.sqrt(sse / test.sum()) if metric == "rmse" else 1 - sse / np.sum((y[test] - y[~test].mean()) ** 2)
            assert np.isclose(got[i], want)


def test_tails():
    assert np.allclose(stats.t_two_sided([0, 1, 2.0, -2.0], [5, 1, 10, 10]), [1, 0.5, 0.07338803, 0.07338803])
    assert np.isclose(stats.t_two_sided(1.959964, 1e7), 0.05, atol=1e-6)
    assert np.isnan(stats.t_two_sided(np.nan, 5)) and np.isnan(stats.t_two_sided(1.0, 0))
    assert np.isclose(stats.norm_sf(1.959964), 0.025, atol=1e-7) and np.isclose(stats.norm_isf(0.025), 1.959964, atol=1e-5)
    assert 37 < stats.norm_isf(1e-300) < 37.1


def test_small_statistics():
    assert stats.nearest_quantile(np.arange(11.0), 0.25) == 2 and stats.nearest_quantile(np.arange(11.0), 0.35) == 4
    assert stats.empirical_p(np.array([1.0, 2, 3]), 10) == 0.5 and np.isnan(stats.empirical_p(np.array([]), 1))
    w = stats.certainty(-0.5)
    assert np.isclose(w * np.log(w) + (1 - w) * np.log(1 - w), -0.5)
    assert stats.imv(-0.3, -0.6) > 0 > stats.imv(-0.69, -0.5)
    x = np.arange(20.0)
    assert np.allclose(stats.lowess(x, 2 * x + 1, 0.5), 2 * x + 1)
    grid = np.linspace(-6, 6, 400)
    assert np.isclose(stats.kde(np.random.default_rng(0).normal(size=300), grid).sum() * (grid[1] - grid[0]), 1, atol=0.01)


def test_specification_space():
    s = space.all_subsets(["a", "b", "c"])
    assert s[0] == () and s[-1] == ("a", "b", "c") and len(s) == space.space_size([1, 2, 3]) and s[4] == ("a", "b")
    assert space.from_mask(space.bitmask(("a", "c"), ["a", "b", "c"]), ["a", "b", "c"]) == ("a", "c")
    z, y = space.sample_z_masks(5, 10, 1), space.sample_y_masks(3, 100, 1)
    assert len(set(z)) == 10 and z == space.sample_z_masks(5, 10, 1) and sorted(y) == list(range(1, 8))
    assert len(set(space.sample_z_masks(40, 50, 1))) == 50
    assert space.selection_keys([["a"], []]) == [frozenset("a"), frozenset()]
    for bad in ("a", ["a"], [[1]]):
        with pytest.raises(ValueError):
            space.selection_keys(bad)


def test_stouffer_with_null_draws():
    p = [0.01, 0.02, 0.03]
    z, combined = inference.stouffer_method(p)
    assert combined < max(p) and z > 0
    null_p = np.array([[0.5, 0.4, 0.3, 0.6, 0.7], [0.45, 0.5, 0.35, 0.65, 0.6], [0.55, 0.3, 0.4, 0.5, 0.8]])
    null_b = np.array([[1, -1, 1, -1, 1]] * 3)
    z, combined = inference.stouffer_method(p, betas=[1, 1, 1], p_values_ystar=null_p, betas_ystar=null_b)
    assert np.isclose(combined, 1 / 6)
    assert np.isclose(inference.stouffer_method(p, betas=[1, 1, 1], p_values_ystar=null_p.T, betas_ystar=null_b.T)[1], 1 / 6)
    assert np.isnan(inference.stouffer_method([np.nan], warn=False)[1])
    with pytest.raises(ValueError):
        inference.stouffer_method([0.1, np.nan], na_action="raise")
    with pytest.raises(ValueError):
        inference.stouffer_method([0.1, 0.2], weights=[0, 0])


def test_poisson_weights_are_reproducible():
    u = moments.uniform(3, np.arange(4000), np.arange(20))
    w = moments.poisson(u, 1.0)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and (w == moments.poisson(moments.uniform(3, np.arange(4000), np.arange(20)), 1.0)).all()
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06
