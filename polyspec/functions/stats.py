"""Numerical kernels over numpy arrays: distribution tails, ranks, density and smoothing."""

from __future__ import annotations

from math import erfc, lgamma
from statistics import NormalDist

import numpy as np

_erfc = np.vectorize(erfc, otypes=[float])
_isf = np.vectorize(lambda p: -NormalDist().inv_cdf(p), otypes=[float])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive arguments: Stirling's series beyond 30, where its error is below 1e-16 of the value."""
    shape = np.shape(x)
    x = np.ravel(x)
    big = x > 30
    y = np.where(big, x, 31.0)
    out = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    small = ~big
    if small.any():
        values, where = np.unique(x[small], return_inverse=True)
        out[small] = np.array([lgamma(v) for v in values])[where]
    return out.reshape(shape)


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 400) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), for x < (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            d = 1 / d
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-13):
            break
    return h


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0, 1)
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        part = np.where(y <= 0, 0.0, front * beta_fraction(p, q, y))
    return np.where(swap, 1 - part, part)


def t_two_sided(t, df) -> np.ndarray:
    """Two-sided tail of Student's t; NaN where t isn't finite or df isn't positive."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    ok = np.isfinite(t) & (df > 0)
    safe_t, safe_df = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    return np.where(ok, incomplete_beta(safe_df / 2, 0.5, safe_df / (safe_df + safe_t**2)), np.nan)


def norm_sf(x) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(x, float) / np.sqrt(2))


def norm_isf(p) -> np.ndarray:
    return _isf(np.asarray(p, float))


def signed_z(p, beta=None, floor: float = 1e-300) -> np.ndarray:
    """Signed z value of a two-sided p."""
    p = np.asarray(p, float)
    ok = np.isfinite(p)
    z = norm_isf(np.clip(np.where(ok, p, 1.0), floor, 1 - 1e-16) / 2)
    return np.where(ok, z if beta is None else np.sign(beta) * z, np.nan)


def nearest_quantile(x: np.ndarray, q: float) -> float:
    """Order statistic nearest to the quantile; a half goes to the even index."""
    x = np.sort(x[np.isfinite(x)])
    return float(x[int(np.rint((len(x) - 1) * q))]) if len(x) else np.nan


def empirical_p(null: np.ndarray, observed: float) -> float:
    """Two-sided Monte-Carlo p with the +1 correction; NaN without draws."""
    null = np.asarray(null, float)
    null = null[np.isfinite(null)]
    if not len(null) or not np.isfinite(observed):
        return np.nan
    up, down = ((np.sum(side) + 1) / (len(null) + 1) for side in (null >= observed, null <= observed))
    return float(min(1.0, 2 * min(up, down)))


def kde(x: np.ndarray, grid: np.ndarray, adjust: float = 1.0) -> np.ndarray:
    """Gaussian kernel density with Scott's bandwidth."""
    x = np.asarray(x, float)
    h = adjust * x.std(ddof=1) * len(x) ** -0.2 if len(x) > 1 else 0
    if not h:
        return np.zeros(len(grid))
    return np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).mean(1) / (h * np.sqrt(2 * np.pi))


def lowess(x: np.ndarray, y: np.ndarray, frac: float, at: np.ndarray | None = None, k: int | None = None) -> np.ndarray:
    """Locally weighted line through (x, y) at each x (or only at the places ``at`` of it), tricube weights, no robustness
    rounds. ``k``: neighbours of a point, if not a share of the given ones."""
    n = len(x)
    k = min(n, max(2, int(np.ceil(frac * n)))) if k is None else min(n, k)
    at = np.arange(n) if at is None else at
    out = np.empty(len(at))
    for o, i in enumerate(at):
        d = np.abs(x - x[i])
        h = np.partition(d, k - 1)[k - 1] or 1.0
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        mx, my = np.average(x, weights=w), np.average(y, weights=w)
        sxx = np.sum(w * (x - mx) ** 2)
        out[o] = my + (np.sum(w * (x - mx) * (y - my)) / sxx * (x[i] - mx) if sxx > 1e-300 else 0)
    return out


def certainty(mean_ll: float) -> float:
    """w in [0.5, 0.999] with w ln w + (1 - w) ln(1 - w) = mean_ll, by bisection."""
    lo, hi = 0.5, 0.999
    entropy = lambda w: w * np.log(w) + (1 - w) * np.log1p(-w)
    if mean_ll <= entropy(lo):
        return lo
    if mean_ll >= entropy(hi):
        return hi
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(mid) < mean_ll else (lo, mid)
    return (lo + hi) / 2


def imv(mean_ll: float, null_ll: float) -> float:
    """Gain in the certainty of a coin from the null's to the model's mean log-likelihood."""
    w, w0 = certainty(mean_ll), certainty(null_ll)
    return (w - w0) / w0


def psd_unit(r: np.ndarray, ridge: float = 1e-12) -> np.ndarray:
    """Correlation matrix with negative eigenvalues cut off, a unit diagonal and a small ridge."""
    values, vectors = np.linalg.eigh((r + r.T) / 2)
    out = (vectors * np.clip(values, 0, None)) @ vectors.T
    d = np.sqrt(np.clip(np.diag(out), 1e-300, None))
    out = out / d[:, None] / d[None, :]
    np.fill_diagonal(out, 1.0)
    return out + ridge * np.eye(len(out))
