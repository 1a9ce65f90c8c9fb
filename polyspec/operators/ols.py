"""Least squares from Gram matrices, in numpy batches."""

from __future__ import annotations

import numpy as np

from polyspec.functions.stats import t_two_sided


def invert(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses of a batch of symmetric matrices, by pseudo-inverse where rank is lacking; and where that was."""
    d = np.sqrt(np.clip(np.einsum("bii->bi", a), 1e-300, None))
    scaled = a / d[:, :, None] / d[:, None, :]
    values = np.linalg.eigvalsh(scaled) if a.shape[1] else np.ones((len(a), 1))
    singular = values[:, 0] <= 1e-13 * np.maximum(values[:, -1], 1e-300)
    out = np.empty_like(a)
    if (~singular).any():
        out[~singular] = np.linalg.inv(scaled[~singular])
    if singular.any():
        out[singular] = np.linalg.pinv(scaled[singular], rcond=1e-12, hermitian=True)
    return out / d[:, :, None] / d[:, None, :], singular


def information(ll: np.ndarray, n: np.ndarray, k: int) -> dict[str, np.ndarray]:
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"aic": 2 * k - 2 * ll, "bic": k * np.log(n) - 2 * ll, "hqic": 2 * k * np.log(np.log(n)) - 2 * ll}


def fit(g: np.ndarray, cols: list[int], y: int, full: bool = True, y_star: tuple[int, float] | None = None, p_of: int | None = None) -> dict[str, np.ndarray]:
    """Fits of v_y on the columns ``cols`` for a batch of Grams (b, p + 1, p + 1), whose last row belongs to the 1.

    y_star: (column, slope): fit y - slope * column instead, by algebra on the Gram alone.
    p_of: number of leading coefficients that need a p value (default: all).
    """
    one, k = g.shape[1] - 1, len(cols)
    a, c = g[:, cols][:, :, cols], g[:, cols, y]
    yy, sy, n, s = g[:, y, y], g[:, y, one], g[:, one, one], g[:, cols, one]
    if y_star:
        x, slope = y_star
        c = c - slope * g[:, cols, x]
        yy = yy - 2 * slope * g[:, y, x] + slope**2 * g[:, x, x]
        sy = sy - slope * g[:, x, one]
    inverse, singular = invert(a)
    b = np.einsum("bij,bj->bi", inverse, c)
    rss = np.clip(yy - 2 * np.einsum("bi,bi->b", b, c) + np.einsum("bi,bij,bj->b", b, a, b), 0, None)
    out = finish(b, np.einsum("bii->bi", inverse), rss, (sy - np.einsum("bi,bi->b", b, s)) / n, n, yy, sy, k, full)
    return out | {"p": t_two_sided(out["t"][:, :p_of], (n - k)[:, None]), "singular": singular}


def finish(b: np.ndarray, inverse: np.ndarray, rss: np.ndarray, mean_e: np.ndarray, n: np.ndarray, yy: np.ndarray, sy: np.ndarray, k: int, full: bool = True) -> dict[str, np.ndarray]:
    """Everything but p values of a batch of fits: b and the diagonal of the inverse (b, k), squared and mean error, rows, and
    squares and sum of the outcome (b)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        df = n - k
        se = np.sqrt(np.clip(inverse, 0, None) * (rss / df)[:, None])
        t = np.where(se == 0, np.nan, b / np.where(se == 0, 1, se))
        var_y = yy / n - (sy / n) ** 2
        r2 = 1 - (rss / n - mean_e**2) / var_y
        out = {"b": b, "se": se, "t": t, "n": n, "r2": 1 - (1 - r2) * (n - 1) / df, "r2_raw": r2}
        if full:
            tiny = np.finfo(float).tiny
            ll = lambda v: -n / 2 * (np.log(2 * np.pi) + np.log(np.maximum(v, tiny)) + 1)
            out |= {"ll": ll(rss / n), "ll_null": ll(var_y)}
            out |= {"ll_gain": out["ll"] - out["ll_null"], "ll_gain_per_obs": (out["ll"] - out["ll_null"]) / n}
            out |= information(out["ll"], n, k)
    return out


def fold_metric(total: np.ndarray, folds: np.ndarray, cols: list[int], y: int, metric: str) -> np.ndarray:
    """Out-of-sample metric of each fold: fitted to the other folds, scored on its own Gram."""
    train = total[None] - folds
    return score_folds(train, folds, fit(train, cols, y, full=False, p_of=0)["b"], cols, y, metric)


def score_folds(train: np.ndarray, folds: np.ndarray, b: np.ndarray, cols: list[int], y: int, metric: str) -> np.ndarray:
    """Metric of coefficients b (fold, k), which were fitted to the Grams ``train``, on the Grams ``folds``."""
    one = folds.shape[1] - 1
    n, yy, sy = folds[:, one, one], folds[:, y, y], folds[:, y, one]
    sse = yy - 2 * np.einsum("bi,bi->b", b, folds[:, cols, y]) + np.einsum("bi,bij,bj->b", b, folds[:, cols][:, :, cols], b)
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "rmse":
            return np.sqrt(np.clip(sse, 0, None) / n)
        mean = train[:, y, one] / train[:, one, one]
        return 1 - sse / (yy - 2 * mean * sy + n * mean**2)


def collinear_pairs(g: np.ndarray, cols: list[int], names: list[str], tolerance: float = 1e-10) -> list[tuple[str, str]]:
    """Pairs of columns of correlation 1 or -1, if the columns lack rank; else none."""
    _, singular = invert(g[None][:, cols][:, :, cols])
    if not singular[0]:
        return []
    one = g.shape[0] - 1
    n, s = g[one, one], g[cols, one]
    cov = g[np.ix_(cols, cols)] - np.outer(s, s) / n
    d = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = cov / np.outer(d, d)
    return [(names[i], names[j]) for i in range(len(cols)) for j in range(i) if np.isfinite(r[i, j]) and abs(abs(r[i, j]) - 1) < max(tolerance, 1e-10)]
