"""The public names in one place: estimators, results, and single-step functions over DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyspec.estimators import LRobust, MergedResult, OLSRobust, Result, concat_results
from polyspec.functions.stats import imv
from polyspec.operators import logit, moments, ols
from polyspec.operators.inference import join_sig_test, stouffer_method
from polyspec.operators.robust import hc1_curve
from polyspec.operators.prepare import group_demean, rescale
from polyspec.plans.space import all_subsets, reservoir_sample, sample_y_masks, sample_z_masks, space_size
from polyspec.plans.spec import MissingValueWarning
from polyspec.sources.readers import panel_recipe as prepare_asc
from polyspec.sources.readers import union_recipe as prepare_union

__all__ = [
    "LRobust", "MergedResult", "MissingValueWarning", "OLSRobust", "Result", "all_subsets", "calculate_imv_score", "concat_results",
    "group_demean", "hc1_curve", "join_sig_test", "logistic_regression_sm", "mcfadden_r2", "prepare_asc", "prepare_union", "pseudo_r2", "rescale",
    "reservoir_sample", "sample_y_masks", "sample_z_masks", "simple_ols", "space_size", "stouffer_method", "stripped_ols",
]

CLIP = 1e-15


def simple_ols(df: DataFrame, y: str, x: list[str]) -> dict:
    """Least squares of y on x as given (no constant is added), with p values, adjusted R2 and information criteria."""
    rows = df.na.drop(subset=[y, *x])
    g = np.array(moments.gram(rows, [y, *x]).first().gram, float)
    if not g.any():
        raise ValueError("no rows to fit")
    return {k: v[0] for k, v in ols.fit(moments.unpack(g, len(x) + 1)[None], [*range(1, len(x) + 1)], 0).items()}


def stripped_ols(df: DataFrame, y: str, x: list[str], add_const: bool = True) -> dict:
    """Coefficients, p values and adjusted R2; with ``add_const`` a 1 takes the place of any const."""
    names = [c for c in x if c != "const"] if add_const else x
    rows = df.na.drop(subset=[y, *names])
    g = np.array(moments.gram(rows, [y, *names]).first().gram, float)
    cols = [*range(1, len(names) + 1), *([len(names) + 1] if add_const else [])]
    r = ols.fit(moments.unpack(g, len(names) + 1)[None], cols, 0, full=False)
    return {k: r[k][0] for k in ("b", "p", "r2")}


def logistic_regression_sm(df: DataFrame, y: str, x: list[str], add_const: bool = False) -> dict:
    """Maximum likelihood with Wald p values, McFadden R2 and information criteria."""
    return logit.fit_one(df.na.drop(subset=[y, *x]), y, x, add_const)


def pseudo_r2(df: DataFrame, y: str, predicted: str, train_mean: float) -> float:
    """1 - squared error / squared error of the training mean."""
    r = df.agg(F.avg((F.col(y) - F.col(predicted)) ** 2), F.avg((F.col(y) - train_mean) ** 2)).first()
    if not r[1]:
        raise ValueError("the null model has no error")
    return 1 - r[0] / r[1]


def mean_log_likelihood(df: DataFrame, y: str, p, clip: float) -> float:
    q = F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip))
    return df.agg(F.avg(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).first()[0]


def mcfadden_r2(df: DataFrame, y: str, p: str, train_mean: float) -> float:
    """1 - log-likelihood / that of the training mean, probabilities clipped."""
    return 1 - mean_log_likelihood(df, y, F.col(p), CLIP) / mean_log_likelihood(df, y, F.lit(float(train_mean)), CLIP)


def calculate_imv_score(df: DataFrame, y: str, p: str) -> float:
    """Gain in certainty over the mean outcome."""
    share = df.agg(F.avg(y)).first()[0]
    return imv(mean_log_likelihood(df, y, F.col(p), 1e-4), mean_log_likelihood(df, y, F.lit(float(share)), 1e-4))
