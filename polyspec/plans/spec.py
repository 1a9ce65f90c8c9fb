"""Model specification: arguments, their defaults and their validation."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, field
from enum import Enum
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyspec.plans import space

MAX_SEED = 2**31 - 1
DEFAULTS = {"draws": 1000, "kfold": 10, "oos_metric": "pseudo-r2", "seed": 192735}


class Family(Enum):
    OLS = "OLS Robust"
    LOGIT = "Logistic Regression Robust"


METRICS = {Family.OLS: ("pseudo-r2", "rmse"), Family.LOGIT: ("pseudo-r2", "mcfaddens-r2", "rmse", "cross-entropy", "imv")}


class MissingValueWarning(UserWarning):
    """The input holds nulls; each specification drops the rows that lack its own columns."""


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def string_list(name: str, value, empty: bool = False) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        raise TypeError(f"{name} must be a list of column names")
    if not value and not empty:
        raise ValueError(f"{name} must not be empty")
    return value


def check_columns(data, y, x) -> None:
    """Checks at construction: types and existence of the columns."""
    string_list("y", y), string_list("x", x)
    if not isinstance(data, DataFrame):
        raise TypeError("data must be a DataFrame")
    if missing := [c for c in (*y, *x) if c not in data.columns]:
        raise ValueError(f"columns not in the data: {missing}")


def warn_missing(data: DataFrame, columns: list[str]) -> None:
    """One aggregate; warns if any of the columns has a null or NaN."""
    kinds = dict(data.dtypes)
    null = lambda c: F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") if kinds[c] in ("double", "float") else F.lit(False))
    if columns and not data.where(reduce(or_, [null(c) for c in columns])).isEmpty():
        warnings.warn("the data has missing values; specifications drop incomplete rows", MissingValueWarning, stacklevel=3)


@dataclass(frozen=True)
class ModelSpec:
    """What to fit, checked."""

    family: Family
    y: list[str]
    x: list[str]
    controls: list[str]
    group: str | None = None
    draws: int = DEFAULTS["draws"]
    kfold: int = DEFAULTS["kfold"]
    oos_metric: str = DEFAULTS["oos_metric"]
    seed: int = DEFAULTS["seed"]
    sample_size: int | None = None
    z_masks: list[int] | None = None
    y_masks: list[int] | None = None
    rng: str = "poisson"
    order_by: list[str] = field(default_factory=list)

    @property
    def multi_y(self) -> bool:
        return len(self.y) > 1

    def masks(self) -> list[int]:
        return self.z_masks if self.z_masks is not None else [space.bitmask(s, self.controls) for s in space.all_subsets(self.controls)]


def resolve(family: Family, data: DataFrame, n_rows: int, y: list[str], x: list[str], *, controls, group=None, draws=None, kfold=None, oos_metric=None, n_cpu=None, seed=None, composite_sample=None, z_specs_sample_size=None, sample_size=None, threshold=1_000_000, rng="poisson", order_by=None) -> ModelSpec:
    """Defaults for what is None, then every check of types, ranges and columns. draws=0 and kfold=0 skip the
    bootstrap and the cross-validation."""
    string_list("controls", controls, empty=True)
    draws = DEFAULTS["draws"] if draws is None else draws
    kfold = DEFAULTS["kfold"] if kfold is None else kfold
    seed = DEFAULTS["seed"] if seed is None else seed
    metric = {"mcfadden-r2": "mcfaddens-r2"}.get(oos_metric, oos_metric) or DEFAULTS["oos_metric"]
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    if missing := [c for c in controls if c not in data.columns]:
        raise ValueError(f"controls not in the data: {missing}")
    if group is not None:
        if not isinstance(group, str):
            raise TypeError("group must be a column name")
        if group not in data.columns:
            raise ValueError(f"group {group!r} not in the data")
    if not whole(kfold) or kfold and not 2 <= kfold <= n_rows - 1:
        raise ValueError("kfold must be an integer from 2 to the number of rows less 1")
    if not whole(draws) or draws < 0:
        raise ValueError("draws must be a positive integer")
    if metric not in METRICS[family]:
        raise ValueError(f"oos_metric must be one of {METRICS[family]}")
    if n_cpu is not None and (not whole(n_cpu) or not 1 <= n_cpu <= (os.cpu_count() or 1)):
        raise ValueError("n_cpu must be an integer from 1 to the number of CPUs")
    if not whole(seed) or not 0 <= seed <= MAX_SEED:
        raise ValueError(f"seed must be an integer from 0 to {MAX_SEED}")
    kinds = {f.name: f.dataType for f in data.schema.fields}
    if bad := [c for c in (*y, *x, *controls) if not is_numeric(kinds[c])]:
        raise ValueError(f"columns must be numeric: {bad}")
    if set(x) & set(controls):
        raise ValueError("x and controls must not overlap")
    if set(y) & {*x, *controls}:
        raise ValueError("y must not be among x or controls")
    for name, v in (("composite_sample", composite_sample), ("z_specs_sample_size", z_specs_sample_size), ("sample_size", sample_size)):
        if v is not None and (not whole(v) or v < 1):
            raise ValueError(f"{name} must be a positive integer")
    if family is Family.LOGIT and len(y) > 1:
        raise NotImplementedError("the logistic model takes one outcome")
    z_masks = space.sample_z_masks(len(controls), z_specs_sample_size, seed) if z_specs_sample_size else None
    y_masks = None
    if len(y) > 1:
        y_masks = space.sample_y_masks(len(y), composite_sample, seed) if composite_sample else [space.bitmask(s, y) for s in space.all_subsets(y)[1:]]
    if family is Family.OLS:
        runs = draws * (len(z_masks) if z_masks else 2 ** len(controls)) * len(y_masks or [0])
        if runs > threshold:
            warnings.warn(f"{runs} model runs are more than {threshold}", UserWarning, stacklevel=3)
    return ModelSpec(family, y, x, controls, group, draws, kfold, metric, seed, sample_size, z_masks, y_masks, rng, order_by or [])
