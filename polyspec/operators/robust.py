"""Heteroskedasticity-robust (HC1) errors for a whole curve, from one scan.

The middle of a sandwich is the sum of e^2 x x', and e = y - x'b is linear in the columns, so e^2 is a weighted sum of the
products of pairs of columns. The sums of products of pairs with pairs (fourth moments) therefore give the middle of every
specification; coefficients and the outer parts come from the Gram matrix, which is among them (pairs with the 1 and 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from polyspec.functions.stats import t_two_sided
from polyspec.operators import lattice, moments, ols, patterns, prepare

SCHEMA = "spec_id long, y string, controls array<string>, predictors array<string>, b array<double>, se array<double>, p array<double>, nobs long, ncoef int"


def fourth_moments(rows: DataFrame, columns: list[str], needs: list[int], pattern: str = "__pattern") -> DataFrame:
    """need, gram: the upper triangle of sums of products of column pairs, over the complete rows of each need; one scan."""
    i, j = np.triu_indices(len(columns) + 1)
    a, b = np.triu_indices(len(i))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.c_[np.nan_to_num(pdf[columns].to_numpy(float, na_value=np.nan)), np.ones(len(pdf))]
            pairs, holes = v[:, i] * v[:, j], pdf[pattern].to_numpy(np.int64)
            for need in needs:
                own = pairs[(holes & need) == 0]
                total[need] = total.get(need, 0.0) + own.T @ own
        for need, m in total.items():
            yield pd.DataFrame({"need": [need], "gram": [m[a, b]]})

    parts = rows.select(*[f"`{c}`" for c in dict.fromkeys([pattern, *columns])]).mapInPandas(run, "need long, gram array<double>")
    return moments.add_up(parts, ["need"], len(a))


def hc1_curve(df: DataFrame, y: str, x: list[str], controls: list[str]) -> DataFrame:
    """The curve with HC1 errors and p values: every specification of x with a subset of the controls and an intercept, each
    over its own complete rows."""
    df, ys, x, controls = prepare.single_constant(prepare.doubles(df, [y, *x, *controls]), [y], list(x), list(controls))
    columns = [*ys, *x, *controls]
    rows = df.select(*[f"`{c}`" for c in columns])
    holes = patterns.holes_of(rows, columns)
    space = lattice.Space(columns, ys, x, controls, holes, None)
    moments4 = fourth_moments(rows.withColumn("__pattern", patterns.null_mask(holes)), columns, space.needs())
    _, x_at, z_at = space.places()
    p = len(columns)
    i, j = np.triu_indices(p + 1)
    at = np.zeros((p + 1, p + 1), int)
    at[i, j] = at[j, i] = np.arange(len(i))
    twice = np.where(i == j, 1.0, 2.0)

    def fit(sums: pd.DataFrame, specs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(sums) and len(specs):
            m = np.zeros((len(i), len(i)))
            a, b = np.triu_indices(len(i))
            m[a, b] = m[b, a] = np.asarray(sums["gram"].iloc[0])
            g = m[at, at[p, p]]  # pairs with the pair of 1 and 1
            masks, ids, _ = lattice.specification_rows(specs)
            for mask in masks.tolist():
                cols = [*x_at, *[c for n, c in enumerate(z_at) if mask >> n & 1]]
                inverse = ols.invert(g[None][:, cols][:, :, cols])[0][0]
                beta = inverse @ g[cols, 0]
                line = np.zeros(p + 1)
                line[0], line[cols] = 1.0, -beta
                middle = (twice * line[i] * line[j]) @ m[:, at[np.ix_(cols, cols)].ravel()]
                n, k = g[p, p], len(cols)
                se = np.sqrt(np.clip(np.diag(inverse @ middle.reshape(k, k) @ inverse), 0, None) * n / (n - k))
                t = np.where(se > 0, beta / np.where(se > 0, se, 1), np.nan)
                own = [c for n_, c in enumerate(space.controls) if mask >> n_ & 1]
                out.append((ids[mask], y, own, [*x, *own], beta.tolist(), se.tolist(), t_two_sided(t, n - k).tolist(), int(n), k))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    spark = df.sparkSession
    dealt = moments4.join(space.blocks(spark).select("need", "block"), "need")
    return dealt.groupBy("need", "block").cogroup(space.blocks(spark).groupBy("need", "block")).applyInPandas(fit, SCHEMA)
