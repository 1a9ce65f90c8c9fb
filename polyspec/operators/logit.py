"""Logistic regression by Newton steps that all models share.

Models (a specification, with a fold left out or a draw's weights) are rows of a state table: their columns, coefficients
and, once they stop, likelihood and information matrix. A step adds up the score and the information of every open model
over the rows, by partial sums of row slices, and solves for the next coefficients where those sums meet their state; what
has converged stays behind in its step's table. Blocks of models meet slices of rows by shuffle; where one block holds all
open models, they travel to the rows instead, which then stay where they are. The driver knows how many models are open.

Weights of a draw are Poisson numbers of a counter-based hash, so any task can make them again. Without draws, rows that are
equal in all that models read count as one row, as often as they occur (``equal_rows``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyspec.functions.stats import imv, norm_sf
from polyspec.operators.moments import add_up, mixed, poisson_of
from polyspec.plans.scratch import Scratch

MAX_STEPS, TOLERANCE = 35, 1e-8
#: Models of a block, rows of a slice, and models multiplied at once: bound what a task holds.
BLOCK, SLICE, AT_ONCE = 1024, 1 << 14, 128
STATE = "model long, spec_id long, cols array<int>, intercept boolean, leave int, draw int, need long, need_at int, rate double, salt long, beta array<double>, done boolean, steps int, ll double, n double, n_pos double, info array<double>"
NAMES = [c.split()[0] for c in STATE.split(", ")]


def model_frame(specs: DataFrame, needs: dict[int, float], full: bool = False, kfold: int = 0, draws: int = 0, intercept: bool = False, apart: bool = False) -> DataFrame:
    """Open states of each specification (spec_id, need, cols, and bare, the columns beside the intercept of draws): of the
    full fit, of each fold left out, of each draw. needs: the rate of draws by need."""
    spark = specs.sparkSession
    order = {n: i for i, n in enumerate(needs)}
    known = spark.createDataFrame([(n, order[n], float(rate)) for n, rate in needs.items()], "need long, need_at int, rate double")
    n = full + kfold + draws
    of = spark.range(n).select(F.col("id").cast("int").alias("i"))
    m = specs.join(F.broadcast(known), "need").crossJoin(of)  # the models asked for
    leave, draw = F.col("i") - int(full), F.col("i") - int(full) - kfold
    drawn = draw >= 0
    cols = F.when(drawn, F.col("bare")).otherwise(F.col("cols")) if "bare" in specs.columns else F.col("cols")
    m = m.withColumns({"cols": cols, "intercept": drawn | F.lit(intercept)})
    return m.select(
        (F.col("spec_id") * n + F.col("i")).alias("model"), "spec_id", "cols", "intercept",
        F.when((leave >= 0) & ~drawn, leave).otherwise(-1).alias("leave"), F.when(drawn, draw).otherwise(-1).alias("draw"),
        "need", "need_at", "rate", (F.col("spec_id") + 1 if apart else F.lit(0)).cast("long").alias("salt"),
        F.transform(F.sequence(F.lit(1), F.size("cols") + F.col("intercept").cast("int")), lambda _: F.lit(0.0)).alias("beta"),
        F.lit(False).alias("done"), F.lit(0).alias("steps"), *[F.lit(None).cast("double").alias(c) for c in ("ll", "n", "n_pos")], F.lit(None).cast("array<double>").alias("info"),
    )


class Rows:
    """Rows of a batch as arrays."""

    def __init__(self, pdf: pd.DataFrame, y: str, columns: list[str]):
        self.v = np.nan_to_num(pdf[columns].to_numpy(float, na_value=np.nan).reshape(len(pdf), len(columns)))
        self.y = np.nan_to_num(pdf[y].to_numpy(float, na_value=np.nan))
        self.unit, self.pattern = pdf["unit"].to_numpy(np.int64), pdf["__pattern"].to_numpy(np.int64)
        self.folds = np.concatenate(pdf["folds"].to_list()).reshape(len(pdf), -1) if "folds" in pdf else None
        self.times = pdf["__times"].to_numpy(float) if "__times" in pdf else np.ones(len(pdf))


def equal_rows(rows: DataFrame, columns: list[str], times: str | None = None) -> DataFrame:
    """``rows`` with those alike in columns (and pattern and folds, if known) as one, and how often each occurs (a row counts
    ``times`` if given); of no use to draws."""
    keys = [c for c in ("__pattern", "folds") if c in rows.columns]
    unit = [F.min("unit").alias("unit")] if "unit" in rows.columns else []
    n = F.sum(f"`{times}`") if times else F.count("*")
    return rows.groupBy(*keys, *[f"`{c}`" for c in columns]).agg(*unit, n.cast("double").alias("__times"))


def grouped(models: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Models of one specification and kind, so many at once."""
    for _, part in models.groupby([models["spec_id"], models["draw"] >= 0, models["leave"] >= 0], sort=False):
        for s in range(0, len(part), AT_ONCE):
            yield part.iloc[s : s + AT_ONCE]


def design(rows: Rows, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Complete rows of a specification: regressors, outcome, and which they are."""
    one = part.iloc[0]
    ok = (rows.pattern & one["need"]) == 0
    x = rows.v[:, list(one["cols"])][ok]
    return (np.c_[x, np.ones(len(x))] if one["intercept"] else x), rows.y[ok], ok


def step_sums(rows: Rows, models: pd.DataFrame, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of models, and for each: likelihood, weight, weight of 1s, score, and upper triangle of the information."""
    for part in grouped(models):
        x, y, ok = design(rows, part)
        if not len(x):
            continue
        beta = np.stack(part["beta"].to_numpy())
        w = np.repeat(rows.times[ok][:, None], len(part), axis=1)
        draw, leave = part["draw"].to_numpy(), part["leave"].to_numpy()
        if draw[0] >= 0:
            w = poisson_of(mixed(seed, rows.unit[ok], draw, int(part["salt"].iloc[0])), float(part["rate"].iloc[0]))
        if leave[0] >= 0:
            w = w * (rows.folds[ok][:, int(part["need_at"].iloc[0])][:, None] != leave[None, :])
        eta = x @ beta.T
        p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        ll = (w * (y[:, None] * eta - np.logaddexp(0, eta))).sum(0)
        i, j = np.triu_indices(x.shape[1])
        score, info = (w * (y[:, None] - p)).T @ x, (w * p * (1 - p)).T @ (x[:, i] * x[:, j])
        yield part["model"].to_numpy(np.int64), np.c_[ll, w.sum(0), y @ w, score, info]


def square(info: np.ndarray, k: int) -> np.ndarray:
    i, j = np.triu_indices(k)
    out = np.zeros((len(info), k, k))
    out[:, i, j] = out[:, j, i] = info
    return out


def solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """States after a step, of states with their sums ``v`` (padded)."""
    out = []
    for k, part in pdf.groupby(pdf["beta"].map(len)):
        part = part.copy()
        v, beta = np.stack(part["v"].to_numpy())[:, : 3 + k + k * (k + 1) // 2], np.stack(part["beta"].to_numpy())
        move = np.einsum("bij,bj->bi", np.linalg.pinv(square(v[:, 3 + k :], k), rcond=1e-12, hermitian=True), v[:, 3 : 3 + k])
        done = np.abs(move).max(1, initial=0) < TOLERANCE * np.maximum(1.0, np.abs(beta).max(1, initial=0))
        part["beta"] = list(np.where(done[:, None], beta, beta + np.clip(move, -20, 20)))
        part["done"], part["steps"] = done, part["steps"] + 1
        part["ll"], part["n"], part["n_pos"] = v[:, 0], v[:, 1], v[:, 2]
        part["info"] = list(v[:, 3 + k :])
        out.append(part[NAMES])
    return pd.concat(out) if out else pdf.assign(**{c: [] for c in NAMES if c not in pdf})[NAMES]


def padded(v: np.ndarray, length: int) -> np.ndarray:
    return np.pad(v, ((0, 0), (0, length - v.shape[1])))


def near(rows: DataFrame, y: str, columns: list[str], own: pd.DataFrame, length: int, seed: int) -> DataFrame:
    """model, gram: partial sums of one block of models, which travels to the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for s in range(0, len(pdf), SLICE):
                for m, v in step_sums(Rows(pdf.iloc[s : s + SLICE], y, columns), own, seed):
                    for a, row in zip(m.tolist(), padded(v, length), strict=True):
                        total[a] = total[a] + row if a in total else row
        if total:
            yield pd.DataFrame({"model": list(total), "gram": list(total.values())})

    return rows.mapInPandas(run, "model long, gram array<double>")


def one_block(rows: DataFrame, y: str, columns: list[str], own: pd.DataFrame, length: int, seed: int) -> DataFrame:
    """States of at most a block of models, few enough for the driver to hold them between steps."""
    stopped = []
    for _ in range(MAX_STEPS):
        if not len(own):
            break
        sums = add_up(near(rows, y, columns, own, length, seed), ["model"], length).withColumnRenamed("gram", "v").toPandas()
        own = solve(own.merge(sums, on="model"))
        stopped.append(own[own["done"]])
        own = own[~own["done"]]
    out = pd.concat([*stopped, own])
    for c in ("cols", "beta", "info"):
        out[c] = [None if v is None else np.asarray(v).tolist() for v in out[c]]
    return Scratch(rows.sparkSession).write(rows.sparkSession.createDataFrame([tuple(r) for r in out[NAMES].astype(object).itertuples(index=False)], STATE), "fitted")


def newton(rows: DataFrame, y: str, columns: list[str], models: DataFrame, width: int, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """States of all models when they stop. rows: unit, __pattern, y, columns, and folds (an array by need) where models leave
    one out, and __times where rows stand for several; a written table. ``width``: coefficients of the largest model."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    length = 3 + width + width * (width + 1) // 2
    used = [c for c in rows.columns if c in {"unit", "__pattern", "folds", "__times", y, *columns}]
    rows = rows.select(*[f"`{c}`" for c in used])
    few = models.limit(block + 1).toPandas()
    if len(few) <= block:
        return one_block(rows, y, columns, few, length, seed)
    state = scratch.write(models.repartition(spark.sparkContext.defaultParallelism, "model"), "states")
    n_rows, stopped = rows.count(), []
    slices = max(1, -(-n_rows // SLICE))

    def meet(given: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        got = list(step_sums(Rows(given, y, columns), own, seed)) if len(given) and len(own) else []
        return pd.DataFrame({"model": np.concatenate([m for m, _ in got]) if got else [], "gram": [r for _, v in got for r in padded(v, length)]})

    for step in range(MAX_STEPS):
        open_ = state.where("NOT done")
        ids = [r[0] for r in open_.select((F.col("model") / block).cast("long").alias("b")).distinct().collect()]  # a row per block
        if not ids:
            break
        if len(ids) == 1:
            own = open_.toPandas()  # a block at most
            parts = near(rows, y, columns, own, length, seed)
        else:
            tasks = int(np.clip(slices * len(ids), spark.sparkContext.defaultParallelism, 10_000))
            left = rows.withColumn("slice", F.pmod("unit", F.lit(slices))).withColumn("block", F.explode(F.array(*[F.lit(b).cast("long") for b in ids])))
            right = open_.withColumn("block", (F.col("model") / block).cast("long")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
            parts = left.repartition(tasks, "block", "slice").groupBy("block", "slice").cogroup(right.repartition(tasks, "block", "slice").groupBy("block", "slice")).applyInPandas(meet, "model long, gram array<double>")
        sums = add_up(parts, ["model"], length).withColumnRenamed("gram", "v")
        following = scratch.write(open_.join(sums, "model").mapInPandas(lambda it: (solve(p) for p in it if len(p)), STATE), "states")
        stopped.append(following.where("done"))
        state = following
    stopped.append(state.where("NOT done"))
    out = stopped[0]
    for s in stopped[1:]:
        out = out.unionByName(s)
    fitted = Scratch(spark).write(out, "fitted")
    scratch.drop()
    return fitted


def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
    """Coefficients, Wald p values, McFadden R2 and information criteria of states; the null model is an intercept."""
    out = []
    for k, part in pdf.groupby(pdf["beta"].map(len)):
        beta = np.stack(part["beta"].to_numpy())
        inverse = np.linalg.pinv(square(np.stack(part["info"].to_numpy()), k), hermitian=True)
        se = np.sqrt(np.clip(np.einsum("bii->bi", inverse), 0, None))
        ll, n, pos = (part[c].to_numpy(float) for c in ("ll", "n", "n_pos"))
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.where(se > 0, beta / se, np.nan)
            p = np.where(np.isfinite(z), 2 * norm_sf(np.abs(np.nan_to_num(z))), np.nan)
            share = pos / n
            null = np.where((share > 0) & (share < 1), pos * np.log(share) + (n - pos) * np.log1p(-share), 0.0)
            r2 = np.where(null != 0, 1 - ll / null, np.nan)
            gain = {"ll_gain": ll - null, "ll_gain_per_obs": (ll - null) / n}
            ic = {"aic": 2 * k - 2 * ll, "bic": k * np.log(n) - 2 * ll, "hqic": 2 * k * np.log(np.log(n)) - 2 * ll}
        out.append(pd.DataFrame({"spec_id": part["spec_id"].to_numpy(), "draw": part["draw"].to_numpy(), "b": list(beta), "se": list(se), "p": list(p), "nobs": np.rint(n).astype(np.int64), "ncoef": k, "r2": r2, "ll_raw": ll, "ll_null": null, **gain, **ic, "converged": part["done"].to_numpy()}))
    return pd.concat(out) if out else pd.DataFrame()


SUMMARY = "spec_id long, draw int, b array<double>, se array<double>, p array<double>, nobs long, ncoef int, r2 double, ll_raw double, ll_null double, ll_gain double, ll_gain_per_obs double, aic double, bic double, hqic double, converged boolean"


def summaries(fitted: DataFrame) -> DataFrame:
    return fitted.mapInPandas(lambda it: (summarise(p) for p in it if len(p)), SUMMARY)


SCORES = ("n", "pos", "sse", "null_sse", "ll", "null_ll", "ll4")


def fold_metrics(rows: DataFrame, y: str, columns: list[str], fitted: DataFrame, metric: str, block: int = BLOCK) -> DataFrame:
    """spec_id, fold, metric of models that left a fold out, on that fold: rows meet blocks of models as in a step."""
    spark = rows.sparkSession
    n_rows = rows.count()
    slices = max(1, -(-n_rows // SLICE))
    schema = "spec_id long, fold int, " + ", ".join(f"{c} double" for c in SCORES)

    def meet(given: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        data = Rows(given, y, columns) if len(given) and len(own) else None
        for part in grouped(own) if data else ():
            x, t, ok = design(data, part)
            fold = data.folds[ok][:, int(part["need_at"].iloc[0])]
            for r in part.itertuples():
                here = fold == r.leave
                if not here.any():
                    continue
                e, s, share, times = x[here] @ np.asarray(r.beta), t[here], r.n_pos / r.n, data.times[ok][here]
                p = 1 / (1 + np.exp(-np.clip(e, -700, 700)))
                loglik = lambda q, c: times @ (s * np.log(np.clip(q, c, 1 - c)) + (1 - s) * np.log(np.clip(1 - q, c, 1 - c)))  # noqa: B023, E731
                out.append((r.spec_id, r.leave, times.sum(), times @ s, times @ (s - p) ** 2, times @ (s - share) ** 2, loglik(p, 1e-15), loglik(np.full(len(s), share), 1e-15), loglik(p, 1e-4)))
        return pd.DataFrame(out, columns=["spec_id", "fold", *SCORES])

    ids = [r[0] for r in fitted.select((F.col("model") / block).cast("long").alias("b")).distinct().collect()]
    tasks = int(np.clip(slices * len(ids), spark.sparkContext.defaultParallelism, 10_000))
    used = rows.select(*[f"`{c}`" for c in rows.columns if c in {"unit", "__pattern", "folds", "__times", y, *columns}])
    if len(ids) == 1:
        own = fitted.toPandas()  # a block at most
        parts = used.mapInPandas(lambda it: (meet(pdf, own) for pdf in it if len(pdf)), schema)
    else:
        left = used.withColumn("slice", F.pmod("unit", F.lit(slices))).withColumn("block", F.explode(F.array(*[F.lit(b).cast("long") for b in ids])))
        right = fitted.withColumn("block", (F.col("model") / block).cast("long")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
        parts = left.repartition(tasks, "block", "slice").groupBy("block", "slice").cogroup(right.repartition(tasks, "block", "slice").groupBy("block", "slice")).applyInPandas(meet, schema)
    sums = parts.groupBy("spec_id", "fold").agg(*[F.sum(c).alias(c) for c in SCORES])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"spec_id": pdf["spec_id"], "fold": pdf["fold"], "metric": [score_of(r, metric) for r in pdf.itertuples()]})

    return sums.mapInPandas(score, "spec_id long, fold int, metric double")


def score_of(r, metric: str) -> float:
    if metric == "rmse":
        return float(np.sqrt(r.sse / r.n))
    if metric == "pseudo-r2":
        return 1 - r.sse / r.null_sse if r.null_sse else np.nan
    if metric == "mcfaddens-r2":
        return 1 - r.ll / r.null_ll if r.null_ll else np.nan
    if metric == "cross-entropy":
        return -r.ll / r.n
    q = float(np.clip(r.pos / r.n, 1e-4, 1 - 1e-4))
    return imv(r.ll4 / r.n, (r.pos * np.log(q) + (r.n - r.pos) * np.log(1 - q)) / r.n)


def fit_one(rows: DataFrame, y: str, x: list[str], intercept: bool = False) -> dict:
    """One model over complete rows."""
    data = rows.select(F.monotonically_increasing_id().alias("unit"), F.lit(0).cast("long").alias("__pattern"), y, *x)
    spec = rows.sparkSession.createDataFrame([(0, 0, list(range(len(x))))], "spec_id long, need long, cols array<int>")
    data = Scratch(rows.sparkSession).write(data, "logit")
    fitted = newton(data, y, x, model_frame(spec, {0: 1.0}, True, intercept=intercept), len(x) + intercept)
    return summaries(fitted).first().asDict()
