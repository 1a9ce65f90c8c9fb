"""Estimators over a specification space, and their results as DataFrames."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyspec.operators import groups, inference, lattice, logit, moments, ols, panels, patterns, prepare
from polyspec.plans import space, spec
from polyspec.plans.scratch import materialize
from polyspec.plans.spec import Family, ModelSpec

FULL_SCHEMA = (
    "spec_id long, y string, controls array<string>, predictors array<string>, b array<double>, se array<double>, p array<double>, nobs long, ncoef int, "
    "beta double, pval double, r2 double, ll_raw double, ll_null double, ll_gain double, ll_gain_per_obs double, aic double, bic double, hqic double, is_singular boolean, converged boolean"
)
#: Equal rows of a logistic model are joined if at most one in this many then stays.
SPARED = 2
BOOT_SCHEMA = "spec_id long, draw int, beta double, p double, r2 double, beta_null double, p_null double"


@dataclass
class Result:
    """Tables of a fitted curve: full (a row per specification), oos (specification, fold, metric), boot
    (specification, draw), and what follows from them."""

    model: ModelSpec
    full: DataFrame
    oos: DataFrame
    boot: DataFrame
    shap: DataFrame | None = None
    label: str = ""

    @property
    def controls(self) -> list[str]:
        return self.model.controls

    @cached_property
    def summary_df(self) -> DataFrame:
        """spec_id, median, max, min, ci_up, ci_down, r2, ll, aic, bic, hqic, ..., av_k_metric, spec_name, y."""
        ll = "ll_gain_per_obs" if self.model.family is Family.OLS else "ll_raw"
        f = self.full.select("spec_id", "beta", "pval", "r2", F.col(ll).alias("ll"), "aic", "bic", "hqic", "ll_raw", "ll_null", "ll_gain", "ll_gain_per_obs", "nobs", F.array_sort("controls").alias("spec_name"), "y")
        folds = self.oos.groupBy("spec_id").agg(F.avg("metric").alias("av_k_metric"))
        return f.join(inference.boot_summary(self.boot, draws=self.model.draws), "spec_id", "left").join(folds, "spec_id", "left")

    @cached_property
    def inference(self) -> DataFrame:
        return inference.curve_inference(self.full, self.boot, self.model.multi_y)

    @cached_property
    def stouffer_keep_mask(self) -> DataFrame:
        """spec_id, kept: whether the specification's null z enter the combined test."""
        return inference.keep_mask(self.boot).select("spec_id", "kept")

    @cached_property
    def correlation_matrix(self) -> DataFrame:
        """a, b, r: correlations of null z of the kept specifications."""
        return inference.null_correlation(self.boot)

    @cached_property
    def sigma_hat(self) -> DataFrame:
        """a, b, r: the matrix that weights the combined test: unit diagonal and a ridge of 1e-12."""
        return inference.null_correlation(self.boot, 1e-12)

    def compute_bma(self) -> DataFrame:
        return inference.bma(self.full, self.controls)

    def merge(self, other: Result, left_prefix: str, right_prefix: str) -> MergedResult:
        return MergedResult.of(self, left_prefix).merge(MergedResult.of(other, right_prefix))

    def plot_data(self, specs: list[list[str]] | None = None, ic: str = "aic", ci: float = 1, loess: bool = True, oddsratio: bool = False) -> dict[str, DataFrame]:
        """The table behind every panel of the curve's figure."""
        return panels.all_panels(self, specs, ic, ci, loess, oddsratio)

    plot = plot_data

    def summary(self, digits: int = 3) -> str:
        """Text report: the model, the curve, joint inference, and the best specifications by each criterion."""
        s = self.summary_df
        i = self.inference.first().asDict()
        show = lambda k: "n/a" if i.get(k) is None else f"{i[k]:.{digits}f}" if isinstance(i[k], float) else str(i[k])
        n = s.agg(F.count("*")).first()[0]
        best = s.agg(*[F.max_by("spec_name", k).alias(f"max_{k}") for k in ("r2", "ll", "av_k_metric")], *[F.min_by("spec_name", k).alias(f"min_{k}") for k in ("aic", "bic", "hqic", "av_k_metric")]).first().asDict()
        lines = [
            "1. Model Summary", f"Model: {self.model.family.value}", f"Inference tests: {'yes' if self.model.draws else 'no'}", f"Dependent variable: {', '.join(self.model.y)}",
            f"Independent variable: {self.model.x[0]}", f"Number of possible controls: {len(self.controls)}", f"Number of draws: {self.model.draws}",
            f"Number of folds: {self.model.kfold}", f"Number of specifications: {n}",
            "2. Model Robustness Metrics", "2.1 Inference metrics",
        ]
        names = ["median_ns", "median", "median_p", "min", "max", "pos_prop", "pos_p", "neg_prop", "neg_p", "sig_prop", "sig_p", "pos_sig_prop", "neg_sig_prop", "stouffer_z", "stouffer_p"]
        lines += [f"{k}: {show(k)}" for k in names]
        lines += ["2.2 In-sample metrics (full sample)"] + [f"{k}: {', '.join(best[k] or []) or 'none'}" for k in ("min_aic", "min_bic", "min_hqic", "max_ll", "max_r2")]
        lines += [f"2.3 Out-of-sample metrics ({self.model.oos_metric})"] + [f"{k}: {', '.join(best[k] or []) or 'none'}" for k in ("max_av_k_metric", "min_av_k_metric")]
        return "\n".join(lines)

    def save_to_csv(self, path: str) -> None:
        self.summary_df.withColumn("spec_name", F.array_join("spec_name", ", ")).orderBy("spec_id").write.mode("overwrite").option("header", True).csv(path)

    def save(self, path: str) -> None:
        """A Parquet table for each part, and the model as JSON."""
        for name in ("full", "oos", "boot", *(["shap"] if self.shap is not None else [])):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        m = self.model
        row = json.dumps({k: (v.name if isinstance(v, Family) else v) for k, v in m.__dict__.items()} | {"shap": self.shap is not None, "label": self.label})
        self.full.sparkSession.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Result:
        m = json.loads(spark.read.text(f"{path}/model").first().value)
        shap, label = m.pop("shap"), m.pop("label")
        m["family"] = Family[m["family"]]
        parts = [spark.read.parquet(f"{path}/{name}") for name in ("full", "oos", "boot")]
        return Result(ModelSpec(**m), *parts, spark.read.parquet(f"{path}/shap") if shap else None, label)


@dataclass
class MergedResult:
    """Curves of the same outcome under one roof, told apart by a tag in each specification's name."""

    y: list[str]
    full: DataFrame
    boot: DataFrame

    @classmethod
    def of(cls, r: Result, tag: str) -> MergedResult:
        if not isinstance(tag, str):
            raise TypeError("prefixes must be strings")
        name = F.array_sort(F.array_append("controls", F.lit(tag))).alias("spec_name")
        full = r.full.select(F.lit(tag).alias("tag"), "spec_id", name, "beta", "pval", "r2")
        return cls(r.model.y, full, r.boot.select(F.lit(tag).alias("tag"), *r.boot.columns))

    def merge(self, other: MergedResult | Result, left_prefix: str | None = None, right_prefix: str | None = None) -> MergedResult:
        other = MergedResult.of(other, right_prefix) if isinstance(other, Result) else other
        if not isinstance(other, MergedResult):
            raise TypeError("only results can be merged")
        if self.y != other.y:
            raise ValueError("results must have the same dependent variable")
        return MergedResult(self.y, self.full.unionByName(other.full), self.boot.unionByName(other.boot))

    @cached_property
    def summary_df(self) -> DataFrame:
        b = self.boot.where("beta IS NOT NULL").groupBy("tag", "spec_id")
        s = b.agg(F.median("beta").alias("median"), F.max("beta").alias("max"), F.min("beta").alias("min"), inference.nearest("beta", 0.975).alias("ci_up"), inference.nearest("beta", 0.025).alias("ci_down"))
        return self.full.join(s, ["tag", "spec_id"], "left")

    def summary(self, digits: int = 3) -> str:
        r = self.full.agg(F.count("*"), F.median("beta")).first()
        return f"Merged result\nDependent variable: {', '.join(self.y)}\nNumber of specifications: {r[0]}\nmedian_ns: {r[1]:.{digits}f}"

    def plot(self, specs=None, **_) -> None:
        if specs is not None:
            space.selection_keys(specs)
        warnings.warn("a merged result has no figure", UserWarning, stacklevel=2)


def concat_results(results: list[Result], de_dupe: bool = True) -> Result:
    """All specifications under new ids; with ``de_dupe`` the first of equal (y, x, controls) stays. Inference follows
    from the joint tables when asked for."""
    if not results or not all(isinstance(r, Result) for r in results):
        raise TypeError("a non-empty list of results is needed")
    if len({tuple(r.controls) for r in results}) > 1 or len({r.model.family for r in results}) > 1:
        warnings.warn("results differ in controls or model; the first one's are kept", UserWarning, stacklevel=2)
    stride = 1 << 40
    tag = lambda df, i, r: df.withColumn("spec_id", F.col("spec_id") + i * stride).withColumn("__x", F.lit(r.model.x[0]))
    full, oos, boot = (None, None, None)
    for i, r in enumerate(results):
        parts = [tag(getattr(r, k), i, r) for k in ("full", "oos", "boot")]
        full, oos, boot = parts if full is None else (a.unionByName(b) for a, b in zip((full, oos, boot), parts, strict=True))
    if de_dupe:
        w = Window.partitionBy("y", "__x", F.array_sort("controls")).orderBy("spec_id")
        full = full.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        oos, boot = (d.join(full.select("spec_id"), "spec_id", "left_semi") for d in (oos, boot))
    m = results[0].model
    y = list(dict.fromkeys(c for r in results for c in r.model.y))
    joint = ModelSpec(m.family, y, m.x, m.controls, m.group, m.draws, m.kfold, m.oos_metric, m.seed)
    return Result(joint, full.drop("__x"), oos.drop("__x"), boot.drop("__x"))


@dataclass
class Base:
    """What the estimators share: construction, its checks, and preparation."""

    y: list[str]
    x: list[str]
    data: DataFrame
    model_name: str = ""
    results: Result | None = field(default=None, init=False)
    family = Family.OLS

    def __post_init__(self) -> None:
        spec.check_columns(self.data, self.y, self.x)
        spec.warn_missing(self.data, [*self.y, *self.x])

    def get_results(self) -> Result:
        return self.results

    def multiple_y(self, composite_sample: int | None = None, seed: int | None = None) -> DataFrame:
        masks = space.sample_y_masks(len(self.y), composite_sample, seed) if composite_sample else [space.bitmask(s, self.y) for s in space.all_subsets(self.y)[1:]]
        return prepare.composites(self.data, self.y, masks)[0]

    def sample_z_specs(self, controls: list[str], n: int, seed: int | None = None) -> list[tuple[str, ...]]:
        return [space.from_mask(m, controls) for m in space.sample_z_masks(len(controls), n, seed)]


class OLSRobust(Base):
    """Least squares over all specifications."""

    family = Family.OLS

    def fit(self, *, controls, group=None, draws=None, kfold=None, oos_metric=None, n_cpu=None, seed=None, composite_sample=None, z_specs_sample_size=None, rescale_y=False, rescale_x=False, rescale_z=False, threshold=1_000_000, rng="poisson", mode=None, order_by=None, shap=True) -> OLSRobust:
        """``mode``: "shared" draws are the same rows for all specifications, "independent" ones each specification's own; by
        default shared for one outcome, independent for composites."""
        if mode not in (None, "shared", "independent"):
            raise ValueError("mode must be shared or independent")
        spec.string_list("controls", controls, empty=True)
        df, y, x, z = self.data, self.y, self.x, controls
        m = spec.resolve(Family.OLS, df, df.count(), y, x, controls=z, group=group, draws=draws, kfold=kfold, oos_metric=oos_metric, n_cpu=n_cpu, seed=seed, composite_sample=composite_sample, z_specs_sample_size=z_specs_sample_size, threshold=threshold, rng=rng, order_by=order_by)
        model_columns = [*dict.fromkeys([*y, *x, *z])]
        df = prepare.doubles(df, [c for c in model_columns if c != group])
        if rescale_y and len(y) > 1:
            warnings.warn("several outcomes are scaled anyway; rescale_y is skipped", UserWarning, stacklevel=2)
        df = prepare.rescale(df, [*(y if rescale_y and len(y) == 1 else []), *(x if rescale_x else []), *(z if rescale_z else [])])
        if group:
            if "const" in df.columns:
                warnings.warn("fixed effects leave no room for a constant; const is dropped", UserWarning, stacklevel=2)
                df, x, z = df.drop("const"), [c for c in x if c != "const"], [c for c in z if c != "const"]
            if same := prepare.group_invariant_columns(df, [*x, *z], group):
                warnings.warn(f"columns that don't vary within groups: {same}", UserWarning, stacklevel=2)
        else:
            df, y, x, z = prepare.single_constant(df, y, x, z)
        y_names = y
        if len(y) > 1:
            df, y_names = prepare.composites(df, y, m.y_masks)
        # A sample of specifications is one of the controls as they are now: constants may have gone or got another name.
        masks = m.z_masks if z == controls or not z_specs_sample_size else space.sample_z_masks(len(z), z_specs_sample_size, m.seed)
        m = ModelSpec(Family.OLS, y, x, z, m.group, m.draws, m.kfold, m.oos_metric, m.seed, None, masks, m.y_masks, m.rng, m.order_by)
        columns = [*y_names, *x, *z]
        keep = df.select(*[f"`{c}`" for c in dict.fromkeys([*columns, *([group] if group else []), *m.order_by])])
        rows = prepare.with_row_index(keep, [F.col(f"`{c}`") for c in m.order_by], "rid") if m.order_by else prepare.in_input_order(keep, "rid")
        holes = patterns.holes_of(rows, [*columns, *([group] if group else [])])
        curve = lattice.Space(columns, y_names, x, z, holes, masks, group)
        self.results = Result(m, *self._fit_curve(rows, curve, m, mode or ("independent" if m.multi_y else "shared")))
        if shap and len(y) == 1:
            self.results.shap = panels.linear_shap(rows, y_names[0], [c for c in x if c != "const"] + [c for c in z if c != "const"], m.seed, group)
        return self

    def _fit_curve(self, rows: DataFrame, curve: lattice.Space, m: ModelSpec, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """full, oos and boot. All needs (sets of complete rows) go through the same few jobs."""
        spark, columns, bits, needs = rows.sparkSession, curve.columns, len(curve.holes), curve.needs()
        rows = rows.withColumn("__pattern", patterns.null_mask(curve.holes))
        n_all, length = rows.count(), moments.size(len(columns))
        sizes = patterns.counts(rows, needs, bits) if bits else dict.fromkeys(needs, n_all)
        if not all(sizes.values()):
            raise ValueError("no complete rows")
        by_group = None
        if m.group:
            within = materialize(groups.within_grams(rows, columns, m.group, needs, bits), "groups")
            by_group = materialize(within.join(groups.dealt(within, m.kfold).drop("size"), ["need", "__group"]), "dealt")
            grams = moments.add_up(by_group, ["need", "fold"], length)
        elif len(needs) == 1:
            cuts = patterns.cut_points(rows, n_all, sizes, m.kfold, bits)[needs[0]] if m.kfold else []
            fold = sum(((F.col("rid") >= F.lit(int(c))).cast("int") for c in cuts), F.lit(0))
            whole = rows.where(F.col("__pattern").bitwiseAND(F.lit(needs[0])) == 0).withColumn("fold", fold)
            grams = moments.gram(whole, columns, ["fold"]).withColumn("need", F.lit(needs[0]).cast("long"))
        else:
            cuts = patterns.cut_points(rows, n_all, sizes, m.kfold, bits) if m.kfold else {n: np.zeros(0, np.int64) for n in needs}
            grams = patterns.fold_grams(rows, columns, needs, bits, cuts)
        grams = materialize(grams.select("need", F.col("fold").cast("int").alias("fold"), "gram"), "grams")
        if m.multi_y:
            most = max(needs, key=int.bit_count)
            total = moments.unpack(np.array([r.gram for r in grams.where(F.col("need") == most).collect()], float), len(columns)).sum(0)
            _, x_at, z_at = curve.places()
            if pairs := ols.collinear_pairs(total, [*x_at, *z_at], [*curve.x, *curve.controls]):
                warnings.warn(f"perfectly collinear columns: {pairs}", UserWarning, stacklevel=3)
        labels = [",".join(space.from_mask(int(y[3:]), m.y)) if m.multi_y else y for y in curve.y]
        fitted = materialize(lattice.full_fits(curve, grams, m.kfold, m.oos_metric, labels), "full")
        oos = fitted.select("spec_id", F.posexplode("scores").alias("fold", "metric"))
        return fitted.drop("scores"), oos, self._boot(rows, curve, m, mode, grams, sizes, n_all, by_group)

    def _boot(self, rows: DataFrame, curve: lattice.Space, m: ModelSpec, mode: str, grams: DataFrame, sizes: dict[int, int], n_all: int, by_group: DataFrame | None) -> DataFrame:
        spark, columns, length = rows.sparkSession, curve.columns, moments.size(len(curve.columns))
        if not m.draws:
            return spark.createDataFrame([], BOOT_SCHEMA)
        apart = mode == "independent"
        units = [moments.Unit(n, n, n_all / sizes[n]) for n in sizes]
        if apart:
            y_at, x_at, z_at = curve.places()
            units = []
            for r in curve.blocks(spark, apart=True).select("unit", "need", F.get("ys", 0).alias("y"), F.get("masks", 0).alias("mask")).collect():  # a row per specification
                used = (y_at[r.y], *x_at, *[c for i, c in enumerate(z_at) if r.mask >> i & 1])
                units.append(moments.Unit(r.unit, r.need, n_all / sizes[r.need], r.unit + 1, used))
        if by_group is not None:
            sums = by_group.groupBy("need").agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.stddev_pop("size").alias("sd"), F.min("size").alias("least"))
            stats = {r.need: r.asDict() for r in sums.collect()}
            drawn = moments.cluster_grams(by_group, stats, units, n_all, m.draws, m.seed, max(5, len(curve.x) + len(curve.controls) + 2), length)
        elif m.rng == "hash":
            drawn = moments.multinomial_grams(rows, columns, units, sizes, n_all, m.draws, m.seed)
        else:
            drawn = moments.poisson_grams(rows, columns, units, m.draws, m.seed)
        totals = moments.add_up(grams, ["need"], length)
        return materialize(lattice.drawn_fits(curve, totals, drawn, m.draws, BOOT_SCHEMA, apart), "boot")


class LRobust(Base):
    """Logistic regression over all specifications; the outcome is 0 or 1."""

    family = Family.LOGIT

    def multiple_y(self, *_, **__):
        raise NotImplementedError("the logistic model takes one outcome")

    def fit(self, *, controls, group=None, draws=None, sample_size=None, kfold=None, oos_metric=None, n_cpu=None, seed=None, rescale_x=False, rescale_y=False, rescale_z=False, threshold=1_000_000, mode=None, shap=True, times=None) -> LRobust:
        """``mode``: "independent" draws (the default) are each specification's own, "shared" ones the same rows for all.
        ``times``: a column with whole numbers, of how many equal rows each row stands for."""
        if mode not in (None, "shared", "independent"):
            raise ValueError("mode must be shared or independent")
        spec.string_list("controls", controls, empty=True)
        df, y, x, z = self.data, self.y, self.x, controls
        if len(y) > 1:
            raise NotImplementedError("the logistic model takes one outcome")
        if times and (times in {*y, *x, *z, group} or times not in df.columns):
            raise ValueError("times must be a column of the data beside those of the model")
        if times:
            df = df.where(F.col(f"`{times}`") > 0)
        n_rows = df.agg(F.coalesce(F.sum(f"`{times}`"), F.lit(0)).cast("long")).first()[0] if times else df.count()
        m = spec.resolve(Family.LOGIT, df, n_rows, y, x, controls=z, group=group, draws=draws, kfold=kfold, oos_metric=oos_metric, n_cpu=n_cpu, seed=seed, sample_size=sample_size, threshold=threshold)
        if group:
            warnings.warn("group only shapes the folds and the bootstrap of a logistic model", UserWarning, stacklevel=2)
        df = prepare.doubles(df, [*dict.fromkeys([*y, *x, *z])])
        scaled = [*(y if rescale_y else []), *(x if rescale_x else []), *(z if rescale_z else [])]
        if times and scaled:
            df, times = prepare.unfolded(df, times), None
        df = prepare.rescale(df, scaled)
        joined = None if group or m.draws or shap else self._joined(df, [*dict.fromkeys([*y, *x, *z])], z, m.kfold, times)
        df = joined if joined is not None else prepare.unfolded(df, times) if times else df
        df, y, x, z = prepare.single_constant(df, y, x, z)
        m = ModelSpec(Family.LOGIT, y, x, z, group, m.draws, m.kfold, m.oos_metric, m.seed, sample_size)
        columns = [*y, *x, *z]
        keep = df.select(*[f"`{c}`" for c in dict.fromkeys([*columns, *([group] if group else []), *([] if joined is None else ["__times"])])])
        order = [F.col(f"`{c}`") for c in columns]
        rows = prepare.with_row_index(keep, order, "rid") if joined is None else prepare.first_rows(keep, order, "__times", "rid")
        curve = lattice.Space(columns, y, x, z, patterns.holes_of(rows, columns), None)
        self.results = Result(m, *self._fit_curve(rows, curve, m, mode != "shared"))
        if shap:
            self.results.shap = panels.logit_shap(rows, y[0], [c for c in [*x, *z] if c != "const"], m.seed)
        return self

    def _joined(self, df: DataFrame, columns: list[str], controls: list[str], kfold: int, times: str | None) -> DataFrame | None:
        """``df`` with equal rows as one, so that nothing but their folds is ever done row by row: where they are few or were
        joined before, and all specifications have the same complete rows. Else None."""
        if not times:
            known = df.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*[F.coalesce(f"`{c}`", F.lit(float("nan"))) for c in columns]))).first()
            if known[1] * max(1, kfold) * SPARED > known[0]:
                return None
        kinds = materialize(logit.equal_rows(df, columns, times), "joined")
        return None if controls and patterns.holes_of(kinds, controls) else kinds

    def _fit_curve(self, rows: DataFrame, curve: lattice.Space, m: ModelSpec, apart: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """full, oos and boot. All needs (sets of complete rows), specifications, folds and draws go through the same steps."""
        spark, bits, needs, y = rows.sparkSession, len(curve.holes), curve.needs(), m.y[0]
        rows = rows.withColumn("__pattern", patterns.null_mask(curve.holes))
        times = "__times" if "__times" in rows.columns else None
        known = rows.agg(F.sum(times).cast("long") if times else F.count("*"), F.approx_count_distinct(F.xxhash64("__pattern", *[f"`{c}`" for c in curve.columns]))).first()
        n_all, kinds = known[0], known[1] * max(1, m.kfold) ** len(needs)
        sizes = patterns.counts(rows, needs, bits, times=times) if bits else dict.fromkeys(needs, n_all)
        if not all(sizes.values()):
            raise ValueError("no complete rows")
        if len(needs) == 1:
            grams = moments.gram(rows.where(F.col("__pattern").bitwiseAND(F.lit(needs[0])) == 0), curve.columns, weight=times).withColumn("need", F.lit(needs[0]).cast("long"))
        else:
            grams = patterns.fold_grams(rows, curve.columns, needs, bits, {n: np.zeros(0, np.int64) for n in needs})
        y_at, x_at, z_at = curve.places()
        for r in grams.collect():  # a row per need
            g = moments.unpack(np.array(r.gram, float), len(curve.columns))
            able = [i for i, c in enumerate(curve.controls) if not patterns.need_of([c], curve.holes) & ~r.need]
            if pairs := ols.collinear_pairs(g, [*x_at, *[z_at[i] for i in able]], [*curve.x, *[curve.controls[i] for i in able]]):
                raise ValueError(f"perfectly collinear columns: {pairs}")
        rows = self._with_folds(rows, m, needs)
        if not times and not m.draws and kinds * SPARED <= n_all:
            rows = logit.equal_rows(rows, curve.columns)
        rows = materialize(rows, "logit")
        columns = [*curve.x, *curve.controls]
        place = {c: i for i, c in enumerate(columns)}
        rate = {n: (m.sample_size or n_all) / sizes[n] for n in needs}
        own = F.filter(F.array(*[F.when(F.getbit("mask", F.lit(i)) == 1, F.lit(place[c])) for i, c in enumerate(curve.controls)], F.lit(None).cast("int")), lambda c: c.isNotNull())
        blocks = curve.blocks(spark).select("need", F.explode(F.arrays_zip("masks", "ids")).alias("s")).select("need", F.col("s.masks").alias("mask"), F.col("s.ids").alias("spec_id"))
        specs = materialize(blocks.select("spec_id", "need", "mask", F.concat(F.array(*[F.lit(place[c]) for c in curve.x]), own).alias("cols")), "specs")
        if m.group and m.draws:  # a draw weights whole groups, by the group's number instead of the row's
            ids = prepare.with_row_index(rows.select(F.col(f"`{m.group}`").alias("__group")).distinct(), ["__group"], "g_idx")
            rows = materialize(rows.drop("unit").join(ids, F.col(f"`{m.group}`").eqNullSafe(F.col("__group"))).withColumnRenamed("g_idx", "unit").drop("__group"), "grouped")
        bare = F.filter("cols", lambda c: ~c.isin([i for c, i in place.items() if c == "const"])) if "const" in place else F.col("cols")
        models = logit.model_frame(specs.withColumn("bare", bare), rate, True, m.kfold, m.draws, apart=apart)
        fitted = logit.newton(rows, y, columns, models, len(columns) + 1, m.seed)
        names = F.filter(F.array(*[F.when(F.getbit("mask", F.lit(i)) == 1, F.lit(c)) for i, c in enumerate(curve.controls)], F.lit(None).cast("string")), lambda c: c.isNotNull())
        full = logit.summaries(fitted.where("leave < 0 AND draw < 0")).join(specs.select("spec_id", names.alias("controls")), "spec_id")
        full = full.withColumns({"y": F.lit(y), "predictors": F.concat(F.array(*[F.lit(c) for c in curve.x]), "controls"), "beta": F.get("b", 0), "pval": F.get("p", 0), "is_singular": F.lit(False)})
        full = materialize(full.select(*[c.split()[0] for c in FULL_SCHEMA.split(", ")]), "full")
        oos, boot = spark.createDataFrame([], "spec_id long, fold int, metric double"), spark.createDataFrame([], BOOT_SCHEMA)
        if m.kfold:
            oos = materialize(logit.fold_metrics(rows, y, columns, fitted.where("leave >= 0"), m.oos_metric), "oos")
        if m.draws:
            none = F.lit(None).cast("double")
            drawn = logit.summaries(fitted.where("draw >= 0"))
            boot = materialize(drawn.select("spec_id", "draw", F.get("b", 0).alias("beta"), F.get("p", 0).alias("p"), "r2", none.alias("beta_null"), none.alias("p_null")), "boot")
        return full, oos, boot

    def _with_folds(self, rows: DataFrame, m: ModelSpec, needs: list[int]) -> DataFrame:
        """``rows`` with unit, and folds: for each need the row's fold among its complete rows (-1 elsewhere)."""
        rows = rows.withColumn("unit", F.col("rid"))
        if not m.kfold:
            return rows
        at = {n: i for i, n in enumerate(needs)}
        served = F.filter(F.array(*[F.lit(n).cast("long") for n in needs]), lambda n: n.bitwiseAND(F.col("__pattern")) == 0)
        by_need = lambda df, *keys: df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("need", "fold"))).alias("__folds"))  # noqa: E731  an entry per need
        if m.group:
            sizes = rows.select(F.explode(served).alias("need"), F.col(f"`{m.group}`").alias("__group")).groupBy("need", "__group").agg(F.count("*").alias("size"))
            folds = by_need(groups.dealt(sizes, m.kfold), "__group")
            rows = rows.join(folds, F.col(f"`{m.group}`") == F.col("__group"), "left").drop("__group")
        elif len(needs) == 1:  # rows that lack a column are in no model
            whole = rows.where(F.col("__pattern").bitwiseAND(F.lit(needs[0])) == 0).withColumns({"__y": F.col(f"`{m.y[0]}`"), "need": F.lit(needs[0]).cast("long")})
            dealt = prepare.stratified_kinds if "__times" in rows.columns else prepare.stratified_folds
            return dealt(whole, m.kfold, m.seed).withColumn("folds", F.array("fold")).drop("__y", "need", "fold")
        else:
            many = rows.select("rid", F.col(f"`{m.y[0]}`").alias("__y"), F.explode(served).alias("need"))
            rows = rows.join(by_need(prepare.stratified_folds(many, m.kfold, m.seed), "rid"), "rid", "left")
        folds = F.array(*[F.coalesce(F.try_element_at("__folds", F.lit(n).cast("long")), F.lit(-1)) for n in at])
        return rows.withColumn("folds", folds).drop("__folds")
