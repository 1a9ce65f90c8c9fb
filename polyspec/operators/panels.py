"""Tables behind the figures of a curve, and the attribution that two of them show. Drawing is left to the caller."""

from __future__ import annotations

from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyspec.functions.stats import kde, lowess
from polyspec.operators import inference, moments, ols
from polyspec.operators.prepare import with_row_index
from polyspec.plans import space

GRID, HEAT_BINS, HIST_BINS, MAX_SELECTED = 20, 128, 30, 3
#: Positions of the curve smoothed in one task, and grid points of a binned density.
SMOOTH_BLOCK, CELLS = 4096, 1024


def hexbin(df: DataFrame, x: str, y: str, grid: int = GRID) -> DataFrame:
    """hx, hy, n: counts on a hexagonal lattice of ``grid`` columns. The two rectangular lattices that make it up compete
    for each point; the nearer centre wins."""
    ny = int(grid / sqrt(3))
    r = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    p = df.select(x, y).crossJoin(F.broadcast(r))  # one row
    u = F.coalesce(F.try_divide((F.col(x) - F.col("x0")) * grid, F.col("x1") - F.col("x0")), F.lit(0.0))
    v = F.coalesce(F.try_divide((F.col(y) - F.col("y0")) * ny, F.col("y1") - F.col("y0")), F.lit(0.0))
    p = p.select(u.alias("u"), v.alias("v")).select("u", "v", F.rint("u").alias("u1"), F.rint("v").alias("v1"), (F.floor("u") + 0.5).alias("u2"), (F.floor("v") + 0.5).alias("v2"))
    d = lambda a, b: (F.col("u") - F.col(a)) ** 2 + 3 * (F.col("v") - F.col(b)) ** 2
    first = d("u1", "v1") < d("u2", "v2")
    return p.groupBy(F.when(first, F.col("u1")).otherwise(F.col("u2")).alias("hx"), F.when(first, F.col("v1")).otherwise(F.col("v2")).alias("hy")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = HIST_BINS) -> DataFrame:
    """bin (from 0), lo, hi, n, density."""
    df = df.where(F.col(column).isNotNull() & ~F.isnan(column))
    r = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("total"))
    width = (F.col("r_hi") - F.col("r_lo")) / bins
    p = df.select(column).crossJoin(F.broadcast(r.select(F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"), "total")))
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("r_lo"), width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    g = p.groupBy(at.alias("bin"), "r_lo", "r_hi", "total").agg(F.count("*").alias("n"))
    return g.select("bin", (F.col("r_lo") + F.col("bin") * width).alias("lo"), (F.col("r_lo") + (F.col("bin") + 1) * width).alias("hi"), "n", F.try_divide(F.col("n"), F.col("total") * width).alias("density"))


def curve_order(summary: DataFrame) -> DataFrame:
    """``summary`` with position (from 1) by median, ties by spec_id; numbered by a range sort."""
    return with_row_index(summary, ["median", "spec_id"], "__at").withColumn("position", (F.col("__at") + 1).cast("int")).drop("__at")


def smoothed(curve: DataFrame, columns: list[str], block: int = SMOOTH_BLOCK) -> DataFrame:
    """``curve`` with smooth_{column}: a local line over the nearest 30 % of the curve. Blocks of positions are smoothed apart,
    each with a halo of as many positions as a point has neighbours."""
    n = curve.count()
    k = min(n, max(2, int(np.ceil(max(2 / max(n, 1), 0.3) * n))))
    last = max(0, (n - 1) // block)
    # The blocks whose positions, with k more on either side, hold this one.
    first = F.greatest(F.lit(0), F.floor((F.col("position") - 1 - k) / block))
    final = F.least(F.lit(last), F.floor((F.col("position") - 1 + k) / block))
    dealt = curve.withColumn("__block", F.explode(F.sequence(first.cast("int"), final.cast("int"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        x, own = pdf["position"].to_numpy(float), ((pdf["position"] - 1) // block == pdf["__block"]).to_numpy()
        at = np.flatnonzero(own)
        return pdf[own].assign(**{f"smooth_{c}": lowess(x, pdf[c].to_numpy(float), 0.3, at, k) for c in columns}).drop(columns="__block")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in curve.schema.fields) + "".join(f", smooth_{c} double" for c in columns)
    return dealt.groupBy("__block").applyInPandas(run, schema)


def spec_curve(boot: DataFrame, full: DataFrame, n_controls: int, ci: float = 1.0, selected: list | None = None, smooth: bool = True) -> DataFrame:
    """spec_id, median, lo, hi, position, kind (null, full, selected or other), smooth_lo, smooth_hi."""
    a = (1 - ci) / 2
    s = boot.where("beta IS NOT NULL").groupBy("spec_id").agg(F.median("beta").alias("median"), inference.nearest("beta", a).alias("lo"), inference.nearest("beta", 1 - a).alias("hi"))
    s = curve_order(s).join(full.select("spec_id", "controls"), "spec_id").withColumn("kind", kind_of("controls", n_controls, selected)).drop("controls")
    return smoothed(s, ["lo", "hi"]) if smooth else s


def kind_of(controls: str, n_controls: int, selected: list | None) -> Column:
    chosen = F.lit(False)
    for s in selected or []:
        chosen = chosen | (F.array_sort(controls) == F.array_sort(F.array(*[F.lit(c) for c in s]) if s else F.array().cast("array<string>")))
    return F.when(chosen, "selected").when(F.size(controls) == 0, "null").when(F.size(controls) == n_controls, "full").otherwise("other")


def spec_matrix(curve: DataFrame, full: DataFrame, controls: list[str], bins: int = HEAT_BINS) -> DataFrame:
    """bin, control, share: inclusion of each control along the curve, averaged within at most ``bins`` bins."""
    n = curve.count()
    q, r = divmod(n, bins)  # the first r bins hold one more
    at = F.col("position") - 1
    bin_ = F.when(at < r * (q + 1), F.floor(at / (q + 1))).otherwise(r + F.floor((at - r * (q + 1)) / max(q, 1))) + 1
    c = curve.select("spec_id", bin_.cast("int").alias("bin")).join(full.select("spec_id", "controls"), "spec_id")
    all_ = F.explode(F.array(*[F.lit(k) for k in controls]) if controls else F.array().cast("array<string>")).alias("control")
    return c.select("bin", "controls", all_).groupBy("bin", "control").agg(F.avg(F.array_contains("controls", F.col("control")).cast("double")).alias("share"))


def ic_curve(full: DataFrame, ic: str, n_controls: int, selected: list | None = None) -> DataFrame:
    """spec_id, value, position, kind: specifications by an information criterion."""
    if ic not in ("aic", "bic", "hqic"):
        raise ValueError("ic must be aic, bic or hqic")
    c = with_row_index(full.select("spec_id", F.col(ic).alias("value"), kind_of("controls", n_controls, selected).alias("kind")), ["value", "spec_id"], "__at")
    return c.select("spec_id", "value", (F.col("__at") + 1).cast("int").alias("position"), "kind")


def binned_density(df: DataFrame, value: str, key: str | None = None, points: int = 100, adjust: float = 1.0, cells: int = CELLS) -> DataFrame:
    """key (if given), x, density: a Gaussian kernel density. Values are shared out linearly between the two nearest of
    ``cells`` grid points by one aggregation, and the few grid counts are convolved, so no task holds the values."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select((F.col(key) if key else F.lit("")).alias("key"), F.col(value).alias("v"))
    per = rows.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"), F.stddev_samp("v").alias("sd"))
    h = F.coalesce("sd", F.lit(0.0)) * adjust * F.pow("n", F.lit(-0.2))
    per = per.withColumn("h", h).where("h > 0").withColumns({"left": F.col("lo") - 3 * F.col("h"), "step": (F.col("hi") - F.col("lo") + 6 * F.col("h")) / (cells - 1)})
    at = (F.col("v") - F.col("left")) / F.col("step")
    placed = rows.join(F.broadcast(per), "key").withColumn("at", at).withColumn("i", F.floor("at").cast("int"))  # a row per key
    two = F.explode(F.array(F.struct(F.col("i").alias("cell"), (1 + F.col("i") - F.col("at")).alias("w")), F.struct((F.col("i") + 1).alias("cell"), (F.col("at") - F.col("i")).alias("w")))).alias("c")
    sums = placed.select("key", "left", "step", "h", "n", two).groupBy("key", "left", "step", "h", "n", "c.cell").agg(F.sum("c.w").alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, step, width, n = (float(pdf[c].iloc[0]) for c in ("left", "step", "h", "n"))
        grid = left + step * np.arange(cells)
        x = np.linspace(grid[0], grid[-1], points)
        centre, w = left + step * pdf["cell"].to_numpy(float), pdf["w"].to_numpy(float)
        density = np.exp(-0.5 * ((x[:, None] - centre[None, :]) / width) ** 2) @ w / (n * width * np.sqrt(2 * np.pi))
        return pd.DataFrame({"key": pdf["key"].iloc[0], "x": x, "density": density})

    out = sums.groupBy("key").applyInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, x double, density double")
    return out.withColumnRenamed("key", key) if key else out.drop("key")


def bma_in_order(bma: DataFrame, shap: DataFrame | None) -> DataFrame:
    """``bma`` with position: controls by their attribution, the largest first, as in the panel beside it; without
    attributions by probability."""
    if shap is None:
        total = bma.withColumn("total", F.col("probs"))
    else:
        total = bma.join(shap_order(shap).select(F.col("feature").alias("control_var"), "total"), "control_var", "left")
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("total").desc_nulls_last(), "control_var")  # a row per control
    return total.withColumn("position", F.row_number().over(w)).drop("total")


def boot_density(boot: DataFrame, full: DataFrame, n_controls: int, selected: list | None = None, points: int = 100) -> DataFrame:
    """spec_id, kind, x, density of the draws of the null, the full and the selected specifications."""
    wanted = full.select("spec_id", kind_of("controls", n_controls, selected).alias("kind")).where("kind <> 'other'")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["beta"].dropna().to_numpy(float)
        pad = 3 * 0.5 * x.std() * len(x) ** -0.2 if len(x) > 1 else 1.0
        grid = np.linspace(x.min() - pad, x.max() + pad, points)
        return pd.DataFrame({"spec_id": pdf["spec_id"].iloc[0], "kind": pdf["kind"].iloc[0], "x": grid, "density": kde(x, grid, 0.5)})

    return boot.where("beta IS NOT NULL").join(wanted, "spec_id").groupBy("spec_id", "kind").applyInPandas(run, "spec_id long, kind string, x double, density double")


def odds_ratios(df: DataFrame, *columns: str, logistic: bool = True) -> DataFrame:
    """exp of coefficients, for a logistic model only."""
    if not logistic:
        raise ValueError("odds ratios need a logistic model")
    return df.withColumns({c: F.exp(c) for c in columns})


def in_train(seed: int, key: str, share: float = 0.8) -> Column:
    """A seeded 80/20 split by digest of a row key, which DuckDB can repeat."""
    return moments.hash_index(seed, 1_000_000, F.col(key)) < int(share * 1_000_000)


def linear_shap(rows: DataFrame, y: str, features: list[str], seed: int, group: str | None = None, key: str = "rid") -> DataFrame | None:
    """row_id, feature, value, phi of the test rows: phi = coefficient * (value - training mean), for the model with all
    controls and an intercept. With a group, columns are demeaned before incomplete rows go."""
    from polyspec.operators.prepare import group_demean

    if not features:
        return None
    data = group_demean(rows, [y, *features], group) if group else rows
    data = data.na.drop(subset=[y, *features])
    p = len(features)
    g = moments.gram(data.where(in_train(seed, key)), [y, *features]).first().gram
    g = moments.unpack(np.array(g, float), p + 1)
    if g[-1, -1] < 1:
        return None
    b = ols.fit(g[None], [*range(1, p + 1), p + 1], 0, full=False)["b"][0]
    means = g[-1, 1 : p + 1] / g[-1, -1]
    return attribution(data.where(~in_train(seed, key)), features, b, means, key)


def attribution(test: DataFrame, features: list[str], b, means, key: str) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("value"), (F.lit(float(b[i])) * (F.col(f"`{c}`") - F.lit(float(means[i])))).alias("phi")) for i, c in enumerate(features)]
    return test.select(F.col(key).alias("row_id"), F.explode(F.array(*parts)).alias("s")).select("row_id", "s.*")


def logit_shap(rows: DataFrame, y: str, features: list[str], seed: int, key: str = "rid", strength: float = 0.1) -> DataFrame | None:
    """As linear_shap in log-odds, for a logistic model with an L2 penalty of 1 / (strength * rows)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    if not features:
        return None
    data = rows.na.drop(subset=[y, *features])
    train = data.where(in_train(seed, key))
    r = train.agg(F.count("*"), *[F.avg(f"`{c}`") for c in features]).first()
    if not r[0]:
        return None
    made = VectorAssembler(inputCols=features, outputCol="__v").transform(train.select(y, *features))
    model = LogisticRegression(featuresCol="__v", labelCol=y, regParam=1 / (strength * r[0]), standardization=False).fit(made)
    return attribution(data.where(~in_train(seed, key)), features, model.coefficients.toArray(), list(r)[1:], key)


def shap_order(shap: DataFrame, top: int | None = None) -> DataFrame:
    """feature, total: sums of abs(phi), largest first."""
    out = shap.groupBy("feature").agg(F.sum(F.abs("phi")).alias("total")).orderBy(F.desc("total"), "feature")
    return out.limit(top) if top else out


def shap_violin(shap: DataFrame, top: int = 10) -> DataFrame:
    """feature, total, p1, p5, p95, p99 of phi for the ``top`` features."""
    q = {f"p{k}": F.percentile("phi", F.lit(k / 100)) for k in (1, 5, 95, 99)}
    return shap.join(F.broadcast(shap_order(shap, top)), "feature").groupBy("feature", "total").agg(*[c.alias(k) for k, c in q.items()])


def smoothed_values(shap: DataFrame, width: int = 20) -> DataFrame:
    """row_id, feature, phi, colour: mean feature value over the trailing ``width`` points in order of phi."""
    w = Window.partitionBy("feature").orderBy("phi", "row_id").rowsBetween(-(width - 1), 0)
    return shap.select("row_id", "feature", "phi", F.avg("value").over(w).alias("colour"))


def selected_specs(full: DataFrame, specs, controls: list[str], most: int = MAX_SELECTED) -> list[list[str]]:
    """Checked specifications to highlight."""
    if specs is None:
        return []
    keys = space.selection_keys(specs)
    if len(keys) > most:
        raise ValueError(f"at most {most} specifications can be highlighted")
    if bad := [sorted(k) for k in keys if not k <= set(controls)]:
        raise ValueError(f"unknown specifications: {bad}")
    return [sorted(k) for k in keys]


def all_panels(result, specs=None, ic: str = "aic", ci: float = 1.0, loess: bool = True, oddsratio: bool = False) -> dict[str, DataFrame]:
    """Tables by panel; three of them for composite outcomes."""
    from polyspec.plans.spec import Family

    if ic not in ("aic", "bic", "hqic"):
        raise ValueError("ic must be aic, bic or hqic")
    if not 0 <= ci <= 1:
        raise ValueError("ci must be between 0 and 1")
    m, full, boot = result.model, result.full, result.boot
    chosen = selected_specs(full, specs, m.controls)
    logistic = m.family is Family.LOGIT
    if oddsratio:
        full, boot = odds_ratios(full, "beta", logistic=logistic), odds_ratios(boot, "beta", logistic=logistic)
    n = len(m.controls)
    curve = spec_curve(boot, full, n, ci, chosen, loess)
    out = {"hexbin_r2": hexbin(boot.where("beta IS NOT NULL AND r2 IS NOT NULL"), "beta", "r2"), "curve": curve, "matrix": spec_matrix(curve, full, m.controls), "bdist": boot_density(boot, full, n, chosen)}
    if not m.multi_y:
        ll = "ll_raw" if logistic else "ll_gain_per_obs"
        scores = result.oos.groupBy("spec_id").agg(F.avg("metric").alias("av_k_metric"))
        out |= {"hexbin_ll": hexbin(full, "beta", ll), "oos": histogram(scores, "av_k_metric"), "oos_density": binned_density(scores, "av_k_metric"), "ic": ic_curve(full, ic, n, chosen), "bma": bma_in_order(result.compute_bma(), result.shap)}
        if result.shap is not None:
            few = result.shap.join(F.broadcast(shap_order(result.shap, 10).select("feature")), "feature")
            out |= {"shap": shap_violin(result.shap), "shap_density": binned_density(few, "phi", "feature"), "shap_points": smoothed_values(few)}
    return out


