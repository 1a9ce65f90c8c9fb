"""Joint inference over the curve, model averaging and summaries: aggregations over the long result tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyspec.functions.stats import norm_sf, psd_unit, signed_z
from polyspec.plans.scratch import materialize

ALPHA = 0.05
#: Specifications of a tile of the null correlations; draws of a specification that are sorted in one task.
TILE, SORTED_DRAWS = 256, 1 << 17


def with_z(df: DataFrame, p: str, beta: str, out: str) -> DataFrame:
    @F.pandas_udf("double")
    def z(p: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(signed_z(p.to_numpy(float), np.nan_to_num(b.to_numpy(float))))

    return df.withColumn(out, z(F.col(p), F.col(beta)))


def nearest(x: str, q: float) -> Column:
    """The order statistic nearest to a quantile; a half goes to the even index."""
    s = F.array_sort(F.collect_list(x))
    return F.get(s, F.rint((F.size(s) - 1) * F.lit(q)).cast("int"))


def boot_summary(boot: DataFrame, lower: float = 0.025, upper: float = 0.975, draws: int = 0) -> DataFrame:
    """spec_id, median, max, min, ci_up, ci_down over the draws; of more than SORTED_DRAWS ``draws`` by ``order_statistics``,
    with the same values."""
    b = boot.where("beta IS NOT NULL AND NOT isnan(beta)")
    if draws > SORTED_DRAWS:
        return order_statistics(b, lower, upper)
    b = b.groupBy("spec_id")
    return b.agg(F.median("beta").alias("median"), F.max("beta").alias("max"), F.min("beta").alias("min"), nearest("beta", upper).alias("ci_up"), nearest("beta", lower).alias("ci_down"))


def order_statistics(b: DataFrame, lower: float, upper: float) -> DataFrame:
    """``boot_summary`` without gathering a specification's draws: all are numbered by one range sort, and those of the wanted
    ranks are picked."""
    from polyspec.operators.prepare import with_row_index

    at = with_row_index(b.select("spec_id", "beta"), ["spec_id", "beta"], "at")
    ends = at.groupBy("spec_id").agg(F.min("at").alias("first"), (F.count("*") - 1).alias("last"))
    rank = lambda q: F.col("first") + F.rint(F.col("last") * F.lit(q)).cast("long")
    half = lambda f: F.col("first") + f(F.col("last") / 2).cast("long")
    wanted = {"min": F.col("first"), "max": F.col("first") + F.col("last"), "ci_up": rank(upper), "ci_down": rank(lower), "m1": half(F.floor), "m2": half(F.ceil)}
    picks = ends.select("spec_id", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("at")) for k, v in wanted.items()])).alias("p")).select("p.name", "p.at")
    got = at.join(picks, "at").groupBy("spec_id").agg(*[F.max(F.when(F.col("name") == k, F.col("beta"))).alias(k) for k in wanted])
    return got.select("spec_id", ((F.col("m1") + F.col("m2")) / 2).alias("median"), "max", "min", "ci_up", "ci_down")


def ic_average(full: DataFrame, ic: str) -> Column:
    """Average of beta with weights exp(-(ic - least ic) / 2), as an aggregate over rows with the least in ``least_{ic}``."""
    w = F.exp(-0.5 * (F.col(ic) - F.col(f"least_{ic}")))
    return F.try_divide(F.sum(w * F.col("beta")), F.sum(w))


def two_sided(null: str, observed: Column) -> Column:
    """Two-sided Monte-Carlo p with the +1 correction, over rows of draws."""
    n = F.count(null)
    up, down = ((F.count_if(side) + 1) / (n + 1) for side in (F.col(null) >= observed, F.col(null) <= observed))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.least(up, down)))


def curve_inference(full: DataFrame, boot: DataFrame, multi_y: bool = False, compat: bool = True) -> DataFrame:
    """One row of scalars. full: spec_id, beta, pval, aic, bic, hqic; boot: spec_id, draw, beta, p, beta_null, p_null
    (null without null draws, as for the logistic model)."""
    f = full.select("spec_id", "beta", "pval", "aic", "bic", "hqic").withColumn("one", F.lit(0))
    least = f.groupBy("one").agg(*[F.min(c).alias(f"least_{c}") for c in ("aic", "bic", "hqic")])
    g = f.join(F.broadcast(least), "one")
    sig = F.col("pval") < ALPHA
    pos, neg = F.col("beta") > 0, F.col("beta") < 0
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    own = g.agg(
        F.median("beta").alias("median_ns"), F.min("beta").alias("min_ns"), F.max("beta").alias("max_ns"),
        *[(F.lit(None).cast("double") if multi_y else ic_average(g, c)).alias(f"{c}_average") for c in ("aic", "bic", "hqic")],
        F.count_if(pos).alias("pos_ns"), share(pos).alias("pos_prop_ns"), F.count_if(neg).alias("neg_ns"), share(neg).alias("neg_prop_ns"),
        F.count_if(sig).alias("sig_ns"), F.avg(sig.cast("double")).alias("sig_prop_ns"),
        F.count_if(pos & sig).alias("pos_sig_ns"), share(pos & sig).alias("pos_sig_prop_ns"), F.count_if(neg & sig).alias("neg_sig_ns"), share(neg & sig).alias("neg_sig_prop_ns"),
    )
    bsig, bpos, bneg = F.col("p") < ALPHA, F.col("beta") > 0, F.col("beta") < 0
    drawn = boot.agg(
        F.median("beta").alias("median"), F.min("beta").alias("min"), F.max("beta").alias("max"),
        F.count_if(bpos).alias("pos"), share(bpos).alias("pos_prop"), F.count_if(bneg).alias("neg"), share(bneg).alias("neg_prop"),
        F.count_if(bsig).alias("sig"), F.avg(bsig.cast("double")).alias("sig_prop"),
        F.count_if(bpos & bsig).alias("pos_sig"), share(bpos & bsig).alias("pos_sig_prop"), F.count_if(bneg & bsig).alias("neg_sig"), share(bneg & bsig).alias("neg_sig_prop"),
    )
    nsig, npos, nneg = F.col("p_null") < ALPHA, F.col("beta_null") > 0, F.col("beta_null") < 0
    per = boot.where("beta_null IS NOT NULL").groupBy("draw").agg(
        F.median("beta_null").alias("d_median"), F.count_if(npos).alias("d_pos"), F.count_if(nneg).alias("d_neg"), F.count_if(nsig).alias("d_sig"),
        F.count_if(npos & nsig).alias("d_pos_sig"), F.count_if(nneg & nsig).alias("d_neg_sig"),
    )
    # compat: sig counts of all draws together are held against those of single draws, as published results do.
    total = "" if compat else "_ns"
    obs = {"pos": "pos_ns", "neg": "neg_ns", "sig": f"sig{total}", "pos_sig": f"pos_sig{total}", "neg_sig": f"neg_sig{total}"}
    both = own.crossJoin(F.broadcast(drawn))  # two single rows
    met = per.crossJoin(F.broadcast(both))
    tests = met.agg(
        F.avg((F.abs("d_median") >= F.abs("median_ns")).cast("double")).alias("median_p"),
        *[two_sided(f"d_{k}", F.col(v)).alias(f"{k}_p") for k, v in obs.items()],
    )
    return both.crossJoin(F.broadcast(tests)).crossJoin(F.broadcast(stouffer(full, boot)))


def null_z(boot: DataFrame) -> DataFrame:
    """spec_id, draw, z: the null draws' signed z, null where there is none."""
    z = with_z(boot.select("spec_id", "draw", "beta_null", "p_null"), "p_null", "beta_null", "z")
    return z.select("spec_id", "draw", F.when(~F.isnan("z") & F.col("beta_null").isNotNull(), F.col("z")).alias("z"))


def keep_mask(boot: DataFrame) -> DataFrame:
    """spec_id, mu, sd, n, kept: specifications whose null z are there in every draw and vary."""
    per = null_z(boot).groupBy("spec_id").agg(F.avg("z").alias("mu"), F.stddev_samp("z").alias("sd"), F.count("*").alias("n"), F.count("z").alias("there"))
    return per.select("spec_id", "mu", "sd", "n", F.coalesce((F.col("there") == F.col("n")) & (F.col("sd") > 1e-14), F.lit(False)).alias("kept"), (F.col("there") > 0).alias("drawn"))


def stouffer(full: DataFrame, boot: DataFrame) -> DataFrame:
    """stouffer_z, stouffer_p, stouffer_kept, mean_correlation: the summed signed z of the curve over its null standard
    deviation, and the share of null draws that reach it. The sum of the null correlations of all pairs is the variance of
    row sums of standardised null z, so no matrix of specifications is built. Where a kept specification lacks an observed
    z, or fewer than two are kept, the tests count as independent; without null draws p is the normal tail."""
    per = keep_mask(boot)
    z = null_z(boot)
    observed = with_z(full.select("spec_id", "beta", "pval"), "pval", "beta", "z_obs").where("NOT isnan(z_obs) AND beta IS NOT NULL AND NOT isnan(beta) AND pval BETWEEN 0 AND 1").select("spec_id", "z_obs")
    drawn = per.agg(F.coalesce(F.max("drawn"), F.lit(False)).alias("any_null"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count_if("kept").alias("null_kept"))
    use = ~F.col("any_null") | (F.col("most") < 2) | F.coalesce("kept", F.lit(False))
    kept = observed.join(per, "spec_id", "left").crossJoin(F.broadcast(drawn)).where(use)
    n = kept.agg(F.count("*").alias("m"), F.sum("z_obs").alias("total"), F.count_if("kept").alias("both"))
    own = z.join(per.where("kept"), "spec_id").groupBy("draw").agg(F.sum((F.col("z") - F.col("mu")) / F.col("sd")).alias("w"))
    spread = own.agg(F.var_samp("w").alias("v"))
    rows = z.where("z IS NOT NULL").join(kept.select("spec_id"), "spec_id").groupBy("draw").agg(F.sum("z").alias("zsum"))
    base = n.crossJoin(F.broadcast(drawn)).crossJoin(F.broadcast(spread))  # single rows
    alike = (F.col("null_kept") >= 2) & (F.col("m") == F.col("null_kept")) & (F.col("both") == F.col("m"))
    m = F.col("m").cast("double")
    base = base.withColumn("denom", F.sqrt(F.when(alike & F.col("v").isNotNull(), F.col("v") + m * 1e-12).otherwise(m)))
    base = base.withColumn("stouffer_z", F.try_divide("total", "denom"))
    hits = rows.crossJoin(F.broadcast(base)).agg(F.count_if(F.abs(F.try_divide("zsum", "denom")) >= F.abs("stouffer_z")).alias("hits"), F.count("*").alias("d"))

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return pd.Series(2 * norm_sf(np.abs(z.to_numpy(float))))

    pairs = F.col("null_kept") * (F.col("null_kept") - 1)
    p = F.when(F.col("any_null"), (F.col("hits") + 1) / (F.col("d") + 1)).otherwise(tail("stouffer_z"))
    return base.crossJoin(F.broadcast(hits)).select(
        "stouffer_z",
        F.when(F.col("stouffer_z").isNotNull(), p).alias("stouffer_p"),
        F.col("m").alias("stouffer_kept"),
        F.when(F.col("any_null"), F.try_divide(F.col("v") - F.col("null_kept"), pairs)).alias("mean_correlation"),
    )


def null_correlation(boot: DataFrame, ridge: float = 0.0, tile: int = TILE) -> DataFrame:
    """a, b, r: correlations of null z over draws for every pair of kept specifications, both ways; with ``ridge`` the matrix
    that combines them, of a diagonal of 1 and the ridge. It is a product of the standardised z with themselves, so it has no
    negative eigenvalue to cut off. Tiles of ``tile`` specifications meet in pairs, each multiplied in one task."""
    per = keep_mask(boot).where("kept")
    z = null_z(boot).join(per, "spec_id").select("spec_id", "draw", ((F.col("z") - F.col("mu")) / F.col("sd") / F.sqrt(F.col("n") - 1)).alias("z"))
    rows = z.groupBy("spec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "z"))), lambda s: s["z"]).alias("z"))  # a value per draw
    block = F.pmod(F.xxhash64("spec_id"), F.greatest(F.ceil(F.lit(per.count()) / tile), F.lit(1)))
    rows = materialize(rows.withColumn("block", block), "null_z")
    others = rows.select(F.col("block").alias("other")).distinct()
    again = boot.sparkSession.read.parquet(rows._polyspec_path)  # a frame of its own for the other side
    left = rows.join(F.broadcast(others), F.col("block") <= F.col("other")).select(F.col("block").alias("i"), F.col("other").alias("j"), "spec_id", "z")
    right = again.join(F.broadcast(again.select(F.col("block").alias("other")).distinct()), F.col("other") <= F.col("block")).select(F.col("other").alias("i"), F.col("block").alias("j"), "spec_id", "z")

    def product(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": [], "r": []})
        a, b = one["spec_id"].to_numpy(), two["spec_id"].to_numpy()
        r = np.clip(np.stack(one["z"].to_numpy()) @ np.stack(two["z"].to_numpy()).T, -1, 1)
        r = np.where(a[:, None] == b[None, :], 1.0 + ridge, r)
        out = pd.DataFrame({"a": np.repeat(a, len(b)), "b": np.tile(b, len(a)), "r": r.ravel()})
        return out if one["i"].iloc[0] == one["j"].iloc[0] else pd.concat([out, out.rename(columns={"a": "b", "b": "a"})])

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(product, "a long, b long, r double")


def stouffer_method(p_values, *, two_sided: bool = True, betas=None, p_values_ystar=None, betas_ystar=None, weights=None, clip_floor: float = 1e-300, na_action: str = "omit", warn: bool = True) -> tuple[float, float]:
    """Combine p values of correlated tests: (Z, p). Null draws (specifications x draws, or transposed) give the
    correlation and a two-sided Monte-Carlo p; without them the tests count as independent."""
    import warnings

    p = np.asarray(p_values, float).ravel()
    beta = np.ones_like(p) if betas is None else np.asarray(betas, float).ravel()
    ok = np.isfinite(p) & np.isfinite(beta) & (p >= 0) & (p <= 1)
    if not ok.all() and na_action == "raise":
        raise ValueError("p_values or betas hold invalid entries")
    w = np.ones_like(p) if weights is None else np.asarray(weights, float).ravel()
    if len(beta) != len(p) or len(w) != len(p):
        raise ValueError("p_values, betas and weights must have the same length")
    if not np.isfinite(w).all():
        raise ValueError("weights must be finite")
    tail = np.clip(p, clip_floor, 1 - 1e-16)
    from polyspec.functions.stats import norm_isf

    z = np.full_like(p, np.nan)
    z[ok] = np.clip(np.sign(beta[ok]) * norm_isf(tail[ok] / 2) if two_sided else norm_isf(tail[ok]), -37, 37)
    sigma, null = None, None
    if p_values_ystar is not None:
        q = np.asarray(p_values_ystar, float)
        b = np.ones_like(q) if betas_ystar is None else np.asarray(betas_ystar, float)
        if q.shape[0] != len(p) and q.shape[1] == len(p):
            q, b = q.T, b.T if b.shape != q.T.shape else b
        if q.shape[0] != len(p):
            raise ValueError("null p values must have a row per specification")
        null = np.clip(np.sign(b) * norm_isf(np.clip(q, clip_floor, 1 - 1e-16) / 2) if two_sided else norm_isf(np.clip(q, clip_floor, 1 - 1e-16)), -37, 37)
        null = null[:, np.isfinite(null).all(0)]
        live = null.std(1) > 1e-14 if null.shape[1] >= 2 else np.zeros(len(p), bool)
        if live.sum() >= 1 and null.shape[1] >= 2:
            ok &= live
            sigma = psd_unit(np.corrcoef(null[ok])) if ok.sum() >= 2 else np.eye(max(ok.sum(), 0))
        else:
            null = None
    if not ok.any():
        if warn:
            warnings.warn("no valid p values to combine", UserWarning, stacklevel=2)
        return np.nan, np.nan
    w = w[ok]
    if not np.any(w):
        raise ValueError("weights must not all be 0")
    denom = np.sqrt(w @ (sigma if sigma is not None else np.eye(len(w))) @ w)
    total = float(w @ z[ok] / denom)
    if null is not None:
        drawn = w @ null[ok] / denom
        return total, float((np.sum(np.abs(drawn) >= abs(total)) + 1) / (len(drawn) + 1))
    return total, float(2 * norm_sf(abs(total)) if two_sided else norm_sf(total))


def join_sig_test(target_full: DataFrame, target_summary: DataFrame, shuffled_boot: DataFrame, sig_level: float, positive: bool) -> DataFrame:
    """p: share of shuffled draws with at least as many significant effects of the sign as the target has specifications
    with an interval beyond 0."""
    bound = "ci_down > 0" if positive else "ci_up < 0"
    observed = target_summary.agg(F.count_if(F.expr(bound)).alias("observed"))
    sign = F.col("beta") > 0 if positive else F.col("beta") < 0
    per = shuffled_boot.groupBy("draw").agg(F.count_if(sign & (F.col("p") < sig_level)).alias("n"))
    return per.crossJoin(F.broadcast(observed)).agg(F.avg((F.col("n") >= F.col("observed")).cast("double")).alias("p"))


def bma(full: DataFrame, controls: list[str]) -> DataFrame:
    """control_var, probs, average_coefs: inclusion probabilities and averaged coefficients with weights exp(-BIC / 2).
    full: spec_id, predictors, b, bic."""
    one = full.select("bic", F.lit(0).alias("one"), F.arrays_zip("predictors", "b").alias("terms"))
    least = one.groupBy("one").agg(F.min("bic").alias("least"))
    w = one.join(F.broadcast(least), "one").withColumn("w", F.exp(-0.5 * (F.col("bic") - F.col("least"))))
    total = w.agg(F.sum("w").alias("total"))
    terms = w.select("w", F.explode("terms").alias("t")).select("w", F.col("t.predictors").alias("control_var"), F.col("t.b").alias("b"))
    sums = terms.where(F.col("control_var").isin(controls)).groupBy("control_var").agg(F.sum("w").alias("ws"), F.sum(F.col("w") * F.col("b")).alias("wb"))
    return sums.crossJoin(F.broadcast(total)).select("control_var", (F.col("ws") / F.col("total")).alias("probs"), (F.col("wb") / F.col("total")).alias("average_coefs"))
