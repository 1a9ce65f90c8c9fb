"""Curves against plain fits: null patterns, lattices, folds, draws."""

import hashlib
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from polyspec.estimators import LRobust, OLSRobust
from polyspec.operators import groups, lattice, logit, moments, ols, patterns, prepare
from polyspec.plans import space


def gram_of(v):
    w = np.c_[v, np.ones(len(v))]
    return w.T @ w


def test_walk_equals_single_fits():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 9)) + 5
    v[:, 1] += v[:, 3]
    w = rng.poisson(1.0, (4, 300))
    g = np.stack([np.c_[v, np.ones(300)].T @ (np.c_[v, np.ones(300)] * k[:, None]) for k in w])
    masks = np.array([0, 1, 5, 12, 31, 22])
    seen = {}
    for node in lattice.walk(g, [2, 9], [3, 4, 5, 6, 7], masks, [0, 1]):
        seen[node.mask] = node
        for i, y in enumerate((0, 1)):
            want = ols.fit(g, node.cols, y, full=False)
            assert np.allclose(node.b[:, :, i], want["b"]) and np.allclose(node.error[:, i] / g[:, 9, 9], 0, atol=1e-8)
            r = ols.finish(node.b[:, :, i], node.inverse, node.rss[:, i], np.zeros(4), g[:, 9, 9], g[:, y, y], g[:, y, 9], len(node.cols), full=False)
            assert np.allclose(r["se"], want["se"]) and np.allclose(r["r2"], want["r2"])
    assert sorted(seen) == sorted(masks.tolist()) and not seen[31].weak.any()
    assert seen[5].cols == [2, 9, 3, 5]
    no_one = next(lattice.walk(g, [2], [3], np.array([1]), [0]))
    want = ols.fit(g, [2, 3], 0, full=False)
    assert np.allclose(1 - (no_one.rss[:, 0] / g[:, 9, 9] - (no_one.error[:, 0] / g[:, 9, 9]) ** 2) / (g[:, 0, 0] / g[:, 9, 9] - (g[:, 0, 9] / g[:, 9, 9]) ** 2), want["r2_raw"])
    v[:, 4] = 2 * v[:, 3] - 1
    weak = {n.mask: n.weak.all() for n in lattice.walk(gram_of(v)[None], [2, 9], [3, 4, 5], np.arange(8), [0])}
    assert weak == {m: m & 3 == 3 for m in range(8)}


def test_masks_are_ranked_like_subsets():
    items = list("abcdefg")
    want = [space.bitmask(s, items) for s in space.all_subsets(items)]
    assert lattice.rank_masks(np.arange(128), 7)[want].tolist() == list(range(128))
    assert lattice.rank_masks(np.array([0, 1 << 39, (1 << 40) - 1]), 40).tolist() == [0, 40, (1 << 40) - 1]


def test_complete_sums_by_either_way():
    rng = np.random.default_rng(1)
    p, v, needs = rng.integers(0, 64, 50), rng.normal(size=(50, 3)), np.arange(64)
    assert np.allclose(patterns.complete_sums(p, v, needs, 6), patterns.complete_sums(p, v, needs, 13))
    assert np.allclose(patterns.complete_sums(p, v, needs[5:6], 6)[0], v[(p & 5) == 0].sum(0))


@pytest.mark.parametrize("cells", [1 << 17, 64])
def test_cuts_are_the_rows_at_which_folds_begin(spark, monkeypatch, cells):
    monkeypatch.setattr(patterns, "CELLS", cells)
    rng = np.random.default_rng(2)
    p = np.where(rng.random(3000) < 0.3, rng.integers(0, 8, 3000), 0)
    df = spark.createDataFrame(pd.DataFrame({"rid": np.arange(3000), "__pattern": p})).repartition(5)
    needs = list(range(8))
    sizes = patterns.counts(df, needs, 3)
    cuts = patterns.cut_points(df, 3000, sizes, 7, 3)
    for need in needs:
        rows = np.flatnonzero((p & need) == 0)
        assert sizes[need] == len(rows)
        assert cuts[need].tolist() == [int(part[0]) for part in np.array_split(rows, 7)[1:]]
    few = df.where("rid < 3")
    assert patterns.cut_points(few, 3, {0: 3, 7: 1}, 3, 3)[7].tolist()[-1] == 3


@pytest.fixture(scope="module")
def holed():
    rng = np.random.default_rng(11)
    d = pd.DataFrame(rng.normal(size=(400, 7)), columns=["y", "x", "a", "b", "c", "d", "e"])
    d["y"] += d["x"] + 0.3 * d["a"]
    for k, c in enumerate("abcd"):
        d.loc[rng.random(400) < 0.05 * (k + 1), c] = np.nan
    d["g"] = rng.integers(0, 40, 400)
    d["z"] = (d["y"] > 0).astype(int)
    return d


def jobs_of(spark, run):
    group = f"g{np.random.default_rng().integers(1 << 60)}"
    spark.sparkContext.setJobGroup(group, "test")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def plain_scores(x, y, k):
    out = []
    for test in np.array_split(np.arange(len(y)), k):
        train = np.setdiff1d(np.arange(len(y)), test)
        b = np.linalg.lstsq(x[train], y[train], rcond=None)[0]
        out.append(1 - ((y[test] - x[test] @ b) ** 2).sum() / ((y[test] - y[train].mean()) ** 2).sum())
    return out


def test_null_patterns_in_one_scan(spark, holed):
    z = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(holed.drop(columns=["g"])).coalesce(1)
    fitted = {}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")

        def run(name, frame):
            r = OLSRobust(["y"], ["x"], frame).fit(controls=z, draws=20, kfold=4, seed=3, shap=False).get_results()
            fitted[name] = r, r.full.collect(), r.oos.collect(), r.boot.collect()

        many = jobs_of(spark, lambda: run("many", df))
        one = jobs_of(spark, lambda: run("one", df.na.fill(0.0, ["b", "c", "d"])))
    assert many <= one + 4, (many, one)  # the cuts of many sets may take a scan or two more, however many sets
    _, full, oos, boot = fitted["many"]
    scores = {}
    for r in oos:
        scores.setdefault(r.spec_id, {})[r.fold] = r.metric
    assert len(full) == 32 and len(boot) == 640
    for r in full:
        d = holed.dropna(subset=list(r.controls))
        x, y = np.c_[d["x"], np.ones(len(d)), d[list(r.controls)]], d["y"].to_numpy()
        assert r.nobs == len(d) and np.allclose(r.b, np.linalg.lstsq(x, y, rcond=None)[0])
        assert np.allclose([scores[r.spec_id][f] for f in range(4)], plain_scores(x, y, 4))
        own = [b.beta for b in boot if b.spec_id == r.spec_id]
        assert len(own) == 20 and abs(np.mean(own) - r.beta) < 0.1


def test_null_patterns_with_groups(spark, holed):
    df = spark.createDataFrame(holed)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        r = OLSRobust(["y"], ["x"], df).fit(controls=["a", "b"], group="g", draws=6, kfold=3, seed=3, shap=False).get_results()
    for row in r.full.collect():
        d = holed.dropna(subset=list(row.controls))
        cols = ["y", "x", *row.controls]
        v = (d[cols] - d.groupby("g")[cols].transform("mean")).to_numpy()
        assert row.nobs == len(d) and np.allclose(row.b, np.linalg.lstsq(v[:, 1:], v[:, 0], rcond=None)[0])
    assert r.oos.count() == 12 and r.boot.where("beta IS NULL OR isnan(beta)").count() == 0 and r.boot.count() == 24


def test_logit_null_patterns_and_blocks(spark, holed):
    df = spark.createDataFrame(holed)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        r = LRobust(["z"], ["x"], df).fit(controls=["a", "b"], draws=3, kfold=2, seed=3, shap=False).get_results()
    for row in r.full.collect():
        d = holed.dropna(subset=list(row.controls))
        x = np.c_[d["x"], np.ones(len(d)), d[list(row.controls)]]
        assert row.nobs == len(d) and np.abs(x.T @ (d["z"] - 1 / (1 + np.exp(-x @ np.array(row.b))))).max() < 1e-5
    assert r.oos.count() == 8 and r.boot.count() == 12


def test_blocks_of_models_meet_slices_of_rows(spark, holed, monkeypatch):
    monkeypatch.setattr(logit, "SLICE", 64)
    rows = spark.createDataFrame(holed[["z", "x", "e"]].assign(unit=np.arange(400), pattern=0)).withColumnRenamed("pattern", "__pattern").cache()
    specs = spark.createDataFrame([(0, 0, [0]), (1, 0, [0, 1])], "spec_id long, need long, cols array<int>")
    models = logit.model_frame(specs, {0: 1.3}, draws=5, apart=True)
    near, far = ({(r.spec_id, r.draw): (r.beta, r.done) for r in logit.newton(rows, "z", ["x", "e"], models, 3, 7, block).collect()} for block in (1024, 2))
    assert len(near) == 10 and near.keys() == far.keys()
    for k, (beta, done) in near.items():
        assert done and far[k][1] and np.allclose(beta, far[k][0])
    w = moments.poisson(moments.uniform(7, np.arange(400), np.array([2]), 2), 1.3)[:, 0]
    x = np.c_[holed[["x", "e"]], np.ones(400)]
    assert np.abs(x.T @ (w * (holed["z"] - 1 / (1 + np.exp(-x @ np.array(near[1, 2][0])))))).max() < 1e-5


def test_long_lattices_have_no_list_of_specifications(spark):
    rng = np.random.default_rng(3)
    d = pd.DataFrame(rng.normal(size=(300, 20)), columns=["y", "x", *[f"z{i}" for i in range(18)]])
    df = spark.createDataFrame(d)
    z = [f"z{i}" for i in range(18)]
    some = OLSRobust(["y"], ["x"], df).fit(controls=z, draws=4, kfold=0, seed=3, z_specs_sample_size=300, shap=False).get_results()
    assert some.full.count() == 300 and some.boot.count() == 1200
    whole = OLSRobust(["y"], ["x"], df).fit(controls=z[:10], draws=0, kfold=0, seed=3, shap=False).get_results()
    assert whole.full.select("spec_id").distinct().count() == 1024
    order = [tuple(r.controls) for r in whole.full.orderBy("spec_id").collect()]
    assert order == space.all_subsets(z[:10])
    for r in [*some.full.limit(5).collect(), *whole.full.where("spec_id % 300 = 7").collect()]:
        x = np.c_[d["x"], np.ones(300), d[list(r.controls)]]
        assert np.allclose(r.b, np.linalg.lstsq(x, d["y"], rcond=None)[0])


@pytest.mark.parametrize("rate", [0.5, 1.0, 64, 100, 1000])
def test_poisson_at_any_rate(rate):
    w = moments.poisson(moments.uniform(3, np.arange(20_000), np.arange(10)), rate)
    assert abs(w.mean() / rate - 1) < 0.01 and abs(w.var() / rate - 1) < 0.03
    if rate == 1.0:
        assert np.allclose([(w == k).mean() for k in range(4)], [0.3679, 0.3679, 0.1839, 0.0613], atol=0.004)


def test_a_column_that_is_nearly_all_null(spark):
    rng = np.random.default_rng(4)
    d = pd.DataFrame(rng.normal(size=(5000, 3)), columns=["y", "x", "z"])
    d.loc[50:, "z"] = np.nan
    r = OLSRobust(["y"], ["x"], spark.createDataFrame(d)).fit(controls=["z"], draws=5, kfold=2, shap=False).get_results()
    assert {x.nobs for x in r.full.collect()} == {5000, 50} and r.boot.where("beta IS NOT NULL").count() == 10


def test_draws_are_shared_or_independent(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(300, 3)), columns=["y", "x", "z"]))

    def correlation(**kw):
        r = OLSRobust(["y"], ["x"], df).fit(controls=["z"], draws=400, kfold=0, seed=3, shap=False, **kw).get_results()
        p = r.boot.toPandas().pivot(index="draw", columns="spec_id", values="beta_null")
        return p.corr().iloc[0, 1], p.std()

    shared, sd = correlation()
    apart, sd2 = correlation(mode="independent")
    assert shared > 0.9 and abs(apart) < 0.17 and np.allclose(sd, sd2, rtol=0.2)
    assert abs(correlation(mode="independent", rng="hash")[0]) < 0.17
    with pytest.raises(ValueError, match="mode"):
        OLSRobust(["y"], ["x"], df).fit(controls=["z"], mode="none")


def test_blocks_of_draws_equal_one_block(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(200, 2)), columns=["y", "x"]).assign(rid=np.arange(200), pattern=rng.integers(0, 2, 200))).withColumnRenamed("pattern", "__pattern").repartition(3)
    units = [moments.Unit(5, 0, 1.0), moments.Unit(6, 1, 1.4, 9, (1,))]
    made = lambda: {(r.unit, r.draw): r.gram for r in moments.poisson_grams(df, ["y", "x"], units, 10, 3).collect()}
    one = made()
    monkeypatch.setattr(moments, "HELD_BYTES", 8 * 6 * 3)
    many = made()
    assert len(one) == 20 and one.keys() == many.keys() and all(np.allclose(one[k], many[k]) for k in one)
    pdf = df.toPandas()
    w = moments.poisson(moments.uniform(3, pdf["rid"].to_numpy(), np.array([4]), 9), 1.4)[:, 0] * (pdf["__pattern"] == 0)
    assert np.allclose(one[6, 4], [0, 0, 0, (w * pdf["x"] ** 2).sum(), (w * pdf["x"]).sum(), w.sum()])


def plain_greedy(sizes, k):
    load, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda t: (-t[1], t[0])):
        f = min(range(k), key=load.__getitem__)
        load[f] += n
        out[g] = f
    return out


@pytest.mark.parametrize("k", [2, 3, 7])
def test_group_folds_are_the_plain_greedy(spark, k):
    rng = np.random.default_rng(k)
    many = {i: int(n) for i, n in enumerate(rng.integers(1, 6, 300))}
    for sizes in (many, many | {500: 900, 501: 13}, dict.fromkeys(range(20), 2), {i: i + 1 for i in range(k)}):
        df = spark.createDataFrame([(0, g, n) for g, n in sizes.items()] + [(1, g, 3) for g in range(10)], "need long, `__group` long, size long")
        got = groups.dealt(df, k).where("need = 0").collect()
        assert {r["__group"]: r.fold for r in got} == plain_greedy(sizes, k)
        assert sorted(r.g_idx for r in got) == list(range(len(sizes)))
    with pytest.raises(ValueError, match="groups"):
        groups.dealt(spark.createDataFrame([(0, 1, 5)], "need long, `__group` long, size long"), 2)
    rows = spark.createDataFrame([(g,) for g, n in many.items() for _ in range(n)], "g long")
    assert {r["__group"]: r.fold for r in prepare.group_folds(rows, "g", k).collect()} == plain_greedy(many, k)


def test_draws_of_singletons_are_tried_again(spark):
    # Three groups of 6 rows among 30 single ones: a draw without a large group has too few rows that stay.
    sizes = [6, 6, 6, *[1] * 30]
    table = spark.createDataFrame([(0, i, n, [float(n)]) for i, n in enumerate(sizes)], "need long, g_idx long, size long, gram array<double>").cache()
    stats = {0: {"n": 33, "mean": np.mean(sizes), "sd": np.std(sizes), "least": 1}}
    units = [moments.Unit(0, 0, 1.0)]
    first = moments.cluster_counts(table.select("need", "g_idx", "size"), stats, units, 8, None, 60, 3).where("times * size > 1").groupBy("draw").agg(F.sum(F.col("times") * F.col("size")).alias("n")).toPandas()
    short = 60 - int((first["n"] >= 5).sum())
    assert short > 3
    got = {r.draw: r.gram[0] for r in moments.cluster_grams(table, stats, units, 8, 60, 3, 5, 1).collect()}
    assert len(got) == 60 and min(got.values()) >= 5
    alone = spark.createDataFrame([(0, i, 1, [1.0]) for i in range(12)], "need long, g_idx long, size long, gram array<double>")
    with pytest.warns(UserWarning, match="groups of one row"):
        kept = moments.cluster_grams(alone, {0: {"n": 12, "mean": 1.0, "sd": 0.0, "least": 1}}, units, 12, 4, 3, 100, 1).collect()
    assert [r.gram[0] for r in kept] == [12.0] * 4


def test_long_draws_are_summed_up_by_runs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    sizes = spark.createDataFrame([(0, i, int(n)) for i, n in enumerate(rng.integers(1, 9, 50))], "need long, g_idx long, size long").cache()
    r = sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.stddev_pop("size").alias("sd"), F.min("size").alias("least")).first().asDict()
    made = lambda: sorted(map(tuple, moments.cluster_counts(sizes, {0: r}, [moments.Unit(0, 0, 1.0)], 230, None, 5, 3).collect()))
    whole = made()
    monkeypatch.setattr(moments, "PICKS", 7)
    assert made() == whole and all(sum(n * t for _, d, _, _, n, t in whole if d == k) >= 230 for k in range(5))


def test_hc1_of_the_whole_curve(spark, holed):
    from polyspec.operators.robust import hc1_curve

    d = holed.assign(y=holed["y"] + holed["x"] ** 2)
    rows = hc1_curve(spark.createDataFrame(d), "y", ["x"], ["a", "e"]).collect()
    assert len(rows) == 4
    for r in rows:
        own = d.dropna(subset=list(r.controls))
        x, y = np.c_[own["x"], np.ones(len(own)), own[list(r.controls)]], own["y"].to_numpy()
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        e, inverse = y - x @ b, np.linalg.inv(x.T @ x)
        want = inverse @ ((x * (e**2)[:, None]).T @ x) @ inverse * len(x) / (len(x) - x.shape[1])
        assert r.nobs == len(x) and np.allclose(r.b, b) and np.allclose(r.se, np.sqrt(np.diag(want)))


def test_order_statistics_by_sorting(spark):
    from polyspec.operators import inference

    rng = np.random.default_rng(4)
    rows = [(s, d, float(v)) for s, n in ((0, 1), (3, 2), (5, 101), (9, 40)) for d, v in enumerate(rng.normal(size=n).round(1))]
    boot = spark.createDataFrame([*rows, (5, 200, None), (5, 201, float("nan"))], "spec_id long, draw int, beta double")
    one, two = (sorted(map(tuple, inference.boot_summary(boot, draws=n).collect())) for n in (0, 1 << 30))
    assert len(one) == 4 and np.allclose(np.array(one, float), np.array(two, float), rtol=1e-15)


def test_null_correlations_by_tiles(spark):
    from polyspec.operators import inference

    rng = np.random.default_rng(6)
    p, b = rng.uniform(0.01, 1, (7, 30)), rng.normal(size=(7, 30))
    p[2] = 0.5
    b[2] = 1.0  # it doesn't vary
    boot = spark.createDataFrame([(s, d, float(b[s, d]), float(p[s, d]) if (s, d) != (4, 3) else None) for s in range(7) for d in range(30)], "spec_id long, draw int, beta_null double, p_null double")
    kept = [0, 1, 3, 5, 6]
    assert {r.spec_id for r in inference.keep_mask(boot).where("kept").collect()} == set(kept)
    z = inference.signed_z(p, b)[kept]
    want = np.corrcoef(z)
    for tile in (2, 256):
        got = {(r.a, r.b): r.r for r in inference.null_correlation(boot, 1e-12, tile).collect()}
        assert len(got) == 25 and all(np.isclose(got[x, y], want[i, j], atol=1e-9) for i, x in enumerate(kept) for j, y in enumerate(kept))
    full = spark.createDataFrame([(s, 0.5, 0.02) for s in range(7)], "spec_id long, beta double, pval double")
    r = inference.stouffer(full, boot).first()
    own = [s for s in kept]
    z1, p1 = inference.stouffer_method([0.02] * 5, betas=[0.5] * 5, p_values_ystar=p[own], betas_ystar=b[own])
    assert r.stouffer_kept == 5 and np.isclose(r.stouffer_z, z1) and np.isclose(r.stouffer_p, p1)
    assert np.isclose(r.mean_correlation, (want.sum() - 5) / 20)
    none = inference.stouffer(full, boot.withColumn("p_null", F.lit(None).cast("double"))).first()
    assert np.isclose(none.stouffer_z, inference.stouffer_method([0.02] * 7, betas=[0.5] * 7)[0]) and none.mean_correlation is None
    assert np.isclose(none.stouffer_p, inference.stouffer_method([0.02] * 7, betas=[0.5] * 7)[1])
    odd = inference.stouffer(full.withColumn("pval", F.when(F.col("spec_id") != 3, F.col("pval"))), boot).first()
    assert odd.stouffer_kept == 4 and np.isclose(odd.stouffer_z, 4 * z1 * np.sqrt(want.sum()) / 5 / 2)


def test_generators(spark):
    from polyspec.sources import readers

    d = readers.binary_data(spark, 501, 3)
    assert d.columns == ["id", "y1", "x1", "z1", "z2", "z3"] and d.agg(F.sum("y1")).first()[0] == 250
    m = readers.multi_outcome_data(spark, 50)
    assert m.count() == 50 and {"y4", "x5", "z4"} <= set(m.columns)


def test_smoothing_by_blocks_and_density_by_bins(spark):
    from polyspec.functions import stats
    from polyspec.operators import panels

    rng = np.random.default_rng(2)
    y = np.sin(np.arange(1, 151) / 20) + rng.normal(size=150) / 5
    curve = spark.createDataFrame([(i, int(i), float(v)) for i, v in enumerate(y, 1)], "spec_id long, position int, lo double").repartition(4)
    want = stats.lowess(np.arange(1.0, 151), y, 0.3)
    for block in (16, 4096):
        got = {r.position: r.smooth_lo for r in panels.smoothed(curve, ["lo"], block).collect()}
        assert len(got) == 150 and np.allclose([got[i] for i in range(1, 151)], want)
    v = rng.normal(size=500)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", float(3 * x)) for x in v[:200]] + [("c", 1.0), ("a", None)], "f string, v double")
    got = panels.binned_density(df, "v", "f").toPandas()
    assert set(got["f"]) == {"a", "b"}
    for f, x in (("a", v), ("b", 3 * v[:200])):
        own = got[got["f"] == f].sort_values("x")
        assert np.allclose(own["density"], stats.kde(x, own["x"].to_numpy()), atol=2e-4)
    order = panels.curve_order(spark.createDataFrame([(4, 1.0), (2, 1.0), (7, -1.0)], "spec_id long, median double"))
    assert {r.spec_id: r.position for r in order.collect()} == {7: 1, 2: 2, 4: 3}


def test_default_draws_of_all_lines_agree_with_a_plain_bootstrap(spark):
    """The rows' numbers aren't fixed after a join, so the quantiles are held against those of other draws."""
    from polyspec.plans import catalog

    sf = "/root/testdata/sf0.001"
    d = catalog.lines(spark, sf).select("y", "x", *catalog.Z).toPandas().to_numpy(float)
    rng = np.random.default_rng(2)
    got = {r.spec: r for r in catalog.boot_lines(spark, sf).collect()}
    assert len(got) == 8
    drawn = []
    for name, r in got.items():
        use = [1, *[2 + catalog.Z.index(c) for c in name.split(",") if c]]
        v = np.c_[d[:, use], np.ones(len(d))]
        b = []
        for _ in range(400):
            at = rng.integers(0, len(d), len(d))
            b.append(np.linalg.lstsq(v[at], d[at, 0], rcond=None)[0][0])
        drawn += b
        spread = np.std(b)
        assert abs(r.median - np.median(b)) < 0.3 * spread
        assert abs(r.ci_down - np.quantile(b, 0.025)) < 0.5 * spread and abs(r.ci_up - np.quantile(b, 0.975)) < 0.5 * spread
        assert r.min < r.ci_down < r.median < r.ci_up < r.max
    i = catalog.boot_lines_inference(spark, sf).first()
    assert abs(i["median"] - np.median(drawn)) < 0.3 * np.std(drawn)
    assert abs(i["pos_prop"] - np.mean(np.array(drawn) > 0)) < 0.05 and abs(i["pos_prop"] + i["neg_prop"] - 1) < 1e-9


def plain_metric(metric, y, p, share):
    """A held-out metric from outcomes, probabilities and the other folds' share of 1s."""
    from polyspec.functions import stats

    ll = lambda q, c=1e-15: np.sum(y * np.log(np.clip(q, c, 1 - c)) + (1 - y) * np.log(np.clip(1 - q, c, 1 - c)))
    if metric == "imv":
        q = y.mean()
        return stats.imv(ll(p, 1e-4) / len(y), q * np.log(q) + (1 - q) * np.log(1 - q))
    null = np.full(len(y), share)
    return {"rmse": np.sqrt(np.mean((y - p) ** 2)), "pseudo-r2": 1 - np.sum((y - p) ** 2) / np.sum((y - null) ** 2), "mcfaddens-r2": 1 - ll(p) / ll(null), "cross-entropy": -ll(p) / len(y)}[metric]


@pytest.mark.parametrize("holes", [False, True])
@pytest.mark.parametrize("metric", ["imv", "cross-entropy", "pseudo-r2", "rmse", "mcfaddens-r2"])
def test_equal_rows_count_as_one_in_logistic_steps(spark, monkeypatch, metric, holes):
    """Folds by the plain rule, and held-out metrics from whole rows; the steps read each kind of row once."""
    rng = np.random.default_rng(8)
    d = pd.DataFrame({"x": rng.integers(0, 3, 700) / 2, "z": rng.integers(0, 2, 700).astype(float)})
    d["y"] = (rng.uniform(size=700) < 1 / (1 + np.exp(1 - 2 * d["x"] + d["z"]))).astype(float)
    if holes:
        d.loc[::9, "x"] = np.nan
    read = []
    newton = logit.newton
    monkeypatch.setattr(logit, "newton", lambda rows, *a, **kw: (read.append(rows.count()), newton(rows, *a, **kw))[1])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        r = LRobust(["y"], ["x"], spark.createDataFrame(d)).fit(controls=["z"], draws=0, kfold=3, seed=7, oos_metric=metric, shap=False).get_results()
    assert len(read) == 1 and read[0] <= 2 * 3 * 2 * 3  # outcomes, x, z and folds
    d = d.sort_values(["y", "x", "z"], na_position="first").reset_index(drop=True)
    d["rid"] = np.arange(len(d))
    d = d.dropna()
    d["key"] = [hashlib.md5(f"7|{i}".encode()).hexdigest() for i in d["rid"]]
    d["fold"] = d.sort_values(["key", "rid"]).groupby("y").cumcount() % 3
    got = {(tuple(s.controls), o.fold): o.metric for s in r.full.collect() for o in r.oos.where(F.col("spec_id") == s.spec_id).collect()}
    assert len(got) == 6 and {s.nobs for s in r.full.collect()} == {len(d)}
    for (controls, fold), value in got.items():
        v = np.c_[d[["x", *controls]], np.ones(len(d))]
        train, b = (d["fold"] != fold).to_numpy(), np.zeros(v.shape[1])
        for _ in range(20):
            p = 1 / (1 + np.exp(-v[train] @ b))
            b += np.linalg.solve((v[train] * (p * (1 - p))[:, None]).T @ v[train], v[train].T @ (d["y"][train] - p))
        y = d["y"].to_numpy()
        assert np.isclose(value, plain_metric(metric, y[~train], 1 / (1 + np.exp(-v[~train] @ b)), y[train].mean()), atol=1e-8)


def test_rows_of_many_kinds_are_left_apart(spark, monkeypatch):
    rng = np.random.default_rng(9)
    d = pd.DataFrame({"x": rng.normal(size=300), "y": rng.integers(0, 2, 300).astype(float)})
    monkeypatch.setattr(logit, "equal_rows", lambda *_: pytest.fail("no two rows are equal"))
    r = LRobust(["y"], ["x"], spark.createDataFrame(d)).fit(controls=[], draws=0, kfold=3, shap=False).get_results()
    assert r.full.first().nobs == 300 and r.oos.count() == 3


def test_rows_without_draws_or_folds_are_joined_by_kind(spark):
    rng = np.random.default_rng(10)
    d = pd.DataFrame({"x": rng.integers(0, 4, 500).astype(float), "y": rng.integers(0, 2, 500).astype(float)})
    one = LRobust(["y"], ["x"], spark.createDataFrame(d)).fit(controls=[], draws=0, kfold=0, shap=False).get_results().full.first()
    x = np.c_[d["x"], np.ones(500)]
    p = 1 / (1 + np.exp(-x @ np.array(one.b)))
    assert one.nobs == 500 and np.abs(x.T @ (d["y"] - p)).max() < 1e-6
    assert np.allclose(one.se, np.sqrt(np.diag(np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x))))


@pytest.mark.parametrize("rate", [0, 0.3, 1.0, 1.4, 7.5, 64, 65, 1000])
def test_counts_by_leading_bits_are_those_of_whole_numbers(rate):
    x = moments.mixed(3, np.arange(3000), np.arange(40), 2)
    assert (x * 2.0**-64 == moments.uniform(3, np.arange(3000), np.arange(40), 2)).all()
    assert (moments.poisson_of(x, rate) == moments.poisson(x * 2.0**-64, rate)).all()
    ends = np.arange(1 << moments.TABLE_BITS, dtype=np.uint64) << np.uint64(64 - moments.TABLE_BITS)
    ends = np.stack([ends, ends + np.uint64((1 << 64 - moments.TABLE_BITS) - 1)])
    assert (moments.poisson_of(ends, rate) == moments.poisson(ends * 2.0**-64, rate)).all()
    if rate == 1:
        assert (moments.count_table(rate) == moments.UNTOLD).sum() < 20


def test_draws_are_made_in_blocks_of_rows_and_draws(spark, monkeypatch):
    df = spark.range(700, numPartitions=1).select(F.col("id").alias("rid"), F.lit(0).cast("long").alias("__pattern"), (F.col("id") % 5).cast("double").alias("y"))
    units = [moments.Unit(0, 0, 1.0)]
    made = lambda: {r.draw: r.gram for r in moments.poisson_grams(df, ["y"], units, 40, 3).collect()}
    whole = made()
    monkeypatch.setattr(moments, "ROWS_AT_ONCE", 64)
    monkeypatch.setattr(moments, "DRAWS_AT_ONCE", 16)
    parts = made()
    w = moments.poisson(moments.uniform(3, np.arange(700), np.arange(40)), 1.0)
    y = np.arange(700) % 5.0
    for d in range(40):
        assert np.allclose(whole[d], [w[:, d] @ y**2, w[:, d] @ y, w[:, d].sum()]) and np.allclose(whole[d], parts[d])


def test_fits_of_joined_lines_read_them_from_one_written_table(spark, monkeypatch):
    from polyspec import estimators
    from polyspec.plans import catalog

    sf, read = "/root/testdata/sf0.001", []

    def seen(data, columns):
        read.append({f.rsplit("/", 2)[-2].split("-")[0] for f in data.inputFiles()})

    monkeypatch.setattr(estimators.spec, "warn_missing", seen)
    i = catalog.boot_lines_inference(spark, sf).first()
    assert read == [{"lines"}] and i["median"] is not None
    catalog.queries()["logit_rmse"](spark, sf)
    assert read == [{"lines"}] * 2


@pytest.mark.parametrize("digits", [1, 15])
def test_kinds_are_dealt_as_their_rows(spark, monkeypatch, digits):
    """Numbers and folds of rows that are never written, in runs, chunks and ranges of a few; with one digit, most rows tie."""
    for name, value in (("KINDS", 4), ("CHUNK", 7), ("RANGE", 64), ("DIGITS", digits)):
        monkeypatch.setattr(prepare, name, value)
    rng = np.random.default_rng(11)
    d = pd.DataFrame({"y": rng.integers(0, 2, 900) * 1.0, "x": rng.integers(0, 9, 900) * 1.0})
    d.loc[d["x"] == 3, "x"] = None
    counts = d.groupby(["y", "x"], dropna=False).size().astype(float).rename("__times").reset_index()
    counts["x"] = counts["x"].astype(object).where(counts["x"].notna(), None)
    kinds = prepare.first_rows(spark.createDataFrame(counts, "y double, x double, __times double"), ["y", "x"], "__times", "rid")
    d = d.sort_values(["y", "x"], na_position="first").reset_index(drop=True)
    d["rid"] = np.arange(len(d))
    first = d.groupby(["y", "x"], dropna=False)["rid"].transform("min")
    assert sorted(r.rid for r in kinds.collect()) == sorted(set(first))
    got = {(r.rid, r.fold): r["__times"] for r in prepare.stratified_kinds(kinds.where("x IS NOT NULL").withColumn("__y", F.col("y")), 4, 7).collect()}
    d["first"], d["key"] = first, [hashlib.md5(f"7|{i}".encode()).hexdigest() for i in d["rid"]]
    d = d.dropna()
    d["fold"] = d.sort_values(["key", "rid"]).groupby("y").cumcount() % 4
    assert got == d.groupby(["first", "fold"]).size().to_dict()
    with pytest.raises(ValueError, match="two classes"):
        prepare.stratified_kinds(kinds.where("y = 1").withColumn("__y", F.col("y")), 4, 7)


@pytest.mark.parametrize("how", ["joined", "holes", "scaled", "group", "shap"])
def test_a_row_that_stands_for_several_counts_as_often(spark, how):
    rng = np.random.default_rng(12)
    d = pd.DataFrame({"x": rng.integers(0, 3, 60) * 1.0, "z": rng.integers(0, 3, 60) * 1.0, "y": rng.integers(0, 2, 60) * 1.0, "n": rng.integers(0, 12, 60)})
    d["g"] = np.arange(60) % 6
    if how == "holes":
        d.loc[d["z"] == 2, "z"] = np.nan
    kw = {"controls": ["z"], "draws": 0, "kfold": 3, "seed": 7, "shap": how == "shap", "rescale_x": how == "scaled", "group": "g" if how == "group" else None}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        short = LRobust(["y"], ["x"], spark.createDataFrame(d)).fit(times="n", **kw).get_results()
        long = LRobust(["y"], ["x"], spark.createDataFrame(d.loc[d.index.repeat(d["n"])].drop(columns="n"))).fit(**kw).get_results()
    table = lambda r: [(*s.b, *s.se, s.nobs) for s in r.full.orderBy("spec_id").collect()] + [(o.metric,) for o in r.oos.orderBy("spec_id", "fold").collect()]
    assert all(np.allclose(a, b, atol=1e-8) for a, b in zip(table(short), table(long), strict=True))
    with pytest.raises(ValueError, match="times"):
        LRobust(["y"], ["x"], spark.createDataFrame(d)).fit(times="z", **kw)


@pytest.mark.parametrize("name", ["logit_xent", "logit_pseudo_r2", "logit_rmse", "logit_mcfadden"])
def test_logistic_folds_of_lines_sort_no_rows(spark, monkeypatch, name):
    """Only kinds of lines are sorted, and the result is that of the SQL."""
    import duckdb

    from polyspec.plans import catalog

    sf, sorted_ = "/root/testdata/sf0.001", []
    with_row_index = prepare.with_row_index
    monkeypatch.setattr(prepare, "with_row_index", lambda df, *a, **kw: (sorted_.append(df.count()), with_row_index(df, *a, **kw))[1])
    got = {r.spec: r.metric for r in catalog.queries()[name](spark, sf).collect()}
    lines, kinds = catalog.logit_data(spark, sf).count(), catalog.logit_data(spark, sf).select("y", "x", "z1").distinct().count()
    assert kinds < lines and sorted_ == [kinds]
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = dict(con.execute(catalog.oracle_sql()[name]).fetchall())
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
