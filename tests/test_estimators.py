import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyspec import estimators
from polyspec.estimators import LRobust, MergedResult, OLSRobust, Result
from polyspec.operators import inference, panels, prepare
from polyspec.plans.spec import MissingValueWarning
from polyspec.sources import readers


@pytest.fixture(scope="module")
def pdf():
    import pandas as pd

    rng = np.random.default_rng(0)
    d = pd.DataFrame(rng.normal(size=(100, 5)), columns=["y", "x1", "x2", "control1", "control2"])
    d["y"] += 0.5 * d["x1"]
    d["group"] = rng.integers(1, 5, 100)
    d["binary_y"] = (d["y"] > 0).astype(int)
    d["text"] = "a"
    return d


@pytest.fixture(scope="module")
def data(spark, pdf):
    return spark.createDataFrame(pdf).cache()


@pytest.fixture(scope="module")
def fitted(data):
    return OLSRobust(["y"], ["x1"], data).fit(controls=["control1", "control2"], draws=20, kfold=5, seed=1).get_results()


def test_full_curve(fitted, pdf):
    rows = {tuple(r.controls): r for r in fitted.full.collect()}
    assert len(rows) == 4
    for controls, r in rows.items():
        x = np.c_[pdf["x1"], np.ones(100), pdf[list(controls)]]
        assert np.allclose(r.b, np.linalg.lstsq(x, pdf["y"], rcond=None)[0]) and r.nobs == 100 and r.predictors == ["x1", "const", *controls]
    assert fitted.oos.count() == 20 and fitted.boot.count() == 80
    summary = {tuple(r.spec_name): r for r in fitted.summary_df.collect()}
    assert summary[()].ci_down <= summary[()].median <= summary[()].ci_up and summary[()].av_k_metric is not None
    assert abs(summary[()].median - rows[()].beta) < 0.2


def test_joint_inference(fitted):
    r = fitted.inference.first()
    boot, full = fitted.boot.toPandas(), fitted.full.toPandas()
    assert np.isclose(r.median_ns, full["beta"].median()) and np.isclose(r["median"], boot["beta"].median())
    null = boot.groupby("draw")["beta_null"].median()
    assert np.isclose(r.median_p, (null.abs() >= abs(r.median_ns)).mean())
    w = np.exp(-0.5 * (full["bic"] - full["bic"].min()))
    assert np.isclose(r.bic_average, (w * full["beta"]).sum() / w.sum())
    p = full.sort_values("spec_id")["pval"].to_numpy()
    null_p, null_b = (boot.pivot(index="spec_id", columns="draw", values=c).to_numpy() for c in ("p_null", "beta_null"))
    z, combined = inference.stouffer_method(p, betas=full.sort_values("spec_id")["beta"], p_values_ystar=null_p, betas_ystar=null_b)
    assert np.isclose(r.stouffer_z, z, rtol=1e-6) and np.isclose(r.stouffer_p, combined)
    off = np.corrcoef(np.stack([row for row in _z(null_p, null_b)]))
    assert np.isclose(r.mean_correlation, (off.sum() - 4) / 12)


def _z(p, b):
    from polyspec.functions.stats import signed_z

    return signed_z(p, b)


def test_report_round_trip_and_merge(spark, fitted, tmp_path):
    text = fitted.summary()
    assert "OLS Robust" in text and "Number of specifications: 4" in text
    fitted.save(str(tmp_path / "r"))
    back = Result.load(spark, str(tmp_path / "r"))
    assert back.full.count() == 4 and back.model == fitted.model
    fitted.save_to_csv(str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 4
    merged = fitted.merge(back, "left", "right")
    assert merged.full.count() == 8 and merged.summary_df.count() == 8 and "Merged" in merged.summary()
    with pytest.warns(UserWarning):
        assert merged.plot() is None
    with pytest.raises(TypeError):
        fitted.merge(fitted, 1, "b")
    other = MergedResult(["other"], merged.full, merged.boot)
    with pytest.raises(ValueError):
        merged.merge(other)
    assert estimators.concat_results([fitted, back]).full.count() == 4 and estimators.concat_results([fitted, back], de_dupe=False).full.count() == 8


def test_panels(fitted):
    tables = fitted.plot_data(specs=[["control1"]], ci=0.9)
    assert {"hexbin_r2", "hexbin_ll", "bma", "shap", "shap_density", "shap_points", "oos", "oos_density", "curve", "matrix", "ic", "bdist"} == set(tables)
    assert tables["shap_density"].select("feature").distinct().count() == 3 and sorted(r.position for r in tables["bma"].collect()) == [1, 2]
    assert tables["hexbin_r2"].agg(F.sum("n")).first()[0] == 80
    assert {r.kind for r in tables["curve"].collect()} == {"null", "full", "selected", "other"}
    assert tables["bdist"].select("spec_id").distinct().count() == 3
    probs = {r.control_var: r.probs for r in tables["bma"].collect()}
    assert set(probs) == {"control1", "control2"} and all(0 <= p <= 1 for p in probs.values())
    for bad in ({"ic": "x"}, {"specs": "a"}, {"specs": [["nope"]]}, {"specs": [[], ["control1"], ["control2"], ["control1", "control2"]]}, {"oddsratio": True}, {"ci": 2}):
        with pytest.raises(ValueError):
            fitted.plot_data(**bad)
    total = panels.shap_order(fitted.shap, 1).collect()
    assert total[0].feature == "x1" and panels.smoothed_values(fitted.shap).count() == fitted.shap.count()


def test_fixed_effects_and_cluster_bootstrap(data, pdf):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        r = OLSRobust(["y"], ["x1"], data).fit(controls=["control1"], group="group", draws=10, kfold=2, seed=3, shap=False).get_results()
    d = pdf[["y", "x1", "control1"]] - pdf.groupby("group")[["y", "x1", "control1"]].transform("mean")
    rows = {tuple(x.controls): x for x in r.full.collect()}
    assert np.allclose(rows[("control1",)].b, np.linalg.lstsq(d[["x1", "control1"]], d["y"], rcond=None)[0])
    assert r.boot.count() == 20 and r.boot.where("beta IS NULL OR isnan(beta)").count() == 0


def test_group_columns_of_any_name(spark, pdf):
    df = spark.createDataFrame(pdf[["y", "x1", "control1", "binary_y"]].assign(g=pdf["group"], fold=1.0))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ols = OLSRobust(["y"], ["x1"], df).fit(controls=["control1"], group="g", draws=3, kfold=2, seed=3, shap=False).get_results()
        lr = LRobust(["binary_y"], ["x1"], df).fit(controls=[], group="g", draws=3, kfold=2, seed=3, shap=False).get_results()
    assert ols.oos.count() == 4 and ols.boot.count() == 6 and lr.oos.count() == 2 and lr.boot.count() == 3


def test_nulls_drop_rows_by_specification(spark, pdf):
    holes = pdf.copy()
    holes.loc[:9, "control1"] = np.nan
    df = spark.createDataFrame(holes.drop(columns="text"))
    with pytest.warns(MissingValueWarning):
        OLSRobust(["y"], ["control1"], df)
    r = OLSRobust(["y"], ["x1"], df).fit(controls=["control1"], draws=5, kfold=0, seed=3).get_results()
    assert {tuple(x.controls): x.nobs for x in r.full.collect()} == {(): 100, ("control1",): 90}


def test_composites_and_samples(data):
    r = OLSRobust(["y", "x2"], ["x1"], data).fit(controls=["control1", "control2"], draws=3, kfold=2, seed=1, composite_sample=2, z_specs_sample_size=3).get_results()
    assert r.full.count() == 6 and r.model.multi_y and set(r.plot_data(loess=False)) == {"hexbin_r2", "curve", "matrix", "bdist"}
    assert r.inference.first().aic_average is None


def test_logit(data, pdf):
    r = LRobust(["binary_y"], ["x1"], data).fit(controls=["control1"], draws=4, kfold=3, oos_metric="mcfadden-r2", seed=1).get_results()
    for row in r.full.collect():
        x = np.c_[pdf[row.predictors[0]], np.ones(100), pdf[[c for c in row.predictors[2:]]]]
        p = 1 / (1 + np.exp(-x @ np.array(row.b)))
        assert np.abs(x.T @ (pdf["binary_y"] - p)).max() < 1e-5 and row.converged and 0 < row.r2 < 1
    assert r.boot.count() == 8 and r.oos.count() == 6 and "Logistic" in r.summary()
    assert r.inference.first().pos_p is None and set(r.plot_data(loess=False, oddsratio=True)) >= {"bma", "ic"}
    for metric in ("imv", "cross-entropy", "rmse", "pseudo-r2"):
        s = LRobust(["binary_y"], ["x1"], data).fit(controls=[], draws=0, kfold=2, oos_metric=metric, seed=1, shap=False).get_results()
        assert all(np.isfinite(x.metric) for x in s.oos.collect())
    with pytest.raises(ValueError, match="collinear"):
        LRobust(["binary_y"], ["x1"], data.withColumn("twice", F.col("x1") * 2)).fit(controls=["twice"], draws=0, kfold=0)
    with pytest.raises(NotImplementedError):
        LRobust(["binary_y", "y"], ["x1"], data).fit(controls=[])


@pytest.mark.parametrize("kw", [{"draws": -1}, {"draws": "a"}, {"kfold": 1}, {"kfold": 100}, {"kfold": 2.5}, {"oos_metric": "imv"}, {"seed": -1}, {"seed": 2**31}, {"n_cpu": 0}, {"group": "none"}, {"controls": ["text"]}, {"controls": ["none"]}, {"controls": ["x1"]}, {"controls": ["y"]}, {"composite_sample": 0}, {"z_specs_sample_size": 0}])
def test_bad_arguments(data, kw):
    with pytest.raises(ValueError):
        OLSRobust(["y"], ["x1"], data).fit(**({"controls": ["control1"]} | kw))


def test_bad_construction(data):
    for y, x, e in (("y", ["x1"], TypeError), (["y"], "x1", TypeError), ([], ["x1"], ValueError), (["y"], [], ValueError), (["y"], [1], TypeError), (["no"], ["x1"], ValueError)):
        with pytest.raises(e):
            OLSRobust(y, x, data)
    with pytest.raises(TypeError):
        OLSRobust(["y"], ["x1"], 3)
    with pytest.raises(TypeError):
        OLSRobust(["y"], ["x1"], data).fit(controls="control1")
    with pytest.raises(TypeError):
        OLSRobust(["y"], ["x1"], data).fit(controls=[], group=123)
    with pytest.warns(UserWarning, match="runs"):
        OLSRobust(["y"], ["x1"], data).fit(controls=["control1"], draws=1, kfold=0, threshold=1, shap=False)


def test_preparation(spark):
    df = spark.createDataFrame([(i, float(i % 3), 2.0, None if i == 4 else 1.0, i % 2) for i in range(12)], "i int, a double, c double, n double, g int")
    d, y, x, z = prepare.single_constant(df, ["i"], ["a"], ["c"])
    assert (y, x, z) == (["i"], ["a"], ["const"]) and d.agg(F.sum("const")).first()[0] == 24
    assert prepare.constant_columns(df, ["a", "c", "n"]) == ["c"]
    assert prepare.group_invariant_columns(df, ["a", "c", "g", "n"], "g") == ["c", "g"]
    idx = prepare.with_row_index(df, [F.desc("i")], "r").collect()
    assert sorted((r.r, r.i) for r in idx) == [(k, 11 - k) for k in range(12)]
    folds = df.select(prepare.contiguous_fold(F.col("i"), 12, 5).alias("f")).groupBy("f").count().collect()
    assert sorted((r.f, r["count"]) for r in folds) == [(0, 3), (1, 3), (2, 2), (3, 2), (4, 2)]
    assert prepare.group_folds(df, "a", 3).count() == 3 == prepare.group_folds(df, "a", 3, max_driver_groups=1).select("fold").distinct().count()
    with pytest.raises(ValueError):
        prepare.group_folds(df, "g", 3)
    z = prepare.rescale(df, ["i", "c"]).agg(F.avg("i"), F.stddev_pop("i"), F.count("c")).first()
    assert abs(z[0]) < 1e-12 and abs(z[1] - 1) < 1e-12 and z[2] == 0
    assert prepare.one_hot(df, "g").columns[-2:] == ["g_0", "g_1"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("junk\nx  y\n1  2\n3  4\n")
    assert [tuple(r) for r in readers.read_text(spark, str(tmp_path / "a.txt"), sep=r"\s+", skip=1).collect()] == [("1", "2"), ("3", "4")]
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    assert readers.read_text(spark, str(tmp_path / "b.csv")).first().y == 2
    import pandas as pd

    pd.DataFrame({"wage": [1.0, 2.0, 3.0], "union": [0, 1, 1], "age": [20, 30, None], "smsa": ["SMSA", "no", "SMSA"]}).to_stata(tmp_path / "u.dta", write_index=False)
    raw = readers.read_stata(spark, str(tmp_path / "u.dta"))
    y, controls, x, df = readers.union_recipe(raw)
    assert (y, x) == (["log_wage"], "union") and df.count() == 2 and abs(df.where("wage = 2").first().log_wage - 100 * np.log(2)) < 1e-9
    assert readers.regression_data(spark, 500).count() == 500 and readers.panel_data(spark, 4, 5).count() == 20
    y, x, controls, group, panel = readers.panel_recipe(readers.panel_data(spark, 4, 5), "y", "x", "period", "group", "z")
    assert panel.count() == 20 and "x_z" in controls and "year_3" in controls
    grid = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    readers.append_runs(grid.limit(1), str(tmp_path / "log"))
    done = spark.read.csv(str(tmp_path / "log"), header=True, inferSchema=True)
    assert readers.pending(grid, done, ["a", "b"]).count() == 1


def test_streaming_grams(spark, tmp_path):
    from polyspec.streaming.grams import windowed_grams

    rows = spark.createDataFrame([("2024-01-01 00:10:00", 1.0, 2.0), ("2024-01-01 00:50:00", 3.0, 1.0), ("2024-01-01 02:00:00", 5.0, 1.0)], "ts string, a double, b double").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_grams(stream, "ts", ["a", "b"], "1 hour", "10 minutes").writeStream.format("memory").queryName("grams").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    got = {r.n: r.gram for r in spark.table("grams").collect()}
    assert got[2] == [10.0, 5.0, 4.0, 5.0, 3.0, 2.0] and got[1] == [25.0, 5.0, 5.0, 1.0, 1.0, 1.0]


def test_default_folds_follow_the_input(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=103)
    y = 2 * x + rng.normal(size=103)
    spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, x, strict=True)], "y double, x double").coalesce(1).write.parquet(f"{tmp_path}/t")
    r = OLSRobust(["y"], ["x"], spark.read.parquet(f"{tmp_path}/t")).fit(controls=[], draws=0, kfold=4, seed=1, shap=False).get_results()
    want = []
    for test in np.array_split(np.arange(103), 4):
        train = np.setdiff1d(np.arange(103), test)
        b = np.linalg.lstsq(np.c_[x[train], np.ones(len(train))], y[train], rcond=None)[0]
        want.append(1 - ((y[test] - b[0] * x[test] - b[1]) ** 2).sum() / ((y[test] - y[train].mean()) ** 2).sum())
    got = [row.metric for row in r.oos.orderBy("fold").collect()]
    assert np.allclose(got, want)


def test_files_are_numbered_by_name_and_place(spark, tmp_path):
    for name, lo, hi in (("a", 0, 5), ("b", 5, 400), ("c", 400, 410)):
        spark.range(lo, hi, numPartitions=1).toPandas().to_parquet(f"{tmp_path}/{name}.parquet")
    out = prepare.in_input_order(spark.read.parquet(str(tmp_path)), "rid")
    assert out.where("rid <> id").count() == 0 and out.count() == 410 and out.columns == ["id", "rid"]
    assert prepare.in_input_order(spark.range(0), "rid").count() == 0


def test_a_sample_of_specifications_outlives_constants(spark):
    df = readers.regression_data(spark, 80, 6).withColumn("seven", F.lit(7.0)).withColumn("g", F.pmod("id", F.lit(8)))
    z = [f"z{i}" for i in range(1, 7)]
    kw = {"draws": 0, "kfold": 0, "seed": 3, "z_specs_sample_size": 4, "shap": False}
    assert OLSRobust(["y1"], ["x1"], df).fit(controls=[*z, "seven"], **kw).get_results().full.count() == 4
    with_const = df.withColumn("const", F.lit(1.0))
    assert OLSRobust(["y1"], ["x1"], with_const).fit(controls=[*z, "const"], group="g", **kw).get_results().full.count() == 4
