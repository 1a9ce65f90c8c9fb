"""Preparing operators against plain pandas and loops, with nulls, ties, hot keys, empty tables and odd names."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from polyspec.estimators import OLSRobust, Result
from polyspec.operators import prepare, sequences, tables
from polyspec.plans import scratch


@pytest.fixture(scope="module")
def panel(spark):
    """A unit holds two thirds of the rows; years have gaps, values nulls and NaN."""
    rng = np.random.default_rng(5)
    unit = np.where(rng.random(600) < 0.66, "hot", rng.choice(["a", "b", "c"], 600))
    d = pd.DataFrame({"unit": unit, "v": rng.normal(size=600) + 3})
    d["year"] = d.groupby("unit").cumcount() + (rng.random(600) < 0.1).cumsum()
    d = d.drop_duplicates(["unit", "year"]).sample(frac=1, random_state=1).reset_index(drop=True)
    rows = [(r.unit if r.unit != "c" else None, int(r.year), None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(r.v), i) for i, r in enumerate(d.itertuples())]
    return spark.createDataFrame(rows, "unit string, year int, v double, id int").cache()


def by_unit(df):
    units = {}
    for r in sorted(df.collect(), key=lambda r: (r.unit or "", r.year)):
        units.setdefault(r.unit, []).append(r)
    return units


def same(a, b):
    return a is None and b is None or a is not None and b is not None and (np.isnan(a) and np.isnan(b) or np.isclose(a, b))


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_neighbours_cross_blocks_and_stop_at_units(panel, block):
    out = sequences.neighbours(panel, ["unit"], ["year"], {"before": ("v", -2), "next": ("v", 1)}, block=block)
    assert out.columns == [*panel.columns, "before", "next"] and out.count() == panel.count()
    for rows in by_unit(out).values():
        for i, r in enumerate(rows):
            assert same(r.before, rows[i - 2].v if i >= 2 else None)
            assert same(r.next, rows[i + 1].v if i + 1 < len(rows) else None)


@pytest.mark.parametrize("logs", [False, True])
def test_gaps_give_no_difference(panel, logs):
    out = by_unit(sequences.differences(panel, ["unit"], ["year"], ["v"], step=1, logs=logs, block=5))
    seen = 0
    for rows in out.values():
        years = {r.year: r.v for r in rows}
        for r in rows:
            then = years.get(r.year - 1)
            want = None if r.v is None or then is None else r.v - then
            if logs and want is not None:
                want = np.log(r.v) - np.log(then) if r.v > 0 and then > 0 else None
            assert same(r.v_diff, want)
            seen += want is not None
    assert seen > 100


@pytest.mark.parametrize("rows,least", [(1, 1), (4, 1), (20, 3)])
def test_trailing_windows(panel, rows, least):
    made = {"total": ("v", "sum"), "mean": ("v", "avg"), "low": ("v", "min"), "n": ("v", "count")}
    for run in by_unit(sequences.trailing(panel, ["unit"], ["year"], made, rows, least, block=6)).values():
        for i, r in enumerate(run):
            v = [x.v for x in run[max(0, i - rows + 1) : i + 1] if x.v is not None and not np.isnan(x.v)]
            full = len(v) >= least
            assert r.n == len(v)
            assert same(r.total, sum(v) if full else None) and same(r.low, min(v) if full else None) and same(r.mean, np.mean(v) if full else None)


def test_ties_fall_alike_and_empty_tables_stay_empty(spark, panel):
    tied = panel.withColumn("year", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.col("id")))
    look = {"next": ("id", 1)}
    one = {(r.id, r.next) for r in sequences.neighbours(tied, ["unit"], ["year"], look).collect()}
    two = {(r.id, r.next) for r in sequences.neighbours(tied.repartition(3, "id"), ["unit"], ["year"], look, block=9).collect()}
    assert one == two
    none = panel.where("id < 0")
    assert sequences.neighbours(none, ["unit"], ["year"], look).count() == 0
    assert sequences.trailing(none, ["unit"], ["year"], {"s": ("v", "sum")}, 3).count() == 0
    with pytest.raises(ValueError):
        sequences.neighbours(panel, ["unit"], ["year"], {"v": ("v", 1)})
    with pytest.raises(ValueError):
        sequences.trailing(panel, ["unit"], ["year"], {"s": ("v", "median")}, 3)


def test_group_figures_join_back_by_null_keys_too(panel):
    out = tables.group_joins(panel, [(["unit"], {"size": F.count("*"), "first": F.min("year")}), (["first"], {"sharing": F.count("*")}), ([], {"all": F.count("*")})])
    rows = out.collect()
    sizes = pd.Series([r.unit or "" for r in rows]).value_counts()
    assert len(rows) == panel.count() == rows[0]["all"] and all(r["size"] == sizes[r.unit or ""] for r in rows)
    firsts = pd.Series([r.first for r in rows]).value_counts()
    assert all(r.sharing == firsts[r.first] for r in rows)
    assert tables.group_size(panel.where("id < 0"), ["unit"]).count() == 0
    with pytest.raises(ValueError):
        tables.group_size(panel, ["unit"], "year")


def test_index_join(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("z", 3), ("a", 4)], "`k.1` string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20), ("b", 30)], "k string, v int")
    got = {tuple(r) for r in tables.index_join(left, right, {"k.1": "k"}).collect()}
    assert got == {("a", 1, 10), ("a", 4, 10), (None, 2, 20), ("z", 3, None)}
    twice = right.union(right)
    with pytest.raises(ValueError):
        tables.index_join(left, twice, {"k.1": "k"})
    assert tables.index_join(left, twice, {"k.1": "k"}, unique=False).count() == 7
    assert tables.index_join(left, right.where("v < 0"), {"k.1": "k"}).where("v_right IS NULL").count() == 4


def test_sets(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), (None, 2), ("y", None)], "k string, v int")
    b = spark.createDataFrame([("x",), ("x",), ("w",)], "k string")
    assert tables.membership(a, b, ["k"]).count() == 2 and tables.membership(a, b, ["k"], inside=False).count() == 2
    assert {r.k for r in tables.difference(a.union(a), b, ["k"]).collect()} == {None, "y"}
    assert tables.difference(a, b.where("k = 'none'"), ["k"]).count() == 3 and tables.difference(a.where("v > 9"), b, ["k"]).count() == 0


def test_keep_first_takes_whole_rows(spark, panel):
    first = {r.unit: r for r in tables.keep_first(panel, ["unit"], ["year"]).collect()}
    last = {r.unit: r for r in tables.keep_first(panel, ["unit"], ["year"], last=True).collect()}
    for unit, rows in by_unit(panel).items():
        assert first[unit].id == rows[0].id and last[unit].id == rows[-1].id
    tied = panel.withColumn("year", F.lit(1))
    assert {r.id for r in tables.keep_first(tied, ["unit"], ["year"]).collect()} == {r.id for r in tables.keep_first(tied.repartition(5), ["unit"], ["year"]).collect()}
    assert tables.keep_first(panel.where("id < 0"), ["unit"], ["year"]).count() == 0


def test_coerced_ranges_and_codes(spark):
    df = spark.createDataFrame([("12", 1), (" 3.5 ", 2), ("x", 3), ("inf", 4), ("nan", 5), (None, 6), ("900", 7)], "s string, i int")
    d = tables.coerce(df, ["s", "i"])
    assert {r.i: r.s for r in d.collect()} == {1: 12.0, 2: 3.5, 3: None, 4: None, 5: None, 6: None, 7: 900.0}
    assert {r.i for r in tables.in_ranges(d, {"s": (3.5, 12)}).collect()} == {1, 2}
    assert {r.i for r in tables.in_ranges(d, {"s": (None, 12), "i": (2, None)}, nulls=True).collect()} == {2, 3, 4, 5, 6}
    assert {r.i: r.s for r in tables.in_ranges(d, {"s": (None, 12)}, blank=True).collect()}[7] is None
    coded = d.select("i", tables.recode(F.col("s"), {12.0: "twelve", None: "none"}, F.lit("rest")).alias("c"))
    assert {r.i: r.c for r in coded.collect()} == {1: "twelve", 2: "rest", 3: "none", 4: "none", 5: "none", 6: "none", 7: "rest"}


def test_melt(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 4.0, 5)], "id int, `a.b` double, c int")
    assert {tuple(r) for r in tables.melt(df, ["id"]).collect()} == {(1, "a.b", 2.0), (1, "c", None), (2, "a.b", 4.0), (2, "c", 5.0)}
    assert {r.value for r in tables.melt(df.withColumn("t", F.lit("x")), ["id"], ["c", "t"]).collect()} == {None, "5", "x"}
    assert tables.melt(df, ["id"], []).count() == 0


@pytest.mark.parametrize("run", [3, 1 << 16])
def test_profile(spark, panel, monkeypatch, run):
    monkeypatch.setattr(tables._running, "__defaults__", (run,))
    df = panel.withColumn("v", F.round("v", 1)).withColumn("w", F.when(F.col("unit") == "a", None).otherwise(F.col("year") % 3)).withColumn("t", F.concat(F.lit("t"), F.col("year") % 4))
    got = {(r.unit, r.column): r for r in tables.profile(df, ["unit"], ["v", "w", "t"]).collect()}
    pdf = df.toPandas()
    pdf["v"] = pdf["v"].astype(float)
    assert len(got) == 3 * 4
    for unit, g in pdf.groupby(pdf.unit.fillna(""), dropna=False):
        for c in ("v", "w"):
            r, s = got[(unit or None, c)], g[c].dropna().astype(float)
            assert (r.n, r.n_distinct) == (len(s), s.nunique())
            for have, want in ((r["mean"], s.mean()), (r.median, s.median()), (r.lo, s.min()), (r.hi, s.max())):
                assert have is None if not len(s) else np.isclose(have, want)
        r = got[(unit or None, "t")]
        assert (r.n, r.n_distinct, r["mean"], r.median) == (len(g), g.t.nunique(), None, None)
    whole = {r.column: r for r in tables.profile(df, [], ["v"]).collect()}
    assert np.isclose(whole["v"].median, pdf.v.dropna().median())
    assert tables.profile(df.where("id < 0"), ["unit"], ["v"]).count() == 0


@pytest.mark.parametrize("p", [3, 6])
def test_correlations_over_the_rows_of_each_pair(spark, p):
    rng = np.random.default_rng(p)
    x = rng.normal(size=(200, p)) @ rng.normal(size=(p, p)) * 1e3 + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, p - 1] = np.where(np.isnan(x[:, p - 1]), np.nan, 7.0)
    names = [f"c.{i}" for i in range(p)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in x], ", ".join(f"`{c}` double" for c in names))
    want, there = pd.DataFrame(x, columns=names).corr(), ~np.isnan(x)
    for r in tables.correlations(df, names).collect():
        i, j = names.index(r.a), names.index(r.b)
        assert r.n == (there[:, i] & there[:, j]).sum()
        assert r.r is None if p - 1 in (i, j) else np.isclose(r.r, want.iloc[i, j], atol=1e-9)
    assert all(r.n == 0 and r.r is None for r in tables.correlations(df.where(F.lit(False)), names).collect())


def test_names_lose_accents(spark):
    names = ["  Côte d'Ivoire ", "SÃO TOMÉ", "Łódź", "e\u0301te\u0301", "Đuro ő ą ș ẽ", "’quoted’", "日本 x", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select(prepare.clean_name(F.col("n")), "i").orderBy("i").collect()]
    assert got == ["cote divoire", "sao tome", "odz", "ete", "uro o a s e", "quoted", " x", "", None]


def tables_left(spark):
    from pathlib import Path

    return {p.name for p in Path(scratch.scratch_dir(spark).removeprefix("file://")).glob("*-*") if any(p.glob("*.parquet"))}


def test_a_scope_deletes_what_was_written_in_it(spark, panel, tmp_path):
    before = tables_left(spark)
    rows = panel.where("v IS NOT NULL AND NOT isnan(v)").withColumns({"x": F.col("year") + 0.5 * F.col("v"), "z": F.col("id") % 7})
    with scratch.scope(spark):
        r = OLSRobust(["v"], ["x"], rows).fit(controls=["z"], draws=5, kfold=2, seed=3).get_results()
        r.save(str(tmp_path / "r"))
        assert tables_left(spark) > before
        with pytest.raises(ZeroDivisionError), scratch.scope(spark):
            sequences.trailing(panel, ["unit"], ["year"], {"s": ("v", "sum")}, 3).count()
            1 / 0
    assert tables_left(spark) == before
    assert Result.load(spark, str(tmp_path / "r")).summary_df.count() == 2
