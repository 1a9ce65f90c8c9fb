import numpy as np
import pandas as pd
import pytest

from polyspec.sources import readers, stata


@pytest.mark.parametrize("version", [114, 117, 118])
def test_record_ranges_equal_the_whole_file(spark, tmp_path, version, monkeypatch):
    rng = np.random.default_rng(1)
    d = pd.DataFrame({
        "a8": rng.integers(-100, 100, 1001).astype(np.int8), "a16": rng.integers(-9000, 9000, 1001).astype(np.int16), "a32": rng.integers(-10**9, 10**9, 1001).astype(np.int32),
        "r32": rng.normal(size=1001).astype(np.float32), "r64": rng.normal(size=1001), "name": [f"n{i}é" if i % 3 else "" for i in range(1001)],
        "day": pd.Timestamp("1999-12-31") + pd.to_timedelta(np.arange(1001), "D"),
    })
    d.loc[5:9, ["r32", "r64"]] = np.nan
    d.loc[7, "day"] = pd.NaT
    path = str(tmp_path / "t.dta")
    d.to_stata(path, write_index=False, version=version, convert_dates={"day": "td"})
    df = readers.read_stata(spark, path, records=300)
    assert df.rdd.getNumPartitions() == 4 and dict(df.dtypes) == {"a8": "bigint", "a16": "bigint", "a32": "bigint", "r32": "double", "r64": "double", "name": "string", "day": "timestamp"}
    got, want = df.toPandas(), pd.read_stata(path)
    for c in ("a8", "a16", "a32", "r32", "r64"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)
    assert got["name"].tolist() == want["name"].tolist() and df.where("r32 IS NULL").count() == 5
    assert got["day"].isna().tolist() == want["day"].isna().tolist() and (got["day"].dropna().to_numpy() == want["day"].dropna().to_numpy()).all()
    plan = stata.layout(path)
    part = stata.read_records(path, plan, 1000, 1001, ["name", "a32"])
    assert part.num_rows == 1 and part.column("a32")[0].as_py() == want["a32"].iloc[1000]


def test_missing_codes_and_other_files(spark, tmp_path):
    d = pd.DataFrame({"a": pd.array([1, None, 3], "Int16"), "b": [1.5, np.nan, 2.0]})
    d.to_stata(str(tmp_path / "m.dta"), write_index=False)
    assert [tuple(r) for r in readers.read_stata(spark, str(tmp_path / "m.dta")).collect()] == [(1, 1.5), (None, None), (3, 2.0)]
    d.iloc[:0].astype(float).to_stata(str(tmp_path / "e.dta"), write_index=False)
    assert readers.read_stata(spark, str(tmp_path / "e.dta")).count() == 0
    (tmp_path / "bad.dta").write_bytes(b"\x60" + b"\0" * 200)
    with pytest.raises(Exception, match="version"):
        readers.read_stata(spark, str(tmp_path / "bad.dta"))
