"""Readers and preparers: text and Stata files, survey-style recodes, synthetic data, resumable run logs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from polyspec.operators import prepare
from polyspec.sources.stata import RECORDS, StataSource


def read_text(spark: SparkSession, path: str, sep: str = ",", header: bool = True, skip: int = 0) -> DataFrame:
    """Delimited text; a ``sep`` of more than one character is a regular expression on lines."""
    if len(sep) == 1 and not skip:
        return spark.read.csv(path, sep=sep, header=header, inferSchema=True)
    lines = spark.read.text(path, wholetext=False).withColumn("n", F.monotonically_increasing_id())
    first = lines.orderBy("n").limit(skip + 1).collect()
    names = [c for c in __import__("re").split(sep, first[skip].value.strip())]
    start = first[skip].n
    names = names if header else [f"_c{i}" for i in range(len(names))]
    rows = lines.where((F.col("n") > start) if header else (F.col("n") >= start)).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), sep)
    return rows.select(*[F.get(parts, i).alias(c) for i, c in enumerate(names)])


_KINDS = {"i": T.LongType(), "u": T.LongType(), "f": T.DoubleType(), "b": T.BooleanType(), "M": T.TimestampType()}


class FramePartition(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class FrameReader(DataSourceReader):
    """Row ranges of an Excel file, through pandas."""

    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.columns = options, schema.names

    def partitions(self) -> list[FramePartition]:
        n, step = len(load_frame(self.options)), int(self.options.get("rows", 100_000))
        return [FramePartition(s, min(n, s + step)) for s in range(0, max(n, 1), step)]

    def read(self, partition: FramePartition):
        pdf = load_frame(self.options).iloc[partition.start : partition.end][self.columns]
        for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
            yield tuple(v.item() if isinstance(v, np.generic) else v for v in row)


def load_frame(options: dict):
    import pandas as pd

    return pd.read_excel(options["path"])


class FrameSource(DataSource):
    """``spark.read.format("frame_file").load(path)`` for an xls or xlsx file that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "frame_file"

    def schema(self) -> T.StructType:
        kinds = load_frame(self.options).dtypes
        return T.StructType([T.StructField(str(c), _KINDS.get(k.kind, T.StringType())) for c, k in kinds.items()])

    def reader(self, schema: T.StructType) -> FrameReader:
        return FrameReader(self.options, schema)


def read_stata(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """A Stata file, ``records`` of it per partition."""
    spark.dataSource.register(StataSource)
    return spark.read.format("dta").option("records", records).load(path)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """An Excel sheet, of at most about a million rows by its format, which each task loads."""
    spark.dataSource.register(FrameSource)
    return spark.read.format("frame_file").load(path)


def union_recipe(df: DataFrame) -> tuple[list[str], list[str], str, DataFrame]:
    """(y, controls, x, data) of a wage survey: log wage in percent, 0/1 flags, complete rows of the model columns."""
    flag = lambda c, yes: F.when(F.col(c).cast("string") == yes, 1).when(F.col(c).isNull(), None).otherwise(0)
    out = df.withColumn("log_wage", prepare.safe_log(F.col("wage").cast("double")) * 100)
    kinds = dict(out.dtypes)
    for c, yes in (("union", "union"), ("married", "married"), ("south", "south"), ("c_city", "central city"), ("smsa", "SMSA"), ("collgrad", "college grad"), ("never_married", "1")):
        if kinds.get(c) == "string":
            out = out.withColumn(c, flag(c, yes))
    controls = [c for c in ("hours", "age", "grade", "collgrad", "married", "south", "smsa", "c_city", "ttl_exp", "tenure") if c in out.columns]
    return ["log_wage"], controls, "union", out.na.drop(subset=["log_wage", "union", *controls])


def panel_recipe(df: DataFrame, y: str, x: str, year: str, group: str, other: str) -> tuple[list[str], list[str], list[str], str, DataFrame]:
    """(y, x, controls, group, data) of a panel: one-hot years, an interaction of x with another column, complete rows."""
    out = prepare.one_hot(df, year, "year").withColumn(f"{x}_{other}", F.col(x) * F.col(other))
    years = [c for c in out.columns if c.startswith("year_")]
    columns = [y, x, other, f"{x}_{other}", *years]
    out = out.select(F.col(group).cast("int").alias(group), *columns).na.drop()
    return [y], [x], [other, f"{x}_{other}", *years], group, out


def correlated_normals(spark: SparkSession, n: int, k: int, seed: int = 192735) -> DataFrame:
    """x1 ... xk from a factor matrix L: covariance L L' plus a diagonal; partitions are generated where they are used."""
    rng = np.random.default_rng(seed)
    load, noise = rng.normal(size=(k, k)), rng.uniform(0.5, 1.5, k)
    base = spark.range(n).select("id", *[F.randn(seed + j).alias(f"e{j}") for j in range(k)], *[F.randn(seed + k + j).alias(f"u{j}") for j in range(k)])
    return base.select("id", *[(sum((F.col(f"e{j}") * float(load[i, j]) for j in range(k)), F.lit(0.0)) + F.col(f"u{i}") * float(noise[i] ** 0.5)).alias(f"x{i + 1}") for i in range(k)])


def regression_data(spark: SparkSession, n: int = 10_000, controls: int = 7, seed: int = 192735) -> DataFrame:
    """y1, x1, z1 ...: correlated normals with a linear outcome."""
    raw = correlated_normals(spark, n, controls + 1, seed)
    z = [F.col(f"x{i + 2}").alias(f"z{i + 1}") for i in range(controls)]
    y = F.col("x1") * 0.5 + sum((F.col(f"x{i + 2}") * (0.3 / (i + 1)) for i in range(controls)), F.lit(0.0)) + F.randn(seed + 99)
    return raw.select("id", y.alias("y1"), "x1", *z)


def binary_data(spark: SparkSession, n: int = 10_000, controls: int = 7, seed: int = 192735) -> DataFrame:
    """y1 (1 where a latent linear outcome is over its median, else 0), x1, z1 ...: regressors of two common factors."""
    rng = np.random.default_rng(seed)
    load, slope = rng.uniform(-0.8, 0.8, (controls + 1, 2)), rng.uniform(-0.6, 0.6, controls + 1)
    base = spark.range(n).select("id", *[F.randn(seed + j).alias(f"f{j}") for j in range(2)], *[F.randn(seed + 2 + j).alias(f"u{j}") for j in range(controls + 1)], F.randn(seed + 99).alias("e"))
    names = ["x1", *[f"z{i + 1}" for i in range(controls)]]
    raw = base.select("id", "e", *[(F.col("f0") * float(load[i, 0]) + F.col("f1") * float(load[i, 1]) + F.col(f"u{i}") * 0.3**0.5).alias(c) for i, c in enumerate(names)])
    latent = raw.withColumn("latent", F.col("e") + sum((F.col(c) * float(slope[i]) for i, c in enumerate(names)), F.lit(0.05)))
    return prepare.median_binarise(latent, "latent", "y1").select("id", "y1", *names)


def multi_outcome_data(spark: SparkSession, n: int = 1000, outcomes: int = 4, regressors: int = 5, controls: int = 4, seed: int = 192735) -> DataFrame:
    """x1 ..., y1 ..., z1 ...: outcomes that share regressors and an error, and controls that have no part in them."""
    slope = np.random.default_rng(seed).uniform(-0.5, 0.6, (outcomes, regressors))
    base = spark.range(n).select("id", *[F.randn(seed + j).alias(f"x{j + 1}") for j in range(regressors)], F.randn(seed + 99).alias("e"), *[F.randn(seed + 100 + j).alias(f"z{j + 1}") for j in range(controls)])
    y = [(F.col("e") + sum((F.col(f"x{j + 1}") * float(slope[i, j]) for j in range(regressors)), F.lit(0.0))).alias(f"y{i + 1}") for i in range(outcomes)]
    return base.select("id", *[f"x{j + 1}" for j in range(regressors)], *y, *[f"z{j + 1}" for j in range(controls)])


def panel_data(spark: SparkSession, groups: int, periods: int, seed: int = 1) -> DataFrame:
    """group, period, y, x, z with a slope of its own for each group."""
    slope = (F.xxhash64(F.lit(seed), "group") % 1000) / 1000.0
    rows = spark.range(groups * periods).select((F.col("id") / periods).cast("int").alias("group"), F.pmod("id", F.lit(periods)).cast("int").alias("period"), F.randn(seed).alias("x"), F.randn(seed + 1).alias("z"), F.randn(seed + 2).alias("e"))
    return rows.select("group", "period", (F.col("x") * (1 + slope) + F.col("z") + F.col("e")).alias("y"), "x", "z")


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of a grid that a log doesn't hold yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def append_runs(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)
