"""Preparing tables before a fit: group figures joined back, lookups, profiles, correlations, distinct rows and long forms.

Keys compare null-safely throughout: null is a value of its own, as it is in a data frame's index. Whatever is kept by group is
an algebraic aggregate, joined back; Spark picks how by measured sizes and splits hot keys, so no task holds a group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyspec.operators import moments
from polyspec.operators.prepare import with_row_index
from polyspec.operators.sequences import tie_breaker

#: Figures that ``profile`` gives of each column.
FIGURES = ["n", "n_distinct", "mean", "median", "lo", "hi"]


def q(c: str) -> Column:
    return F.col(f"`{c}`")


def _refuse(clash: set[str]) -> None:
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")


def _matched(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on columns ``keys`` of ``df`` and __key0, __key1, ... of ``other``, where null meets null."""
    on = None
    for i, k in enumerate(keys):
        same = q(k).eqNullSafe(F.col(f"__key{i}"))
        on = same if on is None else on & same
    return df.join(other, on, how)


def _as_keys(keys: list[str]) -> list[Column]:
    return [q(k).alias(f"__key{i}") for i, k in enumerate(keys)]


def group_join(df: DataFrame, keys: list[str], figures: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates of each row's group. Without keys all rows are one group."""
    _refuse(set(figures) & set(df.columns))
    per = df.groupBy(*_as_keys(keys)).agg(*[c.alias(n) for n, c in figures.items()])
    out = _matched(df, per, keys, "left") if keys else df.crossJoin(F.broadcast(per))  # one row
    return out.select(*[q(c) for c in [*df.columns, *figures]])


def group_joins(df: DataFrame, figures: list[tuple[list[str], dict[str, Column]]]) -> DataFrame:
    """``group_join`` for one list of keys after another; later figures can use earlier ones."""
    for keys, of in figures:
        df = group_join(df, keys, of)
    return df


def group_size(df: DataFrame, keys: list[str], name: str = "size") -> DataFrame:
    """``df`` with the rows of each row's group."""
    return group_join(df, keys, {name: F.count("*")})


def index_join(left: DataFrame, right: DataFrame, on: list[str] | dict[str, str], suffix: str = "_right", unique: bool = True) -> DataFrame:
    """Every row of ``left`` with the columns of the row of ``right`` that has its key (nulls, if none has). ``on``: names, or
    {left name: right name}. Columns of ``right`` that clash take the suffix. ``unique``: a key found twice in ``right`` is an
    error, told by one aggregation; else it repeats the row."""
    pairs = on if isinstance(on, dict) else {c: c for c in on}
    theirs = list(pairs.values())
    if unique and not right.groupBy(*[q(c) for c in theirs]).count().where("count > 1").isEmpty():
        raise ValueError(f"keys {theirs} are not unique on the right")
    names = {c: c + suffix if c in left.columns else c for c in right.columns if c not in theirs}
    _refuse(set(left.columns) & set(names.values()))
    other = right.select(*_as_keys(theirs), *[q(c).alias(n) for c, n in names.items()])
    return _matched(left, other, list(pairs), "left").select(*[q(c) for c in [*left.columns, *names.values()]])


def membership(df: DataFrame, other: DataFrame, keys: list[str], inside: bool = True) -> DataFrame:
    """Rows of ``df``, repeated ones too, whose key is (or is not) in ``other``."""
    there = other.select(*_as_keys(keys)).distinct()
    return _matched(df, there, keys, "left_semi" if inside else "left_anti")


def difference(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``df`` that ``other`` lacks."""
    return membership(df.select(*[q(k) for k in keys]).distinct(), other, keys, inside=False)


def keep_first(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One whole row of each key: the first by ``order`` (nulls come first), or the last. An aggregate, no window: a key's rows
    are reduced before they are shuffled. Rows that tie are taken by a hash of the rest of the row, so alike in every run."""
    rank = F.struct(*[q(c) for c in order], *tie_breaker(df, [*keys, *order]), F.lit(0))
    pick = (F.max_by if last else F.min_by)(F.struct(*[q(c) for c in df.columns]), rank)
    return df.groupBy(*_as_keys(keys)).agg(pick.alias("__row")).select(*[F.col("__row").getField(c).alias(c) for c in df.columns])


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def finite_double(c: str, kind: T.DataType) -> Column:
    """A column as double: strings are parsed, and what is no finite number is null."""
    v = F.trim(q(c)).try_cast("double") if isinstance(kind, T.StringType) else q(c).cast("double") if is_number(kind) else q(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def coerce(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; what isn't a finite number becomes null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: finite_double(c, kinds[c]) for c in columns})


def in_ranges(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]], nulls: bool = False, blank: bool = False) -> DataFrame:
    """Rows whose values lie within the ranges (ends included, None: open); null passes with ``nulls``. With ``blank`` all rows
    stay and values out of range become null. Columns should be numbers (see ``coerce``)."""
    inside = {}
    for c, (lo, hi) in ranges.items():
        ok = F.lit(True) if lo is None else q(c) >= lo
        ok = ok if hi is None else ok & (q(c) <= hi)
        inside[c] = F.when(q(c).isNull(), F.lit(nulls)).otherwise(ok)
    if blank:
        return df.withColumns({c: F.when(ok, q(c)) for c, ok in inside.items()})
    for ok in inside.values():
        df = df.where(ok)
    return df


def recode(column: Column, codes: dict, otherwise: Column | None = None) -> Column:
    """A value for each of a short list of codes (None is a code), else ``otherwise`` (null). Longer lists are tables: ``index_join``."""
    out = None
    for code, value in codes.items():
        hit = column.eqNullSafe(F.lit(code))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    rest = F.lit(None) if otherwise is None else otherwise
    return rest if out is None else out.otherwise(rest)


def melt(df: DataFrame, ids: list[str], columns: list[str] | None = None, name: str = "variable", value: str = "value") -> DataFrame:
    """ids, name, value: a row for each column of each row; values are doubles if all columns are numbers, else strings."""
    columns = [c for c in df.columns if c not in ids] if columns is None else columns
    _refuse({name, value} & set(ids))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    kind = "double" if all(is_number(kinds[c]) for c in columns) else "string"
    if not columns:
        return df.select(*[q(c) for c in ids], F.lit("").alias(name), F.lit(None).cast("double").alias(value)).where(F.lit(False))
    # by place, so that names with dots or clashes with ids do no harm
    plain = df.select(*[q(c) for c in ids], *[q(c).cast(kind).alias(f"__v{i}") for i, c in enumerate(columns)])
    long = plain.unpivot([q(c) for c in ids], [F.col(f"__v{i}") for i in range(len(columns))], name, value)
    return long.withColumn(name, recode(F.col(name), {f"__v{i}": c for i, c in enumerate(columns)}))


def profile(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, column, n, n_distinct, mean, median, lo, hi of the values that aren't null or NaN, for each group and column; for
    columns that aren't numbers n and n_distinct alone. A group without values has n 0.

    Equal values are counted first, so the rest works on distinct values; the exact median is the value at the middle ranks of
    one range sort of them, not a list of a group's values.
    """
    _refuse(set(by) & {"column", *FIGURES})
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def cell(c: str) -> Column:
        number = is_number(kinds[c])
        v = q(c).cast("double") + F.lit(0.0) if number else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if number else q(c).cast("string")
        return F.struct(F.lit(c).alias("column"), F.when(~F.isnan(v), v).alias("v"), text.alias("text"))

    keys = [f"__by{i}" for i in range(len(by))]
    flat = df.select(*[q(c).alias(k) for c, k in zip(by, keys, strict=True)], F.explode(F.array(*[cell(c) for c in columns])).alias("c"))
    counted = flat.groupBy(*keys, "c.column", "c.v", "c.text").agg(F.count("*").alias("m")).withColumn("m", F.when(F.coalesce(F.col("v").cast("string"), "text").isNotNull(), F.col("m")).otherwise(0))
    at = [*keys, "column"]
    sorted_ = with_row_index(counted, [*at, F.col("v"), F.col("text")], "__at")
    stats = sorted_.groupBy(*at).agg(
        F.sum("m").alias("n"), F.count_if(F.col("m") > 0).alias("n_distinct"), F.try_divide(F.sum(F.col("v") * F.col("m")), F.sum(F.when(F.col("v").isNotNull(), F.col("m")))).alias("mean"),
        F.min("v").alias("lo"), F.max("v").alias("hi"),
    )
    ranks = _running(sorted_.where("v IS NOT NULL"), at)
    half = stats.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(at)], F.floor((F.col("n") - 1) / 2).alias("r1"), F.floor(F.col("n") / 2).alias("r2"))
    met = _matched(ranks, half, at, "inner")
    covers = lambda r: F.max(F.when((F.col(r) >= F.col("before")) & (F.col(r) < F.col("before") + F.col("m")), F.col("v")))
    middle = met.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(at)]).agg(((covers("r1") + covers("r2")) / 2).alias("median"))
    out = _matched(stats, middle, at, "left")
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "column", *FIGURES)


#: Distinct values whose counts one task adds up in order.
RUN = 1 << 16


def _running(ordered: DataFrame, by: list[str], run: int = RUN) -> DataFrame:
    """``ordered`` (by, __at, m) with before: the sum of m over the earlier rows of a group. Runs of rows are added up, then the
    few sums of runs, and the rows within a run, so that a hot group is in no single task."""
    cut = ordered.withColumn("__run", F.floor(F.col("__at") / F.lit(run)))
    sums = cut.groupBy(*by, "__run").agg(F.sum("m").alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)  # a row a run
    starts = sums.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate([*by, "__run"])], F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*by, "__run").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    met = _matched(cut, starts, [*by, "__run"], "inner")
    return met.withColumn("before", F.col("__start") + F.coalesce(F.sum("m").over(within), F.lit(0))).select(*ordered.columns, "before")


def correlations(df: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """a, b, n, r: Pearson's correlation of every two columns over the rows that have both, and their number; r is null under
    ``least`` such rows or where a column doesn't vary on them. Strings are parsed; what isn't a finite number is missing.

    Two scans: one for centre and scale, one for a Gram of values, their squares and marks of what is there, whose entries are
    the sums of all pairs at once. The result has a row for each two columns, which is all that the driver holds.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    p = len(columns)
    schema = "a string, b string, n long, r double"
    if not p:
        return df.sparkSession.createDataFrame([], schema)
    plain = df.select(*[finite_double(c, kinds[c]).alias(f"c{i}") for i, c in enumerate(columns)])
    one = plain.agg(*[f(f"c{i}").alias(f"{n}{i}") for i in range(p) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    parts = []
    for i in range(p):
        scaled = (F.col(f"c{i}") - F.lit(one[f"m{i}"] or 0.0)) / F.lit(one[f"s{i}"] or 1.0)
        parts.append((scaled, F.col(f"c{i}").isNotNull().cast("double")))
    marked = plain.select(*[F.coalesce(v, F.lit(0.0)).alias(f"v{i}") for i, (v, _) in enumerate(parts)], *[F.coalesce(v * v, F.lit(0.0)).alias(f"q{i}") for i, (v, _) in enumerate(parts)], *[m.alias(f"m{i}") for i, (_, m) in enumerate(parts)])
    got = moments.gram(marked, marked.columns).first()
    g = moments.unpack(np.array(got.gram if got else np.zeros(moments.size(3 * p)), float), 3 * p)
    v, s, m = slice(0, p), slice(p, 2 * p), slice(2 * p, 3 * p)
    n, sums, squares = g[m, m], g[v, m], g[s, m]  # of column i over the rows that have j too
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = squares - sums**2 / n
        spread[spread <= 1e-12 * squares] = np.nan
        r = (g[v, v] - sums * sums.T / n) / np.sqrt(spread * spread.T)
    r[n < least] = np.nan
    r = np.clip(r, -1.0, 1.0)
    rows = [(columns[i], columns[j], int(n[i, j]), None if np.isnan(r[i, j]) else float(r[i, j])) for i in range(p) for j in range(p)]
    return df.sparkSession.createDataFrame(rows, schema)
