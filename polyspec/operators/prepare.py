"""From a raw table to model columns: casts, scaling, constants, group means, composites, row numbers and folds."""

from __future__ import annotations

import hashlib
import unicodedata
import warnings
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyspec.operators import groups
from polyspec.plans.scratch import materialize

#: Rows of a range of digests, which a task ranks at once, rows that are numbered from one record, and kinds of a run.
RANGE, CHUNK, KINDS = 1 << 20, 1 << 14, 1 << 16
#: Leading hex digits of a digest that rows are ranked by before the rest.
DIGITS = 15


def as_double(c: str, kind: T.DataType) -> Column:
    col = F.col(f"`{c}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(col), None).otherwise(col.cast("double"))
    return col.cast("double")


def doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as double, NaN as null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: as_double(c, kinds[c]).alias(c) for c in columns})


def rescale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(v - mean) / population standard deviation over the non-null rows; null where the deviation is 0."""
    if not columns:
        return df
    df = doubles(df, columns)
    one = df.agg(*[f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({c: F.try_divide(F.col(f"`{c}`") - F.lit(one[f"m{i}"]), F.lit(one[f"s{i}"])) for i, c in enumerate(columns)})


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with one distinct value, where null is a value; one scan."""
    if not columns:
        return []
    aggs = [e for i, c in enumerate(columns) for e in (F.min(f"`{c}`").alias(f"lo{i}"), F.max(f"`{c}`").alias(f"hi{i}"), F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}"))]
    r = df.agg(F.count("*").alias("rows"), *aggs).first()
    one = lambda i: r.rows > 0 and (r[f"n{i}"] == r.rows or r[f"n{i}"] == 0 and r[f"lo{i}"] == r[f"hi{i}"])
    return [c for i, c in enumerate(columns) if one(i)]


def single_constant(df: DataFrame, y: list[str], x: list[str], z: list[str]) -> tuple[DataFrame, list[str], list[str], list[str]]:
    """Data and lists with exactly one constant, named const, at the end of its list. An unused const goes; of several
    constant columns a control stays before an x before a y; without any, a const of 1 joins x."""
    if "const" in df.columns and "const" not in z:
        df, y, x = df.drop("const"), [c for c in y if c != "const"], [c for c in x if c != "const"]
    found = constant_columns(df, [*dict.fromkeys([*z, *x, *y])])
    if not found:
        return df.withColumn("const", F.lit(1.0)), y, [*x, "const"], z
    rank = {**{c: 2 for c in y}, **{c: 1 for c in x}, **{c: 0 for c in z}}
    kept, *rest = sorted(found, key=lambda c: (rank[c], c))
    if rest:
        warnings.warn(f"several constant columns; {kept!r} stays, {rest} go", UserWarning, stacklevel=2)
        df = df.drop(*rest)
    if kept != "const":
        df = df.withColumnRenamed(kept, "const")
    move = lambda names: [c for c in names if c not in found] + ["const"] * (kept in names)
    return df, move(y), move(x), move(z)


def group_invariant_columns(df: DataFrame, columns: list[str], group: str) -> list[str]:
    """Columns with at most one distinct value (null counts) in every group."""
    if not columns:
        return []
    kinds = F.count_distinct, lambda c: F.max(c.isNull().cast("int"))
    per = df.groupBy(f"`{group}`").agg(*[(kinds[0](F.col(f"`{c}`")) + kinds[1](F.col(f"`{c}`"))).alias(f"n{i}") for i, c in enumerate(columns)])
    r = per.agg(*[F.max(f"n{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    return [c for i, c in enumerate(columns) if r[f"n{i}"] is not None and r[f"n{i}"] <= 1]


def group_demean(df: DataFrame, columns: list[str], group: str | None) -> DataFrame:
    """Columns less their group means (over all rows, without a group). The means are partial aggregates that are
    joined back, so that a hot group is no task of its own; AQE can split the join."""
    means = [F.avg(f"`{c}`").alias(f"__mean{i}") for i, c in enumerate(columns)]
    if group is None:
        r = df.agg(*means).first()
        return df.withColumns({c: F.col(f"`{c}`") - F.lit(r[i]) for i, c in enumerate(columns)})
    by = df.groupBy(F.col(f"`{group}`").alias("__group")).agg(*means)
    out = df.join(by, F.col(f"`{group}`").eqNullSafe(F.col("__group")), "left")
    return out.withColumns({c: F.col(f"`{c}`") - F.col(f"__mean{i}") for i, c in enumerate(columns)}).select(*[f"`{c}`" for c in df.columns])


def composites(df: DataFrame, y: list[str], masks: list[int]) -> tuple[DataFrame, list[str]]:
    """A column y_c{mask} for each subset of outcomes: the mean of its z-scores, over those not null."""
    scaled = df.select("*", *[F.col(f"`{c}`").alias(f"__z{i}") for i, c in enumerate(y)])
    scaled = rescale(scaled, [f"__z{i}" for i in range(len(y))])
    names = []
    for m in masks:
        parts = F.filter(F.array(*[F.col(f"__z{i}") for i in range(len(y)) if m >> i & 1]), lambda v: v.isNotNull())
        total = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
        scaled = scaled.withColumn(f"y_c{m}", F.try_divide(total, F.size(parts).cast("double")))
        names.append(f"y_c{m}")
    return scaled.drop(*[f"__z{i}" for i in range(len(y))]), names


def numbered(dealt: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``dealt`` (a written table with __m, increasing ids by part) with numbers from 0: the rows of a part and ``order``
    columns follow each other, and are shifted by the rows of all that come before, by ``order`` and part."""
    part = F.expr("shiftrightunsigned(__m, 33)").alias("__part")
    keys = [*order, "__part"]
    sizes = dealt.select("*", part).groupBy(keys).agg(F.min("__m").alias("least"), F.count("*").alias("n")).collect()  # a row per file split
    before, rows = 0, []
    for r in sorted(sizes, key=lambda r: (*[r[c] for c in order], r.least)):
        rows.append((*[r[c] for c in keys], before - r.least))
        before += r.n
    kinds = {f.name: f.dataType for f in dealt.schema.fields}
    schema = T.StructType([*[T.StructField(c, kinds[c]) for c in order], T.StructField("__part", T.LongType()), T.StructField("__shift", T.LongType())])
    shift = dealt.sparkSession.createDataFrame(rows, schema)
    return dealt.select("*", part).join(F.broadcast(shift), keys).withColumn(name, F.col("__m") + F.col("__shift")).drop("__m", "__shift", *keys)


def with_row_index(df: DataFrame, order_by: list, name: str = "row_idx", ranges: int | None = None) -> DataFrame:
    """Consecutive numbers from 0 in the given order without a global window: a range sort is written once, and
    each part's rows are shifted by the sizes of the parts before it. ``ranges``: how many of the first keys parts are cut by."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order_by[:ranges]).sortWithinPartitions(*order_by)
    return numbered(materialize(dealt.withColumn("__m", F.monotonically_increasing_id()), "sorted"), name, [])


def first_rows(kinds: DataFrame, order_by: list, times: str, name: str) -> DataFrame:
    """``kinds``, each of which stands for so many (``times``) equal rows, with the number of its first row: that of
    ``with_row_index`` of the rows themselves. Kinds are summed up in runs, which are shifted by the rows of earlier runs."""
    at = with_row_index(kinds, order_by, "__at").withColumn("__run", F.floor(F.col("__at") / KINDS))
    before, rows = 0, []
    for r in sorted(at.groupBy("__run").agg(F.sum(times).cast("long").alias("n")).collect()):  # a row per run
        rows.append((r["__run"], before))
        before += r.n
    shift = kinds.sparkSession.createDataFrame(rows, "__run long, __shift long")
    earlier = Window.partitionBy("__run").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    inside = at.withColumn("__inside", F.coalesce(F.sum(times).over(earlier), F.lit(0)).cast("long"))
    out = inside.join(F.broadcast(shift), "__run").withColumn(name, F.col("__inside") + F.col("__shift"))
    return materialize(out.drop("__at", "__run", "__inside", "__shift"), "kinds")


def unfolded(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as ``times`` says."""
    n = F.col(f"`{times}`").cast("long")
    some = df.where(n > 0).select("*", n.alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(CHUNK).cast("long"))).alias("__lo"))
    parts = some.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return parts.withColumn("__i", F.explode(F.sequence("__lo", F.least("__n", F.col("__lo") + CHUNK) - 1))).drop("__n", "__lo", "__i", times)


def in_input_order(df: DataFrame, name: str) -> DataFrame:
    """Consecutive numbers from 0 in the order of the input: for a single source that is not shuffled, of its files by
    name and of the rows in a file; else of Spark's partitions. The rows are written once, unsorted."""
    place = {"__file": F.input_file_name(), "__at": F.input_file_block_start()}
    if df._jdf.queryExecution().analyzed().collectLeaves().size() > 1:
        place = {}
    return numbered(materialize(df.withColumns({**place, "__m": F.monotonically_increasing_id()}), "numbered"), name, list(place))


def contiguous_fold(idx: Column, n: int, k: int) -> Column:
    """Fold of each row number: blocks in order, the first n % k of them one row longer."""
    q, r = divmod(n, k)
    return F.when(idx < r * (q + 1), F.floor(idx / (q + 1))).otherwise(r + F.floor((idx - r * (q + 1)) / max(q, 1))).cast("int")


def group_folds(df: DataFrame, group: str, k: int, max_driver_groups: int | None = None) -> DataFrame:
    """__group, fold: whole groups, largest first, each into the fold with the fewest rows so far (ties: the first), at any
    number of groups. ``max_driver_groups`` has no effect any more."""
    sizes = df.groupBy(F.col(f"`{group}`").alias("__group")).agg(F.count("*").alias("size"))
    return groups.dealt(sizes.withColumn("need", F.lit(0).cast("long")), k).select("__group", "fold")


def stratified_folds(df: DataFrame, k: int, seed: int) -> DataFrame:
    """``df`` (rid, __y, need) with fold: within a need, rows of each class dealt in turn, in order of a seeded digest of rid."""
    classes: dict[int, dict] = {}
    for r in df.groupBy("need", "__y").agg(F.count("*").alias("n")).collect():  # two rows a need
        classes.setdefault(r.need, {})[r["__y"]] = r.n
    if any(len(c) < 2 or k > min(c.values()) for c in classes.values()):
        raise ValueError("stratified folds need two classes of at least kfold rows each")
    rows, before = [], 0
    for need in sorted(classes):
        for y in sorted(classes[need]):
            rows.append((need, y, len(rows), before))
            before += classes[need][y]
    kind = df.schema["__y"].dataType.simpleString()
    place = df.sparkSession.createDataFrame(rows, f"need long, `__y` {kind}, __class long, first long")
    # Class and first digits of the digest as one number, which the sort compares; the digest is only made again on ties.
    digest, digits = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rid").cast("string"))), min(15, (62 - len(rows).bit_length()) // 4)
    key = F.col("__class") * F.lit(16**digits) + F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")
    keyed = df.join(F.broadcast(place), ["need", "__y"]).withColumn("__key", key)
    out = with_row_index(keyed, [F.col("__key"), digest, F.col("rid")], ranges=1)
    return out.withColumn("fold", F.pmod(F.col("row_idx") - F.col("first"), F.lit(k)).cast("int")).drop("row_idx", "first", "__class", "__key")


def stratified_kinds(kinds: DataFrame, k: int, seed: int) -> DataFrame:
    """``stratified_folds`` of the rows that ``kinds`` (rid, __y, __times, one need) stand for, which are numbered from rid on:
    a row per kind and fold, with the number of its rows there as __times. Rows are dealt once, by class and range of the
    digest; their places within a range are shifted by the rows of the ranges before it, and none of them is written."""
    spark = kinds.sparkSession
    classes = {r["__y"]: int(r.n) for r in kinds.groupBy("__y").agg(F.sum("__times").alias("n")).collect()}  # two rows
    if len(classes) < 2 or k > min(classes.values()):
        raise ValueError("stratified folds need two classes of at least kfold rows each")
    n, digits = sum(classes.values()), min(DIGITS, (62 - len(classes).bit_length()) // 4)
    bits = min(4 * digits, ((n - 1) // RANGE).bit_length())
    tasks = int(np.clip(n // RANGE, spark.sparkContext.defaultParallelism, 10_000))
    kind = kinds.schema["__y"].dataType.simpleString()
    place = spark.createDataFrame([(y, i) for i, y in enumerate(sorted(classes))], f"`__y` {kind}, __class long")
    first, last = F.col("rid"), F.col("rid") + F.col("__times").cast("long") - 1
    chunks = kinds.join(F.broadcast(place), "__y").select("__class", "rid", last.alias("last"), F.explode(F.sequence(first, last, F.lit(CHUNK).cast("long"))).alias("lo"))
    rows = chunks.repartition(tasks).select("__class", "rid", F.explode(F.sequence("lo", F.least("last", F.col("lo") + CHUNK - 1))).alias("row"))
    # Class and first digits of the digest as one number, whose first bits are the range.
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("row").cast("string")))
    key = F.col("__class") * F.lit(16**digits) + F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")
    rows = rows.select("rid", "row", key.alias("key")).withColumn("range", F.shiftright("key", 4 * digits - bits))

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        key, row = pdf["key"].to_numpy(), pdf["row"].to_numpy()
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(np.diff(key[order]) == 0)
        if len(same):  # rows whose first digits are equal, by all digits
            at = np.union1d(same, same + 1)
            order[at] = sorted(order[at], key=lambda i: (key[i], hashlib.md5(f"{seed}|{row[i]}".encode()).digest(), row[i]))
        turn = np.empty(len(order), np.int64)
        turn[order] = np.arange(len(order)) % k
        cell, times = np.unique(pdf["rid"].to_numpy() * k + turn, return_counts=True)
        return pd.DataFrame({"range": pdf["range"].iloc[0], "rid": cell // k, "turn": cell % k, "n": times})

    ranked = materialize(rows.groupBy("range").applyInPandas(rank, "range long, rid long, turn long, n long"), "ranked")
    shifts, before = [], [0] * len(classes)
    for r in sorted(ranked.groupBy("range").agg(F.sum("n").alias("n")).collect()):  # a row per class and range
        shifts.append((r.range, before[r.range >> bits] % k))
        before[r.range >> bits] += r.n
    shift = spark.createDataFrame(shifts, "range long, shift long")
    fold = F.pmod(F.col("turn") + F.col("shift"), F.lit(k)).cast("int")
    folds = ranked.join(F.broadcast(shift), "range").groupBy("rid", fold.alias("fold")).agg(F.sum("n").cast("double").alias("__times"))
    return kinds.drop("__times").join(folds, "rid")


def stratified_fold(df: DataFrame, y: str, k: int, seed: int, key: str) -> DataFrame:
    """``df`` with fold: rows of each class dealt in turn, in order of a seeded digest of ``key`` (a number of its own)."""
    folds = stratified_folds(df.select(F.col(key).alias("rid"), F.col(f"`{y}`").alias("__y"), F.lit(0).cast("long").alias("need")), k, seed)
    return df.join(folds.select(F.col("rid").alias(key), "fold"), key)


def one_hot(df: DataFrame, column: str, prefix: str | None = None, values: list | None = None) -> DataFrame:
    """A 0/1 column for each distinct value."""
    values = sorted(r[0] for r in df.select(f"`{column}`").distinct().dropna().collect()) if values is None else values
    return df.withColumns({f"{prefix or column}_{v}": (F.col(f"`{column}`").eqNullSafe(F.lit(v))).cast("int") for v in values})


def median_binarise(df: DataFrame, column: str, out: str) -> DataFrame:
    """1 where a column is above its exact median."""
    m = df.agg(F.median(f"`{column}`")).first()[0]
    return df.withColumn(out, (F.col(f"`{column}`") > F.lit(m)).cast("int"))


def bin_score(column: Column, cuts: list[tuple[float, float]], otherwise: float = 0.0) -> Column:
    """Points of the first range a value is below: [(upper, points), ...]."""
    out = None
    for upper, points in cuts:
        out = F.when(column < upper, points) if out is None else out.when(column < upper, points)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def safe_log(column: Column) -> Column:
    """Natural log of positive finite values, else null."""
    return F.when((column > 0) & (column < float("inf")), F.log(column))


def finite(column: Column) -> Column:
    return F.when(F.isnan(column) | (F.abs(column) == float("inf")), None).otherwise(column)


@cache
def accented() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks and the plain ones that they decompose to."""
    blocks = (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00))
    plain = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in blocks if chr(c) == chr(c).lower()}
    folded = {c: p for c, p in plain.items() if len(p) == 1}
    return "".join(folded), "".join(folded.values())


def clean_name(column: Column) -> Column:
    """Lower-case, trimmed, without apostrophes; accented letters become plain ones, combining marks and what else isn't ASCII go."""
    letters, plain = accented()
    return F.regexp_replace(F.translate(F.lower(F.trim(column)), f"{letters}'", plain), "[^\\x00-\\x7F]", "")
