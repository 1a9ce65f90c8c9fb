"""Rows of a panel in order within their units: neighbours, differences and trailing windows.

A unit may hold any share of the rows, so no window is a unit's. The table is numbered by one range sort and cut into blocks
of rows; a block also gets copies of the few rows before and after it that its own rows look at. A task holds a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyspec.operators.prepare import with_row_index

#: Rows of a block.
BLOCK = 1 << 16
FRAMES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def tie_breaker(df: DataFrame, known: list[str]) -> list[Column]:
    """A hash of the columns that don't order the rows yet, so that ties fall alike in every run; maps have none."""
    rest = [f.name for f in df.schema.fields if f.name not in known and "map<" not in f.dataType.simpleString()]
    return [F.xxhash64(*[F.col(f"`{c}`") for c in rest])] if rest else []


def in_blocks(df: DataFrame, unit: list[str], order: list[str], back: int, ahead: int, block: int) -> DataFrame:
    """``df`` with __at (numbers from 0 by unit and order), __block and __own; a row is copied to every block that looks
    ``back`` or ``ahead`` as far as to it, with __own false."""
    known = [*unit, *order]
    at = with_row_index(df, [*[F.col(f"`{c}`") for c in known], *tie_breaker(df, known)], "__at")
    first, last = (F.floor((F.col("__at") + d) / F.lit(block)).cast("long") for d in (-ahead, back))
    dealt = at.withColumn("__block", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), first), last)))
    return dealt.withColumn("__own", F.floor(F.col("__at") / F.lit(block)).cast("long") == F.col("__block"))


def _over(unit: list[str]):
    return Window.partitionBy("__block", *[F.col(f"`{c}`") for c in unit]).orderBy("__at")


def _own(df: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    clash = set(new) & set(columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    return df.withColumns(new).where("__own").select(*[f"`{c}`" for c in [*columns, *new]])


def neighbours(df: DataFrame, unit: list[str], order: list[str], values: dict[str, tuple[str, int]], step: float | None = None, block: int = BLOCK) -> DataFrame:
    """``df`` with a column for each of ``values``, {name: (column, offset)}: the column's value so many rows later in the
    unit (before, if negative); null past its ends.

    With ``step`` the first order column is a time: only a row that lies exactly offset * step away is a neighbour, so that gaps
    give null instead of a value of another period. Rows of null units are one unit; of a null time, first in it, and with
    ``step`` nobody's neighbours. Ties in order fall by a hash of the rest of the row. An empty table gives an empty one.
    """
    offsets = [k for _, k in values.values()]
    back, ahead = max([0, *[-k for k in offsets]]), max([0, *offsets])
    w = _over(unit)

    def look(column: str, k: int) -> Column:
        return F.lead(column, k).over(w) if k >= 0 else F.lag(column, -k).over(w)

    def value(column: str, k: int) -> Column:
        found = look(f"`{column}`", k)
        if step is None:
            return found
        gap = look(f"`{order[0]}`", k) - F.col(f"`{order[0]}`")
        return F.when(gap == F.lit(k * step), found)

    dealt = in_blocks(df, unit, order, back, ahead, max(block, back, ahead))
    return _own(dealt, df.columns, {name: value(c, k) for name, (c, k) in values.items()})


def differences(df: DataFrame, unit: list[str], order: list[str], columns: list[str], step: float | None = None, logs: bool = False, block: int = BLOCK) -> DataFrame:
    """``df`` with {column}_diff: the value less the one before it in the unit, as ``neighbours`` finds it; with ``logs``, the
    difference of logs (growth), null unless both are positive and finite."""
    before = {f"__before{i}": (c, -1) for i, c in enumerate(columns)}
    out = neighbours(df, unit, order, before, step, block)

    def change(i: int, c: str) -> Column:
        now, then = F.col(f"`{c}`").cast("double"), F.col(f"__before{i}").cast("double")
        if not logs:
            return now - then
        good = (now > 0) & (then > 0) & (now < float("inf")) & (then < float("inf"))
        return F.when(good, F.log(now) - F.log(then))

    return out.select(*[f"`{c}`" for c in df.columns], *[change(i, c).alias(f"{c}_diff") for i, c in enumerate(columns)])


def trailing(df: DataFrame, unit: list[str], order: list[str], values: dict[str, tuple[str, str]], rows: int, least: int = 1, block: int = BLOCK) -> DataFrame:
    """``df`` with a column for each of ``values``, {name: (column, sum | avg | min | max | count)}, over the row and the
    ``rows`` - 1 before it in the unit. Nulls and NaN are left out; under ``least`` values the result is null (but for a count).
    Ties and null units as in ``neighbours``."""
    if rows < 1:
        raise ValueError("a trailing window has at least one row")
    unknown = {how for _, how in values.values()} - set(FRAMES)
    if unknown:
        raise ValueError(f"unknown aggregates {sorted(unknown)}")
    w = _over(unit).rowsBetween(1 - rows, 0)
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def value(c: str, how: str) -> Column:
        v = F.col(f"`{c}`")
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            v = F.when(~F.isnan(v), v)
        made = FRAMES[how](v).over(w)
        return made if how == "count" else F.when(F.count(v).over(w) >= least, made)

    dealt = in_blocks(df, unit, order, rows - 1, 0, max(block, rows))
    return _own(dealt, df.columns, {name: value(c, how) for name, (c, how) in values.items()})
