"""Gram matrices: the only thing that linear models need of the rows.

A Gram is an array of the upper triangle of sums v_i * v_j, row by row, over the model columns and a trailing 1.
Sums are algebraic aggregates, so a scan gives them with map-side partials for every key at once.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyspec.functions.stats import _lgamma
from polyspec.plans.scratch import materialize

#: Widest Gram that goes through generated code; a wider one is summed by numpy per Arrow batch.
NATIVE_COLUMNS = 12
#: Draws and rows whose counts are made at once: their arrays stay in a core's cache.
DRAWS_AT_ONCE, ROWS_AT_ONCE = 256, 512
#: Leading bits that a table of Poisson counts is read by, its largest rate, and its mark where these bits don't tell the count.
TABLE_BITS, TABLE_RATE, UNTOLD = 16, 64.0, 255
#: Bytes of Grams that a task holds at most, and further tries of a draw of groups.
HELD_BYTES, RETRIES = 1 << 26, 8
#: Picks of groups in a run of one draw.
PICKS = 1 << 16


def size(p: int) -> int:
    return (p + 1) * (p + 2) // 2


def unpack(flat: np.ndarray, p: int) -> np.ndarray:
    """Symmetric matrices (..., p + 1, p + 1) of flat triangles."""
    i, j = np.triu_indices(p + 1)
    out = np.zeros((*flat.shape[:-1], p + 1, p + 1))
    out[..., i, j] = flat
    out[..., j, i] = flat
    return out


def gram(df: DataFrame, columns: list[str], keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """keys, gram. Nulls count as 0: filter the rows first."""
    keys = keys or []
    if len(columns) > NATIVE_COLUMNS:
        return wide_gram(df, columns, keys, weight)
    v = [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in columns] + [F.lit(1.0)]
    w = [x * F.col(f"`{weight}`") if weight else x for x in v]
    sums = [F.sum(w[i] * v[j]).alias(f"g{i}_{j}") for i in range(len(v)) for j in range(i, len(v))]
    flat = F.array(*[F.coalesce(F.col(f"g{i}_{j}"), F.lit(0.0)) for i in range(len(v)) for j in range(i, len(v))])
    return df.groupBy(*[f"`{k}`" for k in keys]).agg(*sums).select(*[f"`{k}`" for k in keys], flat.alias("gram"))


def wide_gram(df: DataFrame, columns: list[str], keys: list[str], weight: str | None) -> DataFrame:
    """As ``gram``, by products of whole Arrow batches; rows of a batch that share a key are added up before they leave it."""
    i, j = np.triu_indices(len(columns) + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.c_[np.nan_to_num(pdf[columns].to_numpy(float, na_value=0.0)), np.ones(len(pdf))]
            w = v * pdf[weight].to_numpy(float)[:, None] if weight else v
            if not keys:
                yield pd.DataFrame({"gram": [(w.T @ v)[i, j]]})
                continue
            code = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
            w, v = w[order], v[order]
            sums = np.add.reduceat(w[:, i] * v[:, j], first, axis=0)
            yield pdf[keys].iloc[order[first]].assign(gram=list(sums))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["gram array<double>"])
    parts = df.select(*[f"`{c}`" for c in [*keys, *columns, *([weight] if weight else [])]]).mapInPandas(run, schema)
    return add_up(parts, keys, len(i))


def add_up(parts: DataFrame, keys: list[str], length: int, times: str | None = None) -> DataFrame:
    """Element-wise sums of gram, an array of ``length``, by key; each row counts ``times`` if given. A short array is summed
    in as many aggregates, a longer one element by element."""
    weight = F.col(times) if times else F.lit(1.0)
    if length <= 120:
        sums = [F.sum(F.get("gram", i) * weight).alias(f"g{i}") for i in range(length)]
        out = parts.groupBy(*keys).agg(*sums)
        return out.select(*keys, F.array(*[F.coalesce(f"g{i}", F.lit(0.0)) for i in range(length)]).alias("gram"))
    if not keys:
        parts, keys = parts.withColumn("__all", F.lit(0)), ["__all"]
    long = parts.select(*keys, weight.alias("w"), F.posexplode("gram").alias("at", "v")).groupBy(*keys, "at").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    out = long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("gram"))
    return out.drop("__all")


def mixed(seed: int, row: np.ndarray, draw: np.ndarray, salt: int = 0) -> np.ndarray:
    """Counter-based 64-bit numbers: a pure function of seed, row, draw and salt, the same on any executor and attempt."""
    with np.errstate(over="ignore"):
        by_draw = draw.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed) + np.uint64(salt) * np.uint64(0xA24BAED4963EE407)
        x = np.add.outer(row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), by_draw)
        spare = np.empty_like(x)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= np.right_shift(x, np.uint64(shift), out=spare)
            x *= np.uint64(times)
        x ^= np.right_shift(x, np.uint64(31), out=spare)
        return x


def uniform(seed: int, row: np.ndarray, draw: np.ndarray, salt: int = 0) -> np.ndarray:
    """Counter-based uniforms, of ``mixed`` numbers."""
    return mixed(seed, row, draw, salt) * 2.0**-64


def poisson(u: np.ndarray, rate: float) -> np.ndarray:
    """Poisson counts by inversion of uniforms, at any rate: cumulative probabilities of logarithms."""
    if not rate >= 0 or not np.isfinite(rate):
        raise ValueError("the rate must be a finite number from 0")
    if rate == 0:
        return np.zeros(u.shape)
    k = np.arange(int(rate + 12 * rate**0.5 + 12))
    cdf = np.cumsum(np.exp(k * np.log(rate) - rate - _lgamma(k + 1.0)))
    if rate > 4:
        return np.searchsorted(cdf, u.ravel(), "right").reshape(u.shape).astype(float)
    out = np.zeros(u.shape)
    for c in cdf:  # few counts occur, and a comparison costs less than a search
        over = u >= c
        if not over.any():
            break
        out += over
    return out


@cache
def count_table(rate: float) -> np.ndarray:
    """Poisson counts by the leading bits of a number, UNTOLD where a change of the count lies within them."""
    at = poisson(np.arange((1 << TABLE_BITS) + 1) * 2.0**-TABLE_BITS, rate)
    return np.where(at[:-1] == at[1:], at[:-1], UNTOLD).astype(np.uint8)


def poisson_of(x: np.ndarray, rate: float) -> np.ndarray:
    """``poisson`` of the uniforms of ``mixed`` numbers, read from a table by their leading bits; the few numbers whose leading
    bits don't tell the count are inverted."""
    if not 0 <= rate <= TABLE_RATE:
        return poisson(x * 2.0**-64, rate)
    count = count_table(rate).take((x >> np.uint64(64 - TABLE_BITS)).view(np.int64), mode="clip")
    out = count.astype(float)
    untold = np.flatnonzero(count == UNTOLD)
    out.reshape(-1)[untold] = poisson(x.reshape(-1)[untold] * 2.0**-64, rate)
    return out


@dataclass(frozen=True)
class Unit:
    """What is drawn together: the rows complete for ``need``, each a Poisson number of times of mean ``rate``, by counters
    under ``salt``; ``columns`` (numbers) are those whose products are wanted."""

    key: int
    need: int
    rate: float
    salt: int = 0
    columns: tuple[int, ...] | None = None


def poisson_grams(df: DataFrame, columns: list[str], units: list[Unit], draws: int, seed: int, row_id: str = "rid", pattern: str = "__pattern") -> DataFrame:
    """unit, draw, gram: one scan for all units and draws, without a join. Where their Grams outgrow a task, units and draws
    are cut into blocks and each row is sent to every block, which is little beside the draws that it takes part in."""
    i, j = np.triu_indices(len(columns) + 1)
    most = max(1, HELD_BYTES // (8 * len(i)))
    step = min(draws, DRAWS_AT_ONCE if most >= DRAWS_AT_ONCE else most)
    some = max(1, most // step)
    blocks = [(units[a : a + some], d, min(draws, d + step)) for a in range(0, len(units), some) for d in range(0, draws, step)] if len(units) * draws > most else [(units, 0, draws)]
    entries = {u.columns: np.flatnonzero(np.isin(i, [*u.columns, len(columns)]) & np.isin(j, [*u.columns, len(columns)])) for u in units if u.columns is not None}

    def emit(block: int, total: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
        _, lo, hi = blocks[block]
        for key, sums in total.items():
            yield pd.DataFrame({"unit": np.int64(key), "draw": np.arange(lo, hi, dtype=np.int32), "gram": list(sums)})

    def add(total: dict[int, np.ndarray], block: int, pdf: pd.DataFrame) -> None:
        own, lo, hi = blocks[block]
        values = np.c_[np.nan_to_num(pdf[columns].to_numpy(float, na_value=np.nan)), np.ones(len(pdf))]
        numbers, patterns = pdf[row_id].to_numpy(np.int64), pdf[pattern].to_numpy(np.int64)
        for r in range(0, len(pdf), ROWS_AT_ONCE):
            v, rows, holes = (a[r : r + ROWS_AT_ONCE] for a in (values, numbers, patterns))
            products = v[:, i] * v[:, j]
            for s in range(lo, hi, DRAWS_AT_ONCE):
                d = np.arange(s, min(hi, s + DRAWS_AT_ONCE))
                at = slice(s - lo, s - lo + len(d))
                weights: dict[tuple, np.ndarray] = {}
                u, salt = None, None
                for unit in own:
                    if unit.salt != salt or u is None:
                        u, salt = mixed(seed, rows, d, unit.salt), unit.salt
                        weights.clear()
                    if unit.rate not in weights:
                        weights[unit.rate] = poisson_of(u, unit.rate)
                    w, x = weights[unit.rate], products
                    complete = (holes & unit.need) == 0
                    if not complete.all():
                        w, x = w[complete], x[complete]
                    if not len(x):
                        continue
                    some = entries.get(unit.columns, slice(None))
                    sums = total.setdefault(unit.key, np.zeros((hi - lo, len(i))))
                    sums[at, some] += w.T @ x[:, some]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        now = 0
        for pdf in batches:
            if not len(pdf):
                continue
            if "__block" not in pdf:
                add(total, 0, pdf)
                continue
            of = pdf["__block"].to_numpy()  # in order of blocks
            for block in np.unique(of).tolist():
                if block != now:
                    yield from emit(now, total)
                    total, now = {}, block
                add(total, block, pdf[of == block])
        yield from emit(now, total)

    rows = df.select(*[f"`{c}`" for c in dict.fromkeys([row_id, pattern, *columns])])
    if len(blocks) > 1:
        lanes = max(1, df.sparkSession.sparkContext.defaultParallelism)
        every = F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1)))
        rows = rows.withColumn("__block", every).withColumn("__lane", F.pmod(row_id, F.lit(lanes)))
        rows = rows.repartition(len(blocks) * max(1, -(-lanes // len(blocks))), "__block", "__lane").sortWithinPartitions("__block").drop("__lane")
    return add_up(rows.mapInPandas(run, "unit long, draw int, gram array<double>"), ["unit", "draw"], len(i))


def hash_index(seed: int, n, *parts):
    """Number from 0 to n - 1 of a seeded digest; DuckDB can compute the same."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def multinomial_grams(df: DataFrame, columns: list[str], units: list[Unit], sizes: dict[int, int], m: int, draws: int, seed: int, pattern: str = "__pattern") -> DataFrame:
    """unit, draw, gram: m picks with replacement out of the complete rows of each unit's need, for each draw; a salted unit
    has picks of its own. sizes: complete rows by need. A row is numbered among the complete rows of every need that it
    serves, all by one sort."""
    from polyspec.operators.prepare import with_row_index

    served = F.filter(F.array(*[F.lit(n).cast("long") for n in sizes]), lambda n: n.bitwiseAND(F.col(pattern)) == 0)
    rows = with_row_index(df.withColumn("__need", F.explode(served)), ["__need", "rid"], "at")
    first = dict(zip(sorted(sizes), np.cumsum([0, *[sizes[n] for n in sorted(sizes)]]).tolist(), strict=False))
    sets = df.sparkSession.createDataFrame([(u.key, sizes[u.need], first[u.need], str(u.salt) if u.salt else None) for u in units], "unit long, rows long, first long, salt string")
    picks = df.sparkSession.range(draws * m).select((F.col("id") / m).cast("int").alias("draw"), F.pmod("id", F.lit(m)).alias("pos"))
    picks = picks.crossJoin(F.broadcast(sets))  # a row per unit
    at = F.col("first") + hash_index(seed, F.col("rows"), F.col("draw"), F.col("pos"), F.col("salt"))
    times = picks.select("unit", "draw", at.alias("at")).groupBy("unit", "draw", "at").agg(F.count("*").cast("double").alias("times"))
    return gram(rows.join(times, "at"), columns, ["unit", "draw"], "times")


def cluster_counts(sizes: DataFrame, stats: dict[int, dict], units: list[Unit], target: int, draws: list[tuple[int, int]] | None, n_draws: int, seed: int, attempt: int = 0) -> DataFrame:
    """unit, draw, need, g_idx, size, times: whole groups picked with replacement until the rows reach ``target``. sizes: need,
    g_idx (from 0 within a need), size; stats: n, mean, sd and least of the sizes by need. ``draws``: pairs of unit and draw,
    or None for all. A draw can't need more than target / least size of picks, nor, but for a chance of about 1e-9, more than
    the bound below. Picks are dealt in runs, and rows before a run are summed up by run, so that no task holds a draw."""
    spark = sizes.sparkSession
    rows = []
    for u in units:
        s = stats[u.need]
        mean, sd, least = float(s["mean"]), float(s["sd"] or 0), float(s["least"])
        picks = int(min(target / least + 1, target / mean + 8 * (sd / mean + 1) * (target / mean) ** 0.5 + 16))
        rows.append((u.key, u.need, int(s["n"]), picks, str(u.salt) if u.salt else None))
    plan = spark.createDataFrame(rows, "unit long, need long, groups long, picks long, salt string")
    todo = spark.range(n_draws).select(F.col("id").cast("int").alias("draw")).crossJoin(F.broadcast(plan)) if draws is None else spark.createDataFrame(draws, "unit long, draw int").join(F.broadcast(plan), "unit")
    runs = todo.repartition(spark.sparkContext.defaultParallelism).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("picks") - 1) / PICKS))))
    pos = F.explode(F.sequence(F.col("run") * PICKS, F.least(F.col("picks"), (F.col("run") + 1) * PICKS) - 1))
    made = runs.select("unit", "need", "draw", "run", "groups", "salt", pos.alias("pos"))
    index = hash_index(seed, F.col("groups"), F.col("draw"), F.col("pos"), F.col("salt"), F.lit(attempt or None).cast("string"))
    made = made.withColumn("g_idx", index).drop("groups", "salt").join(sizes, ["need", "g_idx"])
    in_run = Window.partitionBy("unit", "draw", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("before", F.coalesce(F.sum("size").over(in_run), F.lit(0)))
    if max(r[3] for r in rows) > PICKS:
        by_run = Window.partitionBy("unit", "draw").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        earlier = made.groupBy("unit", "draw", "run").agg(F.sum("size").alias("s")).withColumn("earlier", F.coalesce(F.sum("s").over(by_run), F.lit(0))).drop("s")
        made = made.join(earlier, ["unit", "draw", "run"]).withColumn("before", F.col("before") + F.col("earlier"))
    return made.where(F.col("before") < target).groupBy("unit", "draw", "need", "g_idx", "size").agg(F.count("*").cast("double").alias("times"))


def cluster_grams(groups: DataFrame, stats: dict[int, dict], units: list[Unit], target: int, draws: int, seed: int, min_rows: int, length: int) -> DataFrame:
    """unit, draw, gram: sums of group Grams (need, g_idx, size, gram) times their picks. A group that has one row and one
    pick in the sample is left out; where fewer than ``min_rows`` rows would stay, the draw is tried again with other picks, up
    to RETRIES times, and then keeps all of its first picks, with a warning."""
    sizes = groups.select("need", "g_idx", "size")
    rows = F.col("times") * F.col("size")
    used, todo, first = None, None, None
    for attempt in range(RETRIES + 1):
        picked = materialize(cluster_counts(sizes, stats, units, target, todo, draws, seed, attempt), "picks")
        first = picked if first is None else first
        stays = picked.where(rows > 1)
        fed = picked.groupBy("unit", "draw").agg(F.sum(F.when(rows > 1, rows).otherwise(0)).alias("n"))
        todo = [(r.unit, r.draw) for r in fed.where(F.col("n") < min_rows).collect()]  # draws of too few rows: seldom any
        if todo:
            stays = stays.join(F.broadcast(sizes.sparkSession.createDataFrame(todo, "unit long, draw int")), ["unit", "draw"], "left_anti")
        used = stays if used is None else used.unionByName(stays)
        if not todo:
            break
    if todo:
        warnings.warn(f"{len(todo)} draws keep groups of one row, as too few rows would stay without them", UserWarning, stacklevel=2)
        used = used.unionByName(first.join(F.broadcast(sizes.sparkSession.createDataFrame(todo, "unit long, draw int")), ["unit", "draw"]))
    return add_up(used.select("unit", "draw", "need", "g_idx", "times").join(groups.select("need", "g_idx", "gram"), ["need", "g_idx"]), ["unit", "draw"], length, "times")
