"""Null patterns: what each specification's complete rows add up to, from one scan for all of them.

Bit i of a row's pattern is set where the i-th column with nulls is null; a specification needs some of these columns (its
``need``), and its complete rows are those whose pattern shares no bit with it. Sums over the complete rows are therefore
sums over patterns that avoid the need: a subset sum over the bits, which a zeta transform gives for all needs at once.
Nothing here is done once per need, so the number of jobs doesn't grow with the columns that have nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyspec.operators import moments

#: Columns with nulls whose subsets are all summed up at once; with more, only the needs that occur are.
DENSE_BITS, MAX_HOLES = 12, 62
#: Cells of a histogram that comes to the driver, and segments of a task that are held before they are summed up.
CELLS, SEGMENTS = 1 << 17, 64


def holes_of(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns that have nulls."""
    columns = list(dict.fromkeys(columns))
    r = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    found = [c for i, c in enumerate(columns) if r[f"n{i}"]]
    if len(found) > MAX_HOLES:
        raise ValueError(f"at most {MAX_HOLES} model columns may have nulls")
    return found


def null_mask(columns: list[str]) -> Column:
    """Bit i is set where columns[i] is null."""
    return sum((F.when(F.col(f"`{c}`").isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(columns)), F.lit(0).cast("long"))


def need_of(columns, holes: list[str]) -> int:
    own = set(columns)
    return sum(1 << i for i, c in enumerate(holes) if c in own)


def complete_sums(patterns: np.ndarray, values: np.ndarray, needs: np.ndarray, bits: int) -> np.ndarray:
    """(needs, ...): for each need the sum of ``values`` (patterns, ...) over the patterns that avoid it."""
    patterns, needs = np.asarray(patterns, np.int64), np.asarray(needs, np.int64)
    if bits > DENSE_BITS:
        return np.stack([values[(patterns & need) == 0].sum(0) for need in needs]) if len(needs) else np.zeros((0, *values.shape[1:]))
    dense = np.zeros((1 << bits, *values.shape[1:]), values.dtype)
    np.add.at(dense, patterns, values)
    for b in range(bits):
        pairs = dense.reshape(-1, 2, 1 << b, *values.shape[1:])
        pairs[:, 1] += pairs[:, 0]
    return dense[~needs & ((1 << bits) - 1)]


def counts(df: DataFrame, needs: list[int], bits: int, pattern: str = "__pattern", times: str | None = None) -> dict[int, int]:
    """Complete rows of each need; each row counts ``times`` if given."""
    n = F.sum(times).cast("long") if times else F.count("*")
    got = df.groupBy(pattern).agg(n.alias("n")).collect() if bits else [(0, df.agg(n).first()[0])]  # a row per pattern
    n = complete_sums(np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.int64), np.array(needs), bits)
    return dict(zip(needs, n.tolist(), strict=True))


def fold_starts(n: int, k: int) -> list[int]:
    """Ranks at which folds 1 to k - 1 begin: blocks in order, the first n % k of them one row longer."""
    q, r = divmod(n, k)
    return [f * q + min(f, r) for f in range(1, k)]


def cut_points(df: DataFrame, n_all: int, sizes: dict[int, int], k: int, bits: int, row_id: str = "rid", pattern: str = "__pattern") -> dict[int, np.ndarray]:
    """Row numbers at which the folds 1 to k - 1 of each need begin; rows are numbered from 0 to n_all - 1. The ranks among
    complete rows are found by counting rows per pattern in ranges of row numbers that narrow around all cuts together: a
    few scans of two columns, however many needs there are."""
    ranks = {need: np.array(fold_starts(n, k), np.int64) for need, n in sizes.items()}
    out = {need: np.where(r < sizes[need], r, n_all) for need, r in ranks.items()}
    needs = [need for need, n in sizes.items() if n < n_all]
    if not needs:
        return out
    target = np.stack([ranks[need] for need in needs])
    at, before = np.zeros_like(target), np.zeros_like(target)  # start of each cut's range, and complete rows before it
    level = max(1, int(n_all - 1).bit_length())  # a range has 2^level row numbers
    n_patterns = 1 << min(bits, DENSE_BITS)
    while level:
        starts = np.unique(at >> level)
        step = int(min(level, np.clip(np.log2(max(CELLS // (len(starts) * n_patterns), 1)), 2, 10)))
        rows = df.select(F.shiftright(row_id, level).alias("range"), F.shiftright(row_id, level - step).alias("cell"), F.col(pattern).alias("p"))
        if len(starts) << level < n_all:
            wanted = df.sparkSession.createDataFrame([(s,) for s in starts.tolist()], "range long")
            rows = rows.join(F.broadcast(wanted), "range")  # at most a row per cut
        got = rows.groupBy("range", "cell", "p").agg(F.count("*").alias("n")).toPandas()
        for start, part in got.groupby("range"):
            table = np.zeros((len(part), 1 << step), np.int64)
            table[np.arange(len(part)), part["cell"] - (int(start) << step)] = part["n"]
            cells = complete_sums(part["p"].to_numpy(np.int64), table, np.array(needs), bits)
            ends = np.cumsum(cells, 1)
            for i, f in np.argwhere(at >> level == start):
                c = int(min(np.searchsorted(ends[i], target[i, f] - before[i, f], "right"), (1 << step) - 1))
                before[i, f] += ends[i, c] - cells[i, c]
                at[i, f] += c << (level - step)
        level -= step
    for i, need in enumerate(needs):
        out[need] = np.where(target[i] < sizes[need], at[i], n_all)
    return out


def fold_grams(df: DataFrame, columns: list[str], needs: list[int], bits: int, cuts: dict[int, np.ndarray], row_id: str = "rid", pattern: str = "__pattern") -> DataFrame:
    """need, fold, gram over the complete rows of each need: one scan. A task adds up rows by pattern between neighbouring
    cuts of any need, and from these the folds of all needs."""
    i, j = np.triu_indices(len(columns) + 1)
    wanted = np.array(needs, np.int64)
    borders = np.unique(np.concatenate([cuts[n] for n in needs])) if needs else np.zeros(0, np.int64)
    ends = np.concatenate([[0], borders])
    fold_of = np.stack([np.searchsorted(cuts[n], ends, "right") for n in needs])  # (needs, segments)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}
        sums: dict[tuple[int, int], np.ndarray] = {}

        def flush() -> None:
            for segment, (patterns, values) in held.items():
                got = complete_sums(np.concatenate(patterns), np.concatenate(values), wanted, bits)
                for at, row in enumerate(got):
                    if row[-1]:  # the number of rows
                        key = (at, int(fold_of[at, segment]))
                        sums[key] = sums[key] + row if key in sums else row
            held.clear()

        for pdf in batches:
            if not len(pdf):
                continue
            v = np.c_[np.nan_to_num(pdf[columns].to_numpy(float, na_value=np.nan)), np.ones(len(pdf))]
            segment, own = np.searchsorted(borders, pdf[row_id].to_numpy(np.int64), "right"), pdf[pattern].to_numpy(np.int64)
            order = np.lexsort((own, segment))
            segment, own = segment[order], own[order]
            first = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (own[1:] != own[:-1])])
            v = v[order]
            added = np.add.reduceat(v[:, i] * v[:, j], first, axis=0)
            for s in np.unique(segment[first]).tolist():
                here = segment[first] == s
                patterns, values = held.setdefault(s, ([], []))
                patterns.append(own[first][here])
                values.append(added[here])
            if len(held) > SEGMENTS or sum(len(x) for x, _ in held.values()) > 256:
                flush()
        flush()
        if sums:
            yield pd.DataFrame({"need": [needs[a] for a, _ in sums], "fold": np.array([f for _, f in sums], np.int32), "gram": list(sums.values())})

    parts = df.select(*[f"`{c}`" for c in dict.fromkeys([row_id, pattern, *columns])]).mapInPandas(run, "need long, fold int, gram array<double>")
    return moments.add_up(parts, ["need", "fold"], len(i))
