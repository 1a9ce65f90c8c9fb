"""Fixed effects and group folds by group Grams: what a group's rows add up to, less their means, for every need at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyspec.operators import moments
from polyspec.operators.patterns import complete_sums


def within_grams(rows: DataFrame, columns: list[str], group: str, needs: list[int], bits: int, pattern: str = "__pattern") -> DataFrame:
    """need, __group, size, gram: the Gram of each group's complete rows for each need, less the group's means. Sums are
    taken by group and pattern in one scan; a hot group is one row per pattern from then on. Columns are centred on their
    overall means first, which group means take away anyway, so that little is lost in the differences."""
    p = len(columns)
    one = rows.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centred = rows.select(
        F.col(f"`{group}`").alias("__group"), F.col(pattern).alias("__pattern"),
        *[(F.col(f"`{c}`") - F.lit(one[i] if one[i] is not None else 0.0)).alias(f"v{i}") for i, c in enumerate(columns)],
    )
    alone = len(needs) == 1
    if alone:
        centred = centred.where(F.col("__pattern").bitwiseAND(F.lit(needs[0])) == 0).withColumn("__pattern", F.lit(0).cast("long"))
    sums = moments.gram(centred, [f"v{i}" for i in range(p)], ["__group", "__pattern"])
    wanted, kind = np.array(needs, np.int64), rows.schema[group].dataType.simpleString()

    def demeaned(flat: np.ndarray) -> np.ndarray:
        g = moments.unpack(flat, p)
        s, n = g[:, :p, p], g[:, p, p]
        g[:, :p, :p] -= s[:, :, None] * s[:, None, :] / n[:, None, None]
        g[:, :p, p] = g[:, p, :p] = 0
        i, j = np.triu_indices(p + 1)
        return g[:, i, j]

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                flat = np.stack(pdf["gram"].to_numpy())
                yield pd.DataFrame({"need": np.full(len(pdf), needs[0]), "__group": pdf["__group"], "size": flat[:, -1].astype(np.int64), "gram": list(demeaned(flat))})

    def several(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, parts in zip(pdf["__group"], pdf["parts"], strict=True):
                got = complete_sums(np.array([r["__pattern"] for r in parts], np.int64), np.stack([np.asarray(r["gram"], float) for r in parts]), wanted, bits)
                some = np.flatnonzero(got[:, -1] > 0)
                if len(some):
                    out.append(pd.DataFrame({"need": wanted[some], "__group": [key] * len(some), "size": got[some, -1].astype(np.int64), "gram": list(demeaned(got[some]))}))
            if out:
                yield pd.concat(out)

    schema = f"need long, `__group` {kind}, size long, gram array<double>"
    if alone:
        return sums.select("__group", "gram").mapInPandas(single, schema)
    together = sums.groupBy("__group").agg(F.collect_list(F.struct("__pattern", "gram")).alias("parts"))  # a row per pattern
    return together.mapInPandas(several, schema)


def dealt(sizes: DataFrame, k: int) -> DataFrame:
    """need, __group, size, g_idx, fold: within a need, groups are numbered from 0, the largest first and equal ones in order
    of __group, and each goes to the fold of the fewest rows so far (ties: the first). The driver follows the histogram of
    sizes; which fold the i-th of a run of equal groups gets follows from the loads before the run. k = 0: fold is 0."""
    spark = sizes.sparkSession
    runs, before = [], 0
    by_need: dict[int, list[tuple[int, int]]] = {}
    for r in sizes.groupBy("need", "size").agg(F.count("*").alias("n")).collect():  # a row per need and distinct size
        by_need.setdefault(r.need, []).append((r["size"], r.n))
    for need in sorted(by_need):
        load, inside = np.zeros(max(k, 1), np.int64), 0
        total = sum(n for _, n in by_need[need])
        if k > total:
            raise ValueError(f"kfold {k} is more than the {total} groups")
        for size, n in sorted(by_need[need], reverse=True):
            runs.append((need, size, before, inside, load.tolist()))
            load = load + size * taken(load, size, n) if k else load
            before, inside = before + n, inside + n
    table = spark.createDataFrame(runs, "need long, size long, first long, inside long, loads array<long>")
    from polyspec.operators.prepare import with_row_index

    at = with_row_index(sizes.select("need", "__group", "size"), ["need", F.col("size").desc(), "__group"], "at").join(table, ["need", "size"])
    kind = sizes.schema["__group"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            i = (pdf["at"] - pdf["first"]).to_numpy(np.int64)
            fold = fold_of(np.stack(pdf["loads"].to_numpy()), pdf["size"].to_numpy(np.int64), i) if len(pdf) and k else np.zeros(len(pdf), np.int64)
            yield pd.DataFrame({"need": pdf["need"], "__group": pdf["__group"], "size": pdf["size"], "g_idx": i + pdf["inside"].to_numpy(np.int64), "fold": fold.astype(np.int32)})

    return at.mapInPandas(run, f"need long, `__group` {kind}, size long, g_idx long, fold int")


def reached(loads: np.ndarray, size: np.ndarray, level: np.ndarray) -> np.ndarray:
    """How many of the loads + size * (0, 1, ...) of each fold are at most ``level``."""
    return np.maximum((level[..., None] - loads) // size[..., None] + 1, 0)


def fold_of(loads: np.ndarray, size: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Fold of the i-th group of a run of equal ``size`` that begins at ``loads`` (rows, folds): a fold takes its next group
    when its load is the least, so groups go to the values loads + size * t in order of value and fold."""
    lo, hi = loads.min(1), loads.min(1) + size * i
    while (lo < hi).any():
        mid = (lo + hi) // 2
        enough = reached(loads, size, mid).sum(1) > i
        lo, hi = np.where(enough, lo, mid + 1), np.where(enough, mid, hi)
    rest = i - reached(loads, size, lo - 1).sum(1)
    at_level = (lo[:, None] >= loads) & ((lo[:, None] - loads) % size[:, None] == 0)
    return (np.cumsum(at_level, 1) == rest[:, None] + 1).argmax(1)


def taken(loads: np.ndarray, size: int, n: int) -> np.ndarray:
    """Groups of each fold after n groups of equal size."""
    one, s = loads[None, :], np.array([size])
    lo, hi = int(loads.min()), int(loads.min()) + size * (n - 1)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if reached(one, s, np.array([mid])).sum() >= n else (mid + 1, hi)
    out = reached(one, s, np.array([lo - 1]))[0]
    last = np.flatnonzero((lo >= loads) & ((lo - loads) % size == 0))[: n - int(out.sum())]
    out[last] += 1
    return out
