"""Integer vectors of the clustering operators (11 and 13): preparation, exact distances, exact means.

A component x becomes the integer floor(scale * x). Distances and sums are exact in longs; where the largest component
would let a squared distance leave the longs, ``kept_vectors`` raises ValueError before any work is done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyspec.llm.bytebpe import binary
from polyspec.plans.scratch import Scratch


def kept_vectors(df: DataFrame, scratch: Scratch, id_col: str, vector: str, scale: int, width: int | None, *carry: str) -> tuple[DataFrame, int]:
    """(id, key and the columns ``carry`` as c0, c1, ... of the rows that take part, as a scratch table; their width).
    Null vectors and those with null or non-finite components go, and those of another width: of ``width``, or where that
    is None of the width of the row with the smallest id (ties: the shortest; null ids last)."""
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{vector}`").cast("array<double>").alias("v"),
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
    ).where("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    if width is None:
        first = rows.select("id", F.size("v").alias("n")).orderBy(F.col("id").asc_nulls_last(), "n").first()
        width = first.n if first else 0
    rows = rows.where(F.size("v") == width)
    made = rows.select("id", F.expr(f"transform(v, x -> cast(floor({scale}D * x) as bigint))").alias("key"), *[f"c{i}" for i in range(len(carry))])
    table = scratch.write(made, "vectors")
    ends = table.agg(F.max(F.array_max("key")), F.min(F.array_min("key"))).first()
    largest = max(abs(ends[0] or 0), abs(ends[1] or 0))
    if width * (2 * largest) ** 2 >= 2**63:
        raise ValueError("components are too large for squared distances in longs")
    return table, width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of equal width as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def packed(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as binary."""
    size = rows.shape[1] * rows.itemsize
    return binary(np.ascontiguousarray(rows).reshape(-1).view(np.uint8), np.arange(len(rows) + 1) * size, pa.binary())


def unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).copy()


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def group_sums(df: DataFrame, columns: list[str], groups: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sum of the vectors of each group. ``groups`` gives, of a batch, pairs of vectors and their
    numbers of groups under a first number; a task hands on one row per group and component, and Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for base, x, of in groups(batch):
                for g in np.unique(of).tolist():
                    part = x[of == g]
                    row = np.append(part.sum(0), len(part))
                    total[base + g] = total[base + g] + row if base + g in total else row
        for g, row in total.items():
            n = len(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(row)], names=["g", "at", "v"])

    parts = df.select(*columns).mapInArrow(run, "g int, at int, v long")
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("g", "at").agg(F.sum("v").alias("v")).orderBy("g", "at").collect():  # groups x components
        out.setdefault(r.g, []).append(r.v)
    return {g: (row[-1], row[:-1]) for g, row in out.items()}


def means(old: np.ndarray, sums: dict[int, tuple[int, list[int]]], base: int = 0) -> np.ndarray:
    """The componentwise floor of each group's mean; a group without vectors keeps its old one."""
    new = old.copy()
    for i in range(len(old)):
        if base + i in sums:
            n, total = sums[base + i]
            new[i] = [s // n for s in total]
    return new
