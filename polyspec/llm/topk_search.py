"""Exact top-k search by a three-phase uniform threshold (operator 10).

Vectors are cut into ``LISTS`` ranges of components; each range is a list of partial scores for every query. Queries
and vectors meet in cells of a block of each, which hold all lists of their vectors. Phase 1 gathers, for each cell and
list, the vectors of the best partial scores, resolves the whole scores of these few, and notes each list's peak; the k-th
best of the whole scores over all cells is a cutoff that the true top k reach for certain. Phase 2 sends each query's cutoff
to the cells: whatever reaches it has a partial score of at least cutoff / LISTS in some list, so a cell is visited, and a
list multiplied, only where its peak reaches that, and only such entries are collected. Phase 3 resolves them exactly, in
their cell, and those that reach the cutoff leave it, at most k of them. All that leaves cells is cut to the best k by
partial aggregation, so no task holds more than a few rows of a query and cell.

Defined cases: a null vector, or one with a null or non-finite component, takes no part; a missing component counts
as 0; a vec_id that is repeated is a row for each, and a query leaves out its own row only; a null id takes no part; equal
scores, of equal vectors too, go by id; an empty table gives no rows; extra columns are not carried, and never clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyspec.llm.common import by_group, read
from polyspec.plans.scratch import Scratch

TOP, SCALE, LISTS = 5, 256, 2
#: Vectors and queries of a cell, queries of a cell that are multiplied at once, and tasks at most.
ROWS_BLOCK, QUERY_BLOCK, QUERIES_AT_ONCE, MAX_TASKS = 4096, 8192, 512, 10_000
#: Entries that are resolved at once.
PAIRS_AT_ONCE = 1 << 16
NO_CUTOFF = -(1 << 63)


def quantized(df: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id, key: floor(scale * x) of each component, of the vectors that take part."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = "id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return rows.where(finite).select("id", F.expr(f"transform(v, x -> cast(floor({scale}D * x) as bigint))").alias("key"))


def matrix(keys: pd.Series, width: int) -> np.ndarray:
    """Rows of equal width; a missing component is 0."""
    if len(keys) and (keys.str.len() == width).all():
        return np.stack(keys.to_numpy())
    out = np.zeros((len(keys), width), np.int64)
    for i, key in enumerate(keys):
        out[i, : len(key)] = key
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles where every sum is below 2^53."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if bound < 2**53 else a @ b.T


def cells(rows: DataFrame, asking: DataFrame, query_blocks: int, tasks: int) -> DataFrame:
    """qb, vb, side (0: a query, 1: a vector), id, key, low, peaks: each block of vectors with the queries that visit it.
    rows: id, key, vb; asking: q, key, low, vb, peaks. A vector goes to the blocks of queries that come to its block."""
    asking = asking.withColumn("qb", F.pmod("q", F.lit(query_blocks).cast("long")))
    visits = asking.select("qb", "vb").distinct()  # a row per pair of blocks
    none = F.lit(None).cast("array<bigint>")
    vectors = rows.join(visits, "vb").select("qb", "vb", F.lit(1).alias("side"), "id", "key", F.lit(NO_CUTOFF).cast("long").alias("low"), none.alias("peaks"))
    queries = asking.select("qb", "vb", F.lit(0).alias("side"), F.col("q").alias("id"), "key", "low", "peaks")
    return vectors.unionByName(queries).repartition(tasks, "qb", "vb").sortWithinPartitions("qb", "vb", "side", "id")


def best_entries(i: np.ndarray, j: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` best entries of each query i; ties go to the smaller j."""
    order = np.lexsort((j, -score, i))
    of = i[order]
    return order[np.arange(len(of)) - np.searchsorted(of, of) < keep]


def resolve(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whole scores of the entries (i, j)."""
    parts = [np.einsum("ij,ij->i", q[i[s : s + PAIRS_AT_ONCE]], v[j[s : s + PAIRS_AT_ONCE]]) for s in range(0, len(i), PAIRS_AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def cell_entries(pdf: pd.DataFrame, width: int, lists: int, keep: int, cut: bool) -> pd.DataFrame:
    """q, vb, id, score, peaks of a cell: without ``cut``, the best of those that lead a list, with the lists' peaks (phase 1);
    with it, the best of those that reach the cutoff, found by the uniform threshold (phases 2 and 3)."""
    borders = np.linspace(0, width, lists + 1).astype(int)
    ranges = list(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True))
    side = pdf["side"].to_numpy()
    asking, given = pdf[side == 0], pdf[side == 1]
    v, v_id, vb = matrix(given["key"], width), given["id"].to_numpy(np.int64), pdf["vb"].iloc[0]
    q_all, low_all, q_id = matrix(asking["key"], width), asking["low"].to_numpy(np.int64), asking["id"].to_numpy(np.int64)
    peak_all = np.stack(asking["peaks"].to_numpy()) if cut and len(asking) else np.zeros((len(asking), lists), np.int64)
    out = []
    for s in range(0, len(q_id) if len(v_id) else 0, QUERIES_AT_ONCE):
        q, low, peaks = q_all[s : s + QUERIES_AT_ONCE], low_all[s : s + QUERIES_AT_ONCE], peak_all[s : s + QUERIES_AT_ONCE].copy()
        chosen = np.zeros((len(q), len(v)), bool)
        threshold = low // lists + (low % lists != 0)
        for n, (a, b) in enumerate(ranges):
            able = np.flatnonzero(peaks[:, n] >= threshold) if cut else np.arange(len(q))
            if not len(able):
                continue
            part = product(q[able, a:b], v[:, a:b])
            if cut:
                chosen[able] |= part >= threshold[able, None]
            else:
                lead = min(keep, len(v_id))
                np.put_along_axis(chosen, np.argpartition(-part, lead - 1, axis=1)[:, :lead], True, axis=1)
                peaks[:, n] = part.max(1)
        i, j = np.nonzero(chosen)
        score = resolve(q, v, i, j)
        if cut:
            reach = score >= low[i]
            i, j, score = i[reach], j[reach], score[reach]
        kept = best_entries(i, j, score, keep)
        out.append(pd.DataFrame({"q": q_id[s + i[kept]], "vb": vb, "id": v_id[j[kept]], "score": score[kept], "peaks": list(peaks[i[kept]])}))
    return pd.concat(out) if out else pd.DataFrame({"q": [], "vb": [], "id": [], "score": [], "peaks": []})


def entries(met: DataFrame, width: int, lists: int, keep: int, cut: bool) -> DataFrame:
    return met.mapInPandas(by_group(["qb", "vb"], lambda pdf: cell_entries(pdf, width, lists, keep, cut)), "q long, vb long, id long, score long, peaks array<bigint>")


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", top: int = TOP, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` highest inner products of each row where ``is_query`` (a column over
    ``id``) holds, with every row but its own; ties go to the smaller id."""
    scratch, keep = Scratch(df.sparkSession), top + 1
    rows = scratch.write(quantized(df, id_col, vector).withColumn("at", F.monotonically_increasing_id()), "vectors")
    queries = scratch.write(rows.where(is_query).select("id", "key", F.monotonically_increasing_id().alias("q")), "queries")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("key")).alias("width")).first()
    asked = queries.count()
    width = size.width or 0
    lists = max(1, min(lists, width))
    row_blocks, query_blocks = max(1, -(-size.n // ROWS_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    tasks = min(row_blocks * query_blocks, MAX_TASKS)
    blocked = rows.select("id", "key", F.pmod("at", F.lit(row_blocks).cast("long")).alias("vb"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long")))
    none = F.lit(None).cast("array<bigint>")
    asking = queries.select("q", "key", F.lit(NO_CUTOFF).cast("long").alias("low"), every.alias("vb"), none.alias("peaks"))
    first = scratch.write(entries(cells(blocked, asking, query_blocks, tasks), width, lists, keep, cut=False), "first")
    by_score = Window.partitionBy("q").orderBy(F.col("score").desc())
    cutoff = first.select("q", "score").withColumn("at", F.row_number().over(by_score)).where(F.col("at") == keep).select("q", F.col("score").alias("low"))
    bound = queries.join(cutoff, "q", "left").withColumn("low", F.coalesce("low", F.lit(NO_CUTOFF).cast("long")))
    # Each query with the cells where some list's peak reaches its share of the cutoff.
    peaks = first.groupBy("q", "vb").agg(F.first("peaks").alias("peaks"))
    share = F.expr(f"low div {lists}L - 1")  # no more than the exact share, which the cell takes
    visits = bound.join(peaks, "q").where((F.col("low") == NO_CUTOFF) | (F.array_max("peaks") >= share))
    visits = scratch.write(visits.select("q", "key", "low", "vb", "peaks"), "cutoffs")
    reached = entries(cells(blocked, visits, query_blocks, tasks), width, lists, keep, cut=True)
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    ranked = reached.withColumn("at", F.row_number().over(best)).where(F.col("at") <= keep)
    # The query's own row has its id and its score with itself; where it isn't among the best, no other row needs to go.
    own = queries.select("q", F.col("id").alias("query_id"), F.expr("aggregate(key, 0L, (a, x) -> a + x * x)").alias("self"))
    ranked = ranked.join(own, "q").withColumn("is_own", (F.col("id") == F.col("query_id")) & (F.col("score") == F.col("self")))
    ranked = ranked.withColumn("own_at", F.min(F.when(F.col("is_own"), F.col("at"))).over(Window.partitionBy("q")))
    rest = ranked.where("own_at IS NULL OR at <> own_at").withColumn("rank", F.col("at") - F.when(F.col("at") > F.col("own_at"), 1).otherwise(0))
    out = scratch.write(rest.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"), "ranked")
    scratch.drop(rows, queries, first, visits)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(50)) == 0)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
"""
