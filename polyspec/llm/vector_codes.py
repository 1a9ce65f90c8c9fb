"""Vector code compression (operator 11): vectors are cut into parts, each coded by the nearest entry of its codebook.

Codebooks come from Lloyd rounds pruned as Elkan does. A scratch table keeps, of every vector and part, the present entry,
an upper bound of the distance to it and a lower bound of the distance to each entry; an entry's movement shifts the bounds
by as much. An entry is skipped only if the triangle inequality shows it to be strictly farther than the present one (its
lower bound, or half its distance from the present entry, exceeds the upper bound); all others, ties among them, are
decided by exact integers, so the result is that of plain Lloyd rounds. Bounds are single floats rounded outwards. A round
is one pass that writes the next table and one over its codes that adds up each entry's parts; the driver holds codebooks.

Defined cases: see ``vectors.kept_vectors`` for rows that take no part and components too large; parts are equal where
their number divides the width, else the first ones are shorter; the first entries are those of the smallest ids (ties by
components, null ids last), fewer than ``entries`` if there are fewer vectors; equal entries: the lower index wins;
repeated rows count each; an empty table gives no rows; extra columns aren't carried but the label, and never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyspec.llm.common import read, release, small_batches
from polyspec.llm.vectors import group_sums, kept_vectors, matrix, means, packed, squared, unpacked
from polyspec.plans.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Relative margin of bounds: more than the rounding of a square root and its sum or difference in doubles.
MARGIN = 2.0**-50


def up(x: np.ndarray) -> np.ndarray:
    """Single floats that are no smaller."""
    return np.nextafter((x * (1 + MARGIN)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """Single floats that are no larger, at least 0."""
    return np.maximum(np.nextafter((x * (1 - MARGIN)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def between(book: np.ndarray) -> np.ndarray:
    """Half the distances between entries, rounded down."""
    d = book[:, None, :] - book[None, :, :]
    return np.sqrt((d * d).sum(2).astype(float)) / 2 * (1 - MARGIN)


def reassign(x: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves code (n), upper (n) and lower (n, entries) to the nearest entries of the parts x, in place. Returns the number
    of distances that were computed."""
    half = between(book)
    np.fill_diagonal(half, np.inf)
    near = half.min(1) if len(book) > 1 else np.array([np.inf])
    todo = np.flatnonzero(upper >= near[code])
    if not len(todo):
        return 0
    own, at = x[todo], code[todo].astype(np.int64)
    best = squared(own, book[at])
    reach = np.sqrt(best.astype(float)) * (1 + MARGIN)
    lower[todo, at] = down(np.sqrt(best.astype(float)))
    done = len(todo)
    first = at.copy()
    for j in range(len(book)):
        open_ = np.flatnonzero((lower[todo, j] <= reach) & (half[at, j] <= reach) & (first != j) & (at != j))
        if not len(open_):
            continue
        d = squared(own[open_], book[j])
        done += len(open_)
        lower[todo[open_], j] = down(np.sqrt(d.astype(float)))
        better = (d < best[open_]) | ((d == best[open_]) & (j < at[open_]))
        won = open_[better]
        at[won], best[won] = j, d[better]
        reach[won] = np.sqrt(best[won].astype(float)) * (1 + MARGIN)
    code[todo], upper[todo] = at, up(np.sqrt(best.astype(float)))
    return done


@dataclass(frozen=True)
class Codes:
    """frame: id, label, code (binary, an entry index a part), error (squared distance); codebooks: by part, the entries."""

    frame: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position."""
        return hashlib.sha256(",".join(str(v) for book in self.codebooks for v in book.ravel().tolist()).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codebooks after ``rounds`` rounds, and every kept vector's code under them."""
    scratch = Scratch(df.sparkSession)
    rows, width = kept_vectors(df, scratch, id_col, vector, scale, None, label)
    borders = np.linspace(0, width, parts + 1).astype(int)
    cuts = list(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True))
    starts = [r.key for r in rows.select("id", "key").orderBy(F.col("id").asc_nulls_last(), "key").limit(entries).collect()]
    whole = np.array(starts, np.int64).reshape(len(starts), width)
    books = [whole[:, a:b].copy() for a, b in cuts]
    kind = rows.schema["c0"].dataType
    if not starts:
        scratch.drop()
        none = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", kind), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
        return Codes(df.sparkSession.createDataFrame([], none), books)
    k = len(starts)
    moved = [np.zeros(k) for _ in books]
    state_type = T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("bounds", T.BinaryType())])

    def assign(batches: Iterator[pa.RecordBatch], books, moved, fresh: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
        for batch in batches:
            x, n = matrix(batch.column("key"), width), batch.num_rows
            if fresh:
                code = np.zeros((n, parts), np.uint8)
                bounds = np.concatenate([np.full((n, parts, 1), np.inf, np.float32), np.zeros((n, parts, k), np.float32)], 2)
            else:
                code = unpacked(batch.column("code"), np.uint8, parts)
                bounds = unpacked(batch.column("bounds"), np.float32, parts * (1 + k)).reshape(n, parts, 1 + k)
            for p, (a, b) in enumerate(cuts):
                own, upper, lower = code[:, p].copy(), bounds[:, p, 0].copy(), bounds[:, p, 1:].copy()
                if not fresh:
                    upper = up(upper.astype(float) + moved[p][own])
                    lower = down(np.maximum(lower.astype(float) - moved[p][None, :], 0))
                reassign(x[:, a:b], books[p], own, upper, lower)
                code[:, p], bounds[:, p, 0], bounds[:, p, 1:] = own, upper, lower
            yield batch, x, code, bounds

    def step(table: DataFrame, fresh: bool) -> DataFrame:
        own_books, own_moved = [b.copy() for b in books], [m.copy() for m in moved]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, _, code, bounds in assign(batches, own_books, own_moved, fresh):
                columns = [batch.column(c) for c in ("id", "key", "c0")]
                yield pa.RecordBatch.from_arrays([*columns, packed(code), packed(bounds.reshape(len(code), -1))], names=["id", "key", "c0", "code", "bounds"])
            release()

        return scratch.write(table.mapInArrow(run, state_type), "codes")

    def members(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        x, code = matrix(batch.column("key"), width), unpacked(batch.column("code"), np.uint8, parts)
        for p, (a, b) in enumerate(cuts):
            yield p * k, x[:, a:b], code[:, p]

    def last(table: DataFrame, fresh: bool) -> DataFrame:
        own_books, own_moved = [b.copy() for b in books], [m.copy() for m in moved]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, x, code, _ in assign(batches, own_books, own_moved, fresh):
                error = sum((squared(x[:, a:b], own_books[p][code[:, p]]) for p, (a, b) in enumerate(cuts)), np.zeros(len(x), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("c0"), packed(code), pa.array(error)], names=["id", "label", "code", "error"])
            release()

        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", kind), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
        return Scratch(df.sparkSession).write(table.mapInArrow(run, schema), "coded")

    table = rows
    with small_batches(df.sparkSession, 4096):
        for r in range(rounds):
            following = step(table, r == 0)
            scratch.drop(table)
            table = following
            sums = group_sums(table, ["key", "code"], members)
            for p, book in enumerate(books):
                new = means(book, sums, p * k)
                moved[p] = np.sqrt(squared(new, book).astype(float)) * (1 + MARGIN)
                books[p] = new
        coded = last(table, rounds == 0)
    scratch.drop()
    return Codes(coded, books)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compress(read(spark, sf_dir, "embeddings"))
    f = made.frame.select(F.col("id").alias("vec_id"), "label", F.lower(F.hex("code")).alias("code"), "error")
    # Labels are added up first, so that a hot one is a row when it meets its vectors.
    total = f.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return f.join(total, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(made.digest()).alias("codebooks_sha256"))


def oracle() -> str:
    """Plain Lloyd rounds, unrolled."""
    nearest = "SELECT r, part, entry, d FROM (SELECT x.r, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN {c} AS c USING (part, pos) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1"
    size = 64 // PARTS
    ctes = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, (i // {size}) AS part, (i % {size}) AS pos, q[i + 1] AS v FROM v, range(0, 64) AS t(i))",
        f"f AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS entry FROM v QUALIFY entry < {ENTRIES})",
        "c0 AS MATERIALIZED (SELECT part, entry, pos, v FROM x JOIN f USING (r))",
    ]
    for i in range(ROUNDS):
        ctes.append(f"a{i} AS MATERIALIZED ({nearest.format(c=f'c{i}')})")
        ctes.append(f"s{i} AS (SELECT part, entry, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{i} USING (r, part) GROUP BY ALL)")
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN c.v ELSE (s - ((s % n) + n) % n) // n END AS v FROM c{i} AS c LEFT JOIN s{i} USING (part, entry, pos))")
    ctes.append(f"e AS ({nearest.format(c=f'c{ROUNDS}')})")
    ctes.append("o AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM e GROUP BY r)")
    ctes.append(f"h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM c{ROUNDS})")
    return "WITH " + ",\n".join(ctes) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN o USING (r), h"


ORACLE = oracle()
