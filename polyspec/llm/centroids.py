"""Centroid clustering (operator 13): Lloyd rounds whose products are single floats and whose decisions are exact.

The distances from a batch to all centroids come from one matrix product in single floats. Its error is at most
gamma * |x| * |c| in any order of summation, gamma = m * u / (1 - m * u) with u = 2^-24 and m two more than the components,
so each distance lies in an interval; centroids whose interval begins above the least end are out. A vector that keeps one
centroid is decided; the others' distances are recomputed in exact integers, and of equal ones the lowest number wins.
Every round is a pass over the vectors that hands on sums per centroid; the driver holds the centroids alone.

Defined cases: see ``vectors.kept_vectors`` for rows that take no part and components too large; vectors of another width
than ``width`` take none either; the first centroids are the kept vectors of the smallest SHA-256 of "3:" and the id, of
equal ids by components, null ids last, and fewer than ``k`` if there are fewer vectors; an empty centroid stays; repeated
rows count each; an empty table gives no rows; extra columns aren't carried, and never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspec.llm.common import read, release, small_batches
from polyspec.llm.vectors import group_sums, kept_vectors, matrix, means, squared
from polyspec.plans.scratch import Scratch

K, ROUNDS, SCALE, WIDTH, SALT = 8, 10, 1024, 64, 3
UNIT = 2.0**-24


def shortlist(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(n, k): whether the centroid can be a nearest one of the vector, by intervals of single-float distances."""
    m = (x.shape[1] + 2) * UNIT
    gamma = m / (1 - m)
    with np.errstate(over="ignore", invalid="ignore"):
        product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
        c = centroids.astype(float)
        square = np.einsum("ij,ij->i", c, c)
        length = np.sqrt(np.einsum("ij,ij->i", x.astype(float), x.astype(float)))
        score = square[None, :] - 2 * product  # the squared distance less that of the vector
        # Twice the product's error, and that of the few operations in doubles.
        error = (2 * gamma * length[:, None] * np.sqrt(square)[None, :]) * (1 + 1e-9) + (np.abs(score) + square[None, :]) * 1e-12
        return ~(score - error > (score + error).min(1, keepdims=True))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, exactly; ties go to the lowest number."""
    can = shortlist(x, centroids)
    out = can.argmax(1)
    open_ = np.flatnonzero(can.sum(1) > 1)
    best = np.full(len(open_), np.iinfo(np.int64).max)
    for j in range(len(centroids)):
        at = np.flatnonzero(can[open_, j])
        d = squared(x[open_[at]], centroids[j])
        won = d < best[at]
        best[at[won]], out[open_[at[won]]] = d[won], j
    return out


@dataclass(frozen=True)
class Clusters:
    """frame: id, cluster, distance (squared); centroids: their components."""

    frame: DataFrame
    centroids: np.ndarray

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]


def cluster(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, salt: int = SALT) -> Clusters:
    """Centroids after ``rounds`` rounds, and every kept vector's nearest one."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows, width = kept_vectors(df, scratch, id_col, vector, scale, width)
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    starts = [r.key for r in rows.select("key", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "key").limit(k).collect()]
    centroids = np.array(starts, np.int64).reshape(len(starts), width)
    if not starts:
        scratch.drop()
        return Clusters(spark.createDataFrame([], "id long, cluster int, distance long"), centroids)

    def sums(now: np.ndarray) -> dict[int, tuple[int, list[int]]]:
        def members(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            x = matrix(batch.column("key"), width)
            yield 0, x, nearest(x, now)

        return group_sums(rows, ["key"], members)

    def place(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("key"), width)
                of = nearest(x, now)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(of.astype(np.int32)), pa.array(squared(x, now[of]))], names=["id", "cluster", "distance"])
            release()

        return run

    with small_batches(spark, 4096):
        for _ in range(rounds):
            centroids = means(centroids, sums(centroids))
        out = Scratch(spark).write(rows.select("id", "key").mapInArrow(place(centroids), "id long, cluster int, distance long"), "clusters")
    scratch.drop()
    return Clusters(out, centroids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cluster(read(spark, sf_dir, "embeddings"))
    per = made.frame.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()  # a row per centroid
    inertia = {r.cluster: r.total for r in per}
    whole, digest = sum(inertia.values()), made.digests()
    known = spark.createDataFrame([(c, t, whole, digest[c]) for c, t in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = made.frame.join(F.broadcast(known), "cluster")
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """Plain Lloyd rounds, unrolled."""
    closest = "SELECT r, cluster, d FROM (SELECT x.r, c.cluster, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN {c} AS c USING (pos) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1"
    ctes = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, i AS pos, q[i + 1] AS v FROM v, range(0, {WIDTH}) AS t(i))",
        f"f AS (SELECT r, row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id) NULLS LAST, q) - 1 AS cluster FROM v QUALIFY cluster < {K})",
        "c0 AS MATERIALIZED (SELECT cluster, pos, v FROM x JOIN f USING (r))",
    ]
    for i in range(ROUNDS):
        ctes.append(f"a{i} AS MATERIALIZED ({closest.format(c=f'c{i}')})")
        ctes.append(f"s{i} AS (SELECT cluster, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY ALL)")
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, pos, CASE WHEN n IS NULL THEN c.v ELSE (s - ((s % n) + n) % n) // n END AS v FROM c{i} AS c LEFT JOIN s{i} USING (cluster, pos))")
    ctes.append(f"e AS ({closest.format(c=f'c{ROUNDS}')})")
    ctes.append(f"h AS (SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos)) AS h FROM c{ROUNDS} GROUP BY cluster)")
    total = "CAST(sum(d) OVER ({}) AS BIGINT)"
    return "WITH " + ",\n".join(ctes) + f" SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, {total.format('PARTITION BY cluster')} AS cluster_inertia, {total.format('')} AS inertia, h AS centroid_sha256 FROM v JOIN e USING (r) JOIN h USING (cluster)"


ORACLE = oracle()
