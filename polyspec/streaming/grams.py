"""Streaming curves: Gram matrices are sums, so windows of a stream keep them up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_grams(stream: DataFrame, time: str, columns: list[str], window: str, watermark: str) -> DataFrame:
    """window_start, n, gram per event-time window; rows later than the watermark are left out."""
    v = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns] + [F.lit(1.0)]
    sums = [F.sum(v[i] * v[j]).alias(f"g{i}_{j}") for i in range(len(v)) for j in range(i, len(v))]
    out = stream.withWatermark(time, watermark).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), *sums)
    return out.select(F.col("window.start").alias("window_start"), "n", F.array(*[f"g{i}_{j}" for i in range(len(v)) for j in range(i, len(v))]).alias("gram"))
