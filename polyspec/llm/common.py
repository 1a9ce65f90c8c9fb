"""Shared helpers of the training-data operators: table access and names of helper columns. Actions of
the Python operators run in ``small_batches``, which puts the session's setting back; frames that they return lazily don't
depend on it, as ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB) bounds their batches."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from polyspec.plans.scratch import materialize  # noqa: F401

#: Rows per Arrow batch in the operators' own actions.
ARROW_ROWS = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> dict[str, str]:
    """Names for helper columns that clash with none of ``columns``."""
    taken = {c.lower() for c in columns}
    out = {}
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out[name] = new
    return out


def pinned(expression: str) -> str:
    """The SQL expression, always computed in its own projection: Catalyst moves no filter below a column that isn't
    deterministic, where it would otherwise repeat costly array expressions inside the predicate."""
    return f"CASE WHEN spark_partition_id() >= 0 THEN {expression} END"


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Bounds the rows of Arrow batches in the actions inside, so that neither the executor nor a worker holds much of a
    table at once; afterwards the setting is as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.getAll.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def release() -> None:
    """Give the memory that a batch no longer needs back to the system: workers are kept between tasks, and would hold it
    while others run beside them."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def by_group(columns: list[str], one_group: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``one_group`` over each run of rows with equal ``columns``, across batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for pdf in batches:
            if not len(pdf):
                continue
            key = pdf[columns].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(pdf)]
            done = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if held and last != tuple(key[s]):
                    done.append(one_group(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                held.append(pdf.iloc[s:e])
                last = tuple(key[s])
            if done:
                yield pd.concat(done)
                release()
        if held:
            yield one_group(pd.concat(held))
            held.clear()
        release()

    return run
