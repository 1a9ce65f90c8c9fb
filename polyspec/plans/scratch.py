"""Scratch tables in the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths written in each scope that is open in this thread.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a session whose tasks run in the driver's own process
    (tests, local runs) gets a temporary folder; on a cluster it must be set, as executors share no local folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(sc, "_polyspec_scratch", None)
    if own is None:
        own = f"file://{tempfile.mkdtemp(prefix='polyspec-')}"
        sc._polyspec_scratch = own
        sc.setCheckpointDir(own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one computation: ``write`` adds one, ``drop`` deletes those that no frame needs any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: lineage ends in files that every executor sees, so that a lost
        executor costs only its running tasks."""
        path = f"{scratch_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append(path)
        for paths in _scopes.get():
            paths.append(path)
        out._polyspec_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete the tables of these frames, or of all that were written here."""
        gone = [f._polyspec_path for f in frames if f is not None] if frames else list(self.paths)
        for path in gone:
            remove(self.spark, path)
        self.paths = [p for p in self.paths if p not in gone]


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all scratch tables that this thread wrote inside it, after errors too. Frames that read them are of no
    use then: save results inside (``Result.save``), and load them again after it. Scopes can be nested."""
    paths: list[str] = []
    before = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in paths:
            remove(spark, path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a scratch table, which stays until its ``scope`` ends or, without one, until the folder is emptied."""
    return Scratch(df.sparkSession).write(df, tag)
