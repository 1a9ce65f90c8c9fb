"""Stata (dta) files of versions 113 to 115, 117 and 118 by record ranges: the header is parsed once, and a partition reads
the fixed-width records of its own byte range.

Values: missing codes are null; %td and %tc columns are timestamps; value labels are left as numbers; long strings (strL)
aren't supported. Executors must be able to open the path.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORDS = 100_000
# Fixed values of the format: storage codes of the old and the new versions, largest valid value of each storage type, and
# widths of names and formats by version.
OLD_CODES = {251: "i1", 252: "i2", 253: "i4", 254: "f4", 255: "f8"}
NEW_CODES = {65530: "i1", 65529: "i2", 65528: "i4", 65527: "f4", 65526: "f8"}
LARGEST = {"i1": 100, "i2": 32740, "i4": 2147483620, "f4": float.fromhex("0x1.fffffep126"), "f8": float.fromhex("0x1.fffffffffffffp1022")}
NAME_BYTES = {113: 33, 114: 33, 115: 33, 117: 33, 118: 129}
FORMAT_BYTES = {113: 12, 114: 49, 115: 49, 117: 49, 118: 57}
EPOCH = np.datetime64("1960-01-01", "us")


@dataclass(frozen=True)
class Layout:
    """Where the records are and what they hold: columns as (name, storage, format)."""

    start: int
    rows: int
    order: str
    columns: list[tuple[str, str, str]]
    encoding: str

    @property
    def record(self) -> np.dtype:
        return np.dtype([(f"c{i}", kind if kind[0] == "S" else self.order + kind) for i, (_, kind, _) in enumerate(self.columns)])

    def schema(self) -> T.StructType:
        def kind(storage: str, shown: str) -> T.DataType:
            if storage[0] == "S":
                return T.StringType()
            if shown.startswith(("%td", "%d", "%tc")):
                return T.TimestampType()
            return T.LongType() if storage[0] == "i" else T.DoubleType()

        return T.StructType([T.StructField(n, kind(s, f)) for n, s, f in self.columns])


def text_of(raw: bytes, encoding: str) -> str:
    return raw.split(b"\0", 1)[0].decode(encoding, "replace")


def layout(path: str) -> Layout:
    with open(path, "rb") as f:
        return new_layout(f) if f.read(1) == b"<" else old_layout(f)


def old_layout(f) -> Layout:
    f.seek(0)
    head = f.read(109)
    version, order = head[0], "<" if head[1] == 2 else ">"
    if version not in (113, 114, 115):
        raise ValueError(f"dta version {version} isn't supported")
    n_columns, rows = struct.unpack(order + "hi", head[4:10])
    codes = f.read(n_columns)
    names = [text_of(f.read(NAME_BYTES[version]), "latin-1") for _ in range(n_columns)]
    f.read(2 * (n_columns + 1))
    formats = [text_of(f.read(FORMAT_BYTES[version]), "latin-1") for _ in range(n_columns)]
    f.read(n_columns * (NAME_BYTES[version] + 81))
    while True:  # expansion fields
        kind, size = struct.unpack(order + "bi", f.read(5))
        if not kind and not size:
            break
        f.read(size)
    storage = [OLD_CODES.get(c, f"S{c}") for c in codes]
    return Layout(f.tell(), rows, order, list(zip(names, storage, formats, strict=True)), "latin-1")


def new_layout(f) -> Layout:
    f.seek(0)
    head = f.read(1024)
    version = int(head[head.index(b"<release>") + 9 :][:3])
    if version not in (117, 118):
        raise ValueError(f"dta version {version} isn't supported")
    order = "<" if b"<byteorder>LSF" in head else ">"
    n_columns = struct.unpack_from(order + "H", head, head.index(b"<K>") + 3)[0]
    rows = struct.unpack_from(order + ("I" if version == 117 else "Q"), head, head.index(b"<N>") + 3)[0]
    at = struct.unpack_from(order + "14Q", head, head.index(b"<map>") + 5)
    part = lambda i, tag, size: (f.seek(at[i] + len(tag)), f.read(size))[1]
    codes = struct.unpack(f"{order}{n_columns}H", part(2, "<variable_types>", 2 * n_columns))
    encoding = "utf-8" if version == 118 else "latin-1"
    cut = lambda raw, width: [text_of(raw[i * width : (i + 1) * width], encoding) for i in range(n_columns)]
    names = cut(part(3, "<varnames>", n_columns * NAME_BYTES[version]), NAME_BYTES[version])
    formats = cut(part(5, "<formats>", n_columns * FORMAT_BYTES[version]), FORMAT_BYTES[version])
    if any(c == 32768 for c in codes):
        raise ValueError("long strings (strL) aren't supported")
    storage = [NEW_CODES.get(c, f"S{c}") for c in codes]
    return Layout(at[9] + len("<data>"), rows, order, list(zip(names, storage, formats, strict=True)), encoding)


def read_records(path: str, plan: Layout, start: int, end: int, wanted: list[str]) -> pa.RecordBatch:
    """Records ``start`` to ``end`` (exclusive): only their bytes are read."""
    with open(path, "rb") as f:
        f.seek(plan.start + start * plan.record.itemsize)
        rows = np.frombuffer(f.read((end - start) * plan.record.itemsize), plan.record)
    out = {}
    for i, (name, storage, shown) in enumerate(plan.columns):
        v = rows[f"c{i}"]
        if storage[0] == "S":
            out[name] = pa.array([text_of(x, plan.encoding) for x in v.tolist()], pa.string())
            continue
        missing = v > LARGEST[storage]
        if shown.startswith(("%td", "%d", "%tc")):
            unit = 1000 if shown.startswith("%tc") else 86_400_000_000
            micros = np.where(missing, 0, v).astype(np.float64) * unit
            out[name] = pa.array(EPOCH + micros.astype("timedelta64[us]"), pa.timestamp("us", "UTC"), mask=missing)
        else:
            out[name] = pa.array(v.astype(np.int64 if storage[0] == "i" else np.float64), mask=missing)
    return pa.RecordBatch.from_pydict({n: out[n] for n in wanted})


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class StataReader(DataSourceReader):
    def __init__(self, path: str, plan: Layout, records: int, names: list[str]):
        self.path, self.plan, self.records, self.names = path, plan, records, names

    def partitions(self) -> list[Range]:
        return [Range(s, min(self.plan.rows, s + self.records)) for s in range(0, max(self.plan.rows, 1), self.records)]

    def read(self, partition: Range):
        for s in range(partition.start, partition.end, 10_000):
            yield read_records(self.path, self.plan, s, min(partition.end, s + 10_000), self.names)


class StataSource(DataSource):
    """``spark.read.format("dta").option("records", n).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "dta"

    def schema(self) -> T.StructType:
        return layout(self.options["path"]).schema()

    def reader(self, schema: T.StructType) -> StataReader:
        return StataReader(self.options["path"], layout(self.options["path"]), int(self.options.get("records", RECORDS)), schema.names)
