"""Best-fit packing of documents into sequences of fixed size (operator 4).

Sum-of-squares packing: an open sequence has a residual gap; with N(g) open sequences of gap g, each piece goes
where the sum of N(g) squared becomes smallest (ties: the smallest gap, which is the best fit). Pieces come in
falling length, so that the small ones fill what the large ones leave.

Pieces are dealt evenly into groups of about ``GROUP_PIECES``, each packed by one task from lengths alone; a
group's cost is at most the sequences that it leaves partly filled, far below a thousandth of its pieces.

Defined cases: null text: empty, one piece that holds the end id; empty table: no rows; repeated rows are
separate documents; texts of any length are cut; extra columns pass through ``cut_pieces``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyspec.llm.bytebpe import binary, chunks, load_library, vocabulary
from polyspec.llm.common import fresh, materialize, read, release, small_batches

CAPACITY, END_ID, GROUP_PIECES = 2048, 0, 200_000


def cut_pieces(df: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece of each document's ids and ``end_id``: the other columns, piece, start, length, ids (binary,
    little-endian unsigned 32-bit). Longer documents are cut so that only their first piece can be shorter."""
    new = ["piece", "start", "length", "ids"]
    keep = [c for c in df.columns if c not in {text, *new}]
    col = fresh(df.columns, "text")["text"]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(col))
    schema = T.StructType([f for f in src.schema.fields if f.name != col])
    schema = schema.add("piece", T.IntegerType()).add("start", T.LongType()).add("length", T.LongType()).add("ids", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_library(path)
        for batch in batches:
            for row, to, data, docs in chunks(batch.column(col)):
                got, first = bpe.encode_buffer(data, docs)
                ids = np.insert(got, first[1:], end_id).astype("<u4")
                first = first + np.arange(len(first))
                size = np.diff(first)
                head = (size - 1) % capacity + 1
                n = (size - head) // capacity + 1
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                some = batch.slice(row, to - row)
                columns = [some.column(c).take(pa.array(doc)) for c in keep]
                columns += [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), binary(ids.view(np.uint8), np.append(first[doc] + start, first[-1]) * 4, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *new])
            release()

    return src.mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length (1 to ``capacity``), placed in falling length."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; count[0] stays 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened, far = 0, 1 << 60
    for item in order.tolist():
        size = int(lengths[item])
        here = count[size:capacity]
        # From gap g to g - size: (N(g) - 1)^2 + (N(g - size) + 1)^2, less the squares before; a closed one has no square.
        change = 2 * (count[: capacity - size] - here) + 2
        gap = capacity
        best = 2 * int(count[capacity - size]) + 1 if size < capacity else 0  # a new sequence
        if len(change):
            change[0] -= 1
            change[here == 0] = far
            i = int(change.argmin())
            if change[i] <= best:
                gap = i + size
        if gap == capacity:
            b, opened = opened, opened + 1
        else:
            b = stacks[gap].pop()
            count[gap] -= 1
        bins[item], offsets[item] = b, capacity - gap
        if gap > size:
            stacks[gap - size].append(b)
            count[gap - size] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` should be a written table, as it is counted and then
    dealt by row number; it needs a ``length`` column from 1 to ``capacity``."""
    n = pieces.count()
    groups = max(1, round(n / group_pieces))
    group = fresh(pieces.columns, "group")["group"]
    schema = T.StructType(pieces.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    stride = 1 << 32

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns=group).assign(sequence_id=bins + key[0] * stride, offset=offsets)

    dealt = pieces.withColumn(group, F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    return dealt.groupBy(group).applyInPandas(run, schema)


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from packed pieces that still hold ``ids``: sequence_id, length, ids (binary)."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("inside")).select(
        "sequence_id",
        F.expr("aggregate(inside, 0L, (n, x) -> n + x.length)").alias("length"),
        F.expr("aggregate(inside, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"),
    )


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every document."""
    cut = cut_pieces(docs.select(id_col, "text"), path, capacity=capacity)
    with small_batches(docs.sparkSession):
        pieces = materialize(cut.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(pieces, capacity)


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), path or vocabulary())
