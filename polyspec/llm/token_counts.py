"""Token counts (operator 12): pieces are counted once per distinct pre-token and never become ids of a text.

A pre-token is a run of characters all of whose neighbours stand side by side in some piece of the vocabulary: as merges
never cross a pair of characters that no piece holds, a text has as many tokens as its pre-tokens have together. One pass
gives the distinct pre-tokens with the number of texts that hold each; each is encoded once. A second pass gives each
text's pre-token frequencies. Frequent pre-tokens (in at least 1 / HEAD of all pairs of text and pre-token, so at most HEAD
of them) are looked up in that pass itself and leave it as one sum a text; the others are joined by a shuffle, in which no
key is hot. Neither pass holds more than a chunk of texts, and the driver holds the frequent pre-tokens alone.

Counts equal those of the ``sentencepiece`` library for a BPE model with byte fallback, an identity normaliser that keeps
white space, and no pieces defined by the user; another model raises ValueError.

Defined cases: null text: empty, of 0 tokens; any length of text or pre-token works; control strings in a text are plain
text; repeated rows are counted each; null ids pass through; extra columns pass through, and helper names never clash with
them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyspec.llm.bytebpe import chunks, vocabulary
from polyspec.llm.common import read, release, small_batches
from polyspec.plans.scratch import Scratch

#: Most frequent pre-tokens that are looked up without a shuffle, and the longest of them in bytes.
HEAD, HEAD_BYTES = 1 << 19, 32
LIMIT, CHUNK_BYTES, WORDS_AT_ONCE = 4096, 1 << 20, 4096
MODEL = "piece_bpe_32k.model"
SPACE = "▁"


class Pieces:
    """Pre-tokens of texts under a model, and the number of pieces of each."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        norm, kind = model.normalizer_spec, model.trainer_spec
        defined = {p.type for p in model.pieces} & {model.SentencePiece.USER_DEFINED, model.SentencePiece.UNUSED}
        plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if kind.model_type != kind.BPE or not kind.byte_fallback or kind.treat_whitespace_as_suffix or defined or not plain:
            raise ValueError("only BPE models with byte fallback and an identity normaliser are counted by pre-token")
        pieces = [p.piece for p in model.pieces if p.type == model.SentencePiece.NORMAL]
        pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        chars = sorted({c for pair in pairs for c in pair} | {SPACE})
        number = {c: i + 1 for i, c in enumerate(chars)}
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.kind[ord(" ")] = number[SPACE]  # a blank is escaped to it
        self.joined = np.zeros((len(chars) + 1,) * 2, bool)
        for a, b in pairs:
            self.joined[number[a], number[b]] = True
        norm.add_dummy_prefix = False  # texts come with their blank in front
        self.encode = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()).encode

    def cut(self, data: bytes, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of the pre-tokens of concatenated texts (with the end), and the text of each."""
        cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.kind[cp]
        start = np.ones(len(cp), bool)
        start[1:] = ~self.joined[kind[:-1], kind[1:]]
        if len(cp) == len(data):
            start[docs[:-1][docs[:-1] < len(cp)]] = True
            at = np.flatnonzero(start)
        else:
            raw = np.frombuffer(data, np.uint8)
            char = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each character
            begins = np.searchsorted(char, docs[:-1])
            start[begins[begins < len(cp)]] = True
            at = char[start]
        return np.append(at, len(data)), np.searchsorted(docs, at, "right") - 1

    def frequencies(self, data: bytes, docs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pre-tokens of concatenated texts; and of each pair of a text and a pre-token of it, by text: the
        number of the text, of the pre-token, and how often it occurs there."""
        offsets, doc = self.cut(data, docs)
        words = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        n = max(1, len(words.dictionary))
        pairs, times = np.unique(doc * np.int64(n) + words.indices.to_numpy(), return_counts=True)
        return words.dictionary, pairs // n, pairs % n, times


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(1)
def head_numbers(words: tuple[str, ...]) -> dict[str, int]:
    return {w: i for i, w in enumerate(words)}


def pre_tokens(texts: DataFrame, column: str, path: str) -> DataFrame:
    """word, texts, pieces: each distinct pre-token, in how many texts it is, and its number of pieces."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for _, _, data, docs in chunks(batch.column(0), CHUNK_BYTES):
                found, _, word, _ = model.frequencies(data, docs)
                yield pa.RecordBatch.from_arrays([found, pa.array(np.bincount(word, minlength=len(found)))], names=["word", "texts"])
        release()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for s in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.slice(s, WORDS_AT_ONCE)
                n = [len(ids) for ids in model.encode(part.column("word").to_pylist(), num_threads=1)]
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("texts"), pa.array(n, pa.int32())], names=["word", "texts", "pieces"])

    found = texts.select(column).mapInArrow(words, "word string, texts long")
    return found.groupBy("word").agg(F.sum("texts").alias("texts")).mapInArrow(count, "word string, texts long, pieces int")


def count_tokens(df: DataFrame, path: str, text: str = "text", head: int = HEAD) -> DataFrame:
    """``df`` without ``text``, with n_bytes and n_tokens of each text. Columns of ``df`` with these names are replaced."""
    scratch = Scratch(df.sparkSession)
    keep = [c for c in df.columns if c not in {text, "n_bytes", "n_tokens"}]
    kept = {c: f"c{i}" for i, c in enumerate(keep)}
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # The blank that the model puts before a text that isn't empty.
    led = F.when(F.length(value) > 0, F.concat(F.lit(" "), value)).otherwise(value)
    src = df.select(F.struct(*[F.col(f"`{c}`").alias(k) for c, k in kept.items()], F.octet_length(value).cast("long").alias("bytes")).alias("doc"), led.alias("text"))

    with small_batches(df.sparkSession):
        table = scratch.write(pre_tokens(src, "text", path), "pieces")
        total = table.agg(F.sum("texts")).first()[0] or 0
        often = table.where((F.col("texts") * head >= total) & (F.octet_length("word") <= HEAD_BYTES)).select("word", "pieces").toArrow()  # ``head`` rows at most
        top, top_pieces = tuple(often["word"].to_pylist()), often["pieces"].to_numpy().astype(np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, known = load(path), head_numbers(top)
            for batch in batches:
                rows, docs_of = batch.column("row"), batch.column("doc")
                for row, to, data, docs in chunks(batch.column("text"), CHUNK_BYTES):
                    found, doc, word, times = model.frequencies(data, docs)
                    at = np.fromiter((known.get(w, -1) for w in found.to_pylist()), np.int64, len(found))[word]
                    seen = at >= 0
                    sums = np.zeros(to - row, np.int64)
                    np.add.at(sums, doc[seen], top_pieces[at[seen]] * times[seen])
                    n, ids = to - row, rows.slice(row, to - row)
                    yield pa.RecordBatch.from_arrays([ids, ids, pa.array([""] * n), pa.array(np.zeros(n, np.int64)), pa.array(sums), docs_of.slice(row, n)], names=["row", "salt", "word", "times", "tokens", "doc"])
                    rest = np.flatnonzero(~seen)
                    if len(rest):
                        n, zero = len(rest), pa.array(np.zeros(len(rest), np.int64))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[rest])), zero, found.take(pa.array(word[rest])), pa.array(times[rest]), zero, pa.nulls(n, docs_of.type)], names=["row", "salt", "word", "times", "tokens", "doc"])
            release()

        long = lambda n: T.StructField(n, T.LongType())
        schema = T.StructType([long("row"), long("salt"), T.StructField("word", T.StringType()), long("times"), long("tokens"), T.StructField("doc", src.schema["doc"].dataType)])
        numbered = src.select(F.monotonically_increasing_id().alias("row"), "doc", "text")
        # A text's own row carries the frequent words' sum under the empty word, which no text has, and a salt of its own.
        pairs = numbered.mapInArrow(run, schema)
        rare = table.where(~((F.col("texts") * head >= total) & (F.octet_length("word") <= HEAD_BYTES))).select("word", F.lit(0).cast("long").alias("salt"), "pieces")
        met = pairs.join(rare, ["word", "salt"], "left")
        tokens = F.sum(F.col("tokens") + F.col("times") * F.coalesce("pieces", F.lit(0)))
        sums = met.groupBy("row").agg(F.first("doc", ignorenulls=True).alias("doc"), tokens.alias("n_tokens"))
        out = Scratch(df.sparkSession).write(sums.select(*[F.col(f"doc.{k}").alias(c) for c, k in kept.items()], F.col("doc.bytes").alias("n_bytes"), "n_tokens"), "counted")
    scratch.drop()
    return out


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, path or vocabulary(MODEL)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
