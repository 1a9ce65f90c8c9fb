"""Byte-level BPE encoding and decoding (operator 8).

Words are encoded with a contiguous rank array: a short word holds its parts and the merge ranks of adjacent
parts side by side; the smallest rank is found by a scan, its boundary deleted, and the two neighbouring ranks
refreshed. Words longer than ``LONG_WORD`` bytes use a heap, as scans would be quadratic there.

Whole batches of texts are cut into words with numpy on code points, equal words are encoded once a batch, and
a bounded cache keeps words over batches. Results equal the public ``tokenizers`` library with
``add_special_tokens=False`` and no truncation or padding; the string of an added token inside a text becomes
that token, as there.

Defined cases: a null text counts as empty; an empty text has no ids; any length of text or word works;
repeated rows give repeated results; extra columns pass through, and helper names never clash with them.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyspec.llm.common import fresh, read

LONG_WORD = 128
#: Words in each of a worker's two cache generations, and the longest kept: bounds its memory. When the young generation
#: is full it becomes the old one, whose words move back as they are met; others are encoded again.
CACHE_WORDS, CACHE_CHARS = 100_000, 64
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20
NO_RANK = 1 << 60
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    white = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white] = SPACE
    return out


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Vocabulary and merges of a byte-level BPE file (JSON with ``model.vocab`` and ``model.merges``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = byte_chars(), spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        stand_in = {b: c for c, b in chars.items()}
        self.byte_id = [vocab[stand_in[b]] for b in range(256)]
        self.rank, self.merged = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.lengths = np.fromiter(map(len, self.token_bytes), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode_word(self, word: bytes) -> list[int]:
        parts = [self.byte_id[b] for b in word]
        if len(parts) > LONG_WORD:
            return self._encode_long(parts)
        get, merged = self.rank.get, self.merged
        ranks = [get(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 20 | parts[i + 1], NO_RANK)
        return parts

    def _encode_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.rank.get
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], bytearray(b"\1" * n)
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = self.merged[rank], 0, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := get(parts[a] << 20 | parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p, live in zip(parts, alive, strict=True) if live]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as unsigned 32-bit binary."""
        out = []
        for w in words:
            ids = self.young.get(w)
            if ids is None:
                ids = self.old.get(w)
                if ids is None:
                    ids = array("I", [self.specials[w]] if w in self.specials else self.encode_word(w.encode())).tobytes()
                if len(w) <= CACHE_CHARS:
                    self.young[w] = ids
            out.append(ids)
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        return out

    def cut(self, data: bytes, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of the words of concatenated texts (with the end), and the number of words before each text
        (with the end). ``docs``: byte offsets of the texts, with the end."""
        text = data.decode("utf-8")
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(cp)
        if not n:
            return np.zeros(1, np.int64), np.zeros(len(docs), np.int64)
        at = np.zeros(n + 1, np.int64)
        np.cumsum(1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000), out=at[1:])
        doc_chars = np.searchsorted(at, docs)
        apart = np.zeros(n + 1, bool)
        apart[doc_chars] = True
        inside = []
        for special in self.specials:
            p = text.find(special)
            while p >= 0:
                if apart[p + 1 : p + len(special)].any():  # it spans two texts
                    p = text.find(special, p + 1)
                    continue
                inside.append((p, p + len(special)))
                p = text.find(special, p + len(special))
        for p, q in inside:
            apart[p] = apart[q] = True
        kind = char_classes()[cp]
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= apart[:n]
        # A word after white space takes one blank in front; other last white space stands alone.
        first = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~apart[1:n]) + 1
        start[first - 1] = True
        start[first] = cp[first - 1] != 0x20
        # 's 't 'm 'd 're 've 'll where the apostrophe begins a word.
        mark = np.flatnonzero((cp[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~apart[1:n])
        if len(mark):
            a = cp[mark + 1]
            b = np.where((mark + 2 < n) & ~apart[np.minimum(mark + 2, n)], cp[np.minimum(mark + 2, n - 1)], 0)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            for some, length in ((mark[one], 2), (mark[two], 3)):
                start[some + 1] = False
                end = some + length
                end = end[end < n]
                start[end[(kind[end] == LETTER)]] = True
        for p, q in inside:
            start[p + 1 : q] = False
        words = np.flatnonzero(start)
        return np.append(at[words], at[n]), np.searchsorted(words, doc_chars)

    def encode_buffer(self, data: bytes, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of concatenated texts, and the number of ids before each text (with the end)."""
        offsets, first = self.cut(data, docs)
        if len(offsets) == 1:
            return np.zeros(0, np.uint32), np.zeros(len(docs), np.int64)
        words = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        each = self._words(words.dictionary.to_pylist())
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), np.uint32)
        which = words.indices.to_numpy()
        counts = size[which]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.arange(total[-1]) + np.repeat((np.cumsum(size) - size)[which] - total[:-1], counts)]
        return ids, total[first]

    def decode_buffer(self, ids: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of concatenated id lists, and the number of bytes before each list (with the end)."""
        size = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.arange(total[-1]) + np.repeat(self.starts[ids] - total[:-1], size)], total[docs]

    def encode(self, text: str | None) -> list[int]:
        data = (text or "").encode()
        return self.encode_buffer(data, np.array([0, len(data)]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        ids = np.asarray(ids, np.int64)
        return self.decode_buffer(ids, np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")


class LibraryBPE(ByteBPE):
    """The same ids with a library's merge loop for each word, where a file lists its merges in order of their ids."""

    def __init__(self, path: str):
        super().__init__(path)
        single = set(self.byte_id)
        if self.merged == sorted(self.merged) and not single & set(self.merged):
            import tiktoken

            ranks = {self.token_bytes[i]: i for i in (*self.byte_id, *self.merged)}
            self.core = tiktoken.Encoding("own", pat_str="(?s:.)+", mergeable_ranks=ranks, special_tokens={})._core_bpe
            self.encode_word = self.core.encode_single_piece


@lru_cache(2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


@lru_cache(2)
def load_library(path: str) -> ByteBPE:
    return LibraryBPE(path)


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Rows from and to, the bytes of their texts, and byte offsets; nulls are empty."""
    texts = texts.cast(pa.string())
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1 + texts.offset)[texts.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        to = min(to, n)
        lo, hi = int(offsets[row]), int(offsets[to])
        yield row, to, data[lo:hi].to_pybytes() if hi > lo else b"", offsets[row : to + 1] - lo
        row = to


def encode_documents(df: DataFrame, path: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """``df`` without ``text``, with the ids of each text as little-endian unsigned 32-bit binary, their number,
    and, if ``decoded`` names a column, the text decoded from those ids. Columns of ``df`` with these names are replaced."""
    new = [c for c in (ids, n_tokens, decoded) if c]
    keep = [c for c in df.columns if c not in {text, *new}]
    col = fresh(df.columns, "text")["text"]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(col))
    schema = T.StructType([f for f in src.schema.fields if f.name != col] + [T.StructField(n_tokens, T.LongType()), T.StructField(ids, T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for row, to, data, docs in chunks(batch.column(col)):
                got, first = bpe.encode_buffer(data, docs)
                some = batch.slice(row, to - row)
                columns = [some.column(c) for c in keep] + [pa.array(np.diff(first)), binary(got.astype("<u4").view(np.uint8), first * 4, pa.binary())]
                if decoded:
                    back, ends = bpe.decode_buffer(got.astype(np.int64), first)
                    columns.append(binary(back, ends, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *new[1:2], *new[:1], *new[2:]])

    return src.mapInArrow(run, schema)


def binary(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(docs, path or vocabulary(), decoded="decoded")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
