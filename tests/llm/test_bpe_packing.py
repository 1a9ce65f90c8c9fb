import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from polyspec.llm import bytebpe, packing

PATH = bytebpe.vocabulary()


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def ids_of(blob: bytes) -> list[int]:
    return np.frombuffer(blob, "<u4").tolist()


def test_random_texts_match_the_library(theirs):
    rnd = random.Random(3)
    some = [*" \n\t'stmdrevl<|>aé漢😀9٣!.", " ", "　", "  ", "<|endoftext|>", "'ll", "'s"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 50))) for _ in range(3000)]
    bpe = bytebpe.load(PATH)
    data = [t.encode() for t in texts]
    ids, first = bpe.encode_buffer(b"".join(data), np.cumsum([0, *map(len, data)]))
    for i, e in enumerate(theirs.encode_batch(texts, add_special_tokens=False)):
        assert ids[first[i] : first[i + 1]].tolist() == e.ids, texts[i]


def test_long_word_and_round_trip(theirs):
    bpe = bytebpe.load(PATH)
    for text in ("ab" * 4000 + "tion" * 300, "x" * 129, "x" * 128, "", "\x00\x01", "é" * 500):
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == text


def test_documents_with_nulls_repeats_and_extra_columns(spark, theirs):
    rows = [(1, "Hello world", "n"), (2, None, "x"), (3, "", None), (1, "Hello world", "n"), (4, "a " * 30000, "long"), (None, "id", "null")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text string")
    got = bytebpe.encode_documents(df, PATH, decoded="decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t, _ in rows if d == r.doc_id) or ""
        assert ids_of(bytes(r.ids)) == theirs.encode(text, add_special_tokens=False).ids and r.decoded == text and r.n_tokens == len(ids_of(bytes(r.ids)))
    assert bytebpe.encode_documents(df.limit(0), PATH).count() == 0


def test_pieces_and_packing(spark, theirs):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["the", "quick", "tion", "zq"]) for _ in range(rnd.choice([0, 3, 40, 300, 2500])))) for i in range(120)] + [(500, None), (3, "the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = packing.cut_pieces(df, PATH, capacity=512).collect()
    whole: dict = {}
    for p in cut:
        assert p.length == len(ids_of(bytes(p.ids))) <= 512 and (p.piece == 0 or p.length == 512)
        whole.setdefault(p.doc_id, []).append(p)
    for doc, text in rows[:120]:
        if doc != 3:
            got = sorted(whole[doc], key=lambda p: p.piece)
            assert [p.start for p in got] == np.cumsum([0, *[p.length for p in got]])[:-1].tolist()
            assert [i for p in got for i in ids_of(bytes(p.ids))] == [*theirs.encode(text, add_special_tokens=False).ids, 0]
    packed = packing.pack_documents(df, PATH, capacity=512).collect()
    assert len(packed) == len(cut)
    filled: dict = {}
    for p in packed:
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for inside in filled.values():
        inside.sort()
        assert [o for o, _ in inside] == np.cumsum([0, *[n for _, n in inside]])[:-1].tolist() and sum(n for _, n in inside) <= 512
    assert len(filled) <= sum(p.length for p in packed) / 512 * 1.02 + 2


def test_packing_is_near_the_bound_and_assembles(spark):
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6, 1, 20000).astype(int), 1, 2048)
    bins, offsets = packing.sum_of_squares(lengths, 2048)
    used = np.bincount(bins, weights=lengths)
    assert used.max() <= 2048 and len(used) <= lengths.sum() / 2048 * 1.003 + 3
    df = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    out = packing.assemble(packing.pack(packing.cut_pieces(df, PATH).cache())).collect()
    assert len(out) == 1 and out[0].length * 4 == len(out[0].ids)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
