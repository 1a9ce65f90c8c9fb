import hashlib
import random

import numpy as np
import pytest

from polyspec.llm import bytebpe, centroids, token_counts, vector_codes, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, id int, key int, code string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "x") for i, v, label in rows], SCHEMA)


def plain_codes(keys, starts, parts, rounds):
    """Lloyd rounds over plain integers: codes, errors and codebooks."""
    size = len(keys[0]) // parts
    cut = lambda v: [tuple(v[p * size : (p + 1) * size]) for p in range(parts)]
    books = [[cut(s)[p] for s in starts] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    code_of = lambda v: [min(range(len(books[p])), key=lambda j: (dist(part, books[p][j]), j)) for p, part in enumerate(cut(v))]
    for _ in range(rounds):
        codes = [code_of(v) for v in keys]
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(v)[p] for v, c in zip(keys, codes, strict=True) if c[p] == j]
                if own:
                    books[p] = [*books[p][:j], tuple(sum(x) // len(own) for x in zip(*own, strict=True)), *books[p][j + 1 :]]
    codes = [code_of(v) for v in keys]
    return codes, [sum(dist(part, books[p][c]) for p, (part, c) in enumerate(zip(cut(v), code, strict=True))) for v, code in zip(keys, codes, strict=True)], books


@pytest.mark.parametrize("grid", [True, False])
def test_codes_equal_plain_lloyd_rounds(spark, grid):
    rng = np.random.default_rng(4)
    # On the grid many distances are equal; a third of the rows are one vector.
    v = rng.integers(-2, 3, (240, 8)).astype(float) / 4 if grid else rng.normal(size=(240, 8))
    v[100:180] = v[3]
    rows = [(i * 3, x.tolist(), int(rng.integers(0, 3)) if i % 5 else None) for i, x in enumerate(v)]
    rows += [(9, v[7].tolist(), 1), (None, v[5].tolist(), 2)]
    bad = [(1, None, 1), (2, [1.0, None] * 4, 1), (4, [float("nan")] * 8, 1), (5, [float("inf")] * 8, 1), (6, [1.0] * 7, 1)]
    made = vector_codes.compress(frame(spark, [*rows, *bad]), parts=4, entries=6, rounds=4, scale=16)
    keys = [np.floor(16 * np.array(x)).astype(int).tolist() for _, x, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, keys[i]))
    codes, errors, books = plain_codes(keys, [keys[i] for i in order[:6]], 4, 4)
    want = sorted((str(r[0]), str(r[2]), bytes(c).hex(), e) for r, c, e in zip(rows, codes, errors, strict=True))
    assert sorted((str(r.id), str(r.label), bytes(r.code).hex(), r.error) for r in made.frame.collect()) == want
    assert [[tuple(e) for e in b.tolist()] for b in made.codebooks] == books
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert made.digest() == hashlib.sha256(text.encode()).hexdigest()


def test_pruning_skips_distances_but_no_ties():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-50, 50, (4000, 4)), np.array([[-40, -40, 0, 0], [40, 40, 0, 0], [-40, 40, 0, 0], [40, -40, 0, 0], [40, -40, 0, 0]])
    code, upper, lower = np.zeros(4000, np.uint8), np.full(4000, np.inf, np.float32), np.zeros((4000, 5), np.float32)
    all_ = ((x[:, None] - book) ** 2).sum(2)
    assert vector_codes.reassign(x, book, code, upper, lower) < 4000 * 5
    assert (code == all_.argmin(1)).all() and (upper.astype(float) ** 2 >= all_.min(1)).all() and (lower.astype(float) ** 2 <= all_).all()
    moved = book + np.array([[1, 0, 0, 0], [0, 0, 0, 0], [0, 2, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]])
    shift = np.sqrt(vectors.squared(moved, book).astype(float))
    upper, lower = vector_codes.up(upper + shift[code]), vector_codes.down(np.maximum(lower - shift, 0))
    done = vector_codes.reassign(x, moved, code, upper, lower)
    assert (code == ((x[:, None] - moved) ** 2).sum(2).argmin(1)).all() and done < 4000 * 4


def test_codes_of_few_empty_and_too_large_vectors(spark):
    few = vector_codes.compress(frame(spark, [(1, [0.5, 0.25], None), (1, [0.5, 0.25], None)]), parts=2, entries=16, rounds=2)
    assert sorted((r.id, r.label, bytes(r.code).hex(), r.error) for r in few.frame.collect()) == [(1, None, "0000", 0)] * 2 and len(few.codebooks[0]) == 2
    none = vector_codes.compress(frame(spark, [(1, None, 3)]))
    assert none.frame.count() == 0 and none.frame.columns == ["id", "label", "code", "error"]
    assert vector_codes.compress(frame(spark, [(1, [], 3)])).frame.first().error == 0
    for run in (lambda d: vector_codes.compress(d), lambda d: centroids.cluster(d, width=2)):
        with pytest.raises(ValueError, match="too large"):
            run(frame(spark, [(1, [1e9, 1.0], 1), (2, [1e30, 0.0], 1)]))


def plain_clusters(keys, starts, rounds):
    now = [tuple(s) for s in starts]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(now)), key=lambda j: (dist(v, now[j]), j))
    for _ in range(rounds):
        of = [near(v) for v in keys]
        groups = {j: [v for v, o in zip(keys, of, strict=True) if o == j] for j in range(len(now))}
        now = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)) if groups[j] else now[j] for j in range(len(now))]
    return [(near(v), dist(v, now[near(v)])) for v in keys], now


@pytest.mark.parametrize("grid", [True, False])
def test_clusters_equal_plain_lloyd_rounds(spark, grid):
    rng = np.random.default_rng(9)
    v = rng.integers(-1, 2, (200, 6)).astype(float) if grid else rng.normal(size=(200, 6))
    v[50:120] = v[2]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(7, v[7].tolist(), 0), (None, v[8].tolist(), 0)]
    bad = [(901, None, 1), (902, [1.0, None] * 3, 1), (903, [float("nan")] * 6, 1), (904, [1.0] * 7, 1)]
    made = centroids.cluster(frame(spark, [*rows, *bad]), k=5, rounds=6, scale=2, width=6)
    keys = [np.floor(2 * np.array(x)).astype(int).tolist() for _, x, _ in rows]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, digest(rows[i][0]), keys[i]))
    want, now = plain_clusters(keys, [keys[i] for i in order[:5]], 6)
    assert sorted((str(r.id), r.cluster, r.distance) for r in made.frame.collect()) == sorted((str(r[0]), *w) for r, w in zip(rows, want, strict=True))
    assert [tuple(c) for c in made.centroids.tolist()] == now
    assert made.digests()[0] == hashlib.sha256(",".join(map(str, now[0])).encode()).hexdigest()
    assert centroids.cluster(frame(spark, bad[:1])).frame.count() == 0
    assert centroids.cluster(frame(spark, rows[:3]), width=6).frame.count() == 3


def test_intervals_hold_the_exact_distances():
    rng = np.random.default_rng(3)
    for size in (10, 2000, 1 << 25):
        c = rng.integers(-size, size, (8, 64))
        c[5] = c[1]
        c[6] = c[2]
        c[6, 0] += 1
        x = np.concatenate([rng.integers(-size, size, (3000, 64)), (c[1] + c[3])[None] // 2, c])
        exact = (x.astype(object)[:, None] - c.astype(object)) ** 2
        exact = exact.sum(2)
        can = centroids.shortlist(x, c)
        best = exact.min(1)
        assert all(can[i, j] for i in range(len(x)) for j in range(8) if exact[i, j] == best[i])
        assert (centroids.nearest(x, c) == exact.argmin(1)).all()
        assert size != 2000 or can.sum(1).mean() < 2.5


def library_counts(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=bytebpe.vocabulary(token_counts.MODEL))
    return [len(model.encode(t or "")) for t in texts]


def odd_texts():
    rnd = random.Random(6)
    parts = ["the ", "The", " ", "  ", "\n", "\t", "1", "23", "▁", "é", "中文", "ab.c", "://", "<s>", "</s>", "<0x0A>", "\U0001f600", "　", "don't", "\x00", "\r\n", "ﬁ", "é", "Ünï"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    return [*texts, None, "", " ", "   ", "a", "x" * 20_000, "word " * 20_000, "中" * 5000, "▁▁ ▁"]


@pytest.mark.parametrize("head", [token_counts.HEAD, 1, 40])
def test_counts_equal_the_library(spark, head):
    texts = odd_texts()
    rows = [(i if i % 7 else None, t, "t", 1.5, i) for i, t in enumerate(texts)] + [(1, texts[1], "t", 1.5, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, row double, n_tokens int").repartition(3)
    got = token_counts.count_tokens(df, bytebpe.vocabulary(token_counts.MODEL), head=head)
    assert got.columns == ["doc_id", "word", "row", "n_bytes", "n_tokens"]
    want = sorted((str(r[0]), len((r[1] or "").encode()), n) for r, n in zip(rows, library_counts([r[1] for r in rows]), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert token_counts.count_tokens(df.limit(0), bytebpe.vocabulary(token_counts.MODEL)).count() == 0


def test_frequencies_are_of_one_text_each():
    model = token_counts.load(bytebpe.vocabulary(token_counts.MODEL))
    data = [" aé b b".encode(), b"", b" b\n"]
    words, doc, word, times = model.frequencies(b"".join(data), np.cumsum([0, *map(len, data)]))
    names = words.to_pylist()
    assert {(d, names[w]): t for d, w, t in zip(doc.tolist(), word.tolist(), times.tolist(), strict=True)} == {(0, " a"): 1, (0, "é"): 1, (0, " b"): 2, (2, " b"): 1, (2, "\n"): 1}


def test_other_models_are_refused():
    with pytest.raises(Exception):
        token_counts.Pieces(bytebpe.vocabulary())
