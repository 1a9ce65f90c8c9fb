import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyspec.llm import chat_format, ngram_join, pu_quality, topk_search


def words(t):
    return [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())]


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else {("", t or "")})


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        t = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 40, 120]))]
        texts.append(" ".join(t))
        for _ in range(rnd.randint(0, 6)):
            u = list(t)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                u[rnd.randrange(len(u))] = rnd.choice(vocabulary)
            texts.append(" ".join(u))
    hub = [rnd.choice(vocabulary) for _ in range(400)]
    for i in range(60):  # a large group of near copies
        texts.append(" ".join([*hub[:200], f"n{i}", *hub[200:]]))
    texts += ["", None, "!!!", "!!!", "Same, words; here. and now", "same words here and NOW", "one"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, class long")
    got = {r.doc_id: r for r in ngram_join.near_duplicates(df).collect()}
    assert len(got) == len(texts)
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(texts)
    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common * 100 >= 80 * (len(sets[i]) + len(sets[j]) - common):
            links[i] += 1
            links[j] += 1
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    assert [got[i].class_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert [got[i].n_links for i in range(len(texts))] == links
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_pairs_far_from_every_hub_are_met(spark, monkeypatch):
    # All share 452 of about 515 shingles (similarity below 0.8), so most are in one prefix of each tree. Each has one near
    # copy, with which it shares 6 more: too few for most pairs to have a prefix of their own.
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    shared = " ".join(f"s{k}" for k in range(456))
    more = lambda c, i, n: "".join(f" {c}{i}x{k}" for k in range(n))
    texts = [shared + more("p", i, 6) + more("a", i, 57 + i % 6) for i in range(300)] + [shared + more("p", i, 6) + more("b", i, 57 - i % 6) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()}
    lost = [i for i in range(600) if got[i] != (i % 300, 1)]
    assert not lost, len(lost)


def test_prefixes_shorten_until_the_recall():
    assert ngram_join.prefix_length(0.8) == 5 and ngram_join.prefix_length(0.95, depth=6) == 6 and ngram_join.prefix_length(0.3) < 4
    # Links near the threshold call for shorter prefixes, many close ones for none; without links the floor is next.
    assert ngram_join.next_level([(0.81, 5000)], 8, 5, 0.8) == 5 and ngram_join.next_level([(0.97, 5000)], 8, 5, 0.8) is None
    assert ngram_join.next_level([(0.82, 2000), (0.95, 5000)], 8, 5, 0.8) == 7 and ngram_join.next_level([], 8, 5, 0.8) == 5
    assert ngram_join.next_level([], 5, 5, 0.8) is None


def test_agreement_of_labels():
    rng = np.random.default_rng(3)
    least = ngram_join.least_agreement(0.8)
    assert 95 < least < 110 and (rng.binomial(ngram_join.TREES * ngram_join.DEPTH, 0.8, 1_000_000) < least).sum() < 10


def test_twins_among_almost_similar_texts_are_linked(spark):
    # 400 pairs of similarity over 0.8 among texts that are all but similar to each other.
    shared = " ".join(f"s{k}" for k in range(700))
    own = lambda c, n: " ".join(f"{c}x{k}" for k in range(n))
    texts = [f"{shared} {own(f'p{i // 2}', 11)} {own(f'd{i}', 78)}" for i in range(800)]
    sets = [shingle_set(t) for t in texts[:3]]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    assert jaccard(sets[0], sets[1]) >= 0.8 > jaccard(sets[0], sets[2]) > 0.78
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()}
    assert sum(got[i] == (i - i % 2, 1) for i in range(800)) >= 790


def test_rows_without_or_with_one_id_are_told_apart(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(0)), (None, text(1)), (5, text(2)), (5, text(3)), (9, text(2) + " more"), (7, text(1)), (None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node long, doc long")
    got = ngram_join.near_duplicates(df).collect()
    by_text = sorted((r.doc_id is None, r.doc_id or 0, r.n_links) for r in got)
    assert len(got) == len(rows) and by_text == [(False, 5, 0), (False, 5, 1), (False, 7, 1), (False, 9, 1), (True, 0, 0), (True, 0, 1), (True, 0, 1), (True, 0, 1)]
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, []).append(r.doc_id)
    found = sorted(sorted((i or 0) for i in c) for c in classes.values())
    assert found == [[0], [0, 0], [0, 7], [5], [5, 9]] and all(c is not None for c in classes)


def test_settings_of_the_session_stay(spark):
    before = dict(spark.conf.getAll)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "vec_id long, embedding array<double>")
    topk_search.search(df, F.lit(True)).count()
    chat_format.repair(spark.createDataFrame([(1, 1, "user", "b")], "conv_id long, turn long, role string, text string")).count()
    ngram_join.near_duplicates(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count()
    assert dict(spark.conf.getAll) == before


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 105), (103, 105)], "a long, b long")
    got = {r.node: r["class"] for r in ngram_join.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == got[105] == got[100] == 100


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_top_k_against_brute_force(spark, lists):
    rng = np.random.default_rng(lists)
    v = rng.normal(size=(150, 6)).round(2)
    v[40:80] = v[3]  # many equal vectors
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (350, [1.0, None] * 3), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (50, v[3].tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, q long")
    got = {}
    for r in topk_search.search(df, F.pmod("id", F.lit(10)) == 0, lists=lists).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ok = [(i, np.floor(256 * np.array(x))) for i, x in rows if x is not None and None not in x and np.isfinite(x).all()]
    for k, (i, q) in enumerate(ok):
        if i % 10 == 0 and i != 50:
            want = sorted((-int(q @ w), j) for n, (j, w) in enumerate(ok) if n != k)[:5]
            assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)], i
    assert len(got[50]) == 10  # the repeated row is a query of its own
    assert topk_search.search(df.limit(0), F.lit(True)).count() == 0
    few = topk_search.search(df.where("vec_id < 3"), F.lit(True)).collect()
    assert len(few) == 6


def test_whole_scores_only_where_a_list_passes(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(7)
    v = rng.normal(size=(3000, 16))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    q = v[:40] + rng.integers(-3, 4, (40, 16))  # each has a near one
    resolved = []
    monkeypatch.setattr(topk_search, "resolve", lambda a, b, i, j: resolved.append(len(i)) or np.einsum("ij,ij->i", a[i], b[j]))
    multiplied = []
    plain = topk_search.product
    monkeypatch.setattr(topk_search, "product", lambda a, b: multiplied.append(len(a) * len(b)) or plain(a, b))

    def cell(low, peaks):
        side = pd.DataFrame({"side": [0] * 40 + [1] * 3000, "id": [*range(40), *range(3000)], "key": [*q, *v], "vb": 0})
        return topk_search.cell_entries(side.assign(low=[*low, *[0] * 3000], peaks=[*peaks, *[None] * 3000]), 16, 2, 1, cut=peaks[0] is not None)

    first = cell([0] * 40, [None] * 40)
    assert sum(resolved) <= 40 * 2 and sum(multiplied) == 2 * 40 * 3000
    low, peaks = first.groupby("q")["score"].max(), first.groupby("q")["peaks"].first()
    resolved.clear(), multiplied.clear()
    second = cell(low.tolist(), peaks.tolist())
    assert sum(resolved) < 0.15 * 40 * 3000
    assert second.groupby("q")["score"].max().tolist() == (q @ v.T).max(1).tolist()
    # A cell whose peaks don't reach the share isn't multiplied at all.
    multiplied.clear()
    assert len(cell([70_000] * 40, [np.array([34_000, 34_999])] * 40)) == 0 and not multiplied


def best_cost(roles):
    """Least cost by trying every state after each message."""
    known = [r if r in chat_format.ROLES else None for r in roles]
    costs = {"": 0}
    for q in known:
        new = {}
        for s, c in costs.items():
            for t in chat_format.ROLES:
                relabel = chat_format.RELABEL * (t != q)
                path = chat_format.CHAINS[s, t]
                ways = ([c + relabel + chat_format.INSERT * len(path)] if path is not None else []) + ([c + chat_format.MERGE + relabel] if s == t else [])
                if ways:
                    new[t] = min(new.get(t, 1 << 40), *ways)
        costs = new
    return min(c + chat_format.INSERT * len(chat_format.CHAINS[s, None]) for s, c in costs.items())


def legal(roles):
    state = ""
    for r in roles:
        if r not in chat_format.NEXT[state]:
            return False
        state = r
    return state == "assistant"


@pytest.mark.parametrize("chunk", [1024, 3])
def test_chats_are_repaired_at_least_cost(spark, chunk):
    rnd = random.Random(chunk)
    kinds = [*chat_format.ROLES, "User ", "bot", None]
    chats = {i: [rnd.choice(kinds) for _ in range(rnd.randint(1, 12))] for i in range(40)}
    chats[None] = ["user", "assistant"]
    chats[99] = [rnd.choice(kinds) for _ in range(200)]
    rows = [(c, t, r, f"m{t} <|end|>" if t % 3 else None, 1) for c, roles in chats.items() for t, r in enumerate(roles)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    got = {}
    for r in chat_format.repair(df, partitions=5, chunk=chunk).collect():
        got.setdefault(r.conv_id, []).append(r)
    assert got.keys() == chats.keys()
    for c, out in got.items():
        out.sort(key=lambda r: r.seq)
        assert [r.seq for r in out] == list(range(len(chats[c]))) and [r.turn for r in out] == list(range(len(out)))
        clean = [chat_format.known(r) for r in chats[c]]
        assert sum(r.cost for r in out) == best_cost(clean), c
        text = "".join(r.rendered for r in out)
        turns = re.findall(r"<\|start\|>(\w+)\n", text)
        assert legal(turns) and text.count("<|end|>") == len(turns) and text.endswith("<|end|>\n")


def test_chat_ties_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None, "user", "b"), (1, None, "user", "b"), (1, 5, "assistant", "c")], "conv_id long, turn long, role string, text string")
    out = sorted(chat_format.repair(df).collect(), key=lambda r: r.seq)
    assert [(r.action, r.cost) for r in out] == [("keep", 0), ("merge", 1), ("keep", 0)]
    assert chat_format.repair(df.limit(0)).count() == 0


def test_quality_is_learnt_from_positives_and_web_text(spark):
    rnd = random.Random(1)
    plain = lambda: " ".join(rnd.choice(["stone", "river", "lamp.", "over", "Kind", "and"]) for _ in range(rnd.randint(5, 80)))
    junk = [lambda: plain().replace(" ", "### "), lambda: plain().upper().replace(" ", "!! "), lambda: plain().replace(" ", " | "), lambda: "go " * 60]
    good = [rnd.random() < 0.8 for _ in range(1500)]
    texts = [plain() if g else rnd.choice(junk)() for g in good]
    docs = spark.createDataFrame([(i, t, "x", 0.1) for i, t in enumerate(texts)], "doc_id long, text string, words string, score double")
    labels = spark.createDataFrame([(i, int(good[i]), 0) for i in range(0, 1500, 2)], "doc_id long, quality int, toxic int")
    model = pu_quality.train(docs, labels)
    got = {r.doc_id: r for r in pu_quality.score(docs, model).collect()}
    assert sum(got[i].predicted == good[i] for i in range(1500)) > 1440
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a " * 50000), (3, "a " * 50000)], "doc_id long, text string")
    scores = pu_quality.score(odd, model).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores)
    none = pu_quality.train(docs, labels.limit(0))
    assert {r.score for r in pu_quality.score(odd, none).collect()} == {0.5}
    assert pu_quality.score(odd.limit(0), model).count() == 0


def test_risk_and_prior_against_plain_computation(spark):
    rng = np.random.default_rng(2)
    p, u = np.c_[rng.normal(1, 1, (300, 3)), np.ones(300)], np.c_[np.concatenate([rng.normal(1, 1, (350, 3)), rng.normal(-3, 1, (150, 3))]), np.ones(500)]
    for w in (rng.normal(size=4), np.array([3.0, 3, 3, 9]), np.zeros(4)):
        loss = lambda z: float(np.log1p(np.exp(-z)))
        pos = sum(loss(x @ w) for x in p) / len(p)
        neg = sum(loss(-(x @ w)) for x in u) / len(u) - 0.7 * sum(loss(-(x @ w)) for x in p) / len(p)
        assert np.isclose(pu_quality.risk(w, p, u, 0.7), 0.7 * pos + max(0, neg))
        part = (lambda v: 0.7 * np.logaddexp(0, -(p @ v)).mean() + np.logaddexp(0, u @ v).mean() - 0.7 * np.logaddexp(0, p @ v).mean()) if neg >= 0 else (lambda v: 0.7 * np.logaddexp(0, p @ v).mean() - np.logaddexp(0, u @ v).mean())
        slopes = [(part(w + h) - part(w - h)) / 2e-6 for h in np.eye(4) * 1e-6]
        assert np.allclose(pu_quality.risk_gradient(w, p, u, 0.7), slopes, atol=1e-6)
    assert 0.6 < pu_quality.class_prior(p, u) < 0.8
    assert pu_quality.risk_gradient(np.array([3.0, 3, 3, 9]), p, u, 0.99) is not None


def plain_features(t):
    spaces = " \t\n\x0b\x0c\r"
    w = re.split(f"[{spaces}]+", t.strip(spaces)) if t.strip(spaces) else []
    counts = [len(re.findall(r"[#*$%&|<>_=~^@]", t)), t.count("|"), t.count("!"), len(re.findall("[A-Z]{2,}", t)), sum(a.lower() == b.lower() for a, b in zip(w, w[1:], strict=False)), len(re.findall(f"[.?](?:[{spaces}]|\\Z)", t)), len(re.findall("[0-9]", t))]
    return [np.log1p(50 * c / max(len(w), 1)) for c in counts]


def test_features_against_plain_counts():
    rnd = random.Random(12)
    texts = ["".join(rnd.choice(["ab ", "AB ", "a.", "?", "! ", "|", "#x\n", "7", " Go go ", "é "]) for _ in range(rnd.randint(0, 40))) for _ in range(300)] + ["", "A", "AB"]
    data = [t.encode() for t in texts]
    got = pu_quality.Texts(b"".join(data), np.cumsum([0, *map(len, data)]))
    assert np.allclose(got.shape, [plain_features(t) for t in texts])
    assert got.n_grams.tolist() == [max(len(d) - 2, 0) for d in data]
    alone = [pu_quality.Texts(d, np.array([0, len(d)])) for d in data]
    assert got.words.tolist() == [x for a in alone for x in a.words.tolist()] and got.grams.tolist() == [x for a in alone for x in a.grams.tolist()]


def test_the_same_model_however_rows_are_dealt(spark):
    rnd = random.Random(3)
    plain = lambda: " ".join(rnd.choice(["stone", "river", "lamp.", "over", "Kind", "and"]) for _ in range(rnd.randint(5, 30)))
    docs = spark.createDataFrame([(i, plain() if i % 4 else plain().replace(" ", "### ")) for i in range(1200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 1200, 3)], "doc_id long, quality int")
    one, two = (pu_quality.train(d, labels, rows=100) for d in (docs.coalesce(1), docs.repartition(7, "text")))
    assert one.buckets == two.buckets and np.isclose(one.prior, two.prior) and np.allclose(one.weights, two.weights, atol=1e-6)


def test_a_small_prior_is_learnt_as_such():
    rng = np.random.default_rng(5)
    p, u = np.c_[rng.normal(4, 1, (2000, 2)), np.ones(2000)], np.c_[np.concatenate([rng.normal(4, 1, (200, 2)), rng.normal(-4, 1, (19_800, 2))]), np.ones(20_000)]
    assert 0.007 < pu_quality.class_prior(p, u) < 0.02


def test_learning_without_ids_or_unlabelled_texts(spark):
    rnd = random.Random(4)
    plain = lambda: " ".join(rnd.choice(["stone", "river", "lamp.", "over", "Kind", "and"]) for _ in range(40))
    rows = [(i, plain() if i % 5 else plain().replace(" ", "### ")) for i in range(600)]
    docs = spark.createDataFrame([*rows, *[(None, "### ### ###")] * 300], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(600)], "doc_id long, quality int")
    scored = {r.doc_id: r.predicted for r in pu_quality.score(docs, pu_quality.train(docs, labels)).collect()}
    assert sum(scored[i] == (i % 5 > 0) for i in range(600)) > 590 and scored[None] == 0
