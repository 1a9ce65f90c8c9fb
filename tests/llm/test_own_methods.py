"""Methods against versions that share nothing with the modules."""

import random

import numpy as np
from pyspark.sql import functions as F

from polyspec.llm import chat_format, packing, topk_search


def naive_places(lengths, capacity):
    """Offset of each length: every open gap and a new sequence are tried, by the sum over gaps of squared counts."""
    gaps, out = [], {}
    squares = lambda g: sum(g.count(x) ** 2 for x in set(g) if 0 < x < capacity)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[item]
        tried = []
        for gap in sorted({g for g in gaps if g >= size} | {capacity}):
            after = list(gaps)
            if gap in after:
                after.remove(gap)
            tried.append((squares([*after, gap - size]), gap, [*after, gap - size]))
        _, gap, gaps = min(tried, key=lambda t: t[:2])
        out[item] = capacity - gap
    return [out[i] for i in range(len(lengths))]


def test_placement_equals_a_naive_search():
    rnd = random.Random(3)
    for _ in range(60):
        lengths = [rnd.randint(1, 24) for _ in range(rnd.randint(0, 40))]
        bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), 24)
        assert offsets.tolist() == naive_places(lengths, 24)
        for b in set(bins.tolist()):
            places = sorted((o, n) for o, n, c in zip(offsets.tolist(), lengths, bins.tolist(), strict=True) if c == b)
            assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places[:-1]]]).tolist() and sum(n for _, n in places) <= 24


def test_packing_of_tables_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "g", 7, 1), (1, None, 6, "h", 8, 2), (None, "", 7, "i", 9, 3)], "doc_id long, text string, piece long, ids string, length long, __group int")
    out = packing.pack(packing.cut_pieces(df, packing.vocabulary()).cache()).collect()
    assert sorted((r.doc_id or 0, r.length, r.piece, r["__group"]) for r in out) == [(0, 1, 0, 3), (1, 1, 0, 2), (1, 4, 0, 1)]
    assert sorted(r.offset for r in out) == [0, 4, 5] and len({r.sequence_id for r in out}) == 1


def test_least_cost_under_the_automaton_written_out(spark):
    # A system message opens; users follow it, the start or an assistant; assistants follow users and tools; tools follow
    # assistants; an assistant ends. Merging costs 1, another role 2, an empty message 3.
    after = {"start": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user", "tool"}, "tool": {"assistant"}}

    def least(roles):
        best = {"start": 0}

        def spread(costs):  # empty messages
            for _ in range(5):
                for s, c in list(costs.items()):
                    for t in after[s]:
                        costs[t] = min(costs.get(t, 10**9), c + 3)
            return costs

        for r in roles:
            opened, new = spread(dict(best)), {}
            for s, c in opened.items():
                for t in after[s]:
                    new[t] = min(new.get(t, 10**9), c + 2 * (t != r))
            for s, c in best.items():
                if s != "start":
                    new[s] = min(new.get(s, 10**9), c + 1 + 2 * (s != r))
            best = new
        return spread(dict(best))["assistant"]

    rnd = random.Random(12)
    chats = {i: [rnd.choice(["system", "user", "assistant", "tool", "else"]) for _ in range(rnd.randint(1, 9))] for i in range(60)}
    df = spark.createDataFrame([(c, t, r, "m") for c, roles in chats.items() for t, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.cost for r in chat_format.repair(df).groupBy("conv_id").agg(F.sum("cost").alias("cost")).collect()}
    assert got == {c: least(roles) for c, roles in chats.items()}


def test_a_very_long_message_stays_whole(spark):
    df = spark.createDataFrame([(1, 1, "user", "x" * 3_000_000), (1, 2, "assistant", None)], "conv_id long, turn long, role string, text string")
    text = "".join(r.rendered for r in sorted(chat_format.repair(df).collect(), key=lambda r: r.seq))
    assert text.count("x") == 3_000_000


def test_a_null_id_takes_no_part_in_the_search(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in topk_search.search(df, F.col("id") == 0).collect()] == [(0, 1)]
