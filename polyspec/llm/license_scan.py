"""License scans by exact set-similarity join (operator 7), in DataFrame functions only.

A template is the word set of a known notice, with words that must not lack; a block is any run of as many consecutive
words of a text as the template has, and ``SLACK_PERCENT`` more, over line ends. A block meets a template if it holds at
least CONTAINMENT_PERCENT of its words, and all that must not lack. All words are ordered by their global frequency, rarest
first, counted over every text. Of a template with n words of which r are required, a block must hold one of the first
n - r + 1 (prefix filter): texts give their occurrences of such words with the words around them, which an equi-join by
word brings to the templates. There, the words around must be r at least (length filter), and a word at place i of the
template, as the rarest that the block has of it, leaves 1 + the words after place i that are around (positional filter).
Every block that holds the occurrence is then verified by counting.

Besides, base phrases are found wherever their words stand consecutively.

The table of template words is broadcast up to ``BROADCAST_TOKENS`` rows, and so are the texts that meet a template, by a
128-bit digest, up to ``BROADCAST_TEXTS``; beyond, both joins are shuffled, with occurrences of a word spread over tasks.

Defined cases: null text: empty, no words and no labels; texts and words of any length are read whole, and a text shorter
than a block is one; repeated rows are judged alike; an empty table gives no rows; extra columns pass through ``scan``,
and helper names never clash with them (columns with the names of results are replaced).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspec.llm.common import fresh, read
from polyspec.plans.scratch import materialize

# The phrases of the base test, and the public wording of license notices.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: (label, notice, words of it that must not lack)
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc sa"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu"),
    ("mit", "Released under the MIT License.", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", "mozilla"),
)
CONTAINMENT_PERCENT, SLACK_PERCENT = 80, 25
BROADCAST_TOKENS, BROADCAST_TEXTS, SALTS = 100_000, 100_000, 16
BREAK = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def word_list(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def word_set(text: str) -> list[str]:
    return sorted(set(word_list(text)))


def required(n: int, percent: int = CONTAINMENT_PERCENT) -> int:
    return -(-n * percent // 100)


def quoted(words) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def lowered(text: str) -> str:
    """A-Z in lower case. The two characters whose full lower case holds a-z give way to another non-ASCII one first;
    other non-ASCII letters may change, but stay word characters and never equal a phrase's or template's."""
    return f"lower(replace(replace({text}, '\\u212A', '\\uFFFD'), '\\u0130', '\\uFFFD'))"


def words_of(text: str) -> str:
    return f"filter(split({text}, '{BREAK}'), x -> x <> '')"


def block_size(notice: str, slack: int = SLACK_PERCENT) -> int:
    n = len(word_list(notice))
    return n + -(-n * slack // 100)


def word_order(low: DataFrame, text: str, vocabulary: list[str]) -> list[str]:
    """The templates' words, rarest first by occurrences in all texts; ties by the word."""
    some = low.select(F.explode(F.expr(f"filter(split(`{text}`, '{BREAK}'), x -> x IN ({quoted(vocabulary)}))")).alias("w"))
    counts = {r.w: r["count"] for r in some.groupBy("w").count().collect()}  # at most a row per template word
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def prefix_table(templates, percent: int, slack: int, order: list[str]) -> list[tuple]:
    """(token, label, share, after, need, block, must): a row per prefix word of a template. ``share``: of one word;
    ``after``: the words after it."""
    at, rows = {w: i for i, w in enumerate(order)}, []
    for label, notice, must in templates:
        words = sorted(word_set(notice), key=at.get)
        need = required(len(words), percent)
        rows += [(w, label, len(words), words[i + 1 :], need, block_size(notice, slack), must.split()) for i, w in enumerate(words[: len(words) - need + 1])]
    return rows


def met_templates(texts: DataFrame, prefixes: list[tuple], broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """key, found (labels), share (greatest) of the (key, words) that meet a template."""
    spark = texts.sparkSession
    table = spark.createDataFrame(prefixes, "token string, label string, n int, after array<string>, need int, block int, must array<string>")
    widest = max(p[5] for p in prefixes)
    tokens = quoted(sorted({p[0] for p in prefixes}))
    # Places, from 1, of prefix words; each with the words of all blocks that hold it, and its place among them.
    places = texts.select("key", "words", F.explode(F.expr(f"filter(transform(words, (x, i) -> struct(x AS token, i + 1 AS at)), o -> o.token IN ({tokens}))")).alias("o"))
    places = places.selectExpr("key", "o.token AS token", "o.at AS at", f"greatest(1, o.at - {widest - 1}) AS lo", "words")
    places = places.selectExpr("key", "token", "at - lo + 1 AS at", f"slice(words, lo, at - lo + {widest}) AS around")
    if len(prefixes) <= broadcast_tokens:
        pairs = places.join(F.broadcast(table), "token")
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = places.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"])
    pairs = pairs.selectExpr("key", "label", "n", "need", "block", "must", "at", "around", "after", "greatest(1, at - block + 1) AS lo")
    pairs = pairs.where("size(around) >= need AND size(array_except(must, around)) = 0 AND 1 + size(array_intersect(after, slice(around, lo, at - lo + block))) >= need")
    common = "transform(sequence(lo, at), s -> CASE WHEN size(array_except(must, slice(around, s, block))) = 0 THEN 1 + size(array_intersect(after, slice(around, s, block))) ELSE 0 END)"
    met = pairs.selectExpr("key", "label", "n", "need", f"array_max({common}) AS common").where("common >= need")
    return met.groupBy("key").agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.col("n")).alias("share"))


def scan(df: DataFrame, text: str = "text", templates=TEMPLATES, percent: int = CONTAINMENT_PERCENT, slack: int = SLACK_PERCENT, broadcast_tokens: int = BROADCAST_TOKENS, broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels, score (greatest containment of a
    template that is met, 1 with a base phrase, else 0)."""
    keep = [c for c in df.columns if c not in RESULTS]
    h = fresh([*keep, *RESULTS], "low", "words", "key", "places", "of_base", "found", "share", "of")
    low, words, key, places, of_base, found, share, of = h.values()
    cols = [f"`{c}`" for c in keep]
    lower = df.selectExpr(*cols, f"{lowered(f'coalesce(cast(`{text}` as string), {chr(39) * 2})')} AS {low}")
    order = word_order(lower, low, sorted({w for _, t, _ in templates for w in word_set(t)}))
    prefixes = prefix_table(templates, percent, slack, order)
    holds = f"exists({words}, w -> w IN ({quoted(sorted({p[0] for p in prefixes}))}))"
    # Equal texts have equal labels: their digest is the key. Texts without a prefix word get keys that spread and meet nothing.
    parts = lower.selectExpr(*cols, low, f"{words_of(low)} AS {words}")
    parts = parts.selectExpr(*cols, low, words, f"CASE WHEN {holds} THEN md5({low}) ELSE cast(monotonically_increasing_id() as string) END AS {key}")
    met = met_templates(parts.where(F.expr(holds)).select(F.col(key).alias("key"), F.col(words).alias("words")), prefixes, broadcast_tokens)
    met = materialize(met, "licenses").withColumnsRenamed({"key": of, "found": found, "share": share})

    may = " OR ".join(f"contains({low}, '{p.split()[0]}')" for p, _ in PHRASES)
    step = lambda p: " AND ".join(f"get({words}, i + {k}) = '{w}'" for k, w in enumerate(p.split()))
    for_phrase = [f"CASE WHEN ({may}) AND size({words}) > 0 THEN filter(sequence(0, size({words}) - 1), i -> {step(p)}) ELSE cast(array() as array<int>) END" for p, _ in PHRASES]
    out = parts.selectExpr(*cols, f"cast(size({words}) as bigint) AS n_words", f"array({', '.join(for_phrase)}) AS {places}", key)
    labelled = "filter(array(" + ", ".join(f"CASE WHEN size({places}[{k}]) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES)) + "), x -> x IS NOT NULL)"
    out = out.selectExpr(*cols, "n_words", key, f"flatten({places}) AS {places}", f"{labelled} AS {of_base}")
    out = out.join(F.broadcast(met) if met.count() <= broadcast_texts else met, F.col(key) == F.col(of), "left")
    return out.selectExpr(
        *cols,
        "n_words",
        f"cast(size({places}) as bigint) AS n_base",
        f"cast(array_min({places}) as bigint) AS first_word",
        f"cast(array_max({places}) as bigint) AS last_word",
        f"array_join(array_sort(array_distinct({of_base})), ',') AS base_labels",
        f"array_join(array_sort(array_distinct(concat({of_base}, coalesce({found}, cast(array() as array<string>))))), ',') AS labels",
        f"CASE WHEN size({places}) > 0 THEN 1D ELSE coalesce({share}, 0D) END AS score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", *RESULTS)


def oracle() -> str:
    phrase = "\n  UNION ALL ".join(
        f"SELECT r, i - 1 AS i, '{label}' AS label FROM w, unnest(range(1, len(ws) + 1)) AS x(i) WHERE " + " AND ".join(f"ws[i + {k}] = '{p}'" for k, p in enumerate(words.split()))
        for words, label in PHRASES
    )
    strings = lambda words: f"[{', '.join(repr(w) for w in words)}]::VARCHAR[]"
    rows = ", ".join(f"({k}, '{label}', {strings(word_set(t))}, {required(len(word_set(t)))}, {block_size(t)}, {strings(must.split())})" for k, (label, t, must) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM d),
p AS ({phrase}),
tpl(k, label, ts, need, size, must) AS (VALUES {rows}),
c AS (SELECT r, ws, tpl.* FROM w JOIN tpl ON len(list_intersect(ts, list_distinct(ws))) >= need),
b AS (SELECT r, label, ts, need, must, list_distinct(list_slice(ws, i, i + size - 1)) AS bs FROM c, unnest(range(1, len(ws) + 1)) AS x(i)),
m AS (SELECT r, label, len(list_intersect(ts, bs)) / len(ts) AS share FROM b WHERE len(list_intersect(ts, bs)) >= need AND len(list_intersect(must, bs)) = len(must)),
pa AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY r),
la AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM p UNION ALL SELECT r, label FROM m) GROUP BY r),
ma AS (SELECT r, max(share) AS share FROM m GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(pa.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(pa.labels, '') AS base_labels, coalesce(la.labels, '') AS labels, CASE WHEN pa.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d JOIN w USING (r) LEFT JOIN pa USING (r) LEFT JOIN la USING (r) LEFT JOIN ma USING (r)
"""


ORACLE = oracle()
