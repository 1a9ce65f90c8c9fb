"""Quality rules as a short-circuit cascade (operator 2), in DataFrame functions only.

The rules' costs and selectivities are estimated on a bounded random sample; the cascade then tries them in falling
order of rejections per second, and a document meets no rule after the first that rejects it (CASE WHEN stops
there). The order changes the cost of a verdict, never the verdict. Words and windows are told apart by 64-bit hashes.

Defined cases: null text: no words, so rejected; empty text likewise; texts of any length are read whole;
repeated rows are judged alike; an empty table gives no rows and the order as written; extra columns pass
through ``cascade``, and helper names never clash with them.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspec.llm.common import fresh, pinned, read

#: Documents in the sample that orders the rules, the longest taken into it, how much more of the table it is spread
#: over, and how often a rule is run on it to be timed: costs only, never verdicts.
SAMPLE_ROWS, SAMPLE_CHARS, EXTRA, REPEATS, SEED = 400, 200_000, 8, 10, 11
BASE_FAILS = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
WORD_BREAK = r"[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Rule:
    """A named SQL predicate that is true where a document is rejected, over a text column and the base counts."""

    name: str
    rejects: str


#: {t}: the text; n_words, word_chars, n_symbols, n_dup_lines: base counts.
RULES = (
    Rule("mean_word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("symbols", "4 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 4 AND 2 * n_dup_lines > regexp_count({t}, '\\\\n')"),
    Rule("shouting", "10 * regexp_count({t}, '[A-Z]{{2,}}[!.,?]*(?:[\\\\x20\\\\x09-\\\\x0D]|\\\\z)') > 3 * n_words"),
    Rule("exclamations", "5 * regexp_count({t}, '!!') > n_words"),
    Rule("ellipsis", "5 * regexp_count({t}, '[.][.][.]|\u2026') > n_words"),
    Rule("digits", "2 * regexp_count({t}, '[0-9]') > word_chars"),
)


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; columns of these names are replaced.

    3-word windows are known by 64-bit hashes. Most texts repeat none, which a set of their hashes tells; of the others
    the windows are sorted by hash and place, and each repeated one adds the words that the one before it didn't cover.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    t, words, lines, hashes, win, pairs, at = fresh([*df.columns, *names], "t", "words", "lines", "hashes", "win", "pairs", "at").values()
    keep = [f"`{c}`" for c in df.columns if c not in names]
    out = df.selectExpr(*keep, f"coalesce(cast(`{text}` as string), '') AS {t}")
    out = out.selectExpr(
        *keep,
        t,
        f"filter(split({t}, '{WORD_BREAK}'), w -> w <> '') AS {words}",
        f"filter(split({t}, '\\\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS {lines}",
    )
    out = out.selectExpr(
        *keep,
        t,
        f"cast(size({words}) as bigint) AS n_words",
        f"cast(length(concat_ws('', {words})) as bigint) AS word_chars",
        f"cast(regexp_count({t}, '[#*$%&|<>]') as bigint) AS n_symbols",
        f"cast(size({lines}) - size(array_distinct({lines})) as bigint) AS n_dup_lines",
        f"transform({words}, w -> xxhash64(w)) AS {hashes}",
    )
    rest = [*keep, t, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    out = out.selectExpr(*rest, f"transform(slice({hashes}, 1, greatest(size({hashes}) - 2, 0)), (x, i) -> xxhash64(x, get({hashes}, i + 1), get({hashes}, i + 2))) AS {win}")
    none = "cast(array() as array<struct<k: bigint, i: int>>)"
    out = out.selectExpr(*rest, f"CASE WHEN size(array_distinct({win})) = size({win}) THEN {none} ELSE sort_array(transform({win}, (x, i) -> struct(x AS k, i AS i))) END AS {pairs}")
    out = out.selectExpr(*rest, f"sort_array(transform(filter({pairs}, (x, i) -> x.k <=> get({pairs}, i - 1).k OR x.k <=> get({pairs}, i + 1).k), x -> x.i)) AS {at}")
    repeats = f"aggregate(transform({at}, (p, i) -> least(3, coalesce(get({at}, i + 1) - p, 3))), 0L, (n, x) -> n + x)"
    return out.selectExpr(*rest, f"{pinned(repeats)} AS n_repeat_words")


def sampled(df: DataFrame, text: str, rows: int, longest: int) -> list:
    """``rows`` random texts at most, from the partitions that hold an ``EXTRA``-th of the table, or more if it is small."""
    part = min(1.0, EXTRA * rows / max(1, df.count()))
    return df.select(F.col(f"`{text}`").alias("t")).sample(fraction=part, seed=SEED).where(F.length("t") <= longest).take(rows)


def rule_order(df: DataFrame, text: str, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_CHARS) -> list[Rule]:
    """The rules in falling order of rejections per second. Both are measured on those texts of a bounded sample that pass
    the base test, as only they meet a rule; each rule is ranked on what the ones before it let through."""
    spark = df.sparkSession
    taken = sampled(df, text, rows, longest)
    if not taken:
        return list(rules)
    sample = base_counts(spark.createDataFrame(taken, "t string"), "t").where(f"NOT ({BASE_FAILS})").repartition(1).persist()
    try:
        tests = [rule.rejects.format(t="t") for rule in rules]
        verdicts = np.array(sample.select(*[F.expr(f"coalesce({e}, false)") for e in tests]).collect(), bool).reshape(-1, len(rules))
        many = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

        def seconds(e: str) -> float:
            began = time.perf_counter()
            many.agg(F.count_if(F.expr(e))).first()
            return time.perf_counter() - began

        none = min(seconds("n_words < 0") for _ in range(2))
        costs = [max(min(seconds(e) for _ in range(2)) - none, 1e-4) for e in tests]
    finally:
        sample.unpersist()
    order, left = [], list(range(len(rules)))
    alive = np.ones(len(verdicts), bool)
    while left:
        best = max(left, key=lambda i: ((verdicts[alive, i].sum() + 0.5) / costs[i], -i))
        order.append(rules[best])
        left.remove(best)
        alive &= ~verdicts[:, best]
    return order


def cascade(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """``df`` with the base counts, base_failed, and kept: false if base_failed or a rule rejects the document."""
    own = fresh(df.columns, "text")["text"]
    whole = df.withColumn(own, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    counted = base_counts(whole, own)
    order = rules if rules is not None else rule_order(whole, own)
    base = F.expr(BASE_FAILS)
    verdict: Column = F.when(F.col("base_failed"), False)
    for rule in order:
        verdict = verdict.when(F.expr(rule.rejects.format(t=f"`{own}`")), False)
    return counted.withColumn("base_failed", base).withColumn("kept", verdict.otherwise(True)).drop(own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cascade(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
u AS (SELECT r, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS k, i FROM w, unnest(range(1, len(ws) - 1)) AS x(i)),
v AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM u),
p AS (SELECT DISTINCT r, i + j AS i FROM v, unnest(range(0, 3)) AS x(j) WHERE n > 1),
c AS (SELECT r, count(*) AS n FROM p GROUP BY r),
b AS (SELECT d.doc_id, d.t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(c.n, 0) AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 4 * n_symbols > n_words
            OR (n_dup_lines >= 4 AND 2 * n_dup_lines > len(regexp_extract_all(t, chr(10))))
            OR 10 * len(regexp_extract_all(t, '[A-Z]{2,}[!.,?]*(?:[\\x20\\x09-\\x0D]|\\z)')) > 3 * n_words
            OR 5 * len(regexp_extract_all(t, '!!')) > n_words
            OR 5 * len(regexp_extract_all(t, '[.][.][.]|\u2026')) > n_words
            OR 2 * len(regexp_extract_all(t, '[0-9]')) > word_chars) AS kept
FROM f
"""
