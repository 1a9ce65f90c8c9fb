"""Line dedup by site-relative frequency (operator 6).

For each host and line, the pages of the host that hold the line are divided by all pages of the host; lines over
a boilerplate ratio are dropped from that host's pages. A line must be on ``MIN_PAGES`` pages besides, or on all of a host
that has fewer (two at least, as any line is on all of one page). A page counts a line once. Counts are pre-aggregated by
(host, line digest), so neither a hot host nor a hot line meets one task; a host can have at most
(mean distinct lines a page) / ratio boilerplate lines, so they travel to its pages as one short array, by
broadcast up to ``BROADCAST_LINES`` in all and by a join that AQE can split beyond. The array is dealt into ``SLOTS`` by
digest, so that a line is compared with a few digests only.

Defined cases: null text: empty, no lines, and returned as empty text; blank lines are kept and never counted;
lines are compared without white space at their ends; a null host is a host of its own; repeated rows are separate
pages; an empty table gives no rows; extra columns pass through, and helper names never clash with them (columns
named n_lines or n_dropped are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspec.llm.common import fresh, materialize, read

#: A line goes if over RATIO_PERCENT of its host's pages, and at least MIN_PAGES of them or all, hold it.
RATIO_PERCENT, MIN_PAGES = 10, 5
BROADCAST_LINES, SLOTS = 50_000, 64


def boilerplate(df: DataFrame, host: str, text: str, ratio_percent: int = RATIO_PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, digest (of a trimmed line), pages, total: every line over the ratio."""
    pages = df.select(F.col(f"`{host}`").alias("host"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    lines = pages.select("host", F.explode(F.expr(f"array_distinct(transform({line_array('text')}, x -> {digest('x')}))")).alias("digest"))
    counts = lines.where("digest IS NOT NULL").groupBy("host", "digest").agg(F.count("*").alias("pages")).where("pages > 1")
    met = counts.join(totals, counts.host.eqNullSafe(totals.host)).drop(totals.host)
    return met.where((F.col("pages") * 100 > F.col("total") * ratio_percent) & (F.col("pages") >= F.least(F.lit(min_pages), "total")))


def line_array(text: str) -> str:
    return f"split(`{text}`, '\\\\n', -1)"


def digest(line: str) -> str:
    """128 bits of a line without outer white space; null for a blank one."""
    trimmed = f"trim(BOTH ' \\t\\r\\u000B\\u000C' FROM {line})"
    return f"CASE WHEN {trimmed} <> '' THEN substring(unhex(md5({trimmed})), 1, 16) END"


def slot(d: str) -> str:
    return f"cast(pmod(xxhash64({d}), {SLOTS}) as int)"


def drop_lines(df: DataFrame, host: str = "source", text: str = "text", ratio_percent: int = RATIO_PERCENT, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``df`` with ``text`` without its host's boilerplate lines, n_lines and n_dropped."""
    columns = [c for c in df.columns if c not in {"n_lines", "n_dropped"}]
    key, found, lines, left = fresh(columns, "key", "found", "lines", "left").values()
    found_rows = materialize(boilerplate(df, host, text, ratio_percent, min_pages).select("host", "digest"), "boilerplate")
    by_host = found_rows.groupBy("host").agg(F.collect_list("digest").alias(found)).withColumnRenamed("host", key)
    by_host = by_host.withColumn(found, F.expr(f"transform(sequence(0, {SLOTS - 1}), s -> filter({found}, d -> {slot('d')} = s))"))
    if found_rows.count() <= broadcast_lines:
        by_host = F.broadcast(by_host)
    pages = df.select(*[F.col(f"`{c}`") for c in columns])
    out = pages.join(by_host, F.col(f"`{host}`").eqNullSafe(F.col(key)), "left").drop(key)
    out = out.withColumn(text, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    out = out.withColumn(lines, F.expr(line_array(text)))
    out = out.withColumn(left, F.expr(f"CASE WHEN {found} IS NULL THEN {lines} ELSE transform(filter(transform({lines}, x -> struct(x AS line, {digest('x')} AS d)), x -> x.d IS NULL OR NOT array_contains(get({found}, {slot('x.d')}), x.d)), x -> x.line) END"))
    count = lambda c: F.when(F.col(f"`{text}`") == "", 0).otherwise(F.size(c)).cast("long")
    out = out.withColumns({"n_lines": count(lines), "n_dropped": (F.size(lines) - F.size(left)).cast("long")})
    return out.withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join(left, "\n")).otherwise(F.col(f"`{text}`"))).drop(found, lines, left)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(docs).select("doc_id", "source", "n_lines", "n_dropped", "text")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, source, i, ls[i] AS line, trim(ls[i], chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) AS key
      FROM (SELECT r, source, string_split(t, chr(10)) AS ls FROM d), unnest(range(1, len(ls) + 1)) AS x(i)),
c AS (SELECT source, key, count(DISTINCT r) AS pages FROM l WHERE key <> '' GROUP BY source, key),
n AS (SELECT source, count(*) AS total FROM d GROUP BY source),
b AS (SELECT c.source, c.key FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE pages > 1 AND pages >= least(5, total) AND pages * 100 > total * 10),
k AS (SELECT l.*, b.key IS NOT NULL AS gone FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.key = b.key),
o AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY r)
SELECT doc_id, source, CASE WHEN t = '' THEN 0 ELSE n_lines END AS n_lines, n_dropped, CASE WHEN n_dropped > 0 THEN coalesce(kept, '') ELSE t END AS text FROM d JOIN o USING (r)
"""
