"""URL filters by hashed host-suffix and path-prefix expressions (operator 3), in DataFrame functions only.

A rule is a host and a path; it fits the host and its subdomains where the url's path starts with the rule's.
Every distinct (host, path) pair of the urls is expanded into its host suffixes times the path prefixes of those
lengths that rules have. An equi-join on the first 32 bits of an expression's digest finds candidates; equal full
SHA-256 digests confirm them; of the rules that fit a pair the longest wins, on equal length a blocking one.
Rules are broadcast only up to ``BROADCAST_RULES``; more are first reduced to those whose short hashes occur, and
beyond that bound again, joined by shuffle with a salt.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and gets the default
verdict; repeated pages are judged alike; an empty table gives no rows; urls of any length work; extra columns pass
through, and helper names never clash with them (columns named host, path, rule or verdict are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspec.llm.common import read

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BROADCAST_RULES, SALTS = 100_000, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as rows: verdict, host, path."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def split_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host (A-Z lower-cased) and path."""
    pattern = r"^(?s).*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    return df.withColumns({"host": F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), "path": F.regexp_extract(text, pattern, 2)})


def expressions(pairs: DataFrame, lengths: list[int], labels: int) -> DataFrame:
    """host, path, expr: each host suffix of at most ``labels`` labels with each path prefix of one of ``lengths``. A longer
    suffix is longer than any rule, so a host's own length doesn't matter."""
    most = F.lit(labels)
    last = F.split(F.substring_index("host", ".", -labels), "[.]")
    suffixes = F.transform(F.sequence(F.greatest(F.size(last) - most + 1, F.lit(1)), F.size(last)), lambda i: F.array_join(F.slice(last, i, most), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    rows = pairs.select("host", "path", F.explode(suffixes).alias("suffix"), cuts.alias("cuts"))
    rows = rows.select("host", "path", "suffix", F.explode("cuts").alias("cut"))
    return rows.select("host", "path", F.concat("suffix", F.lit("\n"), F.expr("substring(path, 1, cut)")).alias("expr"))


def digests(df: DataFrame) -> DataFrame:
    """``df`` with the digest of ``expr`` and its first 32 bits."""
    df = df.withColumn("digest", F.unhex(F.sha2("expr", 256)))
    return df.withColumn("short", F.conv(F.hex(F.expr("substring(digest, 1, 4)")), 16, 10).cast("bigint"))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``df`` with host, path, rule (host and path of the rule that decides, else null) and verdict."""
    keep = [c for c in df.columns if c not in {"host", "path", "rule", "verdict"}]
    pages = split_urls(df.select(*[F.col(f"`{c}`") for c in keep]), url)
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host <> ''").distinct()
    kinds = rules.select(F.length("path").alias("n"), F.size(F.split("host", "[.]")).alias("labels")).distinct().collect()
    lengths, labels = sorted({r.n for r in kinds}), max((r.labels for r in kinds), default=0)
    keyed = digests(rules.select("verdict", F.concat("host", "path").alias("rule"), F.concat("host", F.lit("\n"), "path").alias("expr")))
    keyed = keyed.select("short", F.col("digest").alias("full"), "rule", F.col("verdict").alias("said"))
    if not lengths:
        return pages.select(*[F.col(f"`{c}`") for c in keep], "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    pairs = pages.where("host <> ''").select("host", "path").distinct()
    found = digests(expressions(pairs, lengths, labels))
    n = keyed.count()
    if n > broadcast_rules:
        keyed = keyed.join(found.select("short").distinct(), "short", "left_semi")
        n = keyed.count()
    if n <= broadcast_rules:
        met = found.join(F.broadcast(keyed), "short")
    else:
        salted = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = found.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    met = met.where("digest = full")
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("said") == "block").alias("blocks"), "rule", "said")).alias("best")
    won = met.groupBy("host", "path").agg(best).select("host", "path", "best.rule", F.col("best.said").alias("said"))
    # Pages of a hot pair meet one row of the other side, and AQE splits a skewed join.
    out = pages.join(won, ["host", "path"], "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule", F.coalesce("said", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS u FROM pages),
s AS (SELECT r, page_id, translate(regexp_extract(u, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(u, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM p),
rules(said, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                             ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT r, h || q AS rule, said, row_number() OVER (PARTITION BY r ORDER BY length(h || q) DESC, said DESC) AS k
      FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM s LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (r)
"""
