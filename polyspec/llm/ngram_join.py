"""N-gram Jaccard join by a MinHash LSH forest (operator 9).

Words are runs of ASCII letters and digits (lower-cased) and of other non-ASCII bytes; a text's shingles are its
5-word windows (all its words, if fewer), as 64-bit hashes. Texts of equal shingle sets form one node, so exact
copies meet only in a count. Each node has a label of ``DEPTH`` MinHash digits in each of ``TREES`` prefix tries.

Nodes that share a trie prefix are candidates. The join starts at whole labels and shortens the prefixes until the
target recall: the exact similarities of the links met so far, each weighted by its chance to be met, tell which part
of all links shares a prefix of each length, and the join goes on with the longest prefix that is expected to reach
TARGET_RECALL. At the shortest, ``prefix_length``, even pairs just at the threshold reach it. Within a prefix, nodes
are first compared with a hub, which connects most copies cheaply; the pairs that stay unconnected are then compared
in blocks, without a row per pair: labels alone drop the nodes whose digits agree too seldom with any other's, and
shingle sets decide on the rest. So every candidate pair ends in one class, or is verified by its exact Jaccard
similarity. Connected nodes are classes. Links are counted exactly within each class, in blocks of at most about
``BLOCK`` nodes against each other.

Defined cases: null text: empty; texts without words are copies of each other only if equal; repeated rows are
copies; rows of a null doc_id are documents too, and a class without any doc_id gets a negative number; a doc_id may
stand for several texts, and where it is the least of several classes all but one of them get negative numbers; an
empty table gives no rows; any length of text works; extra columns are not carried, and never clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspec.llm.bytebpe import chunks
from polyspec.llm.common import by_group, read, release, small_batches
from polyspec.plans.scratch import Scratch

NGRAM, THRESHOLD_PERCENT, TARGET_RECALL = 5, 80, 0.999
TREES, DEPTH, SEED = 20, 8, 20240229
#: Nodes and (about) shingles in a block of exact comparison.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Parts of a crowded prefix in joins.
SALTS = 16
#: Chance that the labels of a pair at the threshold agree too seldom for its shingle sets to be compared.
MISSED = 1e-6
#: Bytes of text and shingles hashed at once (a longer text is hashed alone).
CHUNK, PART = 1 << 20, 1 << 16
#: Nodes whose texts are looked up by broadcast.
BROADCAST_NODES = 1_000_000


def prefix_length(threshold: float, recall: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair of this similarity meets in some tree with chance ``recall``."""
    for k in range(depth, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def least_agreement(threshold: float, missed: float = MISSED) -> int:
    """The digits that two labels share at least, but for a chance of ``missed`` at this similarity."""
    n, below = TREES * DEPTH, 0.0
    for c in range(n + 1):
        below += math.comb(n, c) * threshold**c * (1 - threshold) ** (n - c)
        if below > missed:
            return c
    return n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bytes() -> np.ndarray:
    """Lower-case form of each byte of a word, 0 for bytes between words."""
    out = np.zeros(256, np.uint8)
    out[0x30:0x3A], out[0x61:0x7B], out[0x80:] = range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)
    out[0x41:0x5B] = range(0x61, 0x7B)
    return out


_LOWER = word_bytes()
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = mix(np.arange(1, NGRAM + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(raw: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of concatenated texts; ``raw``: their bytes, 0 between words."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = raw > 0
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    b = docs[1:-1]  # a word ends with its text
    b = b[(b > 0) & (b < len(raw))]
    starts[b] |= raw[b] > 0
    ends[b - 1] |= raw[b - 1] > 0
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw * powers(_BASE, len(raw)), out=sums[1:])
    return first, mix((sums[last + 1] - sums[first]) * powers(_BACK, len(raw) + 1)[first] + (last - first).astype(np.uint64))


def shingle_sets(data: bytes, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of concatenated texts, and their number before each text (with the end)."""
    n_docs = len(docs) - 1
    first, words = word_hashes(_LOWER[np.frombuffer(data, np.uint8)], docs)
    word_at = np.searchsorted(first, docs)
    n_words = np.diff(word_at)
    n_windows = np.where(n_words >= NGRAM, n_words - NGRAM + 1, np.minimum(n_words, 1))
    at = np.concatenate([[0], np.cumsum(n_windows)])
    start = np.repeat(word_at[:-1] - at[:-1], n_windows) + np.arange(at[-1])
    size = np.repeat(np.minimum(n_words, NGRAM), n_windows)
    total = np.zeros(at[-1], np.uint64)
    padded = np.concatenate([words, np.zeros(NGRAM, np.uint64)])
    for j in range(NGRAM):
        total += np.where(j < size, padded[start + j] * _PLACE[j], np.uint64(0))
    sets = mix(total + size.astype(np.uint64))
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s > 1:
            sets[s:e].sort()
    own = np.repeat(np.arange(n_docs), n_windows)
    fresh = np.ones(len(sets), bool)
    fresh[1:] = (sets[1:] != sets[:-1]) | (own[1:] != own[:-1])
    return sets[fresh], np.concatenate([[0], np.cumsum(np.bincount(own[fresh], minlength=n_docs))]).astype(np.int64)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(0, 1 << 64, TREES * DEPTH, np.uint64, endpoint=False)
    return draw() | np.uint64(1), draw()


def labels(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A label per tree of each non-empty set: DEPTH digits of 8 bits, each of a MinHash value, the first on top. The
    labels of a tree in order are its trie, and their leading digits are its prefixes."""
    a, b = permutations()
    out = np.empty((len(at) - 1, len(a)), np.uint8)
    doc = 0
    while doc < len(at) - 1:
        to = max(doc + 1, int(np.searchsorted(at, at[doc] + PART, "right")) - 1)
        part, cuts = sets[at[doc] : at[to]], at[doc:to] - at[doc]
        for k in range(len(a)):
            out[doc:to, k] = np.minimum.reduceat(part * a[k] + b[k], cuts).astype(np.uint8)
        doc = to
    return out.view(">u8").astype(np.uint64).reshape(-1, TREES)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64).reshape(-1))


def keyed_texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc, f, text."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return own.select("doc", F.xxhash64("text").alias("f"), "text")


def sketches(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc, f (hash of the text), k1, k2 (128 bits of the shingle set), n (shingles), labels (one per tree; none without words)."""
    src = keyed_texts(docs, id_col, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, ends in chunks(batch.column("text"), CHUNK):
                sets, at = shingle_sets(data, ends)
                n = to - row
                size = np.diff(at)
                full = np.flatnonzero(size)
                k = np.zeros((2, n), np.uint64)
                flat = np.zeros(0, np.uint64)
                if len(full):
                    cuts = at[:-1][full]
                    k[0, full] = np.add.reduceat(mix(sets + np.uint64(1)), cuts)
                    k[1, full] = np.add.reduceat(mix(sets ^ _BASE), cuts)
                    flat = labels(sets, np.append(cuts, at[-1]))
                for i in np.flatnonzero(size == 0):
                    k[:, i] = np.frombuffer(hashlib.blake2b(data[ends[i] : ends[i + 1]], digest_size=16).digest(), "<u8")
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(size > 0, TREES, 0))).astype(np.int32)), longs(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(row, n), batch.column("f").slice(row, n), longs(k[0]), longs(k[1]), pa.array(size.astype(np.int32)), lists], names=["doc", "f", "k1", "k2", "n", "labels"])
            release()

    return src.mapInArrow(run, "doc long, f long, k1 long, k2 long, n int, labels array<long>")


def shingles(docs: DataFrame) -> DataFrame:
    """node, n, set (array of sorted 64-bit hashes) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, ends in chunks(batch.column("text"), CHUNK):
                sets, at = shingle_sets(data, ends)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), longs(sets))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(row, to - row), pa.array(np.diff(at).astype(np.int32)), lists], names=["node", "n", "set"])
            release()

    return docs.select("node", "text").mapInArrow(run, "node long, n int, set array<long>")


def prefix(label: str, level: int) -> str:
    return f"shiftrightunsigned({label}, {8 * (DEPTH - level)})"


def tries(nodes: DataFrame, floor: int) -> DataFrame:
    """tree, label, node, n of the nodes that share a prefix of ``floor`` digits with another node."""
    placed = nodes.select("node", "n", F.posexplode("labels").alias("tree", "label")).withColumn("at", F.expr(prefix("label", floor)))
    several = placed.groupBy("tree", "at").agg(F.count("*").alias("met")).where("met > 1").drop("met")
    return placed.join(several, ["tree", "at"]).drop("at")


def buckets(trie: DataFrame, level: int, classes: DataFrame | None) -> DataFrame:
    """tree, at (a prefix of ``level`` digits), node, n, class, of the prefixes that hold several classes. Of prefixes that
    hold the same nodes the one in the first tree stays."""
    rows = trie.select("tree", F.expr(prefix("label", level)).alias("at"), "node", "n")
    return mixed(classed(rows, classes))


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (with node) joined with a row per group, in ``SALTS`` parts, so that a crowded prefix is no task of its own."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(groups, [*keys, "salt"]).drop("salt")


def classed(rows: DataFrame, classes: DataFrame | None) -> DataFrame:
    if classes is None:
        return rows.withColumn("class", F.col("node"))
    return rows.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))


def mixed(rows: DataFrame) -> DataFrame:
    held = rows.groupBy("tree", "at").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("met"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    kept = held.where("lo <> hi").groupBy("met", "x", "y").agg(F.min(F.struct("tree", "at")).alias("first")).select("first.*")
    return spread_join(rows, kept, ["tree", "at"])


def hubs(rows: DataFrame) -> DataFrame:
    """tree, at, hub, hub_n, hub_class: the least node of each prefix."""
    least = F.min(F.struct(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("class").alias("hub_class")))
    return rows.groupBy("tree", "at").agg(least.alias("h")).select("tree", "at", "h.hub", "h.hub_n", "h.hub_class")


def components(edges: DataFrame) -> DataFrame:
    """node, class (the least connected node) of the nodes in ``edges``, by alternating large and small stars."""
    scratch = Scratch(edges.sparkSession)
    state, held = None, None
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = scratch.write(small.select("e.*").where("u <> v").distinct(), "stars")
        scratch.drop(large, held)
        held = edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("class", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(roots)


def shared(pdf: pd.DataFrame) -> np.ndarray:
    """Common shingles of each two of the rows (n, set)."""
    n, size = pdf["n"].to_numpy(np.int64), len(pdf)
    hashes = np.concatenate([np.asarray(s, np.int64) for s in pdf["set"]])
    doc = np.repeat(np.arange(size), n)
    order = np.argsort(hashes, kind="stable")
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    column = np.cumsum(new) - 1
    several = np.bincount(column) > 1  # a hash of one node adds to no intersection
    keep = several[column]
    column, doc = (np.cumsum(several) - 1)[column[keep]], doc[keep]
    common = np.zeros((size, size), np.float32)
    step, width = 4096, int(several.sum())
    cuts = np.searchsorted(column, np.arange(0, width + step, step))
    for k in range(len(cuts) - 1):
        s, e = cuts[k], cuts[k + 1]
        if s < e:
            some = np.zeros((size, min(step, width - k * step)), np.float32)
            some[doc[s:e], column[s:e] - k * step] = 1
            common += some @ some.T
    return common.astype(np.int64)


def similar(pdf: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each two of the rows (n, set) are similar enough, and how similar; no row is similar to itself."""
    n, common = pdf["n"].to_numpy(np.int64), shared(pdf)
    union = n[:, None] + n[None, :] - common
    linked = common * 100 >= union * percent
    np.fill_diagonal(linked, False)
    return linked, common / union


GROUP = ["tree", "at", "i", "p", "j", "q"]


def linked_classes(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b (nodes, a < b), share: of each group of ``dealt`` (GROUP, side, node, class) the two classes with a similar
    enough pair of nodes, if there are two sides one of each, and one such pair with the least similarity."""
    rows = dealt.join(sets, "node").repartition(*GROUP).sortWithinPartitions(*GROUP)

    def one_group(pdf: pd.DataFrame) -> pd.DataFrame:
        linked, share = similar(pdf, percent)
        own, side, node = pdf["class"].to_numpy(np.int64), pdf["side"].to_numpy(), pdf["node"].to_numpy(np.int64)
        linked &= own[:, None] < own[None, :]
        if side.any():
            linked &= side[:, None] != side[None, :]
        a, b = np.nonzero(linked)
        out = pd.DataFrame({"x": own[a], "y": own[b], "a": node[a], "b": node[b], "share": share[a, b]})
        return out.sort_values("share").drop_duplicates(["x", "y"])[["a", "b", "share"]]

    return rows.select(*GROUP, "side", "node", "class", "n", "set").mapInPandas(by_group(GROUP, one_group), "a long, b long, share double")


def hub_groups(met: DataFrame, percent: int) -> DataFrame:
    """Groups of each hub (side 0) with a block of the nodes (side 1) that share a prefix with it and are of a fitting size."""
    fits = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    pairs = met.where((F.col("class") != F.col("hub_class")) & fits).select("hub", "hub_n", "hub_class", "node", "n", "class").distinct()
    sizes = pairs.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    pairs = pairs.join(sizes, "hub").withColumn("p", F.pmod(F.xxhash64("node"), F.col("blocks")))
    group = [F.lit(-1).alias("tree"), F.col("hub").alias("at"), F.lit(0).cast("long").alias("i"), "p", F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("q")]
    others = pairs.select(*group, F.lit(1).alias("side"), "node", "class")
    return others.unionByName(pairs.select(*group, F.lit(0).alias("side"), F.col("hub").alias("node"), F.col("hub_class").alias("class")).distinct())


def block_groups(rows: DataFrame, level: int, above: int, percent: int, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Groups of nodes of ``rows`` that share a prefix of ``level`` digits. They are dealt to bands of sizes, of which only
    equal and adjacent ones can be similar, and to blocks of a band; each two blocks that hold several classes meet. Their
    labels leave out nodes without a partner that no group before had: pairs that share a prefix of ``above`` digits or one
    in an earlier tree, and pairs whose digits agree less often than a similar pair's but for a chance of MISSED."""
    width = math.log(100 / percent) + 1e-9
    sized = rows.withColumn("band", F.floor(F.log("n") / width))
    bands = sized.groupBy("tree", "at", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    own = spread_join(sized, bands, ["tree", "at", "band"]).select("tree", "at", "band", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), "node", "n", "class")
    own = scratch.write(own, "cells")
    cells = own.groupBy("tree", "at", "band", "block").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    one = cells.select("tree", "at", F.col("band").alias("i"), F.col("block").alias("p"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    two = cells.select("tree", "at", F.col("band").alias("j"), F.col("block").alias("q"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = one.join(two, ["tree", "at"]).where("(i = j AND p <= q OR i + 1 = j) AND least(lo1, lo2) <> greatest(hi1, hi2)").select(GROUP)
    first = own.withColumnsRenamed({"band": "i", "block": "p"}).join(met, ["tree", "at", "i", "p"]).withColumn("side", F.lit(0))
    second = own.withColumnsRenamed({"band": "j", "block": "q"}).join(met.where("i <> j OR p <> q"), ["tree", "at", "j", "q"]).withColumn("side", F.lit(1))
    columns = [*GROUP, "side", "node", "n", "class"]
    dealt = first.select(columns).unionByName(second.select(columns)).join(nodes.select("node", "labels"), "node")
    dealt = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP)
    agree = least_agreement(percent / 100)
    shift = lambda k: np.uint64(8 * (DEPTH - k))

    def one_group(pdf: pd.DataFrame) -> pd.DataFrame:
        n, own, side = pdf["n"].to_numpy(np.int64), pdf["class"].to_numpy(np.int64), pdf["side"].to_numpy()
        label = np.stack(pdf["labels"].to_numpy()).astype(np.int64).view(np.uint64)
        a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(pdf)),) * 2
        may = (own[a, None] != own[b]) & (np.minimum(n[a, None], n[b]) * 100 >= np.maximum(n[a, None], n[b]) * percent)
        tree = int(pdf["tree"].iloc[0])
        for t in range(TREES):
            if t < tree:
                may &= (label[a, None, t] ^ label[b, t]) >> shift(level) != 0
            elif above <= DEPTH:
                may &= (label[a, None, t] ^ label[b, t]) >> shift(above) != 0
        i, j = np.nonzero(may)
        digits = label.view(np.uint8).reshape(len(pdf), -1)
        same = np.zeros(len(i), np.int64)
        for s in range(0, len(i), 1 << 14):
            same[s : s + (1 << 14)] = (digits[a[i[s : s + (1 << 14)]]] == digits[b[j[s : s + (1 << 14)]]]).sum(1)
        good = same >= agree
        return pdf.iloc[np.unique(np.concatenate([a[i[good]], b[j[good]]]))].drop(columns=["labels", "n"])

    kinds = "tree int, at long, i long, p long, j long, q long, side int, node long, class long"
    return scratch.write(dealt.select(*columns, "labels").mapInPandas(by_group(GROUP, one_group), kinds), "groups")


def count_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, links: documents in other nodes of its class that are similar enough. ``members``: node, class, copies."""
    sized = members.join(sets.select("node", "n"), "node")
    sized = sized.join(sized.groupBy("class").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "class").drop("n")
    own = sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = other.select("node", "copies", "class", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    dealt = dealt.join(sets, "node")
    dealt = dealt.repartition("class", "i", "j").sortWithinPartitions("class", "i", "j")

    def one_group(pdf: pd.DataFrame) -> pd.DataFrame:
        linked, _ = similar(pdf, percent)
        block = pdf["block"].to_numpy()
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            linked &= block[:, None] != block[None, :]
        return pd.DataFrame({"node": pdf["node"].to_numpy(), "links": linked @ pdf["copies"].to_numpy(np.int64)})

    counted = dealt.select("class", "i", "j", "block", "node", "copies", "n", "set").mapInPandas(by_group(["class", "i", "j"], one_group), "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


class Classes:
    """Classes of nodes as links are found; a link joins whole classes."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.table = scratch, None

    def join(self, links: DataFrame) -> None:
        """``links``: a, b."""
        old, edges = self.table, links.select("a", "b")
        if old is not None:
            for c in "ab":
                of = old.select(F.col("node").alias(c), F.col("class").alias("own"))
                edges = edges.join(of, c, "left").withColumn(c, F.coalesce("own", c)).drop("own")
        new = components(edges)
        if old is not None:
            moved = new.select(F.col("node").alias("class"), F.col("class").alias("now"))
            kept = old.join(moved, "class", "left").select("node", F.coalesce("now", "class").alias("class"))
            new = kept.unionByName(new.join(old.select("node"), "node", "left_anti"))
        self.table = self.scratch.write(new, "classes")
        if old is not None:
            self.scratch.drop(old)


def estimated_recall(links: list[tuple[float, int]], level: int, to: int, threshold: float) -> float:
    """Share of all similar pairs that share ``to`` digits in some tree, from the similarities (and numbers) of links met at
    ``level``: each stands for 1 / (its chance to be met) pairs. A pair at the threshold is added, for what was never met."""
    met = lambda s, k: 1 - (1 - s**k) ** TREES
    pairs = [(s, n / met(s, level)) for s, n in links] + [(threshold, 1.0)]
    return sum(n * met(s, to) for s, n in pairs) / sum(n for _, n in pairs)


def next_level(links: list[tuple[float, int]], level: int, floor: int, threshold: float) -> int | None:
    """The longest shorter prefix that reaches TARGET_RECALL, as far as the links tell; None where ``level`` does."""
    if level <= floor or estimated_recall(links, level, level, threshold) >= TARGET_RECALL:
        return None
    return next((k for k in range(level - 1, floor, -1) if estimated_recall(links, level, k, threshold) >= TARGET_RECALL), floor)


def texts_of(docs: DataFrame, id_col: str, text: str, wanted: DataFrame) -> DataFrame:
    """node, text of the ``wanted`` nodes (node, of and key: the doc_id and hash of a text of theirs)."""
    texts = keyed_texts(docs, id_col, text)
    if wanted.count() <= BROADCAST_NODES:  # 24 bytes a row
        wanted = F.broadcast(wanted)
    met = texts.join(wanted, texts.doc.eqNullSafe(wanted.of) & (texts.f == wanted.key))
    return met.groupBy("node").agg(F.first("text").alias("text"))  # rows of one doc_id and text may repeat


def class_names(own: DataFrame) -> DataFrame:
    """class, class_id of (class, least doc_id of a node)."""
    least = own.groupBy("class").agg(F.min("least").alias("least"))
    first = least.where("least IS NOT NULL").groupBy("least").agg(F.min("class").alias("class")).select("class", F.col("least").alias("own"))
    return least.join(first, "class", "left").select("class", F.coalesce("own", -1 - F.col("class")).alias("class_id"))


def with_copies(seen: DataFrame, own: DataFrame) -> DataFrame:
    """doc, class_id, n_links of every document. Nodes with over a thousandth of the documents, at most 1000 of them, are
    broadcast, so that their copies don't meet in one task."""
    most = max(1000, seen.count() // 1000)
    hot = own.where(F.col("copies") > most).drop("copies").withColumnsRenamed({"class_id": "hot_id", "n_links": "hot_links"})
    dealt = seen.join(F.broadcast(hot), ["k1", "k2"], "left")
    done = dealt.where("hot_links IS NOT NULL").select("doc", F.col("hot_id").alias("class_id"), F.col("hot_links").alias("n_links"))
    rest = dealt.where("hot_links IS NULL").select("doc", "k1", "k2").join(own.where(F.col("copies") <= most), ["k1", "k2"])
    return done.unionByName(rest.select("doc", "class_id", "n_links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """id_col, class_id (least id of its class), n_links (other documents, copies included, that are similar enough)."""
    with small_batches(docs.sparkSession):
        return joined(docs, id_col, text, percent)


def joined(docs: DataFrame, id_col: str, text: str, percent: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    threshold = percent / 100
    floor = prefix_length(threshold)
    seen = scratch.write(sketches(docs, id_col, text), "sketches")
    first = F.min(F.struct("doc", "f")).alias("first")
    nodes = seen.groupBy("k1", "k2").agg(F.min("doc").alias("least"), first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels"))
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    trie = scratch.write(tries(nodes, floor), "tries")
    wanted = nodes.select("node", "first.doc", "first.f").join(trie.select("node").distinct(), "node", "left_semi")
    wanted = scratch.write(wanted.withColumnsRenamed({"doc": "of", "f": "key"}), "wanted")
    sets = scratch.write(shingles(texts_of(docs, id_col, text, wanted)), "sets")
    classes, level, above = Classes(scratch), DEPTH, DEPTH + 1
    met: dict[float, int] = {}

    def add(groups: DataFrame) -> None:
        links = scratch.write(linked_classes(groups, sets, percent), "links")
        shares = links.groupBy(F.round("share", 3).alias("s")).count().collect()  # at most a row per thousandth
        for r in shares:
            met[r.s] = met.get(r.s, 0) + r["count"]
        if shares:
            classes.join(links)
        scratch.drop(links)

    while level is not None:
        rows = scratch.write(buckets(trie, level, classes.table), "buckets")
        rows = spread_join(rows, hubs(rows), ["tree", "at"])
        add(hub_groups(rows, percent))
        rest = rows.where("node <> hub").select("tree", "at", "node", "n")
        rest = scratch.write(mixed(classed(rest, classes.table)), "buckets")
        groups = block_groups(rest, level, above, percent, nodes, scratch)
        add(groups)
        scratch.drop(rest, groups)
        above, level = level, next_level(sorted(met.items()), level, floor, threshold)
    own = nodes.select("k1", "k2", "node", "least", "copies")
    if classes.table is None:
        own = own.withColumns({"class": F.col("node"), "links": F.lit(0).cast("long")})
    else:
        links = count_links(classes.table.join(own.select("node", "copies"), "node"), sets, percent)
        own = own.join(classes.table, "node", "left").join(links, "node", "left").withColumn("class", F.coalesce("class", "node"))
    own = own.select("k1", "k2", "class", "least", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own = scratch.write(own, "counted")
    named = scratch.write(class_names(own), "names")
    out = scratch.write(with_copies(seen.select("doc", "k1", "k2"), own.join(named, "class").select("k1", "k2", "copies", "class_id", "n_links")), "near")
    scratch.paths.remove(out._polyspec_path)
    scratch.drop()
    return out.select(F.col("doc").alias(id_col), "class_id", "n_links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
