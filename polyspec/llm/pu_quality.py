"""Quality classifier by positive-unlabelled learning (operator 5).

A logistic model over features of the whole text is fitted to trusted positives and unlabelled web text by the
non-negative unbiased risk  pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)).  The class prior pi is the smallest ratio, with a
margin for sampling error, of the unlabelled to the positive share above any score of a preliminary classifier (positive
against unlabelled). Features are shape counts per word, and the shares of hashed words and of hashed byte trigrams among
all of a text; of the hashed ones those enter whose mean differs most between the positives and the unlabelled sample, in
units of its deviation. Only a bounded training sample comes to the driver.

Learning sees rows whose crc32(doc_id as text) mod 3 is not 1, and of their labels only the positives; if all of them have
labels, all of their texts are the unlabelled ones. Labels, lang, source and doc_id are never inputs of a score.

Defined cases: null text: empty; an empty text has all features 0 and the score that follows; a null doc_id takes no part
in learning, and is scored; without positives or any texts to learn from every score is 0.5; repeated rows score alike; an
empty table gives no rows; extra columns pass through ``score``, and helper names never clash with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspec.llm.bytebpe import chunks
from polyspec.llm.common import materialize, read, release, small_batches
from polyspec.llm.ngram_join import word_hashes
from polyspec.plans.scratch import Scratch

#: Positives in the training sample, and unlabelled texts in it, about (a Bernoulli sample of rows).
SAMPLE_ROWS = 10_000
#: Bytes of text at once (a longer text alone).
CHUNK = 1 << 20
#: Buckets of hashed words and of hashed trigrams, and how many of them enter the model.
BUCKETS, CHOSEN, SURE = 1 << 14, 128, 6.0
SHAPES = ("symbols", "bars", "exclamations", "shouted", "repeats", "sentences", "digits")
#: Ridges of the shapes and of the hashed features. Of the latter's, 0.001 to 1 were tried with a fit on remainder 0 of the
#: folds and remainder 2 as its test (all from 0.05 on do alike); the held-out remainder has no part in the choice.
RIDGE, HASHED_RIDGE = 1e-3, 0.1
SYMBOLS = b"#*$%&|<>_=~^@"


def table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SPACE, _SYMBOL, _UPPER, _DIGIT, _STOP = (table(b) for b in (b" \t\n\x0b\x0c\r", SYMBOLS, bytes(range(65, 91)), b"0123456789", b".?"))
_WORD = np.where(_SPACE, 0, np.where(_UPPER, np.arange(256) + 32, np.maximum(np.arange(256), 1))).astype(np.uint8)


class Texts:
    """Features of concatenated texts: ``shape`` (a row per text), and for words and trigrams the bucket of each, how many
    each text has, and where its first is."""

    def __init__(self, data: bytes, docs: np.ndarray):
        raw = np.frombuffer(data, np.uint8)
        n_docs, size = len(docs) - 1, len(raw)
        last = np.zeros(size, bool)  # the last byte of a text
        last[docs[1:][np.diff(docs) > 0] - 1] = True
        first, hashes = word_hashes(_WORD[raw], docs)
        self.word_at = np.searchsorted(first, docs)
        self.n_words = np.diff(self.word_at)
        self.words = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        count = lambda places: np.diff(np.searchsorted(places, docs))
        upper = _UPPER[raw]
        pair = np.zeros(size, bool)
        pair[:-1] = upper[:-1] & upper[1:] & ~last[:-1]
        run = pair.copy()
        run[1:] &= ~(pair[:-1])
        stop = _STOP[raw]
        stop[:-1] &= _SPACE[raw[1:]] | last[:-1]
        again = np.zeros(len(hashes), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        starts = self.word_at[:-1]
        again[starts[starts < len(again)]] = False
        places = [_SYMBOL[raw], raw == ord("|"), raw == ord("!"), run, None, stop, _DIGIT[raw]]
        counts = [np.diff(np.searchsorted(first[again], docs)) if x is None else count(np.flatnonzero(x)) for x in places]
        self.shape = np.log1p(50 * np.stack(counts, 1) / np.maximum(self.n_words, 1)[:, None]) if n_docs else np.zeros((0, len(SHAPES)))
        low = np.where(upper, raw + 32, raw).astype(np.uint32)
        three = low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16) if size > 2 else np.zeros(0, np.uint32)
        inside = ~(last[:-2] | last[1:-1]) if size > 2 else np.zeros(0, bool)
        places = np.flatnonzero(inside)
        self.gram_at = np.searchsorted(places, docs)
        self.n_grams = np.diff(self.gram_at)
        self.grams = ((three[places] * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)

    def kinds(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of words and of trigrams: bucket and text of each, and how many the text has."""
        return [(bucket, np.repeat(np.arange(len(n)), n), n) for bucket, n in ((self.words, self.n_words), (self.grams, self.n_grams))]

    def features(self, place: np.ndarray) -> np.ndarray:
        """A row per text: the shapes, and of each bucket with a ``place`` (else -1) the damped share."""
        width = int(place.max(initial=-1)) + 1
        out = np.zeros((len(self.shape), width))
        for (bucket, doc, n), own in zip(self.kinds(), place.reshape(2, BUCKETS), strict=True):
            at = own[bucket]
            times = np.bincount(doc[at >= 0] * width + at[at >= 0], minlength=out.size).reshape(out.shape) if width else 0
            out += times / np.maximum(n, 1)[:, None]
        return np.c_[self.shape, damped(out)]


def damped(share: np.ndarray) -> np.ndarray:
    return np.log1p(50 * share)


def places(buckets) -> np.ndarray:
    out = np.full(2 * BUCKETS, -1)
    out[list(buckets)] = np.arange(len(buckets))
    return out


def moments(df: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean and variance over the texts (column t) of the damped share of each bucket of words, and then of trigrams; and
    the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2, BUCKETS))
        n = 0
        for batch in batches:
            for row, to, data, docs in chunks(batch.column("t"), CHUNK):
                n += to - row
                for kind, (bucket, doc, size) in enumerate(Texts(data, docs).kinds()):
                    cell, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
                    value = damped(times / size[cell // BUCKETS])
                    sums[kind] += [np.bincount(cell % BUCKETS, value**k, BUCKETS) for k in (1, 2)]
            release()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.ravel().tolist()])], names=["n", "sums"])

    parts = df.mapInArrow(run, "n long, sums array<double>")
    rows = parts.select(F.lit(-1).alias("at"), F.col("n").cast("double").alias("v")).unionByName(parts.select(F.posexplode("sums").alias("at", "v")))
    got = rows.groupBy("at").agg(F.sum("v").alias("v")).where("v <> 0").toArrow()  # a row per bucket and moment at most
    total = np.zeros(4 * BUCKETS + 1)
    total[got["at"].to_numpy()] = got["v"].to_numpy()  # the number of texts is at -1
    mean, square = (total[:-1] / max(total[-1], 1)).reshape(2, 2, BUCKETS).transpose(1, 0, 2).reshape(2, -1)
    return mean, np.maximum(square - mean**2, 0), float(total[-1])


def chosen_buckets(positive: tuple, unlabelled: tuple, chosen: int = CHOSEN) -> np.ndarray:
    """The buckets whose means differ most, in units of the deviations, of those that differ for certain: by SURE standard
    errors, which none of so many buckets does by chance."""
    (m1, v1, n1), (m2, v2, n2) = positive, unlabelled
    far = np.abs(m1 - m2) / np.sqrt(v1 + v2 + 1e-12)
    sure = np.abs(m1 - m2) > SURE * np.sqrt(v1 / max(n1, 1) + v2 / max(n2, 1)) + 1e-9
    best = np.argsort(-far, kind="stable")
    return np.sort(best[sure[best]][:chosen])


def vectors(df: DataFrame, buckets: np.ndarray) -> np.ndarray:
    """A row of features per text (column t): the shapes and the damped shares of ``buckets``."""
    place, width = places(buckets), len(SHAPES) + len(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, docs in chunks(batch.column("t"), CHUNK):
                rows = Texts(data, docs).features(place).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], names=["f"])

    got = df.mapInArrow(run, "f binary").collect()  # the bounded sample
    return np.frombuffer(b"".join(bytes(r.f) for r in got), "<f4").reshape(-1, width).astype(np.float64)


@dataclass(frozen=True)
class Model:
    """``weights``: of the shapes, then of ``buckets`` (words, and from BUCKETS on trigrams)."""

    weights: tuple[float, ...]
    bias: float
    prior: float
    buckets: tuple[int, ...] = ()


def fit(positive: np.ndarray, unlabelled: np.ndarray, buckets: np.ndarray | tuple = ()) -> Model:
    """The model of least non-negative risk, on standardised features."""
    if not len(positive) or not len(unlabelled):
        return Model((0.0,) * positive.shape[1], 0.0, 0.5, tuple(buckets))
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.c_[(x - mean) / scale, np.ones(len(x))] for x in (positive, unlabelled))
    ridge = np.r_[np.full(len(SHAPES), RIDGE), np.full(len(mean) - len(SHAPES), HASHED_RIDGE), 0]
    prior = class_prior(p, u, ridge)
    w = descend(lambda w: risk_gradient(w, p, u, prior) + ridge * w, p.shape[1])
    weights = w[:-1] / scale
    return Model(tuple(weights), float(w[-1] - weights @ mean), prior, tuple(int(b) for b in buckets))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def descend(gradient, size: int, steps: int = 800, rate: float = 0.05) -> np.ndarray:
    """Adam with a falling rate, from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(p: np.ndarray, u: np.ndarray, ridge: np.ndarray | float = RIDGE, confidence: float = 0.1) -> float:
    """Share of positives in ``u``: the least upper bound on the ratio of shares above a score. Each half of the rows is
    scored by a classifier of the other half, since one's own rows look more separable than they are."""
    sp, su = np.empty(len(p)), np.empty(len(u))
    for k in (0, 1):
        a, b = p[1 - k :: 2], u[1 - k :: 2]
        if not len(a) or not len(b):
            a, b = p, u
        w = descend(lambda w, a=a, b=b: a.T @ (sigmoid(a @ w) - 1) / len(a) + b.T @ sigmoid(b @ w) / len(b) + ridge * w, p.shape[1], 400)
        sp[k::2], su[k::2] = p[k::2] @ w, u[k::2] @ w
    sp, su = np.sort(sp), np.sort(su)
    cuts = np.unique(np.quantile(sp, np.linspace(0, 0.9, 91)))
    share_p, share_u = (1 - np.searchsorted(s, cuts, "left") / len(s) for s in (sp, su))
    slack = np.sqrt(np.log(4 / confidence) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = int(np.argmin((share_u + slack) / share_p))
    least = 1 / (len(u) + 1)  # no sample tells a smaller share, or one as near to 1
    return float(np.clip(share_u[best] / share_p[best], least, 1 - least))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The logistic non-negative risk."""
    fp, fu = p @ w, u @ w
    return float(prior * np.logaddexp(0, -fp).mean() + max(0.0, np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()))


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the logistic non-negative risk; where the negative part is below 0 its gradient is reversed."""
    fp, fu = p @ w, u @ w
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    of_negative = u.T @ sigmoid(fu) / len(u) - prior * (p.T @ sigmoid(fp)) / len(p)
    of_positive = prior * (p.T @ (sigmoid(fp) - 1)) / len(p)
    return of_positive + of_negative if negative >= 0 else -of_negative


def in_order(rows: np.ndarray) -> np.ndarray:
    """Rows sorted by their values, so that sums and halves of a sample don't depend on how its rows were dealt."""
    return rows[np.lexsort(rows.T[::-1])] if len(rows) else rows


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 1) -> Model:
    """Fit on trusted positives (label 1) and on documents without a label, both outside the held-out fold, as samples of
    about ``rows`` rows each: those of least seeded hash of doc_id and text, however the rows are dealt. Rows that repeat one
    id and text are in or out together; where they swell a sample beyond twice ``rows``, it is thinned at random."""
    scratch = Scratch(docs.sparkSession)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    labels = scratch.write(labels.where(fold).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good")), "labels")
    docs = docs.where(fold).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))

    def some(df: DataFrame, total: int) -> DataFrame:
        """About ``rows`` rows if ``df`` stands for ``total``."""
        share = int(rows / max(total, 1) * (1 << 40))
        at = F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(1 << 40))
        return df if total <= rows else df.where(at < F.lit(share))

    def written(df: DataFrame, tag: str) -> DataFrame:
        out = scratch.write(df.select("t"), tag)
        n = out.count()
        return out if n <= 2 * rows else out.sample(fraction=rows / n, seed=seed)

    # Rows are counted by their ids alone, and sampled before they meet the labels, so that few texts are shuffled.
    ids = docs.select("doc_id").join(labels, "doc_id", "left").agg(F.count_if(F.col("good")).alias("good"), F.count_if(F.col("good").isNull()).alias("web")).first()
    known = labels.where("good").select("doc_id")
    n = known.count()
    chosen = docs.join(F.broadcast(some(known, n)), "doc_id", "left_semi")  # about ``rows`` ids
    positive = written(chosen, "positives")
    web = some(docs, ids.web).join(labels, "doc_id", "left_anti") if ids.web else some(docs, docs.count())
    unlabelled = written(web, "unlabelled")
    with small_batches(docs.sparkSession):
        buckets = chosen_buckets(moments(positive), moments(unlabelled))
        model = fit(in_order(vectors(positive, buckets)), in_order(vectors(unlabelled, buckets)), buckets)
    release()  # the driver's share of the sample
    scratch.drop()
    return model


def scorer(model: Model):
    """An Arrow function from texts to scores."""
    place, weights, bias = places(model.buckets), np.array(model.weights), model.bias

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        out = [sigmoid(bias + Texts(data, docs).features(place) @ weights) for _, _, data, docs in chunks(texts, CHUNK)]
        release()
        return pa.array(np.concatenate([np.zeros(0), *out]))

    return scores


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 where score >= 0.5)."""
    value = scorer(model)(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    return docs.withColumn("score", value).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def scored(docs: DataFrame, model: Model, *columns: str, kept: bool = False) -> DataFrame:
    """The columns of ``score`` as a scratch table; with ``kept``, of the documents predicted to be of quality."""
    out = score(docs, model)
    out = (out.where("predicted = 1") if kept else out).select(*[F.col(f"`{c}`") for c in columns])
    with small_batches(docs.sparkSession):
        return materialize(out, "scored")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, read(spark, sf_dir, "labels")), "doc_id", "score", "predicted")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
