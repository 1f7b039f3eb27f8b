"""Toxicity from a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features say which n-grams of 3 to 7 characters it holds (A-Z lower-cased, white space runs as
one space, a space at both ends), by hash bucket. A feature's value is its log-count ratio: the logarithm
of its share among the n-grams of toxic documents over that among the others, both with one added. Logistic
regression with weight decay over these values gives the probability of being toxic.

It is fitted on a bounded sample: of each label at most ``sample`` labelled documents, those with the
smallest hashes of their ids among the rows to learn from, whole texts. Tasks count the n-grams of the
sample; the ``features`` buckets that tell the labels apart best (likelihood ratio statistic) are kept,
and only their numbers come to the driver, at most ``features`` for each sampled document. Every document
is scored in place, without a shuffle.

Null and empty texts hold one space. Long texts are read whole, in overlapping pieces. Labels with a null
id or value are ignored; of several labels of one id the lowest counts, of several documents with a
sampled id one is learned from. Without labels of both kinds every score is 0.5. Ids, language, source and
labels are never features. Columns pass through unchanged; an empty table stays empty.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabscout.session import ship, written

SAMPLE = 4000
FEATURES = 8192
THRESHOLD = 0.5
SIZES = (3, 4, 5, 6, 7)
BITS = 22
PIECE = 1 << 20  # characters looked at together

_STEP = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Hash buckets of all n-grams of a text, by piece and size."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = np.concatenate(([np.uint64(32)], c, [np.uint64(32)]))
    c[(c >= 9) & (c <= 13)] = 32
    c[(c >= 65) & (c <= 90)] += np.uint64(32)
    space = c == 32
    c = c[~(space & np.concatenate(([False], space[:-1])))]
    for at in range(0, len(c), PIECE):
        h = piece = c[at:at + PIECE + max(SIZES) - 1]
        for size in range(2, max(SIZES) + 1):
            if len(piece) < size:
                break
            h = h[:-1] * _STEP + piece[size - 1:]
            if size in SIZES:  # the size tells n-grams apart that differ in leading characters of value 0
                yield ((h + np.uint64(size)) * _SPREAD >> np.uint64(64 - BITS)).astype(np.int32)


def present(text: str | None) -> np.ndarray:
    """The buckets a text has, each once."""
    return np.unique(np.concatenate([np.empty(0, np.int32), *map(np.unique, buckets(text))]))


class Model(NamedTuple):
    """``feature`` numbers the kept buckets, -1 elsewhere; ``weight`` belongs to their presence."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def found(self, text: str | None) -> np.ndarray:
        """Features of a text, in order."""
        has = np.zeros(len(self.weight) + 1, bool)
        for b in buckets(text):
            has[self.feature[b]] = True  # -1 marks the spare place at the end
        return np.flatnonzero(has[:-1])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weight[self.found(text)].sum() + self.bias, -500, 500))))


NOTHING = Model(np.full(1 << BITS, -1, np.int16), np.zeros(0), 0.0)


def log_ratio(toxic: np.ndarray, other: np.ndarray, all_toxic: int, all_other: int) -> np.ndarray:
    """Naive Bayes log-count ratios; ``all_...`` are the sums over all buckets, ones added."""
    return np.log((toxic + 1) / all_toxic) - np.log((other + 1) / all_other)


def fit(documents: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, rounds: int = 200, rate: float = 0.05,
        decay: float = 3e-3) -> tuple[np.ndarray, float]:
    """(weights of presence, bias): logistic regression over ``ratio`` values by full-batch Adam.

    Both labels weigh the same in sum.
    """
    sizes = np.array([len(d) for d in documents])
    at = np.concatenate([np.empty(0, np.int64), *documents]).astype(np.int64)
    row = np.repeat(np.arange(len(documents)), sizes)
    share = labels.mean()
    per_row = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(labels)
    w = np.zeros(len(ratio) + 1)  # the last one is the bias
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for turn in range(1, rounds + 1):
        z = np.bincount(row, (w[:-1] * ratio)[at], len(documents)) + w[-1]
        pull = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) * per_row
        g = np.append(np.bincount(at, pull[row], len(ratio)) * ratio + decay * w[:-1], pull.sum())
        mean = 0.9 * mean + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        w -= rate * (mean / (1 - 0.9 ** turn)) / (np.sqrt(square / (1 - 0.999 ** turn)) + 1e-8)
    return w[:-1] * ratio, float(w[-1])


def _sampled(docs: DataFrame, labels: DataFrame, learn: Column, sample: int) -> DataFrame:
    """(doc_id, toxic, text) of the sample, stored."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(learn)
    marks = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    first = lambda toxic: marks.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = first(0).unionByName(first(1))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return written(texts.groupBy("doc_id", "toxic").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")), "labelled")


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """A model of ``labels.toxic`` from the documents whose id satisfies ``learn``."""
    ship(docs.sparkSession)
    rows = _sampled(docs, labels, learn, sample)
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return NOTHING

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text")):
                seen[toxic, present(text.as_py())] += 1
        at = np.flatnonzero(seen.any(axis=0))
        for part in np.array_split(at, max(1, len(at) >> 16)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), *[pa.array(seen[t, part].astype(np.int64)) for t in (0, 1)]], ["bucket", "other", "toxic"])

    counts = written(
        rows.select("toxic", "text").mapInArrow(count, "bucket int, other bigint, toxic bigint")
        .groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")), "ngram-counts")
    totals = counts.agg(F.sum(F.col("toxic") + 1).alias("toxic"), F.sum(F.col("other") + 1).alias("other")).first()

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    # twice the log likelihood ratio of "presence depends on the label", over documents
    n1, n0 = sizes[1], sizes[0]
    share = (F.col("toxic") + F.col("other")) / (n0 + n1)
    gain = sum((part(F.col(c), share * n) + part(n - F.col(c), (1 - share) * n) for c, n in (("toxic", n1), ("other", n0))), F.lit(0.0))
    best = counts.withColumn("gain", gain).where("toxic + other > 1").orderBy(F.desc("gain"), "bucket").limit(features).collect()
    if not best:
        return NOTHING
    number = np.full(1 << BITS, -1, np.int16)
    number[[r.bucket for r in best]] = np.arange(len(best))
    ratio = log_ratio(np.array([r.toxic for r in best]), np.array([r.other for r in best]), totals.toxic, totals.other)
    empty = docs.sparkSession.sparkContext.broadcast(Model(number, np.zeros(len(best)), 0.0))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [empty.value.found(t.as_py()).astype(np.int16).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "found"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    known = rows.mapInArrow(look, f"doc_id {kind}, toxic int, found binary").orderBy("doc_id").collect()
    weight, bias = fit([np.frombuffer(r.found, np.int16) for r in known], np.array([r.toxic for r in known]), ratio)
    return Model(number, weight, bias)


def with_scores(docs: DataFrame, model: Model, name: str = "_toxicity") -> DataFrame:
    """All columns and the probability that ``text`` is toxic, called ``name``."""
    shipped = ship(docs.sparkSession).sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shipped.value.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
