"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its own measures and those of the lines before and after, cut into bins,
give the state scores; transitions tie neighbouring lines. Forward-backward gives each line's
probability of being good; a document's score is their mean, weighted by line length.

The field is fitted on a bounded sample: at most ``sample`` labelled documents, those with the
smallest hashes of their ids among the rows to learn from, whole texts. A line takes the label of its
document. Their measures (a few numbers a line) come to the driver; every document is scored in
place, without a shuffle.

Null and empty texts are one empty line. Labels with a null id or value are ignored; of several
labels of one id the lowest counts, of several documents with a sampled id one is learned from.
Without labels of both kinds the field stays at zero: every score is 0.5. Ids, language, source and
labels are never measured. Columns pass through unchanged; an empty table stays empty.
"""
from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabscout.llm.columns import free
from tabscout.session import ship

SAMPLE = 4000
BINS = 10
THRESHOLD = 0.3

# One letter per byte: u capital, l other letter or part of one, d digit, s white space, p common
# punctuation, x any other sign.
_KIND = bytes(
    ord("u") if 65 <= c <= 90 else ord("l") if 97 <= c <= 122 or c >= 128 else ord("d") if 48 <= c <= 57
    else ord("s") if c in b" \t\r\n\x0b\x0c" else ord("p") if c in b".,;:'\"-()?" else ord("x")
    for c in range(256)
)
MEASURES = 11


def measures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(MEASURES numbers of every line, line lengths in bytes)."""
    lines = (text or "").encode().split(b"\n")
    out = np.zeros((len(lines), MEASURES), np.float32)
    size = np.empty(len(lines), np.int64)
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        n = size[i] = len(line)
        words = line.split()
        if not words:
            continue
        kinds = line.translate(_KIND)
        upper, lower, digits, signs = (kinds.count(k) for k in (b"u", b"l", b"d", b"x"))
        count = len(words)
        own = set(words)
        again = sum(map(operator.eq, words, words[1:]))
        pairs = len(set(zip(words, words[1:])))
        out[i] = (
            n, count, upper / (upper + lower + 1), digits / n, signs / n, signs / count, 1 - len(own) / count,
            again / count, n / count, 1 - (pairs + 1) / count, line in seen,
        )
        seen.add(line)
    return out, size


def cuts_of(rows: np.ndarray) -> np.ndarray:
    """Inner bin borders of every measure, at equal shares of its distinct values' ranks."""
    borders = [np.quantile(np.unique(rows[:, m]), np.linspace(0, 1, BINS + 1)[1:-1]) for m in range(MEASURES)]
    return np.array(borders, np.float32)


def cells(rows: np.ndarray, cuts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers of the weights that score each line: own, previous and next line, by measure and bin."""
    own = np.stack([np.searchsorted(cuts[m], rows[:, m], side="right") for m in range(MEASURES)], axis=1)
    own += np.arange(MEASURES) * (BINS + 1)
    width = MEASURES * (BINS + 1)
    outside = np.full((1, MEASURES), BINS) + np.arange(MEASURES) * (BINS + 1)  # no such line
    before = np.concatenate((outside, own[:-1]))
    after = np.concatenate((own[1:], outside))
    before[first] = outside
    after[first[1:] - 1] = outside
    return np.concatenate((own, before + width, after + 2 * width), axis=1)


WEIGHTS = 3 * MEASURES * (BINS + 1)


class Chains:
    """Documents side by side, longest first, to step through their lines together."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.first = np.cumsum(lengths) - lengths
        self.order = np.argsort(-lengths, kind="stable")
        self.longest = int(lengths.max(initial=0))
        sizes = lengths[self.order]
        self.active = np.searchsorted(-sizes, -np.arange(1, self.longest + 1), side="right")

    def marginals(self, good: np.ndarray, step: np.ndarray, per_line: np.ndarray | None = None):
        """(P(good) per line, expected transitions, each counted by the weight of its later line)."""
        begin = self.first[self.order]
        score = np.zeros((len(good), 2))
        score[:, 1] = good
        forward, backward = np.empty((len(good), 2)), np.zeros((len(good), 2))
        for t in range(self.longest):
            at = begin[:self.active[t]] + t
            if t == 0:
                forward[at] = score[at]
            else:
                old = forward[at - 1]
                forward[at] = score[at] + np.logaddexp(old[:, :1] + step[0], old[:, 1:] + step[1])
        for t in range(self.longest - 2, -1, -1):
            at = begin[:self.active[t + 1]] + t
            ahead = score[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
        ends = self.first + self.lengths - 1
        norm = np.logaddexp(forward[ends, 0], forward[ends, 1])
        total = np.repeat(norm, self.lengths)
        p = np.exp(forward[:, 1] + backward[:, 1] - total)
        if per_line is None:
            return p, None
        at = self.inner()
        joint = forward[at - 1][:, :, None] + step + (score[at] + backward[at])[:, None, :] - total[at][:, None, None]
        return p, (np.exp(joint) * per_line[at][:, None, None]).sum(axis=0)

    def inner(self) -> np.ndarray:
        """Lines that have one before them."""
        inner = np.ones(int(self.lengths.sum()), bool)
        inner[self.first] = False
        return np.flatnonzero(inner)


class Field:
    """The fitted weights."""

    def __init__(self, cuts: np.ndarray | None = None, weights: np.ndarray | None = None, step: np.ndarray | None = None):
        self.cuts = np.zeros((MEASURES, BINS - 1), np.float32) if cuts is None else cuts
        self.weights = np.zeros(WEIGHTS) if weights is None else weights
        self.step = np.zeros((2, 2)) if step is None else step

    def score(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not documents:
            return np.zeros(0)
        rows = np.concatenate([m for m, _ in documents])
        size = np.concatenate([s for _, s in documents]) + 1.0
        chains = Chains(np.array([len(m) for m, _ in documents]))
        good = self.weights[cells(rows, self.cuts, chains.first)].sum(axis=1)
        p, _ = chains.marginals(good, self.step)
        return np.clip(np.add.reduceat(p * size, chains.first) / np.add.reduceat(size, chains.first), 0, 1)


def fit(documents: list[np.ndarray], labels: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 2e-5,
        step_decay: float = 0.05) -> Field:
    """Maximum likelihood with weight decay by full-batch Adam.

    Every document counts the same, and both labels weigh the same in sum. The lines of a sampled
    document share one label, so it is the decay that bounds the pull between neighbours.
    """
    if len(set(labels.tolist())) < 2:
        return Field()
    lengths = np.array([len(m) for m in documents])
    chains = Chains(lengths)
    rows = np.concatenate(documents)
    cuts = cuts_of(rows)
    at = cells(rows, cuts, chains.first)
    y = np.repeat(labels, lengths).astype(int)
    share = labels.mean()
    per_line = np.repeat(np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / lengths, lengths) / len(labels)
    inner = chains.inner()
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1], y[inner]), per_line[inner])
    w, step = np.zeros(WEIGHTS), np.zeros((2, 2))
    mean, square = np.zeros(WEIGHTS + 4), np.zeros(WEIGHTS + 4)
    for turn in range(1, rounds + 1):
        p, expected = chains.marginals(w[at].sum(axis=1), step, per_line)
        pull = np.bincount(at.ravel(), np.repeat((p - y) * per_line, at.shape[1]), WEIGHTS) + decay * w
        g = np.concatenate((pull, (expected - seen + step_decay * step).ravel()))
        mean = 0.9 * mean + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        move = rate * (mean / (1 - 0.9 ** turn)) / (np.sqrt(square / (1 - 0.999 ** turn)) + 1e-8)
        w -= move[:WEIGHTS]
        step -= move[WEIGHTS:].reshape(2, 2)
    return Field(cuts, w, step)


def sampled_documents(docs: DataFrame, labels: DataFrame, learn: Column, sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Measures and labels of the sample."""
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("_label")).where("doc_id is not null and _label is not null")
    chosen = known.where(learn).groupBy("doc_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(t.as_py())[0].tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_label"), pa.array(rows, pa.binary())], ["doc_id", "_label", "rows"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = (
        texts.mapInArrow(measured, f"doc_id {kind}, _label int, rows binary")
        .groupBy("doc_id", "_label").agg(F.max("rows").alias("rows")).orderBy("doc_id").collect()
    )
    return [np.frombuffer(r.rows, np.float32).reshape(-1, MEASURES) for r in rows], np.array([r._label for r in rows], int)


def with_scores(docs: DataFrame, labels: DataFrame, learn: Column, name: str = "_score", sample: int = SAMPLE) -> DataFrame:
    """All columns and the score of ``text`` called ``name``; ``learn`` is a condition on doc_id."""
    spark = ship(docs.sparkSession)
    field = spark.sparkContext.broadcast(fit(*sampled_documents(docs, labels, learn, sample)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                rows = batch.slice(begin, 512)
                scores = field.value.score([measures(t.as_py()) for t in rows.column("text")])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores, pa.float64())], [*rows.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches ``threshold``, all columns; learned from all labels."""
    score = free(docs, "_score")
    return with_scores(docs, labels, F.lit(True), score).where(F.col(score) >= threshold).select(*docs.columns)
