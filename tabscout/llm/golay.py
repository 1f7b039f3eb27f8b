"""SimHash near-duplicates, linked through Golay-code keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, read as words of the binary Golay
code [23, 12, 7]. The code is perfect: every word lies within 3 errors of exactly one codeword, and
within 4 errors of at most 6. A word one bit away from y is within 4 errors of the codeword nearest
to y. Three differing bits over three segments leave two segments with at most one each, so two
linked fingerprints always meet under one of three segment pairs: one brings the indices of its
nearest codewords (1 key), the other all codewords within 4 errors (up to 36 keys). Whoever meets is
compared bit by bit, so links are exact.

Equal fingerprints are one node. Links of a key leave a task as stars around the smallest
fingerprint of each local component, never as all pairs. Components follow by spreading the smallest
label with pointer jumping over stored tables.

Words are runs without ASCII white space, A-Z lower-cased; a text with fewer words than a shingle is
one shingle, one without words (also null) has fingerprint 0 and is linked like any other. Rows are
kept one by one; a null doc_id never names a component unless it holds nothing else. Other columns
are not looked at. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tabscout.llm.columns import free
from tabscout.session import ship, written

GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, width)
RADIUS = 3
SMALL_RUN = 1 << 16


def _syndromes() -> np.ndarray:
    """Remainder modulo the generator of every word with one bit set."""
    out = []
    for bit in range(23):
        word = 1 << bit
        for high in range(22, 10, -1):
            if word >> high & 1:
                word ^= GENERATOR << (high - 11)
        out.append(word)
    return np.array(out, np.uint32)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome by byte and value, up to six error patterns by syndrome, how many of them)."""
    unit = _syndromes()
    by_byte = np.zeros((3, 256), np.uint32)
    for byte in range(3):
        for bit in range(8):
            if 8 * byte + bit < 23:
                by_byte[byte, (np.arange(256) >> bit & 1).astype(bool)] ^= unit[8 * byte + bit]
    errors, count = np.zeros((2048, 6), np.uint32), np.zeros(2048, np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            at = int(np.bitwise_xor.reduce(unit[list(places)])) if places else 0
            errors[at, count[at]] = sum(1 << p for p in places)
            count[at] += 1
    return by_byte, errors, count


_BY_BYTE, _ERRORS, _COUNT = _tables()


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within 4 errors, nearest first, and which of the six are there."""
    words = words.astype(np.uint32)
    syndrome = _BY_BYTE[0][words & 255] ^ _BY_BYTE[1][words >> 8 & 255] ^ _BY_BYTE[2][words >> 16]
    index = (words[:, None] ^ _ERRORS[syndrome]) >> 11
    return index, np.arange(6) < _COUNT[syndrome][:, None]


def keys(fps: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((rows, keys) under their own nearest codewords, (rows, keys) under all near codewords)."""
    parts = [codewords((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)) for low, width in SEGMENTS]
    rows = np.arange(len(fps))
    own, near = [], []
    for number, (a, b) in enumerate(combinations(range(3), 2)):
        (ia, ma), (ib, mb) = parts[a], parts[b]
        top = np.uint32(number << 24)
        own.append((rows, top | ia[:, 0] << np.uint32(12) | ib[:, 0]))
        both = (top | ia[:, :, None] << np.uint32(12) | ib[:, None, :])
        there = ma[:, :, None] & mb[:, None, :]
        near.append((np.broadcast_to(rows[:, None, None], there.shape)[there], both[there]))
    return tuple(tuple(map(np.concatenate, zip(*kind))) for kind in (own, near))


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links (a, b), each as a star: (smallest member, other member)."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x != y) & (np.bitwise_count(x ^ y) <= RADIUS)


def links_of_runs(key: np.ndarray, probe: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links among rows sorted by (key, probe)."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    probes = np.add.reduceat(probe.astype(np.int64), starts)
    own = sizes - probes
    pairs = own * probes
    small = (pairs > 0) & (pairs <= SMALL_RUN)
    left, right = [], []
    begin = starts[small]
    for part in np.array_split(np.arange(len(begin)), max(1, int(pairs[small].sum()) >> 22)):
        n = pairs[small][part]
        run = np.repeat(part, n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i = begin[run] + inside // probes[small][run]
        j = begin[run] + own[small][run] + inside % probes[small][run]
        hit = _close(fp[i], fp[j])
        left.append(fp[i[hit]])
        right.append(fp[j[hit]])
    a, b = star(np.concatenate(left), np.concatenate(right))
    for run in np.flatnonzero(pairs > SMALL_RUN):
        mid = starts[run] + own[run]
        index, probing = fp[starts[run]:mid], fp[mid:starts[run] + sizes[run]]
        step = max(1, (1 << 22) // len(index))
        for at in range(0, len(probing), step):
            block = probing[at:at + step]
            i, j = np.nonzero(_close(index[:, None], block[None, :]))
            a, b = star(np.concatenate((a, index[i])), np.concatenate((b, block[j])))
    return a, b


_BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The signed number of the bits that are set in over half the hashes, 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    octets = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BIT_OF for i in range(8)])
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def _fingerprinter(words: int, seed: int):
    digest = partial(xxhash.xxh64_intdigest, seed=seed)

    def fingerprint(text: str | None) -> int:
        tokens = (text or "").encode().lower().split()
        if not tokens:
            return 0
        if len(tokens) <= words:
            shingles, n = [b" ".join(tokens)], 1
        else:
            n = len(tokens) - words + 1
            shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
        return majority(np.fromiter(map(digest, shingles), np.uint64, n))

    return fingerprint


def with_fingerprints(docs: DataFrame, name: str = "fp", words: int = 3, seed: int = 42) -> DataFrame:
    """All columns and the fingerprint of ``text`` as a signed bigint."""
    ship(docs.sparkSession)
    fingerprint = _fingerprinter(words, seed)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.int64())], [*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_fps = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(all_fps), 2000):
            fps = all_fps[at:at + 2000]
            (own_row, own_key), (near_row, near_key) = keys(fps)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((own_key, near_key)).astype(np.int32)),
                pa.array(np.arange(len(own_key) + len(near_key)) >= len(own_key)),
                pa.array(fps[np.concatenate((own_row, near_row))].view(np.int64)),
            ], ["key", "probe", "fp"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of complete runs; a run that may go on waits for the next batch."""
    held = [np.empty(0, np.int32), np.empty(0, bool), np.empty(0, np.uint64)]

    def out(key, probe, fp):
        a, b = links_of_runs(key, probe, fp)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    waiting: list[list[np.ndarray]] = [held]
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column("key").to_numpy(), batch.column("probe").to_numpy(zero_copy_only=False),
               batch.column("fp").to_numpy().view(np.uint64)]
        last = int(np.searchsorted(new[0], new[0][-1]))
        if last == 0 and len(waiting[-1][0]) and waiting[-1][0][-1] == new[0][0]:
            waiting.append(new)
            continue
        ready = [np.concatenate(x) for x in zip(*waiting, [v[:last] for v in new])]
        waiting = [[v[last:] for v in new]]
        if len(ready[0]):
            yield out(*ready)
    ready = [np.concatenate(x) for x in zip(*waiting)]
    if len(ready[0]):
        yield out(*ready)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints within RADIUS bits into the same components."""
    keyed = distinct.select("fp").mapInArrow(_keyed, "key int, probe boolean, fp bigint")
    dealt = keyed.repartition("key").sortWithinPartitions("key", "probe")
    return dealt.mapInArrow(_linked, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(fp, label): every linked node with the smallest node of its component. ``links`` is stored."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("fp")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        spread = written(
            labels.join(near, F.col("fp") == F.col("node"))
            .select("fp", F.least("label", "low").alias("label"), F.col("label").alias("old")), "labels")
        parent = spread.select(F.col("fp").alias("of"), F.col("label").alias("up"))
        labels = written(
            spread.join(parent, F.col("label") == F.col("of"), "left")
            .select("fp", F.least("label", "up").alias("label"), "old"), "labels")
        if labels.where("label < old").isEmpty():
            return labels.select("fp", "label")
        labels = labels.select("fp", "label")


def representatives(fingerprints: DataFrame) -> DataFrame:
    """(fp, label, component_id) for every fingerprint of a stored (doc_id, fp) table.

    ``label`` is the smallest fingerprint of the component, ``component_id`` its smallest doc_id.
    """
    distinct = written(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    linked = components(written(fingerprint_links(distinct), "links"))
    of = linked.join(distinct, "fp")
    least = of.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = written(linked.join(least, "label").select("fp", "label", "component_id"), "named")
    return written(
        distinct.join(named, "fp", "left").select(
            "fp", F.coalesce("label", "fp").alias("label"), F.coalesce("component_id", "first_id").alias("component_id")),
        "representatives")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    fps = written(with_fingerprints(docs.select("doc_id", F.col("text").cast("string").alias("text")))
                  .select("doc_id", "fp"), "doc-fingerprints")
    return fps.join(representatives(fps), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """All columns of the one document kept of each component: that with the smallest doc_id.

    Of rows that repeat this doc_id inside the component one stays.
    """
    fp, label, component = (free(docs, name) for name in ("_fp", "_label", "_component"))
    marked = written(with_fingerprints(docs, fp), "fingerprinted")
    reps = representatives(marked.select("doc_id", F.col(fp).alias("fp")))
    reps = reps.select(F.col("fp").alias(fp), F.col("label").alias(label), F.col("component_id").alias(component))
    kept = marked.join(reps, fp).where(F.col("doc_id").eqNullSafe(F.col(component)))
    return kept.dropDuplicates([label]).select(*docs.columns)
