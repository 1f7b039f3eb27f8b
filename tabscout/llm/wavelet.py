"""Token ids in wavelet-matrix files: one compressed file per shard, with access, rank and select.

Documents are put in ascending id order (null ids first) by range partitioning and encoded where
they land. About ``shard_tokens`` ids of whole documents make a shard, stored as one Parquet file
of one row: a header (documents, their lengths, zeros per plane), one packed bit-plane per bit of
an id, most significant first, and the number of ones before every block of 4096 bits. Plane k+1
holds the ids in the order that puts those with a 0 in plane k first, both halves in old order.

A null or empty text has only its end id. Repeated rows stay; equal ids are ordered by the hash of
the text, then the text. An empty table gives no shard. Other columns are not looked at.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabscout.llm.pieces import WordEncoder
from tabscout.session import scratch_path, ship

SHARD_TOKENS = 1 << 20
RANK_BITS = 4096
CACHE_BYTES = 96 << 20  # of a worker

SHARD_SCHEMA = (
    "part int, seq int, n_tokens bigint, bits int, doc_ids binary, doc_has_id binary, lengths binary, "
    "zeros array<bigint>, planes array<binary>, ranks array<binary>"
)
_FIELDS = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("bits", pa.int32()),
    ("doc_ids", pa.binary()), ("doc_has_id", pa.binary()), ("lengths", pa.binary()),
    ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
])


def build_planes(ids: np.ndarray, bits: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """(zeros per plane, packed planes, ones before each block of RANK_BITS)."""
    zeros, planes, ranks = [], [], []
    for shift in range(bits - 1, -1, -1):
        one = np.bitwise_and(ids, ids.dtype.type(1 << shift)) != 0
        packed = np.packbits(one)
        padded = np.zeros(-(-len(packed) * 8 // RANK_BITS) * (RANK_BITS // 8), np.uint8)
        padded[:len(packed)] = packed
        per_block = np.bitwise_count(padded.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(axis=1)
        ranks.append((np.cumsum(per_block) - per_block).astype("<u4").tobytes())
        planes.append(packed.tobytes())
        upper = ids[one]
        lower = ids[np.logical_not(one, out=one)]
        zeros.append(len(lower))
        ids = np.concatenate((lower, upper))
    return zeros, planes, ranks


class WaveletMatrix:
    """Queries on one shard's row; positions count from 0 inside the shard."""

    def __init__(self, row):
        self.n, self.bits = row["n_tokens"], row["bits"]
        self.zeros = list(row["zeros"])
        self.planes = [np.frombuffer(p, np.uint8) for p in row["planes"]]
        self.ranks = [np.frombuffer(r, "<u4") for r in row["ranks"]]
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.doc_has_id = np.frombuffer(row["doc_has_id"], np.uint8).astype(bool)
        self.lengths = np.frombuffer(row["lengths"], "<i8")

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        block = i // RANK_BITS
        first, last = block * RANK_BITS // 8, i // 8
        bits = self.planes[plane]
        inside = int(np.bitwise_count(bits[first:last]).sum()) + (int(bits[last]) >> (8 - i % 8)).bit_count()
        return int(self.ranks[plane][block]) + inside

    def _bit(self, plane: int, i: int) -> int:
        return (int(self.planes[plane][i // 8]) >> (7 - i % 8)) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for plane in range(self.bits):
            bit, ones = self._bit(plane, i), self._ones(plane, i)
            value = value * 2 + bit
            i = self.zeros[plane] + ones if bit else i - ones
        return value

    def _span(self, token: int, begin: int, end: int) -> tuple[int, int]:
        for plane in range(self.bits):
            b, e = self._ones(plane, begin), self._ones(plane, end)
            if token >> (self.bits - 1 - plane) & 1:
                begin, end = self.zeros[plane] + b, self.zeros[plane] + e
            else:
                begin, end = begin - b, end - e
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often an id occurs in [begin, end)."""
        if token >> self.bits:
            return 0
        first, last = self._span(token, begin, self.n if end is None else end)
        return last - first

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this value in a plane, by bisection on rank."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            ones = self._ones(plane, middle + 1)
            if (ones if bit else middle + 1 - ones) > k:
                high = middle
            else:
                low = middle + 1
        return low

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        first, last = self._span(token, 0, self.n) if not token >> self.bits else (0, 0)
        if not 0 <= k < last - first:
            raise IndexError(k)
        at = first + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            at = self._select_bit(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def occurrences(self, token: int) -> Iterator[int]:
        for k in range(self.count(token)):
            yield self.select(token, k)

    def tokens(self) -> np.ndarray:
        """All ids in order, rebuilt plane by plane from the last."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for plane in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[plane], count=self.n).view(bool)
            above = np.empty(self.n, kind)
            above[bit] = ids[self.zeros[plane]:] | kind(1 << (self.bits - 1 - plane))
            above[np.logical_not(bit, out=bit)] = ids[:self.zeros[plane]]
            ids = above
        return ids


def _two_bytes(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = ids.astype(np.uint16).tobytes()
    return [raw[2 * b:2 * e] for b, e in zip(begins.tolist(), ends.tolist())]


def _four_bytes(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = ids.tobytes()
    return [raw[4 * b:4 * e] for b, e in zip(begins.tolist(), ends.tolist())]


_MARKS = re.compile(rb"<\||[\xcc\xcd]")  # special tokens, combining accents


def _pieces(text: str, lower: bool) -> list[bytes]:
    """Parts between ASCII white space, which the pre-tokenizer drops.

    Case is folded early for ASCII letters, so that the cache meets fewer forms, unless that could
    change the normalised text: combining accents may join a capital only, and special tokens are
    found before folding.
    """
    raw = text.encode()
    if lower and not _MARKS.search(raw):
        raw = raw.lower()
    return raw.split()


def _spaced(piece: bytes) -> str:
    return " " + piece.decode()


def encode_shards(
    docs: DataFrame, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS, bits: int = 16,
    lower_cased: bool = True,
) -> DataFrame:
    """Shard rows (SHARD_SCHEMA) of all documents in ascending id order.

    ``lower_cased`` says that the tokenizer folds case after composing accents.
    """
    ship(docs.sparkSession)
    kind = np.uint16 if bits <= 16 else np.uint32
    value = _two_bytes if bits <= 16 else _four_bytes
    end = np.array([end_id], kind).tobytes()
    width = len(end)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordEncoder.of(tokenizer, value, 1 << 60, limit_bytes=CACHE_BYTES)
        part, seq = TaskContext.get().partitionId(), 0
        streams, ids, lengths = [], [], []
        held = 0

        def shard() -> pa.RecordBatch:
            zeros, planes, ranks = build_planes(np.frombuffer(b"".join(streams), kind), bits)
            row = {
                "part": part, "seq": seq, "n_tokens": held, "bits": bits, "zeros": zeros,
                "doc_ids": np.array([i or 0 for i in ids], "<i8").tobytes(),
                "doc_has_id": np.array([i is not None for i in ids], np.uint8).tobytes(),
                "lengths": np.array(lengths, "<i8").tobytes(), "planes": planes, "ranks": ranks,
            }
            return pa.RecordBatch.from_pylist([row], _FIELDS)

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                pieces = [_pieces(t.as_py() or "", lower_cased) for t in rows.column("text")]
                met: set[bytes] = set()
                met.update(*pieces)
                long = tokens.fill(met, _spaced)
                tokens.cache.update(long)  # for this batch only
                get = tokens.cache.__getitem__
                for doc_id, own in zip(rows.column("doc_id"), pieces):
                    stream = b"".join(map(get, own)) + end
                    n = len(stream) // width
                    if held and held + n > shard_tokens:
                        yield shard()
                        seq += 1
                        streams, ids, lengths, held = [], [], [], 0
                    streams.append(stream)
                    ids.append(doc_id.as_py())
                    lengths.append(n)
                    held += n
                for piece in long:
                    del tokens.cache[piece]
                tokens.shrink()
        if lengths:
            yield shard()

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    placed = texts.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return placed.mapInArrow(encode, SHARD_SCHEMA)


def write_shards(shards: DataFrame, path: str) -> None:
    """One Parquet file for each shard."""
    shards.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = WaveletMatrix(row)
            ids = shard.tokens().astype("<u4")
            ends = np.cumsum(shard.lengths)
            crcs = [zlib.crc32(ids[e - n:e]) for e, n in zip(ends, shard.lengths)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(ends), row["part"], np.int32)), pa.array(np.full(len(ends), row["seq"], np.int32)),
                pa.array(shard.doc_ids, mask=~shard.doc_has_id), pa.array(ends - shard.lengths),
                pa.array(shard.lengths), pa.array(crcs, pa.int64()),
            ], ["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    ship(spark)
    files = read_shards(spark, path)
    sizes = files.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    # One row per range partition meets in one task; the shards of a partition stay together.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("seq_start"))
    starts = starts.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("shard_start"))
    rows = files.mapInArrow(
        _digests, "part int, seq int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def binary_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Encode, write the shard files, read them back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_shards(encode_shards(docs, tokenizer, end_id), path)
    return read_back(spark, path)
