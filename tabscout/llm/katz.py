"""Katz backoff bigram scores of documents, learned from the training part of the same table.

Counts are Good-Turing discounted up to ``CUT`` occurrences; a discount that the counts of counts
leave undefined or outside (0, 1) is 1. The probability of a token after a context is

* its discounted share of the context's occurrences, if the pair was seen in training, else
* the context's backoff weight times the token's unigram probability (1 times, for unknown contexts).

Unigrams back off in turn to one class of unknown tokens, which gets all discounted mass. The
backoff weight is the mass that discounting freed, over the unigram mass of tokens not seen after the
context, so each distribution over the vocabulary and the unknown class sums to 1. Where nothing
was freed, the total counts one occurrence more. The first token's context is a start mark.

How it runs. Texts become chunks of about ``CHUNK_TOKENS`` tokens, stored once as numbers of the
chunk's own words. Each chunk sends its distinct words, then its distinct pairs, to hash buckets;
buckets add up the training counts, keep them as the stored tables of the model, and answer each
chunk in the order it asked. A context that occurs more than ``HOT`` times is spread over several
buckets, whose sums its chunks add. A chunk then evaluates its tokens with the answers. No table is
broadcast; the driver sees sums of counts only.

Words are known by 64-bit hashes. Null texts are empty and score their end token. Null ids are
training. Rows are scored one by one, repeated ones too; other columns are not looked at. With no
training token all probability belongs to the unknown class. An empty table gives no rows.
"""
from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tabscout.session import scratch_path, ship

CUT = 5
CHUNK_TOKENS = 4_000_000
BUCKET_KEYS = 4_000_000
HOT = 4_000_000
END, START = b"\n", b" "  # no word holds white space

CHUNKS = (
    "chunk bigint, tokens_n bigint, words_n bigint, words binary, train binary, tokens binary, "
    "doc_ids binary, has_id binary, lengths binary, held binary"
)
PARCEL = "bucket bigint, chunk bigint, a binary, b binary, c binary, d binary, e binary"
ANSWER = "kind string, bucket bigint, chunk bigint, a binary, b binary, c binary, d binary, sums array<bigint>"


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, by byte of the number, so that high bytes cost little."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    head = f"{values.dtype.str}:{len(values)}".encode().ljust(24)
    return head + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    kind, n = bytes(data[:24]).decode().strip().split(":")
    dtype, n = np.dtype(kind), int(n)
    planes = np.frombuffer(zstandard.decompress(bytes(data[24:]), max_output_size=max(1, n * dtype.itemsize)), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).reshape(n)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.int64)


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Good-Turing factors by count 0..CUT from the number of types seen 1..CUT+1 times."""
    n = [0, *counts_of_counts]
    factor = np.ones(CUT + 1)
    common = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        if n[r] and n[r + 1] and common < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            if 0 < d < 1:
                factor[r] = d
    return factor


class Level:
    """Totals and discounts of one order of the model."""

    def __init__(self, total: int, types: int, counts_of_counts: list[int]):
        self.total, self.types, self.factor = total, types, discounts(counts_of_counts)
        freed = sum(n * r * (1 - self.factor[r]) for r, n in enumerate(counts_of_counts[:CUT], 1))
        self.scale = total if freed > 0 else total + 1
        self.freed = freed if freed > 0 else 1.0

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * np.where(counts <= CUT, self.factor[np.minimum(counts, CUT)], 1.0)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of tokens by training count; 0 is the unknown class."""
        return np.where(counts > 0, self.kept(counts), self.freed) / self.scale


def _chunks(chunk_tokens: int):
    return lambda batches: _chunk_rows(batches, chunk_tokens)


def _chunk_rows(batches: Iterator[pa.RecordBatch], chunk_tokens: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    number: dict[bytes, int] = {}
    tokens, lengths, ids, held = array("I"), [], [], []

    def row() -> pa.RecordBatch:
        local = np.frombuffer(tokens, np.uint32)
        counts = np.bincount(local, minlength=len(number))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        local = rank[local]
        words = np.array([xxhash.xxh64_intdigest(w) for w in number], np.uint64)[order]
        trained = np.repeat(~np.array(held, bool), lengths)
        train = np.bincount(local[trained], minlength=len(order)).astype(np.uint32)
        values = [part << 32 | seq, len(local), len(words), words.tobytes(), pack(train), pack(local),
                  np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is not None for i in ids], np.uint8).tobytes(),
                  pack(np.array(lengths, np.int64)), np.array(held, np.uint8).tobytes()]
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 7
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        for doc_id, is_held, text in zip(batch.column("doc_id"), batch.column("held"), batch.column("text")):
            words = (text.as_py() or "").encode().lower().split()
            words.append(END)
            tokens.extend([number.setdefault(w, len(number)) for w in words])
            lengths.append(len(words))
            ids.append(doc_id.as_py())
            held.append(is_held.as_py())
            if len(tokens) >= chunk_tokens:
                yield row()
                seq += 1
                number, tokens, lengths, ids, held = {}, array("I"), [], [], []
    if lengths:
        yield row()


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, positions in old order) of every bucket met."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[p[0]]), p) for p in np.split(order, cuts) if len(p)]


def _word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return (words >> np.uint64(17)) % np.uint64(buckets)


def _parcels(rows: list[tuple]) -> pa.Table:
    rows = [(*r, *[None] * (7 - len(r))) for r in rows]
    columns = list(zip(*rows)) or [()] * 7
    kinds = [pa.int64()] * 2 + [pa.binary()] * 5
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in PARCEL.split(", ")])


def _answers(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64())]
    columns = list(zip(*rows)) or [()] * 8
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in ANSWER.split(", ")])


def _ask_words(buckets: int):
    def ask(batches):
        for batch in batches:
            for chunk, words, train in zip(*(batch.column(c) for c in ("chunk", "words", "train"))):
                keys, counts = np.frombuffer(words.as_py(), np.uint64), unpack(train.as_py())
                yield from _parcels([
                    (b, chunk.as_py(), keys[at].tobytes(), pack(counts[at])) for b, at in _by_bucket(_word_bucket(keys, buckets))
                ]).to_batches()

    return ask


def _count_words(buckets: int):
    def count(key, table):
        bucket = key[0].as_py()
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        asked = [np.frombuffer(r["a"], np.uint64) for r in rows]
        words, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([unpack(r["b"]) for r in rows])).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        ids = np.empty(len(words), np.int64)
        ids[order] = np.arange(len(words)) * buckets + bucket  # frequent words have small numbers
        ids[counts == 0] = -1
        seen = counts[counts > 0]
        sums = [int(seen.sum()), len(seen), *[int((seen == r).sum()) for r in range(1, CUT + 2)]]
        kept = counts > 0
        out = [("table", bucket, None, words[kept].tobytes(), pack(counts[kept]), pack(ids[kept]), None, sums)]
        for r, at in zip(rows, np.split(inverse, np.cumsum([len(a) for a in asked])[:-1])):
            out.append(("reply", bucket, r["chunk"], pack(ids[at]), pack(counts[at]), None, None, None))
        return _answers(out)

    return count


class Chunk:
    """One chunk with the answers to its words."""

    def __init__(self, row: dict, replies: list[dict], word_buckets: int, start_count: int, hot: int):
        self.hot = hot
        keys = np.frombuffer(row["words"], np.uint64)
        self.tokens = unpack(row["tokens"]).astype(np.int64)
        self.lengths = unpack(row["lengths"])
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.ids = np.full(len(keys) + 1, -1, np.int64)  # the last is the start mark
        self.counts = np.zeros(len(keys) + 1, np.int64)
        by_bucket = {r["bucket"]: r for r in replies}
        for bucket, at in _by_bucket(_word_bucket(keys, word_buckets)):
            self.ids[at] = unpack(by_bucket[bucket]["a"])
            self.counts[at] = unpack(by_bucket[bucket]["b"])
        self.start = len(keys)
        self.ids[self.start] = -2
        self.counts[self.start] = start_count
        first = np.cumsum(self.lengths) - self.lengths
        self.first = first
        self.context = np.empty_like(self.tokens)
        self.context[1:] = self.tokens[:-1]
        self.context[first] = self.start

    def requests(self, buckets: int, inverse: bool = False):
        """Pairs of known words, distinct, and the (context, salt) groups they belong to, by bucket."""
        known = self.ids != -1
        both = known[self.context] & known[self.tokens] & (self.counts[self.context] > 0)
        pair = self.context[both] * (self.start + 1) + self.tokens[both]
        if inverse:
            pair, at = np.unique(pair, return_inverse=True)
            self.pair_at = np.full(len(self.tokens), -1, np.int64)
            self.pair_at[both] = at
            train = None
        else:
            # One sort gives the distinct pairs and, from the lowest bit, their training counts.
            trained = np.repeat(~self.held, self.lengths)[both]
            each = np.sort(pair * 2 + trained)
            starts = np.flatnonzero(np.diff(each >> 1, prepend=-1))
            pair = each[starts] >> 1
            train = np.add.reduceat(each & 1, starts).astype(np.uint32) if len(starts) else np.zeros(0, np.uint32)
        context, word = pair // (self.start + 1), pair % (self.start + 1)
        contexts = np.unique(self.context[known[self.context] & (self.counts[self.context] > 0)])
        salts = -(-self.counts[contexts] // self.hot)
        # Groups: every salt of every known context, whether or not a pair of this chunk falls in it.
        group_context = np.repeat(contexts, salts)
        group_salt = np.arange(int(salts.sum())) - np.repeat(np.cumsum(salts) - salts, salts)
        offset = np.zeros(self.start + 1, np.int64)
        offset[contexts] = np.cumsum(salts) - salts
        width = np.ones(self.start + 1, np.int64)
        width[contexts] = salts
        pair_group = offset[context] + (self.ids[word] * 40503 >> 8) % width[context]
        mixed = (self.ids[group_context].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) + group_salt.astype(np.uint64)
        group_bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        return context, word, train, group_context, pair_group, group_bucket

    def parts(self, requests):
        """(bucket, its groups, its pairs in order of group and word number, their group's place)."""
        context, word, _, group_context, pair_group, group_bucket = requests
        rank = np.empty(len(group_bucket), np.int64)
        rank[np.argsort(group_bucket, kind="stable")] = np.arange(len(group_bucket))
        order = np.argsort(rank[pair_group] << 40 | self.ids[word])
        pair_cuts = np.searchsorted(group_bucket[pair_group][order], np.arange(group_bucket.max(initial=-1) + 2))
        for bucket, groups in _by_bucket(group_bucket):
            pairs = order[pair_cuts[bucket]:pair_cuts[bucket + 1]]
            yield bucket, groups, pairs, np.searchsorted(groups, pair_group[pairs])


def _ask_pairs(word_buckets: int, buckets: int, start_count: int, hot: int):
    def ask(_key, chunks, replies):
        rows = []
        for row in chunks.to_pylist():
            chunk = Chunk(row, replies.to_pylist(), word_buckets, start_count, hot)
            asked = chunk.requests(buckets)
            _, word, train, group_context, _, _ = asked
            for bucket, groups, pairs, place in chunk.parts(asked):
                rows.append((
                    bucket, row["chunk"], pack(chunk.ids[group_context[groups]]),
                    pack(np.bincount(place, minlength=len(groups)).astype(np.uint32)),
                    pack_sorted(chunk.ids[word[pairs]]), pack(chunk.counts[word[pairs]]), pack(train[pairs])))
        return _parcels(rows)

    return ask


def _count_pairs(unigrams: Level):
    def count(key, table):
        bucket = key[0].as_py()
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        asked = [unpack(r["a"]) for r in rows]
        reps = [unpack(r["b"]) for r in rows]
        contexts, group = np.unique(np.concatenate(asked), return_inverse=True)
        own = np.repeat(group, np.concatenate(reps))
        words = np.concatenate([unpack_sorted(r["c"]) for r in rows])
        pairs, first, inverse = np.unique(own << 40 | words, return_index=True, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([unpack(r["e"]) for r in rows]), len(pairs)).astype(np.int64)
        lower = unigrams.unigram(np.concatenate([unpack(r["d"]) for r in rows])[first])
        seen, of = counts > 0, pairs >> 40
        n = len(contexts)
        stats = np.zeros((CUT + 1, n), np.int64)
        stats[0] = np.bincount(of, counts, n)
        for r in range(1, CUT + 1):
            stats[r] = np.bincount(of[counts == r], minlength=n)
        mass = np.bincount(of[seen], lower[seen], n)
        sums = [int(counts.sum()), int(seen.sum()), *[int((counts == r).sum()) for r in range(1, CUT + 2)]]
        out = [("table", bucket, None, pack(contexts), pack(np.bincount(of[seen], minlength=n).astype(np.uint32)),
                pack_sorted((pairs & ((1 << 40) - 1))[seen]), pack(counts[seen]), sums)]
        groups = np.split(group, np.cumsum([len(a) for a in asked])[:-1])
        places = np.split(inverse, np.cumsum([int(r.sum()) for r in reps])[:-1])
        for r, g, at in zip(rows, groups, places):
            out.append(("reply", bucket, r["chunk"], pack(counts[at]), pack(stats[:, g].reshape(-1)), pack(mass[g]), None, None))
        return _answers(out)

    return count


def _score(word_buckets: int, pair_buckets: int, start_count: int, hot: int, unigrams: Level, pairs: Level):
    def score(_key, chunks, replies):
        tables = []
        for row in chunks.to_pylist():
            answers = replies.to_pylist()
            chunk = Chunk(row, [r for r in answers if r["order"] == 1], word_buckets, start_count, hot)
            asked = chunk.requests(pair_buckets, inverse=True)
            context, _, _, group_context, _, _ = asked
            count = np.zeros(len(context), np.int64)
            stats, mass = np.zeros((CUT + 1, chunk.start + 1), np.int64), np.zeros(chunk.start + 1)
            by_bucket = {r["bucket"]: r for r in answers if r["order"] == 2}
            for bucket, groups, at, _ in chunk.parts(asked):
                reply = by_bucket[bucket]
                count[at] = unpack(reply["a"])
                # A bucket answers for a context as a whole, however many of its salts lie there.
                of, once = np.unique(group_context[groups], return_index=True)
                stats[:, of] += unpack(reply["b"]).reshape(CUT + 1, -1)[:, once]
                mass[of] += unpack(reply["c"])[once]
            freed = sum(stats[r] * r * (1 - pairs.factor[r]) for r in range(1, CUT + 1))
            none = freed <= 0
            scale = np.maximum(stats[0] + none, 1)
            weight = np.where(stats[0] > 0, np.where(none, 1.0, freed) / scale / (1 - mass), 1.0)
            lower = unigrams.unigram(chunk.counts)
            p = weight[chunk.context] * lower[chunk.tokens]
            asked_for = chunk.pair_at >= 0
            own = count[chunk.pair_at[asked_for]]
            p[asked_for] = np.where(own > 0, pairs.kept(own) / scale[chunk.context[asked_for]], p[asked_for])
            c = chunk.counts[chunk.tokens]
            base = np.log10((c + 1) / (unigrams.total + unigrams.types + 1))
            add = lambda x: np.add.reduceat(x, chunk.first)
            n = len(chunk.lengths)
            tables.append(pa.Table.from_arrays([
                pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["has_id"], np.uint8) == 0),
                pa.array(chunk.held), pa.array(chunk.lengths), pa.array(add((c > 0).astype(np.int64))),
                pa.array(np.full(n, unigrams.total, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p))),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(tables) if tables else _NOTHING

    return score


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
_NOTHING = pa.table({name: pa.array([], kind) for name, kind in (
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(ANSWER).parquet(path)


def _level(answers: DataFrame) -> Level:
    """The sums of all buckets: occurrences, types, types seen 1..CUT+1 times."""
    row = answers.where("kind = 'table'").agg(*[F.sum(F.col("sums")[i]) for i in range(CUT + 3)]).first()
    total, types, *rest = [x or 0 for x in row]
    return Level(total, types, rest)


def score_documents(
    docs: DataFrame, held_out, path: str | None = None, chunk_tokens: int = CHUNK_TOKENS, hot: int = HOT,
) -> DataFrame:
    """SCORES of every document; ``held_out`` is a Column that is true for rows not to learn from.

    The model stays under ``path``: words/ and pairs/, one stored table by bucket each (kind=table).
    """
    spark = ship(docs.sparkSession)
    path = path or scratch_path(spark, "katz")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held"))
    rows.mapInArrow(_chunks(chunk_tokens), CHUNKS).write.option("compression", "zstd").parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    sizes = chunks.agg(F.sum("words_n"), F.sum("tokens_n")).first()
    word_buckets = max(1, math.ceil((sizes[0] or 0) / BUCKET_KEYS))
    pair_buckets = max(1, math.ceil((sizes[1] or 0) / BUCKET_KEYS))
    start_count = rows.where(~F.col("held")).count()

    words = _stored(
        chunks.select("chunk", "words", "train").mapInArrow(_ask_words(word_buckets), PARCEL)
        .groupBy("bucket").applyInArrow(_count_words(word_buckets), ANSWER), f"{path}/words")
    unigrams = _level(words)
    to_words = words.where("kind = 'reply'").select("chunk", "bucket", "a", "b", "c", F.lit(1).alias("order"))
    pairs = _stored(
        chunks.groupBy("chunk").cogroup(to_words.groupBy("chunk"))
        .applyInArrow(_ask_pairs(word_buckets, pair_buckets, start_count, hot), PARCEL)
        .groupBy("bucket").applyInArrow(_count_pairs(unigrams), ANSWER), f"{path}/pairs")
    bigrams = _level(pairs)
    to_pairs = pairs.where("kind = 'reply'").select("chunk", "bucket", "a", "b", "c", F.lit(2).alias("order"))
    return (
        chunks.groupBy("chunk").cogroup(to_words.unionByName(to_pairs).groupBy("chunk"))
        .applyInArrow(_score(word_buckets, pair_buckets, start_count, hot, unigrams, bigrams), SCORES))
