"""Token counts per document by a map-side lookup in two tiers; no pre-token is ever shuffled.

Tier one is a broadcast table with the token counts of frequent pre-tokens, at most ``frequent``
entries of at most 64 characters. Tier two is the cache of a Python worker: pre-tokens it has not
met go to the tokenizers library once. Which entries are in either tier changes speed alone.

Pre-tokens here are the parts of a text between single blanks: the byte-level pre-tokenizer cuts
before any blank that stands between two other characters, so token counts add up over such parts.

Null and empty texts have no tokens. Rows are kept as they are, repeated ones too.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscout.llm.pieces import LONGEST_CACHED, PieceEncoder
from tabscout.session import ship

_ADJACENT = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
CACHE_PIECES = 800_000
BATCH_CHARS = 8_000_000


def _sizes(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[int]:
    return (ends - begins).tolist()


def _spaced(piece: str) -> str:
    """The text a piece stands for: a blank before it, unless it opens a line."""
    return piece if piece[:1] == "\n" else " " + piece


def split_pieces(text: str) -> tuple[str, list[str], int]:
    """(text to encode apart, pieces, tokens to take off): their sum is the count of ``text``."""
    if not _ADJACENT.search(text):
        # One newline between other characters is a token of its own; so is the one put in front.
        return "", ("\n" + text).replace("\n", " \n")[1:].split(" "), 1
    first, *rest = _CUT.split(text)
    return first, rest, 0


def sampled_pieces(texts: DataFrame, documents: int, frequent: int) -> list[str]:
    """The most common pre-tokens of a random sample of about ``documents`` rows."""
    rows = texts.count()
    if not rows:
        return []
    word = F.explode(F.split(F.translate("text", "\n\r\t", "   "), " +")).alias("piece")
    sample = texts if rows <= documents else texts.sample(documents / rows, seed=11)
    top = (
        sample.select(word).where(F.length("piece").between(1, LONGEST_CACHED))
        .groupBy("piece").count().where("count > 1").orderBy(F.desc("count"), "piece").limit(frequent)
    )
    return [r.piece for r in top.collect()]


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 512, frequent: int = 8192, sample_documents: int = 1000,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document under the tokenizer file given."""
    spark = ship(docs.sparkSession).sparkContext
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    common = sampled_pieces(texts.select("text"), sample_documents, frequent)
    encoder = PieceEncoder(tokenizer, _sizes, CACHE_PIECES)
    encoder.fill(set(common), _spaced)
    tier_one = spark.broadcast({p: encoder.cache[p] for p in common})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = PieceEncoder.of(tokenizer, _sizes, CACHE_PIECES, tier_one.value)
        for batch in batches:
            sizes, counts = [], []
            parts: list[tuple[str, list[str], int]] = []
            held = 0

            def flush():
                met: set[str] = set()
                for _, pieces, _ in parts:
                    met.update(pieces)
                long = tokens.fill(met, _spaced)
                get = tokens.cache.__getitem__ if not long else (tokens.cache | long).__getitem__
                for first, pieces, off in parts:
                    apart = len(tokens.ids(first)) if first else 0
                    counts.append(apart + sum(map(get, pieces)) - off)
                tokens.shrink()
                parts.clear()

            for value in batch.column("text"):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                parts.append(split_pieces(text) if text else ("", [], 0))
                held += len(text)
                if held > BATCH_CHARS:
                    flush()
                    held = 0
            flush()
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), n,
                 pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
