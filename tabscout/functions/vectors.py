"""Vector expressions and the default, weight-free text encoder."""
from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm(vector) -> Column:
    return F.sqrt(F.aggregate(_c(vector), F.lit(0.0), lambda s, x: s + x * x))


def normalise(vector) -> Column:
    """Unit length; the zero vector stays."""
    v = F.transform(_c(vector), lambda x: x.cast("double"))
    return F.transform(
        F.array(F.struct(v.alias("v"), norm(v).alias("n"))),
        lambda p: F.when(p["n"] > 0, F.transform(p["v"], lambda x: x / p["n"])).otherwise(p["v"]),
    )[0]


@functools.lru_cache(maxsize=1 << 18)
def _code(token: str) -> int:
    """The 60-bit hash of ``functions.hashing.h`` for one token."""
    return int(hashlib.md5(token.encode()).hexdigest()[:15], 16)


_BETWEEN = r"[^\p{L}\p{N}]+"  # tokens are letters and digits of any script


def hash_texts(texts: pa.Array | list[str | None], dim: int) -> np.ndarray:
    """Signed token counts of each text, unit length: a token counts in bucket hash mod dim, with
    the sign given by the next bit of the hash. A text without tokens is the zero vector.

    Texts are cut into tokens by Arrow; only the distinct tokens of a batch are hashed one by one.
    """
    whole = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
    cut = pc.split_pattern_regex(pc.utf8_lower(whole), pattern=_BETWEEN)
    row = np.repeat(np.arange(len(whole)), np.diff(cut.offsets.to_numpy()))
    tokens = cut.flatten().dictionary_encode()
    known = np.array([_code(t) if t else -1 for t in tokens.dictionary.to_pylist()], np.int64)
    codes = known[tokens.indices.to_numpy()] if len(known) else np.empty(0, np.int64)
    row, codes = row[codes >= 0], codes[codes >= 0] % (2 * dim)
    sign = np.where(codes >= dim, -1.0, 1.0)
    sums = np.bincount(row * dim + codes % dim, weights=sign, minlength=len(whole) * dim).reshape(len(whole), dim)
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return sums / np.where(length > 0, length, 1.0)


def _lists(m: np.ndarray) -> pa.Array:
    offsets = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))


def hash_encode(text, dim: int = 64) -> Column:
    """Hashed bag of words per text in Arrow batches: no weights, no shuffle."""

    @F.arrow_udf("array<double>")
    def encode(texts: pa.Array) -> pa.Array:
        return _lists(hash_texts(texts, dim))

    return encode(_c(text))


def hash_encode_sum(texts, dim: int = 64) -> Column:
    """Sum of the hashed vectors of an array of texts."""

    @F.arrow_udf("array<double>")
    def encode(cells: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(cells), 0).to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes)))
        total = np.concatenate(([np.zeros(dim)], np.cumsum(hash_texts(cells.flatten(), dim), axis=0)))
        return _lists(total[ends[1:]] - total[ends[:-1]])

    return encode(_c(texts))


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, x: s + x,
    )


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a, b) -> Column:
    return F.sqrt(
        F.aggregate(
            F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double")),
            F.lit(0.0), lambda s, d: s + d * d,
        )
    )
