"""Benchmark decontamination with an Aho-Corasick automaton over words.

Texts are normalised to words (A-Z lower-cased; runs of digits, letters a-z and anything beyond
ASCII). The automaton holds every window of ``window`` consecutive words of every benchmark item; an
item with fewer words, but not none, is one window. It runs over word numbers, so one scan of a text
finds all windows of all items, and word positions are mapped back to the original text.

The benchmark is measured before it is broadcast. Up to ``block_chars`` characters make one
automaton; a larger benchmark is cut into blocks by a hash of the item, and the stored result of one
block's scan is the input of the next. A null text has no words; rows with the same item_id are one
item, null ids count as the item ''. Repeated documents are judged one by one. Columns of the documents
pass through unchanged; an empty benchmark contaminates nothing.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tabscout.llm.columns import free
from tabscout.session import ship, written

WINDOW = 10
BLOCK_CHARS = 2_000_000

_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", T.ArrayType(T.LongType())),  # begin, end, begin, end ... of merged runs of words
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_chars", T.ArrayType(T.LongType())),  # the same runs as offsets in the text
])
_ARROW = pa.struct([("n_words", pa.int64()), ("hit_words", pa.list_(pa.int64())),
                    ("items", pa.list_(pa.string())), ("hit_chars", pa.list_(pa.int64()))])


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split()


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(runs):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


class Windows:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            row = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            for at in range(max(1, len(row) - window + 1) if row else 0):
                owners.setdefault(row[at:at + window], set()).add(item_id)
        self.values = [(len(key), ids) for key, ids in owners.items()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for n, key in enumerate(owners):
            self.automaton.add_word(key, n)
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(runs of hit words, items found)."""
        runs, items = [], set()
        if not self.values or not words:
            return runs, items
        for last, n in self.automaton.iter(tuple(map(self.number.get, words, repeat(0)))):
            length, ids = self.values[n]
            runs.append((last + 1 - length, last + 1))
            items |= ids
        return merged(runs), items


_windows: dict[str, Windows] = {}


def _offsets(text: str, runs: list[tuple[int, int]]) -> list[int]:
    """Begin and end of word runs as code points of the original text."""
    spans = [m.span() for m in _WORD.finditer(text)] if runs else []
    return [x for begin, end in runs for x in (spans[begin][0], spans[end - 1][1])]


def _pairs(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2]))


def scan(docs: DataFrame, benchmark: DataFrame, name: str = "_found", window: int = WINDOW,
         block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of ``docs`` and what was found in ``text``, a struct FOUND called ``name``."""
    sc = ship(docs.sparkSession).sparkContext
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")
    ).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, FOUND)])
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        held = sc.broadcast([(r.item_id, r.text) for r in mine.collect()])  # about block_chars characters
        docs = docs.mapInArrow(_scanner(held, window, name), schema)
        if block < blocks - 1:
            docs = written(docs, "scanned")
    return docs


def _scanner(held, window: int, name: str):
    key = uuid.uuid4().hex  # a worker builds the automaton of a block once

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = _windows.get(key)
        if found_by is None:
            _windows.clear()
            found_by = _windows[key] = Windows(held.value, window)
        for batch in batches:
            names = batch.schema.names
            before = batch.column(name).to_pylist() if name in names else repeat(None, batch.num_rows)
            rows = []
            for value, old in zip(batch.column("text"), before):
                text = value.as_py() or ""
                words = words_of(text)
                runs, ids = found_by.scan(words)
                if old:
                    runs = merged(runs + _pairs(old["hit_words"]))
                    ids |= set(old["items"])
                rows.append({"n_words": len(words), "hit_words": [x for run in runs for x in run],
                             "items": sorted(ids), "hit_chars": _offsets(text, runs)})
            keep = [(n, c) for n, c in zip(names, batch.columns) if n != name]
            yield pa.RecordBatch.from_arrays(
                [*(c for _, c in keep), pa.array(rows, _ARROW)], [*(n for n, _ in keep), name])

    return add


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    found = scan(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark)
    runs = F.col("_found.hit_words")
    covered = F.aggregate(
        F.transform(runs, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(
        "doc_id", "_found.n_words", covered.alias("n_hit"), F.size("_found.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "_found.items"), 256).alias("items_sha256"), (F.size(runs) > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, all columns."""
    found = free(docs, "_found")
    return scan(docs, benchmark, found).where(F.size(f"{found}.hit_words") == 0).select(*docs.columns)
