"""Encoding of many short text pieces with a public tokenizer, through a bounded cache per worker.

Both tokenizers used here cut a text at white space before they merge bytes, so the ids of a text
are those of its pieces one after another. A piece is encoded by the library, never by this module.
"""
from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np

MARK = "\x02"  # an ASCII control character, never white space, a letter or part of another character
LONGEST_CACHED = 64
TAILS = ".,;:!?"
ENTRY_BYTES = 170  # two objects and a place in a dict that is two thirds full


def _word_end(char: str | bytes) -> bool:
    return char.isascii() and char.isalnum()


_encoders: dict[tuple, "PieceEncoder"] = {}


class PieceEncoder:
    """Cache from piece to its value; new pieces go to the library, many in one call.

    ``values(ids, begins, ends)`` gives the values of consecutive slices of an array of ids.
    """

    def __init__(self, path: str, values, limit: int, seed: dict | None = None, limit_bytes: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.values, self.limit, self.limit_bytes, self.cache = values, limit, limit_bytes, dict(seed or {})
        self.measured = 0  # entries counted so far
        self.bytes = 0  # of pieces, values and their places in the cache, estimated
        self.mark = self.ids(" " + MARK)
        signs = {c: self.value(self.ids(c)) for c in TAILS}
        self.tails = signs | {c.encode(): v for c, v in signs.items()}

    @classmethod
    def of(cls, path: str, values, limit: int, seed: dict | None = None, limit_bytes: int | None = None) -> "PieceEncoder":
        """The worker's own encoder: tasks that run in one Python process share its cache."""
        key = (cls, path, values.__name__, limit, limit_bytes)
        if key not in _encoders:
            _encoders[key] = cls(path, values, limit, seed, limit_bytes)
        return _encoders[key]

    def value(self, ids: list[int]):
        return self.values(np.array(ids, np.uint32), np.array([0]), np.array([len(ids)]))[0]

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def encode_many(self, texts: list[str]) -> list:
        """Values of texts that start with white space or may follow it, in few library calls.

        Texts are joined with a marked separator whose ids can come from nothing else; a text that
        holds the mark or a special token is encoded alone.
        """
        out: list = [None] * len(texts)
        plain = [i for i, text in enumerate(texts) if MARK not in text and "<|" not in text]
        for i in set(range(len(texts))).difference(plain):
            out[i] = self.value(self.ids(texts[i]))
        separator = " " + MARK
        for at in range(0, len(plain), 512):
            part = plain[at:at + 512]
            ids = np.array(self.ids("".join([texts[i] + separator for i in part])), np.uint32)
            marks = np.flatnonzero(ids == self.mark[-1]) + 1
            values = self.values(ids, np.r_[0, marks[:-1]], marks - len(self.mark))
            for i, value in zip(part, values, strict=True):
                out[i] = value
        return out

    def fill(self, pieces: set, text_of) -> dict:
        """Make every piece known; long pieces come back in a dict of their own, not kept.

        A sign of ``TAILS`` after an ASCII letter or digit is a pre-token of its own, so such a
        piece is worth its two parts and only the first has to be known.
        """
        new = pieces.difference(self.cache)
        ending = {p: p[:-1] for p in new if p[-1:] in self.tails and _word_end(p[-2:-1])}
        bases = {b for b in ending.values() if b not in self.cache}
        alone = list(new.difference(ending) | bases)
        values = dict(zip(alone, self.encode_many([text_of(p) for p in alone])))
        long = {p: v for p, v in values.items() if len(p) > LONGEST_CACHED}
        self.cache.update((p, v) for p, v in values.items() if p not in long)
        for piece, base in ending.items():
            value = (self.cache[base] if base in self.cache else long[base]) + self.tails[piece[-1:]]
            (self.cache if len(piece) <= LONGEST_CACHED else long)[piece] = value
        return long

    def shrink(self) -> None:
        """Over the limit, go back to two thirds of it: the newest go, common pieces came early."""
        if len(self.cache) > self.limit:
            for _ in range(len(self.cache) - 2 * self.limit // 3):
                self.cache.popitem()
        if self.limit_bytes is not None:  # for values that have a length
            entries = len(self.cache)
            if entries > self.measured:
                self.bytes += sum(ENTRY_BYTES + len(p) + len(v) for p, v in islice(reversed(self.cache.items()), entries - self.measured))
            if self.bytes > self.limit_bytes:
                while self.cache and self.bytes > 2 * self.limit_bytes // 3:
                    p, v = self.cache.popitem()
                    self.bytes -= ENTRY_BYTES + len(p) + len(v)
            self.measured = len(self.cache)


_LETTERS = re.compile(" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordEncoder(PieceEncoder):
    """Encodes words of Latin letters without the normalizer and the pattern of the library.

    Only for tokenizers that fold case, take a run of letters as one word and mark its last token with a
    suffix, which tells where it ends. NFC leaves such letters alone.
    """

    def __init__(self, path: str, *args, **kwargs):
        super().__init__(path, *args, **kwargs)
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(self.library.to_str())
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        suffix = spec["model"].get("end_of_word_suffix")
        self.words = None
        if suffix and steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and (
                cuts[0]["pattern"] == {"Regex": _WORDS} and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]):
            self.words = Tokenizer.from_file(path)
            self.words.no_truncation()
            self.words.no_padding()
            self.words.normalizer = None
            self.words.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.words.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encode_many(self, texts: list[str]) -> list:
        if self.words is None:
            return super().encode_many(texts)
        out: list = [None] * len(texts)
        match = _LETTERS.fullmatch
        plain = [i for i, text in enumerate(texts) if match(text)]
        for at in range(0, len(plain), 512):
            part = plain[at:at + 512]
            ids = np.array(self.words.encode("".join([texts[i] for i in part]).lower(), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                for i, value in zip(part, self.values(ids, np.r_[0, ends[:-1]], ends)):
                    out[i] = value
        rest = [i for i, value in enumerate(out) if value is None]
        for i, value in zip(rest, super().encode_many([texts[i] for i in rest])):
            out[i] = value
        return out
