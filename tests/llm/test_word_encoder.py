"""Words of letters go to the library without its normalizer, with the same ids."""
from __future__ import annotations

import public_tokenizers
from tabscout.llm import pieces, wavelet

WORDS = ["and", "oftionnten", "É", "Èonai", "ßÿ", "naïve", "ÞÐ", "x" * 300]
ODD = ["", "İ", "ẞ", "Ÿ", "É", "É́", "a×b", "ªµ", "don't", "'s", "les&&&", "a\x02b", "<|endoftext|>", "a b", "K", "40418"]


def _encoder(name):
    return pieces.WordEncoder(public_tokenizers.path(name), wavelet._four_bytes, 1 << 60)


def test_words_and_odd_pieces_have_the_ids_of_the_library():
    encoder = _encoder("word_bpe_49k.json")
    texts = [" " + w for w in WORDS + ODD] * 100
    assert encoder.encode_many(texts) == [encoder.value(encoder.ids(t)) for t in texts]


def test_words_skip_the_normalizer(monkeypatch):
    encoder = _encoder("word_bpe_49k.json")
    normalized = []
    monkeypatch.setattr(pieces.PieceEncoder, "encode_many", lambda self, texts: normalized.extend(texts) or [b""] * len(texts))
    encoder.encode_many([" " + w for w in WORDS + ["les&&&"]])
    assert normalized == [" les&&&"]


def test_other_tokenizers_take_the_plain_way():
    encoder = _encoder("byte_bpe_50k.json")
    assert encoder.words is None
    texts = [" " + w for w in WORDS]
    assert encoder.encode_many(texts) == [encoder.value(encoder.ids(t)) for t in texts]
