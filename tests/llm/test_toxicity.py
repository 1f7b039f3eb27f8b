"""Toxicity scores next to a plain version of the features, and on held-out rows."""
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscout.llm import queries, toxicity

SCHEMA = "doc_id bigint, text string, _toxicity int, toxic string, place int, found string"


def grams(text):
    flat = re.sub(r"[\x20\x09-\x0D]+", " ", " " + re.sub("[A-Z]", lambda m: m[0].lower(), text or "") + " ")
    return {flat[i:i + n] for n in (3, 4, 5, 6, 7) for i in range(len(flat) - n + 1)}


@pytest.mark.parametrize("text", [None, "", " ", "a", "Ab\n\nC  ", "ÉÈ日本\U0001F600語 tab\tend", "x" * 50, "word " * 40 + "\x00\x00\x00a"])
@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_ngrams(monkeypatch, text, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    want = set()
    for g in grams(text):
        h = 0
        for c in g:
            h = (h * 0x100000001B3 + ord(c)) % 2**64
        want.add(((h + len(g)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS))
    assert set(toxicity.present(text).tolist()) == want


def rows():
    polite = ["the weather is mild today", "please read the annex", "we meet at noon near the station", "thanks for the notes"]
    rude = ["you utter gnarl", "what a gnarl you are", "gnarl gnarl go away", "such a Gnarl"]
    out, labels = [], []
    for i in range(60):
        text = polite[i % 4] + f" {i} " + (rude[i // 2 % 4] if i % 3 == 0 else polite[(i + 1) % 4])
        out.append((i, text))
        labels.append((i, int(i % 3 == 0)))
    out += [(60, None), (61, ""), (62, "  "), (None, "gnarl"), (None, None), (63, "calm " * 60000 + "gnarl"), (64, "calm " * 60000), (5, "again"), (5, None)]
    labels += [(None, 1), (7, None), (3, 1), (3, 0), (999, 1), (8, 2)]
    return out, labels


def test_scores_follow_the_method(spark):
    texts, marks = rows()
    docs = spark.createDataFrame([(*r, 1, "t", 2, "f") for r in texts], SCHEMA).repartition(3)
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, F.lit(True), features=300)
    known = {}
    for i, y in marks:
        if i is not None and y in (0, 1):
            known[i] = min(known.get(i, 1), y)
    of = {}
    for i, t in texts:
        if i in known:
            of[i] = max(of.get(i, ""), t or "")
    counts = [Counter(g for i, t in of.items() if known[i] == y for g in grams(t)) for y in (0, 1)]
    every = set(counts[0]) | set(counts[1])
    total = [sum(c[g] + 1 for g in every) for c in counts]
    docs_of = [sum(known[i] == y for i in of) for y in (0, 1)]

    def gain(g):
        share, out = (counts[0][g] + counts[1][g]) / sum(docs_of), 0.0
        for c, n in ((counts[1][g], docs_of[1]), (counts[0][g], docs_of[0])):
            out += (c * math.log(c / (share * n)) if c else 0) + ((n - c) * math.log((n - c) / ((1 - share) * n)) if c < n else 0)
        return out

    often = sorted((g for g in every if counts[0][g] + counts[1][g] > 1), key=gain, reverse=True)[:300]
    edge = gain(often[-1]) + 1e-9
    places = {g: int(model.feature[_bucket(g)]) for g in often if gain(g) > edge}
    assert len(places) > 50 and sum(p < 0 for p in places.values()) <= 3  # n-grams that share a bucket with another
    number = {b: int(p) for b, p in enumerate(model.feature) if p >= 0}
    values = np.zeros(len(number))
    for g in every:
        if _bucket(g) in number:
            values[number[_bucket(g)]] = math.log((counts[1][g] + 1) / total[1]) - math.log((counts[0][g] + 1) / total[0])
    held = [np.array(sorted({number[_bucket(g)] for g in grams(of[i]) if _bucket(g) in number})) for i in sorted(of)]
    weight, bias = toxicity.fit(held, np.array([known[i] for i in sorted(of)]), values)
    assert np.allclose(weight, model.weight, rtol=0.01, atol=1e-3) and bias == pytest.approx(model.bias, abs=0.01)
    got = toxicity.with_scores(docs, model, "score_")
    assert got.columns == [*docs.columns, "score_"]
    scores = [(r[0], r[1], r[-1]) for r in got.collect()]
    assert len(scores) == len(texts)
    agree = []
    for i, text, score in scores:
        has = np.array(sorted({int(model.feature[_bucket(g)]) for g in grams(text)}), int)
        z = model.weight[has[has >= 0]].sum() + model.bias
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        if i is not None and i < 60 and i != 5:
            agree.append((score >= 0.5) == ("gnarl" in text.lower()))
    assert sum(agree) >= 57  # one text carries two labels


def _bucket(gram):
    h = 0
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) % 2**64
    return ((h + len(gram)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS)


def test_fit_is_at_its_optimum():
    deal = np.random.default_rng(0)
    docs = [np.flatnonzero(deal.random(6) < 0.5) for _ in range(200)]
    labels = np.array([int(0 in d) if deal.random() < 0.9 else 1 - int(0 in d) for d in docs])
    ratio = np.array([2.0, -1.0, 0.5, 0.1, -0.3, 1.5])
    weight, bias = toxicity.fit(docs, labels, ratio, rounds=3000, rate=0.02)
    x = np.array([[i in d for i in range(6)] for d in docs]) * ratio
    per = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / 200
    off = (1 / (1 + np.exp(-(x @ (weight / ratio) + bias))) - labels) * per
    assert np.abs(np.append(x.T @ off + 3e-3 * weight / ratio, off.sum())).max() < 1e-5


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(*r, 1, "t", 2, "f") for r in rows()[0]], SCHEMA)
    one_kind = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, one_kind, F.lit(True))
    assert {r[-1] for r in toxicity.with_scores(docs, model, "s").collect()} == {0.5}
    assert toxicity.with_scores(docs.limit(0), model).count() == 0


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op13_ngram_toxicity"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert len(toxic) > 50 and sum(r.predicted for r in toxic) >= 0.88 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    above = sum((t.score > c.score) + 0.5 * (t.score == c.score) for t in toxic for c in clean)
    assert above >= 0.98 * len(toxic) * len(clean)
