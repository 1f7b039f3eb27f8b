"""Operators over documents next to plain Python versions, on a table of hard cases."""
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabscout.llm import decontaminate, golay, katz, linejoin, mixing, pieces, randomness, tokencount, wavelet

WS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, size int, _fp string, _found int, _score string, fp int, held int"


def texts():
    base = " ".join(f"word{i % 37} The{i % 11} x{i}" for i in range(400))
    near = base.replace("x200", "other")
    line = "one two three four five six seven eight nine ten eleven twelve"
    return [
        (1, base, "a"), (2, base, "a"), (3, near, "b"), (4, None, None), (5, "", "b"), (6, "  \n\t ", "a"), (7, "single", "c"),
        (8, "single", "c"), (8, "single", "c"), (None, "no id here at all", "c"), (None, None, None),
        (9, "é È ñ 日本語 テスト don't <|endoftext|> A\x02B a\x1cb", "é"), (10, base + "\n" + line, None),
        (11, line.replace("six", "SIX"), "b"), (12, line.replace("twelve", "12") + "\n" + line + "\n\n" + line, "b"),
        (13, "password = 'abcdefg' token: ab AKIA" + "B2" * 9 + " " + "0123456789abcdef" * 3, "d"),
        (14, "é secret=token=abcdef password: token: abcdefgh", "d"), (15, "long " * 30000, "a"), (16, "y" * 50000, "d"),
        (17, "a  b\r\nc\n\n d \n", "d"), (18, " lead", "d"), (19, "trail ", "d"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx", s, 1, "f", 2, "s", 3, 4) for i, t, s in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def words(text):
    return (text or "").encode().lower().split()


# --- tokens -----------------------------------------------------------------------------------

def test_token_counts(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = []
    for i, t, _ in texts():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    same(tokencount.count_tokens(docs, path).collect(), want)
    assert tokencount.count_tokens(empty, path).count() == 0


def test_piece_cache_stays_bounded():
    encoder = pieces.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), tokencount._sizes, 10)
    for start in range(0, 100, 7):
        met = {f"w{n}" for n in range(start, start + 7)}
        encoder.fill(met, lambda p: " " + p)
        assert all(encoder.cache[p] == len(encoder.ids(" " + p)) for p in met)
        encoder.shrink()
        assert len(encoder.cache) <= 10


def test_piece_cache_is_bounded_in_bytes():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = pieces.PieceEncoder(path, wavelet._two_bytes, 1 << 60, limit_bytes=100_000)
    for turn in range(40):
        met = {f"word{turn}x{i}".encode() for i in range(60)} | {b"common"}
        long = encoder.fill(met, wavelet._spaced)
        assert all(p in encoder.cache or p in long for p in met)
        encoder.shrink()
        assert encoder.bytes == sum(pieces.ENTRY_BYTES + len(p) + len(v) for p, v in encoder.cache.items()) <= 100_000
    assert b"common" in encoder.cache


def test_wavelet_files(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    order = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {(i, t): library.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in order}
    got = wavelet.binary_tokens(docs, path).collect()
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got],
         [(i, len(ids[i, t]), zlib.crc32(np.array(ids[i, t], "<u4").tobytes())) for i, t, _ in order])
    spans = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    assert [s for s, _, _ in spans] == list(np.cumsum([0] + [n for _, n, _ in spans[:-1]]))
    assert [i for _, _, i in spans] == [i for i, _, _ in order]
    assert wavelet.binary_tokens(empty, path).count() == 0

    where = f"file://{tmp_path}/shards"
    wavelet.write_shards(wavelet.encode_shards(docs, path, 1, shard_tokens=500), where)
    rows = wavelet.read_shards(spark, where).orderBy("part", "seq").collect()
    assert len(rows) > 5 and len(list((tmp_path / "shards").glob("*.parquet"))) == len(rows)
    assert sum(r.n_tokens for r in rows) == sum(n for _, n, _ in spans)


def test_wavelet_queries():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.5, 20_000) % 49_000).astype(np.uint16)
    zeros, planes, ranks = wavelet.build_planes(ids, 16)
    m = wavelet.WaveletMatrix({"n_tokens": len(ids), "bits": 16, "zeros": zeros, "planes": planes, "ranks": ranks,
                               "doc_ids": b"", "doc_has_id": b"", "lengths": b""})
    assert (m.tokens() == ids).all()
    for i in (0, 1, 4095, 4096, 4097, 19_999):
        assert m.access(i) == ids[i]
    for token in (1, 2, 17, 48_999, 60_000, 1 << 17):
        at = np.flatnonzero(ids == token)
        assert m.count(token) == len(at) and m.count(token, 100, 9000) == ((at >= 100) & (at < 9000)).sum()
        assert list(m.occurrences(token))[:50] == list(at)[:50] if len(at) < 500 else m.select(token, len(at) - 1) == at[-1]
    with pytest.raises(IndexError):
        m.select(60_000, 0)


# --- decontamination --------------------------------------------------------------------------

BENCH = [(7, "word1 The1 x1"), (8, " ".join(f"word{i % 37} the{i % 11} X{i}" for i in range(20, 40))), (9, None), (10, " . "),
         (8, "no id"), (None, "one two three four five six seven eight nine ten eleven")]


def found_by_hand(text):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    own, hit, items = word.findall(low(text)), set(), set()
    for item, t in BENCH:
        w = word.findall(low(t))
        for i in range(max(1, len(w) - 9) if w else 0):
            window = w[i:i + 10]
            for at in range(len(own) - len(window) + 1):
                if own[at:at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    items.add(str(item) if item is not None else "")
    return len(own), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame(BENCH, "item_id int, text string")
    some = [r for r in texts() if r[0] not in (15, 16)]
    got = decontaminate.report(docs.where("doc_id is null or doc_id not in (15, 16)"), bench).collect()
    same(got, [(i, *found_by_hand(t)) for i, t, _ in some])
    plain = docs.select("doc_id", "text")
    whole = decontaminate.scan(plain, bench).collect()
    blocks = decontaminate.scan(plain, bench, block_chars=60).collect()
    same(blocks, map(tuple, whole))
    for r in whole:
        flat = r._found.hit_chars
        for begin, end in zip(flat[::2], flat[1::2]):
            assert found_by_hand(r.text[begin:end])[1] > 0
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r.contaminated for r in got) + 2
    assert decontaminate.report(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(docs, bench.limit(0)).collect())


# --- SimHash ----------------------------------------------------------------------------------

def test_golay_tables():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 23, 2000, dtype=np.uint32)
    index, there = golay.codewords(x)
    assert (there.sum(axis=1)[there.sum(axis=1) > 1] == 6).all()
    y = x ^ (np.uint32(1) << rng.integers(0, 23, 2000, dtype=np.uint32))
    own, _ = golay.codewords(y)
    assert (((index == own[:, :1]) & there).any(axis=1)).all()  # one bit away: the nearest codeword is shared


def test_links_are_exact_at_three_bits():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ sum(np.uint64(1) << np.uint64(k) for k in rng.choice(64, d, replace=False))
            for b in base for d in (1, 2, 3, 3, 4)]
    fps = np.unique(np.concatenate((base, np.array(near, np.uint64))))
    (own_row, own_key), (near_row, near_key) = golay.keys(fps)
    key = np.concatenate((own_key, near_key)).astype(np.int64)
    probe = np.arange(len(key)) >= len(own_key)
    row = np.concatenate((own_row, near_row))
    order = np.lexsort((probe, key))
    a, b = golay.links_of_runs(key[order], probe[order], fps[row[order]])
    label = {int(f): int(f) for f in fps}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for u, v in zip(a, b):
        label[max(root(int(u)), root(int(v)))] = min(root(int(u)), root(int(v)))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    for i, j in zip(*np.nonzero(close)):
        assert root(int(fps[i])) == root(int(fps[j]))
    assert all(np.bitwise_count(np.uint64(u) ^ np.uint64(v)) <= 64 for u, v in zip(a, b))


def test_large_runs_equal_small_ones(monkeypatch):
    rng = np.random.default_rng(4)
    fps = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)))
    key, probe = np.zeros(2 * len(fps), np.int64), np.arange(2 * len(fps)) >= len(fps)
    small = golay.links_of_runs(key, probe, np.concatenate((fps, fps)))
    monkeypatch.setattr(golay, "SMALL_RUN", 10)
    large = golay.links_of_runs(key, probe, np.concatenate((fps, fps)))
    assert sorted(zip(*small)) == sorted(zip(*large))


def fingerprint(text):
    w = words(text)
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    ones = collections.Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b, n in ones.items() if n * 2 > len(shingles))


def test_near_duplicates(docs, empty):
    rows = [(i, fingerprint(t)) for i, t, _ in texts()]
    label = {f: f for _, f in rows}
    for _ in rows:
        for f in label:
            label[f] = min(label[g] for g in label if (f ^ g).bit_count() <= 3)
    least = {}
    for i, f in rows:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    want = [(i, f"{f:016x}", least.get(label[f])) for i, f in rows]
    same(golay.near_duplicates(docs).collect(), want)
    kept = golay.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label.values()))
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want}
    assert golay.near_duplicates(empty).count() == 0 and golay.deduplicate(empty).count() == 0


# --- mixing -----------------------------------------------------------------------------------

def by_hand_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        per = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * per >= 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * per for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    return target


@pytest.mark.parametrize("options", [{}, {"block_words": 3, "shard_words": 40, "fan_out": 4}])
def test_mixing(docs, options):
    got = mixing.mix(docs, **options).collect()
    rows = texts()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(WS.findall(t or ""))) for i, t, _ in rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WS.findall(t or ""))
    target = by_hand_targets(sizes)
    source_of = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == r.copies * r.size + sum(c.end - c.begin for c in r.cuts)
        if r.doc_id is not None:
            s = source_of[r.doc_id]
            assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        taken[r.source_size] += r.taken
    block = options.get("block_words", mixing.BLOCK_WORDS)
    for s, size in sizes.items():
        if list(sizes.values()).count(size) == 1:
            assert abs(taken[size] - target[s]) <= max(block, 0.1 * target[s])
    same(mixing.mix(docs, **options).collect(), map(tuple, got))
    out = mixing.mixed_documents(docs, **options)
    assert out.columns == docs.columns
    assert out.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r.taken for r in got)


def test_sainte_lague(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for parent in range(30):
        weights, seats = rng.integers(1, 500, rng.integers(1, 12)).tolist(), int(rng.integers(0, 60))
        won = [0] * len(weights)
        for _ in range(seats):
            won[max(range(len(weights)), key=lambda c: (weights[c] / (2 * won[c] + 1), -c))] += 1
        rows += [(parent, c, float(w), seats) for c, w in enumerate(weights)]
        want |= {(parent, c): n for c, n in enumerate(won)}
    df = spark.createDataFrame(rows, "parent int, child int, weight double, seats bigint")
    got = {(r.parent, r.child): r.quota for r in mixing.apportion(df, ["parent"], "child", "weight", "seats", "quota").collect()}
    assert got == want


def test_no_document_comes_more_than_twice(spark):
    sizes = [90, 66, 40, 68, 99]  # blocks, each one document
    rows = [(i, "w " * 64, f"s{s}") for i, s in enumerate(s for s, n in enumerate(sizes) for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()
    assert len(got) == sum(sizes) and max(r.taken for r in got) <= 2 * 64
    # many mixes at once: sources of random sizes with the targets that the contract gives them
    rng = np.random.default_rng(8)
    asked, total = [], {}
    for case in range(20000):
        blocks = {f"s{s}": int(b) for s, b in enumerate(rng.integers(1, 120, rng.integers(3, 11)))}
        target = by_hand_targets(blocks)
        total[case] = math.floor(sum(target.values()) + 0.5)
        asked += [(case, s, float(target[s]), total[case], 2 * b) for s, b in blocks.items()]
    df = spark.createDataFrame(asked, "parent int, child string, weight double, seats bigint, cap bigint")
    over = mixing.apportion(df, ["parent"], "child", "weight", "seats", "quota", "cap")
    sums = over.groupBy("parent").agg(F.sum("quota").alias("n"), F.max(F.col("quota") - F.col("cap")).alias("above"),
                                      F.max(F.abs(F.col("quota") - F.col("weight"))).alias("off")).collect()
    assert max(r.above for r in sums) <= 0 and all(r.n == total[r.parent] for r in sums) and max(r.off for r in sums) < 1.6


def test_documents_without_id_spread_over_shards(spark):
    rows = [(None, f"text number {i} of many", "a") for i in range(600)] + [(i, "other words here", "a") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    keyed = df.select(mixing.h(mixing.SEED, F.col("doc_id"), F.lit("=a"), mixing.h(F.col("text"))).alias("order"), "doc_id")
    shards = keyed.where("doc_id is null").groupBy(F.pmod("order", F.lit(8))).count().collect()
    assert len(shards) == 8 and max(r["count"] for r in shards) < 120
    assert sum(r.taken for r in mixing.mix(df, block_words=4, shard_words=500).collect()) > 0


def test_mixing_nothing(empty, docs):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert {r.taken for r in mixing.mix(docs.where("size(split(text, '[^ ]')) = 1 or text is null")).collect()} <= {0}


# --- Katz -------------------------------------------------------------------------------------

def test_katz(docs, empty, monkeypatch):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    unigrams, bigrams, after = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t, _ in texts():
        if not is_held(i):
            w = words(t) + [b"\n"]
            pairs = list(zip([b" "] + w[:-1], w))
            unigrams.update(w)
            bigrams.update(pairs)
            after.update(a for a, _ in pairs)
    n, v = sum(unigrams.values()), len(unigrams)
    many = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.CUT + 2)]
    one, two = katz.Level(n, v, many(unigrams)), katz.Level(n, len(bigrams), many(bigrams))
    kept = lambda level, c: c * (level.factor[c] if c <= katz.CUT else 1.0)
    p1 = lambda w: (kept(one, unigrams[w]) if w in unigrams else one.freed) / one.scale
    known = collections.defaultdict(list)
    for (a, b), c in bigrams.items():
        known[a].append((b, c))
    weight = {}
    for a, seen in known.items():
        freed = sum(c * (1 - two.factor[c]) for _, c in seen if c <= katz.CUT)
        scale = after[a] + (freed <= 0)
        weight[a] = ((freed if freed > 0 else 1.0) / scale / (1 - sum(p1(b) for b, _ in seen)), scale)

    def p2(a, b):
        if a not in weight:
            return p1(b)
        return kept(two, bigrams[a, b]) / weight[a][1] if (a, b) in bigrams else weight[a][0] * p1(b)

    for context in [*weight, b"never seen"]:
        assert sum(p2(context, w) for w in unigrams) + p2(context, b"un known") == pytest.approx(1, abs=1e-9)
    want = []
    for i, t, _ in texts():
        w = words(t) + [b"\n"]
        score = sum(math.log10(p2(a, b)) for a, b in zip([b" "] + w[:-1], w))
        base = sum(math.log10((unigrams[x] + 1) / (n + v + 1)) for x in w)
        want.append((str(i), is_held(i), len(w), sum(x in unigrams for x in w), n, round(base, 6), round(score, 6)))

    for chunk, bucket, hot in ((katz.CHUNK_TOKENS, katz.BUCKET_KEYS, katz.HOT), (500, 300, 40)):
        monkeypatch.setattr(katz, "BUCKET_KEYS", bucket)
        got = katz.score_documents(docs, held, chunk_tokens=chunk, hot=hot).collect()
        same([(str(r.doc_id), *r[1:5], round(r.base_score, 6), round(r.score, 6)) for r in got], want)
    assert katz.score_documents(empty, held).count() == 0
    alone = katz.score_documents(docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in alone)


def test_packed_numbers():
    for values in (np.arange(0), np.array([5], np.int64), np.arange(-3, 1000, 7), np.array([2**40, 1, 2**62], np.int64)):
        assert (katz.unpack(katz.pack(values)) == values).all()
        assert (katz.unpack_sorted(katz.pack_sorted(values.astype(np.int64))) == values).all()


# --- randomness -------------------------------------------------------------------------------

PATTERNS = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def test_secret_base_spans(spark, docs, empty):
    more = spark.createDataFrame([(50, "0123456789abcdef01234567 é " * 900), (51, "API_KEY: \"" + "Zz9" * 30)], "doc_id bigint, text string")
    got = {str(r.doc_id) + str(r.n_hex): r for r in randomness.report(docs.select("doc_id", "text").unionByName(more)).collect()}
    for i, t in [*((i, t) for i, t, _ in texts()), *map(tuple, more.collect())]:
        spans, counts = [], []
        for rank, (kind, pattern, ok) in enumerate(PATTERNS):
            hits = [m for m in pattern.finditer(t or "") if ok(m)]
            counts.append(len(hits))
            spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in hits]
        r = got[str(i) + str(counts[2])]
        base = ",".join(s for _, _, s in sorted(spans))
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert randomness.report(empty).count() == 0


def test_battery_tells_random_strings(spark):
    rng = np.random.default_rng(6)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    hexes = [(n, draw("0123456789abcdef", 40)) for n in range(300)]
    mixed = [(1000 + n, draw(randomness.ENCODINGS[5][2], 48)) for n in range(300)]
    dull = [(2000 + n, draw("theandofing", 38) + "12") for n in range(300)] + [(3000 + n, "abc123" * 8) for n in range(20)]
    docs = spark.createDataFrame([(i, f"x {s} y") for i, s in hexes + mixed + dull], "doc_id bigint, text string")
    found = {r.doc_id for r in randomness.report(docs).collect() if "random:" in r.spans}
    assert len([i for i in found if i < 2000]) > 560 and len([i for i in found if i >= 2000]) < 16


# --- line dedup -------------------------------------------------------------------------------

def test_line_join(docs, empty, spark, monkeypatch):
    monkeypatch.setattr(linejoin, "SPLIT", 5)
    monkeypatch.setattr(linejoin, "NEAR", 1)
    rng = np.random.default_rng(7)
    variants = []
    for n in range(60):  # one large group of near copies
        w = [f"w{k}" for k in range(24)]
        w[int(rng.integers(24))] = f"v{n}"
        w[int(rng.integers(24))] = f"u{n % 7}"
        variants.append((100 + n, "\n".join((" ".join(w), f"lone line {n} of its own", "common line"))))
    rows = [(i, t) for i, t, _ in texts() if i not in (8, None)] + variants
    want, seen = {}, []
    for i, t in sorted(rows):
        gone = []
        lines = (t or "").split("\n") if t is not None else []
        for at, line in enumerate(lines):
            s = frozenset(words(line))
            if s and any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                gone.append(at)
            if s:
                seen.append(s)
        want[i] = (len(lines), len(gone), ",".join(map(str, gone)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in linejoin.report(table).collect()}
    assert got == want
    texts_left = {r.doc_id: r.text for r in linejoin.deduplicated(table).collect()}
    for i, t in rows:
        gone = set(filter(None, want[i][2].split(",")))
        assert texts_left[i] == (None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if str(at) not in gone))
    assert linejoin.report(empty).count() == 0
    assert linejoin.report(docs).count() == len({i for i, _, _ in texts()})


def test_line_links(docs, empty, spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, t) for i, t, _ in texts()]
    for n in range(40):  # one large group of near copies
        w = [f"w{k}" for k in range(24)]
        w[int(rng.integers(24))] = f"v{n % 30}"
        rows.append((100 + n, "\n".join((" ".join(w), f"lone line {n} of its own", "common line"))))
    lines = [(i, at, frozenset(words(x))) for i, t in rows if t is not None for at, x in enumerate(t.split("\n"))]
    size = collections.Counter(s for _, _, s in lines)
    count = {s: sum(s != o and bool(o) and 9 * len(s & o) >= 4 * (len(s) + len(o)) for o in size) for s in size}
    want = [(i, at, size[s] if s else 0, count[s] if s else 0) for i, at, s in lines]
    assert max(count.values()) > 20
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for split in (linejoin.SPLIT, 5):
        monkeypatch.setattr(linejoin, "SPLIT", split)
        got = linejoin.line_links(table).collect()
        same([(r.doc_id, r.line_no, r.class_lines, r.n_links) for r in got], want)
        assert len({r.class_id for r in got if r.class_id}) == len([s for s in size if s])
    assert linejoin.line_links(empty).count() == 0


def test_line_join_tells_rows_apart(spark, docs):
    def left(rows):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        return sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in linejoin.deduplicated(df).collect())

    # Line 0 of one row without id goes; line 0 of the other has no earlier match.
    assert left([(1, "a b c"), (None, "a b c\nd e f"), (None, "g h i\nj k l")]) == [(-1, "d e f"), (-1, "g h i\nj k l"), (1, "a b c")]
    # Equal lines at one place of two rows of one id: the later one goes.
    assert left([(8, "single"), (8, "single"), (None, "x y"), (None, "x y")]) == [(-1, ""), (-1, "x y"), (8, ""), (8, "single")]
    twice = spark.createDataFrame([(8, "p q"), (8, "p q")], "doc_id bigint, text string")
    assert [tuple(r) for r in linejoin.report(twice).collect()] == [(8, 2, 1, "0")]

    # Null and repeated ids of the hard cases, by brute force in the order of the rows.
    want, seen = [], []
    for (at, _, _), i, t in sorted((tuple(r.doc), r.doc_id, r.text) for r in linejoin._numbered(docs).collect()):
        assert at == (linejoin.LAST if i is None else i)
        kept = []
        for line in (t.split("\n") if t is not None else []):
            s = frozenset(words(line))
            if not (s and any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen)):
                kept.append(line)
            if s:
                seen.append(s)
        want.append((i, None if t is None else "\n".join(kept)))
    same(linejoin.deduplicated(docs).collect(), want)
