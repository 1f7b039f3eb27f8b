"""Secret scans: fixed patterns, and a battery of randomness tests for strings in an encoding.

Base spans come from three patterns (assigned passwords and tokens, access key ids, long hex runs).
The battery looks at runs of 20 or more encoding characters that hold a letter and a digit. The
narrowest alphabet that fits is the encoding; the characters are read as numbers of it. Three tests
ask whether they could be random: chi-squared uniformity over as many cells as the length feeds with
five characters each, the number of runs above and below the middle, and the lag-one serial
correlation. Fisher's method makes one p-value of the three.

False discoveries are controlled in strata of encoding and length, since short strings leave the
tests little power. Random strings spread their p-values evenly, so those above 1/2 tell how many
there are; what lies above a threshold beyond their share are ordinary strings. Each stratum takes the
lowest threshold on a fixed grid at which that part is at most ``RATE``. Counts per stratum and
grid cell are all that leaves the documents.

DataFrame functions only. Offsets are code points, ends exclusive. Null texts are empty; rows are
scanned one by one, repeated ones too; an empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabscout.session import written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "[0-9a-f]{24,}+"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}+"
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Narrowest first: name, pattern, characters in order of value.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex_upper", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER),
    ("base36_upper", "^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base62", "^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", "^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64_url", "", _UPPER + _LOWER + _DIGITS + "-_+/"),
)
LENGTHS = (32, 48, 96)
GRID = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
RATE = 0.05
BLOCK = 256


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(array: Column, kind: str = "bigint") -> Column:
    return F.aggregate(array, F.lit(0).cast(kind), lambda a, x: a + x)


def _before(lengths: Column) -> Column:
    """Sum of all earlier entries for each entry, block by block."""
    totals = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
        lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    return _let(totals, lambda t: F.transform(lengths, lambda _, i: (
        _sum(F.slice(t, F.lit(1), F.floor(i / BLOCK).cast("int")))
        + _sum(F.slice(lengths, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK)))))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<begin, end, match>> of leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = lambda f: F.zip_with(  # noqa: E731  the text between matches, then the match
        f, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(f)), lambda m, gap: F.length(gap) + F.length(m)).cast("array<bigint>")
    spans = _let(found, lambda f: _let(_let(steps(f), lambda s: F.zip_with(_before(s), s, lambda a, b: a + b)), lambda ends: F.zip_with(
        ends, f, lambda end, m: F.struct((end - F.length(m)).alias("begin"), end.alias("end"), m.alias("match")))))
    none = F.array().cast("array<struct<begin:bigint,end:bigint,match:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(none)


def assigned(text: Column) -> Column:
    """Matches of ASSIGN whose second group has six or more characters."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return F.when(
        F.regexp_like(text, F.lit(ASSIGN)),
        _let(values, lambda v: F.filter(matches(text, ASSIGN), lambda _, i: F.length(F.get(v, i)) >= 6)),
    ).otherwise(matches(F.lit(""), ASSIGN))


def normal_tail(z: Column) -> Column:
    """P(N > z) for z >= 0, by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    t = 1 / (1 + 0.2316419 * z)
    # Fixed coefficients of the approximation.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / 2.5066282746310002 * poly


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * normal_tail(F.least(F.abs(z), F.lit(30.0))))


def chi_squared_tail(x: Column, df: Column) -> Column:
    """P(chi-squared > x) through the Wilson-Hilferty cube root."""
    spread = 2 / (9 * df)
    z = (F.pow(x / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    side = normal_tail(F.least(F.abs(z), F.lit(30.0)))
    return F.when(z >= 0, side).otherwise(1 - side)


def uniformity(values: Column, letters: Column) -> Column:
    n = F.size(values)
    cells = F.least(letters, F.greatest(F.lit(2), F.floor(n / 5).cast("int")))

    def tested(k: Column) -> Column:
        cell = F.transform(values, lambda v: F.floor(v * k / letters))
        # Cells of a split by rounding hold different numbers of letters.
        parts = F.transform(F.sequence(F.lit(0), k - 1), lambda c: (
            F.ceil((c + 1) * letters / k) - F.ceil(c * letters / k)).cast("double") * n / letters)
        squares = _let(cell, lambda cs: F.transform(parts, lambda e, c: F.pow(
            F.size(F.filter(cs, lambda x: x == c)) - e, F.lit(2)) / e))
        return chi_squared_tail(_sum(squares, "double"), (k - 1).cast("double"))

    return _let(cells, tested)


def runs(values: Column, letters: Column) -> Column:
    high = F.transform(values, lambda v: F.when(v * 2 >= letters, 1).otherwise(0))

    def tested(h: Column) -> Column:
        n, n1 = F.size(h).cast("double"), _sum(h).cast("double")
        n0 = n - n1
        changes = _sum(F.zip_with(F.slice(h, F.lit(2), F.size(h) - 1), F.slice(h, F.lit(1), F.size(h) - 1), lambda a, b: F.abs(a - b)))
        mean = 2 * n0 * n1 / n + 1
        spread = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
        return F.when(spread > 0, two_sided((changes + 1 - mean) / spread)).otherwise(0.0)

    return _let(high, tested)


def serial(values: Column) -> Column:
    def tested(v: Column) -> Column:
        n = F.size(v).cast("double")
        mean = _sum(v).cast("double") / n
        return _let(mean, lambda m: _let(
            _sum(F.transform(v, lambda x: (x - m) * (x - m)), "double"), lambda square: F.when(square > 0, two_sided((
                _sum(F.zip_with(F.slice(v, F.lit(2), F.size(v) - 1), F.slice(v, F.lit(1), F.size(v) - 1), lambda a, b: (a - m) * (b - m)), "double")
                / square + 1 / n) * F.sqrt(n))).otherwise(0.0)))

    return _let(values, tested)


def fisher(p: list[Column]) -> Column:
    """One p-value of three: the chi-squared tail with six degrees of freedom has a closed form."""
    half = -sum((F.ln(F.greatest(x, F.lit(1e-12))) for x in p[1:]), F.ln(F.greatest(p[0], F.lit(1e-12))))
    return _let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))


def encoding(text: Column) -> Column:
    """Number of the narrowest encoding that fits."""
    out = F.lit(len(ENCODINGS) - 1)
    for number in range(len(ENCODINGS) - 2, -1, -1):
        out = F.when(text.rlike(ENCODINGS[number][1]), number).otherwise(out)
    return out


def battery(text: Column, number: Column) -> Column:
    """P-value of the string under the hypothesis that its characters are random."""
    alphabet = F.element_at(F.array(*[F.lit(e[2]) for e in ENCODINGS]), number + 1)
    values = F.transform(F.split(text, ""), lambda c: F.position(c, alphabet) - 1)
    return _let(values, lambda v: fisher([uniformity(v, F.length(alphabet)), runs(v, F.length(alphabet)), serial(v)]))


def stratum(number: Column, length: Column) -> Column:
    band = sum((F.when(length >= limit, 1).otherwise(0) for limit in LENGTHS), F.lit(0))
    return (number * (len(LENGTHS) + 1) + band).cast("int")


def candidates(text: Column) -> Column:
    """array<struct<begin, end, stratum, p>> of strings with a letter and a digit."""
    mixed = F.filter(matches(text, CANDIDATE), lambda m: m["match"].rlike("[0-9]") & m["match"].rlike("[A-Za-z]"))
    return F.transform(mixed, lambda m: _let(encoding(m["match"]), lambda e: F.struct(
        m["begin"].alias("begin"), m["end"].alias("end"), stratum(e, F.length(m["match"])).alias("stratum"),
        battery(m["match"], e).alias("p"))))


def thresholds(scanned: DataFrame) -> dict[int, float]:
    """Lowest p-value to report by stratum; there are at most len(ENCODINGS) * (len(LENGTHS) + 1)."""
    each = scanned.select(F.explode("candidates").alias("c")).select("c.stratum", "c.p")
    above = each.groupBy("stratum").agg(*[F.count(F.when(F.col("p") > t, 1)).alias(f"n{i}") for i, t in enumerate(GRID)])
    out = {}
    for row in above.collect():
        random = row[f"n{GRID.index(0.5)}"] / 0.5
        for i, t in enumerate(GRID):
            found = row[f"n{i}"]
            if found and found - random * (1 - t) <= RATE * found:
                out[row.stratum] = t
                break
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: array<struct<begin, rank, end>>, rank being the place in KINDS, in order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = lambda found, rank: F.transform(found, lambda m: F.struct(
        m["begin"].alias("begin"), F.lit(rank).alias("rank"), m["end"].alias("end")))
    scanned = written(docs.select(
        F.col("doc_id"), plain(assigned(text), 0).alias("assign"), plain(matches(text, ACCESS), 1).alias("access"),
        plain(matches(text, HEX), 2).alias("hex"), candidates(text).alias("candidates")), "scanned")
    lowest = thresholds(scanned)
    limits = F.array(*[F.lit(lowest.get(n, 2.0)) for n in range(len(ENCODINGS) * (len(LENGTHS) + 1))])
    random = F.filter("candidates", lambda c: c["p"] > F.element_at(limits, c["stratum"] + 1))
    spans = F.array_sort(F.concat("assign", "access", "hex", plain(random, 3)))
    return scanned.select("doc_id", spans.alias("spans"))


def listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    found = scan(docs)
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("bigint")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
