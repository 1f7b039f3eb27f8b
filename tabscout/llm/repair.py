"""Repair of conversation structure: cheapest edits by a Viterbi recursion that runs in chunks.

A repaired conversation is empty or an optional system row followed by user/assistant pairs. The
recursion has four states (nothing yet, after system, after user, after assistant) and gives, from the
end of a conversation to its start, the least cost to go from every state.

Conversations are cut into chunks of bounded size, each held as one byte a row. All chunks run at once
from speculative cost vectors. A chunk whose later neighbour turns out to start with another vector is
run again from that one, until its vectors differ from the earlier ones by a constant only: the rest of
the chunk is then right but for that constant. Passes go on until no neighbour disagrees. Chunks that
still disagree after ``FIXUPS`` passes (long stretches of unknown roles never forget where they began)
hand out their cost from each state to each state, and these few numbers are chained. With the right
vectors at hand, a chunk traces the least audit from each of its four possible entry states; the states
are then stitched together along the conversation.

Rows of one turn stand in the order of their role and of a digest of their text, null turns first. Rows
without conv_id are one conversation. Null roles and texts are one space. A role counts by its first
letter; an empty or unknown one must be changed or deleted. Repeated rows are kept one by one (and found
to be duplicates). Other columns are not looked at; an empty table gives an empty result.

The digest of a repaired conversation is sequential by nature: one task streams its rows, in constant
memory, and its audit is one string.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabscout.session import ship, written

CHUNK = 1 << 14
FIXUPS = 3
SPACE = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NONE, SYSTEM, USER, ASSISTANT = range(4)  # what was put out last
NEXT = (USER, USER, ASSISTANT, USER)  # state after an inserted or changed row
# state after a kept row, by state and initial (s, u, a, other); -1 where it may not be kept
KEPT = ((SYSTEM, USER, -1, -1), (-1, USER, -1, -1), (-1, -1, ASSISTANT, -1), (-1, USER, -1, -1))
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40

# A row is one byte: initial (0-3), plus 4 if it is cut off, 8 if it is blank or a duplicate.
CUT, GONE = 4, 8


def _inserts(v: list[int]) -> list[int]:
    u, a = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return [min(v[NONE], INSERT + u), min(v[SYSTEM], INSERT + u), u, a]


def _before(code: int, v: list[int]) -> list[int]:
    """Costs to go before a row from those after it."""
    if code & GONE:
        return [DELETE + x for x in v]
    extra, kept = TRUNCATED * bool(code & CUT), code & 3
    out = []
    for state in range(4):
        best = min(DELETE + v[state], REROLE + extra + v[NEXT[state]])
        to = KEPT[state][kept]
        out.append(best if to < 0 else min(best, KEEP + extra + v[to]))
    return _inserts(out)


def costs(codes: bytes, after: list[int]) -> list[list[int]]:
    """Costs to go before each row of a chunk and after its last."""
    out = [list(after)]
    for code in reversed(codes):
        out.append(_before(code, out[-1]))
    out.reverse()
    return out


def relative(v: list[int]) -> list[int]:
    low = min(v)
    return [x - low for x in v]


def mended(codes: bytes, old: list[int], new: list[int]) -> list[int]:
    """Costs before a chunk from ``new``, stopping where they differ from those from ``old`` by a constant."""
    earlier = costs(codes, old)
    v = list(new)
    for i in range(len(codes), 0, -1):
        if relative(v) == relative(earlier[i]):
            shift = v[0] - earlier[i][0]
            return [x + shift for x in earlier[0]]
        v = _before(codes[i - 1], v)
    return v


def trace(codes: bytes, after: list[int], state: int, last: bool) -> tuple[str, int, int]:
    """(least audit among the cheapest, state at the end, cost) of a chunk entered in ``state``."""
    togo = costs(codes, after)
    audit, spent, i = [], 0, 0
    while True:
        rest = togo[i][state]
        if i == len(codes):
            if not last or rest == 0:
                return "".join(audit), state, spent
            audit.append("I")
            spent, state = spent + INSERT, NEXT[state]
            continue
        code, extra = codes[i], TRUNCATED * bool(codes[i] & CUT)
        to = -1 if code & GONE else KEPT[state][code & 3]
        if rest == DELETE + togo[i + 1][state]:
            audit.append("D")
            spent += DELETE
        elif rest == INSERT + togo[i][NEXT[state]]:
            audit.append("I")
            spent, state = spent + INSERT, NEXT[state]
            continue
        elif to >= 0 and rest == KEEP + extra + togo[i + 1][to]:
            audit.append("K")
            spent, state = spent + KEEP + extra, to
        else:
            audit.append("R")
            spent, state = spent + REROLE + extra, NEXT[state]
        i += 1


def beside(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Columns of both, joined where all keys are equal or both null."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, same, how).drop(*[f"_{k}" for k in keys])


# --- rows -------------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that the crc32 of ``conv_id:turn`` decides."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    return (
        rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"),
                    kind.alias("kind"))
        .where("kind <> 0")
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
        .drop("copy")
    )


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _placed(rows: DataFrame) -> DataFrame:
    """Rows without texts in order: ``pos`` grows along it, ``chunk`` names a bounded stretch."""
    initial = F.substring("role", 1, 1)
    end = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    light = rows.select(
        "conv_id", "turn", "role", _digest(),
        (F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
         + F.when((end != "") & ~end.isin(".", "!", "?"), CUT).otherwise(0)).alias("code"),
        (end == "").alias("blank"), F.rand(11).alias("salt"),
    )
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*_order(), F.col("salt")]  # the salt parts rows that are equal in everything
    sorted_rows = light.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("salt")
    placed = written(sorted_rows.withColumn("pos", F.monotonically_increasing_id()), "turns")
    return placed.withColumn("chunk", F.shiftright("pos", CHUNK.bit_length() - 1))


_CHUNK = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("codes", T.BinaryType()),
    *[T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "opens", "closes")],
    T.StructField("role", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("turn", T.LongType()),
])
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _summed(group: list[dict]) -> dict:
    """A chunk as one row. A row marked ``first`` says that the row of that place is no duplicate."""
    codes = bytearray()
    out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    turn, before = None, None
    fresh = {r["pos"] for r in group if r["first"]}
    rows = [r for r in group if not r["first"]]
    for r in rows:
        code = r["code"]
        if before is not None and (before, code & 3) not in LEGAL:
            out["illegal"] += 1
        before = code & 3
        if r["turn"] is not None and r["turn"] != turn:
            out["turns"] += 1
            turn = r["turn"]
        if r["blank"]:
            out["blank"] += 1
            code = code & 3 | GONE
        elif r["pos"] not in fresh:
            out["duplicate"] += 1
            code = code & 3 | GONE
        elif code & CUT:
            out["truncated"] += 1
        codes.append(code)
    known = [r["turn"] for r in rows if r["turn"] is not None]
    return {**out, "codes": bytes(codes), "opens": codes[0] & 3, "closes": codes[-1] & 3, "low": min(known, default=None), "high": max(known, default=None),
            **{c: rows[0][c] for c in ("conv_id", "chunk", "role", "digest", "turn")}}


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Rows of sorted batches, one list for each stretch of equal keys."""
    rows = (row for batch in batches for part in range(0, batch.num_rows, 4096) for row in batch.slice(part, 4096).to_pylist())
    for _, run in groupby(rows, itemgetter(*keys)):
        yield list(run)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _chunks(placed: DataFrame) -> DataFrame:
    """One stored row per conversation and chunk, numbered along the conversation."""
    first = placed.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select(
        "conv_id", F.shiftright("pos", CHUNK.bit_length() - 1).alias("chunk"), "pos", F.lit(True).alias("first"))
    light = placed.select("conv_id", "chunk", "pos", F.lit(False).alias("first"), "turn", "role", "digest", "code", "blank")
    marked = light.unionByName(first, allowMissingColumns=True)
    schema = T.StructType([placed.schema["conv_id"], *_CHUNK.fields])
    arrow = _arrow(schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((_summed(run) for run in _runs(batches, "conv_id", "chunk")), arrow)

    one_each = written(
        marked.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "pos").mapInArrow(make, schema), "chunks")
    whole = Window.partitionBy("conv_id")
    numbers = one_each.select(
        "conv_id", "chunk", F.row_number().over(whole.orderBy("chunk")).alias("seq"),
        (F.col("chunk") == F.max("chunk").over(whole)).alias("last"))
    return written(beside(one_each, numbers, "conv_id", "chunk"), "numbered-chunks")


# --- vectors ----------------------------------------------------------------------------------

def _vectors(chunks: DataFrame, fixups: int = FIXUPS) -> DataFrame:
    """The chunks with ``after``, the right costs to go after their last row but for a constant."""
    state = T.StructType([chunks.schema["conv_id"], T.StructField("seq", T.IntegerType()),
                          T.StructField("after", T.ArrayType(T.LongType())), T.StructField("start", T.ArrayType(T.LongType()))])
    arrow = _arrow(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["new"] is None:
                    after = list(END) if r["last"] else [0, 0, 0, 0]  # speculative but for the last
                    start = costs(r["codes"], after)[0]
                else:
                    after, start = r["new"], mended(r["codes"], r["after"], r["new"])
                out.append({"conv_id": r["conv_id"], "seq": r["seq"], "after": after, "start": relative(start)})
            yield pa.RecordBatch.from_pylist(out, arrow)

    rows = chunks.select("conv_id", "seq", "last", "codes")
    none = F.lit(None).cast("array<bigint>")
    states = written(rows.select("*", none.alias("after"), none.alias("new")).mapInArrow(run, state), "vectors")

    alone = chunks.where("seq = 1 and not last").isEmpty()
    for turn in range(fixups + 1):
        if alone:  # every conversation is one chunk, whose end is known
            break
        later = states.select("conv_id", (F.col("seq") - 1).alias("seq"), F.col("start").alias("new"))
        differs = F.transform("after", lambda x: x - F.array_min("after")) != F.col("new")
        wrong = written(beside(states.drop("start"), later, "conv_id", "seq").where(differs), "wrong")
        if wrong.isEmpty():
            break
        if turn == fixups:
            states = _chained(chunks)
            break
        redone = beside(rows, wrong, "conv_id", "seq").select("conv_id", "seq", "last", "codes", "after", "new").mapInArrow(run, state)
        kept = beside(states, wrong.select("conv_id", "seq"), "conv_id", "seq", how="left_anti")
        states = written(kept.unionByName(redone), "vectors")
    return beside(chunks, states.select("conv_id", "seq", "after"), "conv_id", "seq")


def _chained(chunks: DataFrame) -> DataFrame:
    """Right vectors of all chunks from the cost of every chunk between any two states."""
    conv = chunks.schema["conv_id"]
    moves = T.StructType([conv, T.StructField("seq", T.IntegerType()), T.StructField("costs", T.ArrayType(T.ArrayType(T.LongType())))])
    done = T.StructType([conv, T.StructField("seq", T.IntegerType()), T.StructField("after", T.ArrayType(T.LongType()))])
    moves_arrow, done_arrow = _arrow(moves), _arrow(done)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ends = [[0 if s == t else FAR for s in range(4)] for t in range(4)]
                out.append({"conv_id": r["conv_id"], "seq": r["seq"], "costs": [costs(r["codes"], e)[0] for e in ends]})
            yield pa.RecordBatch.from_pylist(out, moves_arrow)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            at, v, none = object(), list(END), object()
            for batch in batches:
                for r in batch.to_pylist():
                    if at is none or r["conv_id"] != at:
                        at, v = r["conv_id"], list(END)
                    yield {"conv_id": r["conv_id"], "seq": r["seq"], "after": v}
                    v = relative([min(v[t] + r["costs"][t][s] for t in range(4)) for s in range(4)])
        yield from _batches(rows(), done_arrow)

    found = chunks.select("conv_id", "seq", "codes").mapInArrow(between, moves)
    right = found.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seq")).mapInArrow(chain, done)
    return written(right, "chained")


# --- trace and result -------------------------------------------------------------------------

def _audits(chunks: DataFrame) -> DataFrame:
    """(conv_id, seq, audit, cost): the edits of every chunk from the state it is entered in."""
    conv = chunks.schema["conv_id"]
    ways = T.StructType([conv, T.StructField("seq", T.IntegerType()), T.StructField("exits", T.ArrayType(T.IntegerType()))])
    entries = T.StructType([conv, T.StructField("seq", T.IntegerType()), T.StructField("state", T.IntegerType())])
    out = T.StructType([conv, T.StructField("seq", T.IntegerType()), T.StructField("audit", T.StringType()), T.StructField("cost", T.LongType())])
    ways_arrow, entries_arrow, out_arrow = _arrow(ways), _arrow(entries), _arrow(out)

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"conv_id": r["conv_id"], "seq": r["seq"],
                     "exits": [trace(r["codes"], r["after"], s, r["last"])[1] for s in range(4)]} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, ways_arrow)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            state = NONE
            for batch in batches:
                for r in batch.to_pylist():
                    state = NONE if r["seq"] == 1 else state
                    yield {"conv_id": r["conv_id"], "seq": r["seq"], "state": state}
                    state = r["exits"][state]
        yield from _batches(rows(), entries_arrow)

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                audit, _, cost = trace(r["codes"], r["after"], r["state"], r["last"])
                rows.append({"conv_id": r["conv_id"], "seq": r["seq"], "audit": audit, "cost": cost})
            yield pa.RecordBatch.from_pylist(rows, out_arrow)

    cols = ["conv_id", "seq", "codes", "after", "last"]
    alone = chunks.where("seq = 1 and last").select(*cols, F.lit(NONE).alias("state")).mapInArrow(edits, out)
    long = chunks.where("not (seq = 1 and last)")
    if long.isEmpty():
        return alone
    exits = long.select(*cols).mapInArrow(leave, ways)
    entered = exits.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(stitch, entries)
    entered = written(entered, "entries")
    traced = beside(long.select(*cols), entered, "conv_id", "seq")
    return alone.unionByName(traced.mapInArrow(edits, out))


def _counts(chunks: DataFrame) -> DataFrame:
    """Faults, gaps and illegal neighbours of every conversation, from its chunks."""
    along = Window.partitionBy("conv_id").orderBy("seq")
    before = F.lag("closes").over(along)
    pair = before * 4 + F.col("opens")
    legal = [4 * a + b for a, b in sorted(LEGAL)]
    # a turn that goes on from one chunk into the next is one turn
    goes_on = F.col("low") == F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    return (
        chunks.drop("codes").withColumn("illegal", F.col("illegal") + F.when(before.isNotNull() & ~pair.isin(legal), 1).otherwise(0))
        .withColumn("turns", F.col("turns") - F.when(goes_on, 1).otherwise(0))
        .groupBy("conv_id").agg(
            F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
            *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    )


_NAMES = {USER: "user", ASSISTANT: "assistant"}
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _repaired(stream: Iterator[dict]) -> Iterator[dict]:
    """Results of conversations from a stream of, each in order: counts, audits of chunks, rows."""
    for _, rows in groupby(stream, itemgetter("conv_id")):
        counts, parts, waiting, state, digest, empty = None, [], [], NONE, hashlib.sha256(), True

        def put(role: str, text: str) -> None:
            nonlocal empty
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False

        def inserted() -> None:
            nonlocal state
            while waiting and waiting[-1] == "I":
                waiting.pop()
                state = NEXT[state]
                put(_NAMES[state], "")

        for r in rows:
            if r["kind"] == 0:
                counts = {c: r[c] or 0 for c in _COUNTS}
            elif r["kind"] == 1:
                parts.append(r["text"])
                waiting[:0] = reversed(r["text"])
                counts["cost"] += r["cost"]
            else:
                inserted()
                edit = waiting.pop()
                if edit == "K":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[r["role"][:1]]
                    put(r["role"], r["text"])
                elif edit == "R":
                    state = NEXT[state]
                    put(_NAMES[state], r["text"])
        inserted()
        yield {"conv_id": r["conv_id"], **counts, "audit": "".join(parts), "repaired_sha256": digest.hexdigest()}


def repair(conversations: DataFrame, fixups: int = FIXUPS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    ``conversations(conv_id, turn, role, text)`` as they are; see ``report`` for damaged ones.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role"), blank("text"))
    return _mended(conversations.select("conv_id"), rows, fixups)


def report(conversations: DataFrame, fixups: int = FIXUPS) -> DataFrame:
    """As ``repair``, after ``damaged``; conversations that lost all rows come with zeros."""
    return _mended(conversations.select("conv_id"), damaged(conversations), fixups)


def _mended(ids: DataFrame, rows: DataFrame, fixups: int) -> DataFrame:
    ship(ids.sparkSession)
    chunks = _chunks(_placed(rows))
    vectors = written(_vectors(chunks, fixups), "chunk-vectors")
    counts = _counts(chunks)
    audits = _audits(vectors)
    keys = vectors.select("conv_id", "seq", "turn", "role", "digest")
    placed = beside(audits, keys, "conv_id", "seq").withColumnRenamed("audit", "text").withColumn("kind", F.lit(1))
    heads = beside(ids.distinct(), counts, "conv_id", how="left").withColumn("cost", F.lit(0).cast("bigint")).withColumn("kind", F.lit(0))
    texts = rows.select("conv_id", "turn", "role", _digest(), "text", F.lit(2).alias("kind"))
    stream = texts.unionByName(placed, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    schema = T.StructType([
        rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in _COUNTS],
        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    arrow = _arrow(schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for at in range(0, b.num_rows, 1024) for r in b.slice(at, 1024).to_pylist())
        yield from _batches(_repaired(rows), arrow, 256)

    # the counts of a conversation first, then the edits of a chunk before the rows they are for
    conv, *inside = _order()
    order = [conv, F.col("kind") != 0, *inside, F.col("kind"), F.col("seq")]
    return stream.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(finish, schema)
