"""Mixing sources to target weights, with DataFrame operations alone.

1. Targets. Sources in code point order, null last, get the weights 3, 1, 2, 3, 1, 2 ...; together
   they want ``share`` of all words. No target may pass ``most`` times its source's words; what lies
   above is shared among the rest by weight until none is above (sources sorted by words per weight
   are filled one after another, so two running sums give the end state).
2. Blocks. A source's documents are dealt to shards of about ``shard_words`` by a seeded hash and
   put in seeded order; a shard is cut into blocks of equal length, within one word.
3. Quotas. Blocks go to sources by Sainte-Lague: the highest quotients target / 1, 3, 5 ... win. A
   source's blocks go to its shards the same way, through a tree of at most ``fan_out`` children, so no
   window sees more than one node's children. Nobody gets more than ``most`` times its blocks.
4. Selection. A shard whose quota is n times its blocks and r more is taken n times, and r blocks
   once more: those that follow a seeded block, around the end of the shard.

The sum of all quotas is exact, so a source's words differ from its target by about half a block.
Sources are one row each, as many as there are weights to give. Null and empty texts have size 0 and
are never taken; repeated rows and null ids are documents like others; an empty table gives no rows.
Columns of the input that are not asked for in ``carry`` are dropped.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscout.functions.hashing import h
from tabscout.session import written

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # 150 % of all words
MOST = 2
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 18
FAN_OUT = 1024
SEED = 7

SEPARATORS = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space. Each becomes one letter; a leading one is put in front."""
    pattern = f"[^{SEPARATORS}]++[{SEPARATORS}]*+"
    return F.coalesce(F.length(F.regexp_replace(F.concat(F.lit("x "), text), pattern, "x")) - 1, F.lit(0)).cast("bigint")


def apportion(df: DataFrame, parent: Sequence[str], child: str, weight: str, seats: str, quota: str, limit: str | None = None) -> DataFrame:
    """Sainte-Lague: ``seats`` of each parent go to its children by the highest quotients of weight.

    Rounding weight * seats / total gives most of them; what is over or short (about half the
    children at most) is settled among the quotients next in line, of which each child offers its share.
    No child gets more seats than the column ``limit`` says.
    """
    own = Window.partitionBy(*parent)
    most = F.lit(1 << 62) if limit is None else F.col(limit)
    total, n = F.sum(weight).over(own), F.count(F.lit(1)).over(own)
    first = df.withColumn("_base", F.least(most, F.when(total > 0, F.floor(F.col(weight) * F.col(seats) / total + 0.5)).otherwise(0).cast("bigint")))
    first = first.withColumn("_short", F.col(seats) - F.sum("_base").over(own)).withColumn("_room", most - F.col("_base"))
    up = F.col("_short") > 0
    open_ = F.when(up & (F.col("_room") <= 0), 0.0).otherwise(F.col(weight))
    share = F.ceil(open_ / F.sum(open_).over(own) * 1.5 * n) + 2
    first = first.withColumn("_offers", F.when((F.col("_short") != 0) & (F.sum(open_).over(own) > 0), F.when(
        up, F.greatest(F.least(share, F.col("_room")), F.lit(1))).otherwise(share)).otherwise(1).cast("bigint"))
    offered = first.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_offers") - 1)))
    seat = F.when(up, F.col("_base") + F.col("_j")).otherwise(F.col("_base") - 1 - F.col("_j"))
    quotient = F.col(weight) / (2 * seat + 1)
    order = Window.partitionBy(*parent).orderBy(
        ~F.col("_free"), F.when(up, -F.col("_quotient")).otherwise(F.col("_quotient")), F.col(child))
    ranked = (
        offered.withColumn("_seat", seat).withColumn("_quotient", quotient)
        .withColumn("_free", (F.col("_seat") >= 0) & (F.col("_seat") < F.when(up, most).otherwise(1 << 62)))
        .withColumn("_rank", F.row_number().over(order))
    )
    moved = F.sum(F.when((F.col("_rank") <= F.abs("_short")) & F.col("_free"), 1).otherwise(0))
    return ranked.groupBy(*df.columns).agg((F.first("_base") + F.signum(F.first("_short")) * moved).cast("bigint").alias(quota))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, docs, target) from one row (source, source_size, docs) per source."""
    everything = Window.partitionBy()
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    listed = F.array(*[F.lit(w).cast("bigint") for w in weights])
    weighed = sizes.withColumn("_w", F.element_at(listed, ((number - 1) % len(weights) + 1).cast("int")))
    filled = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    up, down = share
    # Whole numbers, times ``down``: what is left to share and the weights left to share it.
    left = up * F.sum("source_size").over(everything) - down * most * F.coalesce(F.sum("source_size").over(filled), F.lit(0))
    rest = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(filled), F.lit(0))
    full = down * most * F.col("source_size") * F.col("_rest") <= F.col("_w") * F.col("_left")
    marked = weighed.withColumn("_left", left).withColumn("_rest", rest).withColumn("_full", full)
    # The first source that is not full knows what all the others share.
    open_left = F.max(F.when(~F.col("_full"), F.struct(F.col("_rest"), F.col("_left")))).over(everything)
    target = F.when(F.col("_full"), (most * F.col("source_size")).cast("double")).otherwise(
        (F.col("_w") * F.col("_open._left")).cast("double") / (down * F.col("_open._rest")).cast("double"))
    return marked.withColumn("_open", open_left).select("source", "source_size", "docs", target.alias("target"))


def _levels(children: int, fan_out: int) -> int:
    return max(1, math.ceil(round(math.log(max(children, 1), fan_out), 9)))


def mix(
    docs: DataFrame, carry: Sequence[str] = (), block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
    fan_out: int = FAN_OUT, seed: int = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, and how: ``copies`` of the whole document plus the
    word ranges ``cuts`` (array of begin, end). ``carry`` names columns of the input to keep as ``_carried``."""
    rows = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"),
        h(F.col("text").cast("string")).alias("_digest"),
        F.struct(*([F.col(c) for c in carry] or [F.lit(0).alias("none")])).alias("_carried"))
    if not carry:
        rows = written(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = written(
        source_targets(sizes).withColumn("shards", F.ceil((F.col("source_size") + F.col("docs")) / shard_words).cast("bigint")),
        "sources")
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))  # null is a source of its own
    known = sources.withColumn("_key", named).drop("source", "docs")
    placed = (
        rows.withColumn("_key", named).join(known, "_key")
        .withColumn("_order", h(seed, F.col("doc_id"), F.col("_key"), F.col("_digest")))  # rows that share an id spread as well
        .withColumn("shard", F.pmod(F.col("_order"), F.col("shards")))
    )
    shards = (
        placed.groupBy("_key", "shard").agg(F.sum("size").alias("words")).where("words > 0")
        .withColumn("blocks", F.ceil(F.col("words") / block_words).cast("bigint"))
    )
    shards = written(shards, "shards")

    # Sources: their targets in blocks, then whole blocks that add up to the whole.
    weighed = (
        shards.groupBy("_key").agg(F.sum("blocks").alias("blocks")).join(known, "_key")
        .select("_key", (F.col("target") * F.col("blocks") / F.col("source_size")).alias("weight"), (MOST * F.col("blocks")).alias("limit"))
        .withColumn("_all", F.lit(0))
        .withColumn("seats", F.floor(F.sum("weight").over(Window.partitionBy("_all")) + 0.5).cast("bigint"))
    )
    quotas = apportion(weighed, ["_all"], "_key", "weight", "seats", "quota", "limit").select("_key", F.lit(0).cast("bigint").alias("node"), "quota")

    most_shards = sources.agg(F.max("shards")).first()[0] or 1
    for level in range(_levels(most_shards, fan_out) - 1, -1, -1):
        width = fan_out ** level
        children = shards.groupBy("_key", F.floor(F.col("shard") / width).cast("bigint").alias("child")).agg(F.sum("blocks").alias("weight"))
        dealt = children.withColumn("node", F.floor(F.col("child") / fan_out).cast("bigint")).join(quotas, ["_key", "node"])
        dealt = dealt.withColumnRenamed("quota", "seats").withColumn("limit", MOST * F.col("weight"))
        quotas = apportion(dealt, ["_key", "node"], "child", "weight", "seats", "quota", "limit").select(
            "_key", F.col("child").alias("node"), "quota")
    plan = written(
        shards.join(quotas.withColumnRenamed("node", "shard"), ["_key", "shard"])
        .withColumn("_times", F.expr("quota div blocks")).withColumn("_more", F.expr("quota % blocks"))
        .withColumn("_first", F.pmod(h(seed, F.lit("first"), F.col("_key"), F.col("shard")), F.col("blocks")))
        .select("_key", "shard", "words", "blocks", "_times", "_more", "_first"), "plan")

    # Where a document lies in its shard, and what the chosen blocks cover of it.
    order = Window.partitionBy("_key", "shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    some = placed.where("size > 0").withColumn("_at", F.coalesce(F.sum("size").over(order), F.lit(0))).join(plan, ["_key", "shard"])
    edge = lambda block: F.expr(f"({block}) * words div blocks")
    inside = lambda x: F.greatest(F.lit(0), F.least(F.col("size"), x - F.col("_at")))
    ranges = F.array(
        F.struct(F.lit(0).cast("bigint").alias("begin"), inside(edge("greatest(_first + _more - blocks, 0)")).alias("end")),
        F.struct(inside(edge("_first")).alias("begin"), inside(edge("least(_first + _more, blocks)")).alias("end")),
    )
    cut = some.withColumn("cuts", F.filter(ranges, lambda r: r["end"] > r["begin"]))
    more = F.aggregate("cuts", F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["begin"])
    taken = cut.withColumn("taken", F.col("_times") * F.col("size") + more)
    columns = ["doc_id", "size", "source_size", "target", "taken", F.col("_times").alias("copies"), "cuts", "_carried"]
    none = placed.where("size = 0").select(
        "doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"), F.lit(0).cast("bigint").alias("copies"),
        F.filter(F.array(F.struct(F.lit(0).cast("bigint").alias("begin"), F.lit(0).cast("bigint").alias("end"))), lambda r: r["end"] > r["begin"]).alias("cuts"),
        "_carried")
    return taken.select(*columns).unionByName(none)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, all columns: a row for each whole copy and one for the words cut out.

    Words keep the white space that follows them. Documents that the mix leaves out are gone.
    """
    rows = mix(docs, carry=docs.columns, **options).where("taken > 0")
    text = F.col("_carried.text").cast("string")
    words = F.split(F.regexp_replace(text, f"^[{SEPARATORS}]+", ""), f"(?<=[{SEPARATORS}])(?=[^{SEPARATORS}])")
    parts = F.transform("cuts", lambda r: F.array_join(
        F.slice(words, (r["begin"] + 1).cast("int"), (r["end"] - r["begin"]).cast("int")), ""))
    whole = F.when(F.col("copies") > 0, F.array_repeat(text, F.col("copies").cast("int"))).otherwise(F.array().cast("array<string>"))
    cut = F.when(F.size("cuts") > 0, F.array(F.array_join(parts, " "))).otherwise(F.array().cast("array<string>"))
    out = rows.withColumn("_text", F.explode(F.concat(whole, cut)))
    return out.select(*[
        F.col("_text").alias("text") if c == "text" else F.col(f"_carried.`{c}`").alias(c) for c in docs.columns])
