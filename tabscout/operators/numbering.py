"""Positions and running aggregates that never put a whole group into one task.

A plain window over a group sorts the group in one task. Here a group is cut into buckets that
follow its order; each bucket is numbered by itself and shifted by what the earlier buckets hold.
The input is read twice (sizes, rows): store it first where it is costly (``session.written``).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscout.functions.hashing import HASH_BITS
from tabscout.session import written

BUCKET_ROWS = 1 << 16


def buckets_for(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """A power of two, at least 16, that leaves about ``bucket_rows`` rows or fewer to a bucket."""
    return max(16, 1 << max(0, -(-rows // bucket_rows) - 1).bit_length())


def hash_bucket(hash_col: Column, buckets: int) -> Column:
    """The leading bits of a 60-bit hash: buckets of even size, in the order of the hash."""
    return F.shiftright(hash_col, HASH_BITS - (buckets.bit_length() - 1))


def number_within(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "ord",
    size: str | None = None,
) -> DataFrame:
    """Zero-based position of each row in its group, by (bucket, order).

    ``bucket`` must not decrease along ``order``. With no keys the whole table is numbered; the
    only unpartitioned window then runs over one row per bucket. ``size`` names a column for the
    number of rows of the group. Rows and offsets are merged: the rows are dealt and sorted for the
    window already, and Catalyst takes what a Python reader puts out for small enough to broadcast.
    """
    keys = list(keys)
    marked = df.withColumn("_bucket", bucket)
    sizes = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    total = [F.sum("_n").over(Window.partitionBy(*keys)).alias(size)] if size else []
    offsets = sizes.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *total
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        marked.withColumn("_rn", F.row_number().over(inside)).hint("merge")
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_rn") - 1).cast("bigint"))
        .drop("_bucket", "_rn", "_before")
    )


def number_sorted(
    df: DataFrame, order: Sequence[Column], name: str = "ord", partitions: int | None = None
) -> DataFrame:
    """Zero-based position of each row in a global order over arbitrary, maybe hot, sort keys.

    Range partitioning follows sampled bounds, so the sorted rows are stored once, each with its place;
    counts and rows then come from the same files. There is one offset per partition, sent to all tasks.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        written(
            df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()),
            "sorted")
        .withColumn("_part", F.shiftright("_mid", 33))
        .withColumn("_rn", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_rn")).cast("bigint"))
        .drop("_mid", "_part", "_rn", "_before")
    )


_AGG = {"min": F.min, "max": F.max, "sum": F.sum}
_MERGE = {
    "min": F.least,
    "max": F.greatest,
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
}


def running(
    df: DataFrame, keys: Sequence[str], position: str, value: str, how: str, name: str,
    inclusive: bool = True, block_rows: int = 65536,
) -> DataFrame:
    """Running min, max or sum of ``value`` along ``position`` inside each group."""
    keys = list(keys)
    blocked = df.withColumn("_block", F.floor(F.col(position) / block_rows))
    agg, merge = _AGG[how], _MERGE[how]
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        blocked.groupBy(*keys, "_block").agg(agg(value).alias("_all"))
        .select(*keys, "_block", agg("_all").over(before).alias("_earlier"))
    )
    upto = (
        Window.partitionBy(*keys, "_block").orderBy(position)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    return (
        blocked.withColumn("_local", agg(value).over(upto))
        .join(earlier, [*keys, "_block"])
        .withColumn(name, merge(F.col("_local"), F.col("_earlier")))
        .drop("_block", "_local", "_earlier")
    )
