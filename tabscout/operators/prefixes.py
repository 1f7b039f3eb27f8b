"""Membership by name prefix, as equi-joins on the prefixes a name has."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabscout.session import written


def prefix_join(names: DataFrame, databases: DataFrame, name: str = "name", db: str = "db") -> DataFrame:
    """Every database whose name starts the table name (all of them, also prefixes of prefixes).

    Only prefixes as long as some database name are tried; there are as many such lengths as
    distinct lengths of names.
    """
    lengths = databases.agg(F.array_sort(F.collect_set(F.length(db)))).scalar()
    tried = (
        names.withColumn("_lens", lengths)
        .withColumn("_len", F.explode(F.filter("_lens", lambda n: n <= F.length(name))))
        .withColumn(db, F.left(name, F.col("_len"))).drop("_lens", "_len")
    )
    # stored, so that both sides of the join are plain shuffles and a hot prefix can be split
    return tried.join(written(databases.select(db).distinct(), "prefixes"), db)


def longest_prefix(names: DataFrame, databases: DataFrame, name: str = "name", db: str = "db") -> DataFrame:
    """The longest known database that ends before an underscore of the name, or null.

    Hyphens count as underscores on both sides.
    """
    key = lambda c: F.replace(F.col(c), F.lit("-"), F.lit("_"))
    parts = F.split(key(name), "_")
    heads = F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "_")),
    )
    known = written(databases.select(F.col(db), key(db).alias("_key")).distinct(), "prefixes")
    found = (
        names.select(name, F.explode(heads).alias("_key")).join(known, "_key")
        .groupBy(name).agg(F.max_by(db, F.struct(F.length("_key"), F.col(db))).alias(db))
    )
    return names.join(found, name, "left")
