"""A vector collection that skips stored ids without scanning them, for any number of writers.

    <path>/points/version=V/dataset=D/model=M/bucket=B/*.parquet
    <path>/ids/version=V/*.parquet      which hashes each bucket holds, a few kilobytes a bucket
    <path>/commits/<number>             holds the name of the version that this commit adds

A bucket is the first hex digits of ``point_id``. A batch is first held against the bits of the ids
stored in its buckets: an id whose bit is not set is new for certain. Only buckets in which some bit is
set are read, and only their ids.

A version counts once its commit file exists. A writer takes the next number if nobody else has it; who comes second looks at what was added since in the buckets of the batch, drops ids that are there
by now, and tries the next number. Two overlapping appends leave each id once. A writer that dies before
its commit leaves a version nobody reads.
"""
from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabscout.schemas import VECTOR_SCHEMA
from tabscout.session import written
from tabscout.sources.store import PARTS

DIGITS = 1  # 16 buckets a collection; take 2 or 3 for collections of many millions of points
BITS = 20  # of the hash that tells ids apart inside a bucket
KEYS = [*PARTS, "bucket"]


def bucket_of(digits: int = DIGITS) -> Column:
    return F.substring("point_id", 1, digits)


def _bit() -> Column:
    return F.xxhash64("point_id").bitwiseAND(F.lit((1 << BITS) - 1)) + 1  # bitmap functions count from 1


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, path: str) -> list[str]:
    """Versions in the order of their commits."""
    fs, at = _fs(spark, f"{path}/commits")
    if not fs.exists(at):
        return []
    found = spark.read.text(f"{path}/commits").select(F.col("_metadata.file_name").alias("number"), "value").collect()  # a row per commit
    return [r.value for r in sorted(found)]


def claim(spark: SparkSession, path: str, number: int, version: str) -> bool:
    """Adds the commit of that number, unless another writer has added it.

    The file is complete before it gets its name, and naming never replaces: a link on a local file
    system, a rename elsewhere (which HDFS refuses if the name is taken).
    """
    fs, target = _fs(spark, f"{path}/commits/{number:012d}")
    _, made = _fs(spark, f"{path}/attempts/{version}")
    fs.mkdirs(target.getParent())
    out = fs.create(made, True)
    out.write(bytearray(version.encode()))
    out.close()
    if fs.getUri().getScheme() != "file":
        return bool(fs.rename(made, target))
    try:
        os.link(unquote(urlparse(str(made)).path), unquote(urlparse(str(target)).path))
    except FileExistsError:
        return False
    return True


def _read(spark: SparkSession, path: str, kind: str, versions: list[str]) -> DataFrame:
    root = f"{path}/{kind}"
    return spark.read.option("basePath", root).parquet(*[f"{root}/version={v}" for v in versions])


def stored_ids(spark: SparkSession, path: str, versions: list[str], buckets: list[tuple]) -> DataFrame:
    """Ids of the given (dataset, model, bucket) folders in those versions; other folders are not opened."""
    wanted = F.lit(False)
    for values in buckets:
        here = F.lit(True)
        for key, value in zip(KEYS, values):
            here = here & (F.col(key) == value)
        wanted = wanted | here
    # partition values are text, whatever they look like
    text = spark.read.schema("point_id string, version string, dataset string, model string, bucket string")
    root = f"{path}/points"
    return text.option("basePath", root).parquet(*[f"{root}/version={v}" for v in versions]).where(wanted).select(*KEYS, "point_id")


def maybe_stored(batch: DataFrame, path: str, versions: list[str]) -> DataFrame:
    """Rows of ``batch`` whose id has its bit set in some version."""
    bits = _read(batch.sparkSession, path, "ids", versions).select(*KEYS, "part", "bits")
    asked = batch.withColumn("part", F.bitmap_bucket_number(_bit()))
    place = F.bitmap_bit_position(_bit())
    byte = F.conv(F.hex(F.substring("bits", (F.call_function("div", place, F.lit(8)) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    merged = bits.groupBy(*KEYS, "part").agg(F.call_function("bitmap_or_agg", F.col("bits")).alias("bits"))
    return asked.join(merged, [*KEYS, "part"]).where(is_set).drop("part", "bits")


def _without_stored(batch: DataFrame, path: str, versions: list[str]) -> DataFrame:
    if not versions:
        return batch
    maybe = written(maybe_stored(batch, path, versions).select(*KEYS, "point_id"), "maybe")
    buckets = [tuple(r) for r in maybe.select(*KEYS).distinct().collect()]  # folders: collections x 16^digits
    if not buckets:
        return batch
    there = stored_ids(batch.sparkSession, path, versions, buckets).join(maybe, [*KEYS, "point_id"], "left_semi")
    return batch.join(there, [*KEYS, "point_id"], "left_anti")


def _stage(batch: DataFrame, path: str) -> str:
    """Writes a version that no reader sees yet."""
    version = uuid.uuid4().hex
    batch.repartition(*KEYS).write.partitionBy(*KEYS).parquet(f"{path}/points/version={version}")
    ids = batch.select(*KEYS, F.bitmap_bucket_number(_bit()).alias("part"), F.bitmap_bit_position(_bit()).alias("place"))
    ids.groupBy(*KEYS, "part").agg(F.call_function("bitmap_construct_agg", F.col("place")).alias("bits")).write.parquet(f"{path}/ids/version={version}")
    return version


def append(points: DataFrame, path: str, digits: int = DIGITS, before_commit=None) -> str | None:
    """Adds the points whose id is not stored, each once; the version added, None if all are there.

    ``digits`` must be the same for all writers of a path. ``before_commit`` is called once the first
    attempt is staged (for tests).
    """
    spark = points.sparkSession
    known = committed(spark, path)
    batch = written(points.dropDuplicates([*PARTS, "point_id"]).withColumn("bucket", bucket_of(digits)), "batch")
    fresh = written(_without_stored(batch, path, known), "fresh")
    while not fresh.isEmpty():
        version = _stage(fresh, path)
        if before_commit:
            before_commit()
            before_commit = None
        if claim(spark, path, len(known), version):
            return version
        now = committed(spark, path)
        fresh = written(_without_stored(fresh, path, now[len(known):]), "fresh")
        known = now
    return None


def read(spark: SparkSession, path: str, schema: str = VECTOR_SCHEMA) -> DataFrame:
    """All committed points."""
    versions = committed(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    root = f"{path}/points"
    found = spark.read.schema(f"{schema}, version string, bucket string").option("basePath", root).parquet(*[f"{root}/version={v}" for v in versions])
    return found.drop("version", "bucket")
