"""Vector collections as Parquet, partitioned by dataset and model."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscout.schemas import VECTOR_SCHEMA

PARTS = ["dataset", "model"]


def last_by_id(points: DataFrame, order: str, keys: tuple[str, ...] = ("dataset", "model", "point_id")) -> DataFrame:
    """One row per point, the last by ``order``; found by aggregation, so a hot id is reduced early."""
    rest = [c for c in points.columns if c not in keys and c != order]
    return points.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_p")).select(*keys, "_p.*")


def overwrite_collections(df: DataFrame, path: str, parts: list[str] = PARTS) -> None:
    """Replace the partitions present in ``df`` and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_vectors(points: DataFrame, path: str, order: str) -> None:
    """Recreate the collections in ``points``; of a repeated id the last row wins."""
    overwrite_collections(last_by_id(points, order), path)


def read_vectors(spark: SparkSession, path: str, schema: str = VECTOR_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def new_points(points: DataFrame, stored: DataFrame) -> DataFrame:
    """Points whose id is not stored yet, each id once."""
    ids = stored.select(*PARTS, "point_id")
    return points.dropDuplicates([*PARTS, "point_id"]).join(ids, [*PARTS, "point_id"], "left_anti")


def stored_for(points: DataFrame, path: str) -> DataFrame:
    """Stored rows of the collections that ``points`` names; none if nothing is stored yet."""
    try:
        stored = points.sparkSession.read.parquet(path)
    except AnalysisException as missing:  # first batch: there is no collection yet
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return points.limit(0)
    named = points.select(*PARTS).distinct().collect()  # a row per collection, which are folders
    wanted = F.lit(False)
    for row in named:
        wanted = wanted | ((F.col(PARTS[0]) == row[0]) & (F.col(PARTS[1]) == row[1]))
    return stored.where(wanted)


def append_new(points: DataFrame, path: str) -> None:
    """Idempotent append: ids already stored are skipped.

    Only id columns of the collections named in the batch are scanned.
    """
    new_points(points, stored_for(points, path)).write.mode("append").partitionBy(*PARTS).parquet(path)
