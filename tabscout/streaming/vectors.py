"""Incremental ingest of vector files through a file stream."""
from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tabscout.schemas import VECTOR_SCHEMA
from tabscout.sources.store import append_new


def ingest_vectors(
    spark: SparkSession, incoming: str, collection: str, progress: str, schema: str = VECTOR_SCHEMA,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Append the points of new Parquet files to a collection, skipping ids it already holds.

    A batch that is run again after a failure adds nothing, so each point is stored once.
    """
    points = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
    return (
        points.writeStream.foreachBatch(lambda batch, _: append_new(batch, collection))
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
