"""All pending (dataset, model) combinations as index jobs, kept track of in an append-only ledger.

A row of the ledger is an event of one combination: claimed, done (with its run record) or failed (with
the reason). What a combination's last event says is its state: done ones are left alone, failed ones and
those claimed by a job that never came back are taken up again. One that fails does not stop the rest.
"""
from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabscout.plans import index_job
from tabscout.schemas import RUN_METRICS_SCHEMA
from tabscout.sources.run_files import write_json

_EVENT = "dataset string, model string, event string, reason string, job string, at double"
LEDGER_SCHEMA = f"{_EVENT}, record struct<{', '.join(c.replace(' ', ': ', 1) for c in RUN_METRICS_SCHEMA.split(', '))}>"
KEYS = ["dataset", "model"]

Encoder = Callable[[Column], Column]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER_SCHEMA).json(path)
    except AnalysisException as missing:  # no job has run yet
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def _note(spark: SparkSession, path: str, dataset: str, model: str, event: str, job: str, reason: str | None = None,
          record: DataFrame | None = None) -> None:
    one = record if record is not None else spark.range(1)
    fields = [c.split()[0] for c in RUN_METRICS_SCHEMA.split(", ")]
    kept = F.struct(*[F.col(c) for c in fields if c in one.columns]) if record is not None else F.lit(None).cast("struct<dataset: string>")
    row = one.select(
        F.lit(dataset).alias("dataset"), F.lit(model).alias("model"), F.lit(event).alias("event"), F.lit(reason).cast("string").alias("reason"),
        F.lit(job).alias("job"), F.lit(time.time()).alias("at"), kept.alias("record"))
    row.coalesce(1).write.mode("append").json(path)


def states(ledger: DataFrame) -> DataFrame:
    """The last event of every combination."""
    last = F.max_by(F.struct("event", "reason", "job", "record"), F.struct("at", F.col("event") != "claimed"))
    return ledger.groupBy(*KEYS).agg(last.alias("_e"), F.count_if(F.col("event") == "claimed").alias("attempts")).select(*KEYS, "_e.*", "attempts")


def run_pending(
    spark: SparkSession, ledger: str, datasets: Mapping[str, DataFrame], models: Mapping[str, Encoder], path: str,
    skip: Sequence[str] = (), job: str = "job",
) -> DataFrame:
    """Runs what is open and returns the events of this job, in the order of the combinations.

    ``datasets`` maps names to documents(database_name, table_id, table), ``models`` names to encoders.
    """
    done = {(r.dataset, r.model) for r in states(read_ledger(spark, ledger)).where("event = 'done'").collect()}  # one row per combination
    for dataset, documents in datasets.items():
        for model, encoder in models.items():
            if model in skip or (dataset, model) in done:
                continue
            _note(spark, ledger, dataset, model, "claimed", job)
            try:
                record = index_job.build_index(documents, dataset, model, path, encoder)
                _note(spark, ledger, dataset, model, "done", job, record=record)
            except Exception as failed:  # the reason is kept, the other combinations go on
                _note(spark, ledger, dataset, model, "failed", job, reason=str(failed).strip().splitlines()[0][:500])
    return read_ledger(spark, ledger).where(F.col("job") == job)


def combinations(spark: SparkSession, ledger: str, datasets: Sequence[str], models: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """Every combination with its state: done, failed, claimed, skipped model or to run."""
    grid = spark.createDataFrame([(d, m) for d in datasets for m in models], "dataset string, model string")
    now = states(read_ledger(spark, ledger))
    state = F.when(F.col("model").isin(list(skip)), "skipped model").otherwise(F.coalesce("event", F.lit("to run")))
    return grid.join(now, KEYS, "left").select(
        *KEYS, state.alias("state"), "reason", F.coalesce("attempts", F.lit(0)).alias("attempts"), "record.embeddings_count",
        "record.skipped_tables", "record.embedding_dimension")


def summary(combos: DataFrame) -> DataFrame:
    """Combinations wanted, completed and failed, and what they made, as one row."""
    wanted = combos.where("state <> 'skipped model'")
    return wanted.agg(
        F.count(F.lit(1)).alias("total_combinations"), F.count_if(F.col("state") == "done").alias("completed"),
        F.count_if(F.col("state") != "done").alias("failed"), F.coalesce(F.sum("embeddings_count"), F.lit(0)).alias("embeddings"),
        F.array_sort(F.collect_list(F.struct("dataset", "model", (F.col("state") == "done").alias("success"), F.col("reason").alias("error")))).alias("results"),
    )


def write_summary(combos: DataFrame, path: str) -> None:
    write_json(summary(combos).withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).coalesce(1), path)
