"""Epoch logs: running best, patience and early stop."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabscout.operators.numbering import running
from tabscout.session import written


def progress(
    log: DataFrame, run: str = "run", epoch: str = "epoch", loss: str = "val_loss", patience: int = 5,
    block_rows: int = 65536,
) -> DataFrame:
    """Adds best_before, improved, best_val_loss, waited, perplexity and stop_here.

    ``waited`` counts the epochs since the last strict improvement. A run of any length is handled
    in blocks.
    """
    args = dict(keys=[run], position=epoch, block_rows=block_rows)
    best = running(log, value=loss, how="min", name="best_before", inclusive=False, **args)
    marked = best.withColumn(
        "improved", F.col("best_before").isNull() | (F.col(loss) < F.col("best_before"))
    ).withColumn("_at", F.when(F.col("improved"), F.col(epoch)))
    last = running(written(marked, "epochs"), value="_at", how="max", name="_last", **args).drop("_at")
    return (
        last.withColumn("best_val_loss", F.least("best_before", loss))
        .withColumn("waited", (F.col(epoch) - F.col("_last")).cast("bigint")).drop("_last")
        .withColumn("perplexity", F.exp(F.least(F.col(loss), F.lit(30.0))))
        .withColumn("stop_here", F.col("waited") >= patience)
    )


def early_stop(progressed: DataFrame, run: str = "run", epoch: str = "epoch", block_rows: int = 65536) -> DataFrame:
    """Epochs up to each run's first stop, the stopping one flagged."""
    flagged = written(progressed.withColumn("_flag", F.col("stop_here").cast("int")), "progress")
    passed = running(flagged, [run], epoch, "_flag", "max", "_passed", inclusive=False, block_rows=block_rows)
    return (
        passed.filter(F.coalesce("_passed", F.lit(0)) == 0)
        .withColumn("early_stopped", F.col("stop_here")).drop("_flag", "_passed")
    )


def run_summary(stopped: DataFrame, run: str = "run", epoch: str = "epoch") -> DataFrame:
    return stopped.groupBy(run).agg(
        F.max(epoch).alias("epochs"), F.min("best_val_loss").alias("best_val_loss"),
        F.max("early_stopped").alias("early_stopped"),
    )
