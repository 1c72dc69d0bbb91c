"""Ordered logs of training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ordered import last_marked, minimum_before

EPOCHS_PER_BUCKET = 10_000


def early_stopping(history: DataFrame, run: str = "run", patience: int = 10, carried_best: float | None = None) -> DataFrame:
    """Adds best loss, best epoch, epochs without improvement and the stop mark.

    ``history`` has ``epoch`` (1, 2, ...) and ``val_loss``.  An epoch improves
    only if it is strictly below all earlier ones and below a carried best.
    """
    bucket = F.floor(F.col("epoch") / EPOCHS_PER_BUCKET)
    seen = minimum_before(history, [run], ["epoch"], "val_loss", bucket, "_earlier")
    bar = F.least("_earlier", F.lit(carried_best)) if carried_best is not None else F.col("_earlier")
    marked = seen.withColumn("improved", bar.isNull() | (F.col("val_loss") < bar)).withColumn(
        "best_loss", F.least(bar, F.col("val_loss")))
    marked = marked.withColumn("_mark", F.when(F.col("improved"), F.col("epoch")))
    out = last_marked(marked, [run], ["epoch"], "_mark", bucket, "best_epoch")
    stale = (F.col("epoch") - F.coalesce("best_epoch", F.lit(0))).cast("int")
    return out.withColumn("epochs_no_improve", stale).drop("_mark", "_earlier")


def stop_epoch(state: DataFrame, run: str = "run", patience: int = 10) -> DataFrame:
    """First epoch at which the patience is used up, per run; null if it never is."""
    return state.groupBy(run).agg(F.min(F.when(F.col("epochs_no_improve") >= patience, F.col("epoch"))).alias("stop_epoch"))


def running_batch_means(batches: DataFrame, run: str, order: list[str], rows: int = 20) -> DataFrame:
    """Mean loss and accuracy of the last ``rows`` batches of the epoch; a partition is one epoch."""
    w = Window.partitionBy(run, "epoch").orderBy(*order).rowsBetween(-(rows - 1), 0)
    return batches.withColumn("running_loss", F.avg("loss").over(w)).withColumn(
        "running_accuracy", F.avg(F.col("correct") / F.col("pixels")).over(w))


def epoch_metrics(batches: DataFrame, run: str) -> DataFrame:
    """Mean loss over batches and share of correct pixels, summed over all ranks."""
    return batches.groupBy(run, "epoch").agg(
        (F.sum("loss") / F.count("*")).alias("loss"),
        F.coalesce(F.try_divide(F.sum("correct"), F.sum("pixels")), F.lit(0.0)).alias("accuracy"))
