"""Scores of predicted against reference masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.fixed import CLASS_NAMES, N_CLASSES
from ..session import materialize
from . import blocks
from .blocks import BLOCK, Tile, block_map


def paired(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """One row per pixel of both masks with ``gt`` and ``pred`` class.

    Grouped, not joined: masks that are dealt by section meet where they are,
    and no mask is ever small enough in Spark's eyes to be sent to all.
    """
    at = [*keys, "y", "x"]
    none = F.lit(None).cast("int")
    both = gt.select(*at, F.col("cls").alias("gt"), none.alias("pred")).unionByName(pred.select(*at, none.alias("gt"), F.col("cls").alias("pred")))
    return both.groupBy(*at).agg(F.max("gt").alias("gt"), F.max("pred").alias("pred")).where("gt is not null and pred is not null")


def confusion(pairs: DataFrame, keys: list[str], n: int = N_CLASSES) -> DataFrame:
    """Long matrix with every cell: counts and shares of the reference row."""
    # read twice below: written once, so that the pixels are paired once
    counts = materialize(pairs.groupBy(*keys, "gt", "pred").agg(F.count("*").alias("n")))
    classes = F.sequence(F.lit(0), F.lit(n - 1))
    groups = counts.select(*keys).distinct() if keys else pairs.sparkSession.range(1).select()
    frame = groups.withColumn("gt", F.explode(classes)).withColumn("pred", F.explode(classes))
    full = frame.join(counts, [*keys, "gt", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*keys, "gt"))  # n rows per window
    return full.withColumn("row_share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def class_metrics(matrix: DataFrame, keys: list[str], n: int = N_CLASSES) -> DataFrame:
    """IoU, Dice, precision and recall per class; null where undefined."""
    c = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hits = (
        matrix.select(*keys, "gt", "pred", "n", c.alias("cls"))
        .groupBy(*keys, "cls").agg(
            F.sum(F.when((F.col("gt") == F.col("cls")) & (F.col("pred") == F.col("cls")), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when((F.col("gt") != F.col("cls")) & (F.col("pred") == F.col("cls")), F.col("n")).otherwise(0)).alias("fp"),
            F.sum(F.when((F.col("gt") == F.col("cls")) & (F.col("pred") != F.col("cls")), F.col("n")).otherwise(0)).alias("fn"))
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return hits.select(
        *keys, "cls", "tp", "fp", "fn",
        F.try_divide(tp, tp + fp + fn).alias("iou"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("dice"),
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))


def overall_metrics(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, mean IoU with and without background, IoU weighted by reference pixels."""
    m = class_metrics(matrix, keys)
    weight = F.col("tp") + F.col("fn")
    return m.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum("tp"), F.sum(weight)), F.lit(0.0)).alias("pixel_accuracy"),
        F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou_all"),
        F.coalesce(F.avg(F.when(F.col("cls") > 0, F.col("iou"))), F.lit(0.0)).alias("mean_iou_fg"),
        F.coalesce(F.try_divide(F.sum(weight * F.col("iou")), F.sum(weight)), F.lit(0.0)).alias("weighted_iou"))


def image_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per image: IoU, Dice and reference share per class; means over classes present in the reference."""
    m = class_metrics(confusion(pairs, keys), keys)
    gsum = F.col("tp") + F.col("fn")
    present = gsum > 0
    lesion = present & (F.col("cls") >= 2)
    size = F.sum(gsum)
    per_class = []
    for c, name in enumerate(CLASS_NAMES):
        at = F.col("cls") == c
        per_class += [F.max(F.when(at, F.col("iou"))).alias(f"iou_{name.lower()}"),
                      F.max(F.when(at, F.col("dice"))).alias(f"dice_{name.lower()}"),
                      (F.sum(F.when(at, gsum)) / size).alias(f"gt_frac_{name.lower()}")]
    return m.groupBy(*keys).agg(
        *per_class, (F.sum("tp") / size).alias("pixel_acc"),
        F.avg(F.when(present, F.col("iou"))).alias("mean_iou"), F.avg(F.when(present, F.col("dice"))).alias("mean_dice"),
        F.avg(F.when(lesion, F.col("iou"))).alias("lesion_iou"), F.avg(F.when(lesion, F.col("dice"))).alias("lesion_dice"))


def macro_dice(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Mean Dice over classes of a pooled matrix."""
    return class_metrics(matrix, keys).groupBy(*keys).agg(F.avg("dice").alias("macro_dice"))


def boundary_metrics(pairs: DataFrame, keys: list[str], tolerances=(1, 3, 5), block: int = BLOCK) -> DataFrame:
    """Boundary precision, recall and F1 per tolerance: both masks travel to a block once."""
    reach = max(tolerances)
    ring = blocks.ellipse(3)
    discs = {t: blocks.ellipse(2 * t + 1) for t in tolerances}

    def fn(tile: Tile):
        def boundary(name):
            cls = tile[name].astype("int16")
            return tile.present & (blocks.extreme(cls, tile.present, ring, True) != blocks.extreme(cls, tile.present, ring, False))

        gt, pred = boundary("gt"), boundary("pred")
        out = {"gt_b": gt, "pred_b": pred}
        for t in tolerances:
            out[f"p{t}"] = pred & blocks.dilate(gt, tile.present, discs[t])
            out[f"r{t}"] = gt & blocks.dilate(pred, tile.present, discs[t])
        return gt | pred, out

    kinds = {"gt_b": "boolean", "pred_b": "boolean"}
    for t in tolerances:
        kinds |= {f"p{t}": "boolean", f"r{t}": "boolean"}
    hits = block_map(pairs, keys, ["gt", "pred"], reach + 1, fn, kinds, block)
    counts = hits.groupBy(*keys).agg(*[F.count_if(F.col(k)).alias(k) for k in kinds])
    counts = pairs.select(*keys).distinct().join(counts, keys, "left").fillna(0)
    tol = F.explode(F.array(*[
        F.struct(F.lit(t).alias("tol"), F.col(f"p{t}").alias("p"), F.col(f"r{t}").alias("r")) for t in tolerances]))
    scored = counts.select(*keys, "gt_b", "pred_b", tol.alias("t")).select(
        *keys, "t.tol", F.coalesce(F.try_divide("t.p", "pred_b"), F.lit(0.0)).alias("boundary_precision"),
        F.coalesce(F.try_divide("t.r", "gt_b"), F.lit(0.0)).alias("boundary_recall"))
    p, r = F.col("boundary_precision"), F.col("boundary_recall")
    return scored.withColumn("boundary_f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def _known(col: str):
    return F.when(~F.isnan(F.col(col).cast("double")), F.col(col))


def model_ranking(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric per model over scored images, ranked by mean Dice, models without one last."""
    means = rows.where("error is null").groupBy("model").agg(
        F.count("*").alias("n_images"), *[F.avg(_known(m)).alias(m) for m in metrics])
    # one row per model; the rank is over that small table
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("mean_dice"), "model"))
    return means.withColumn("rank", rank)


def report_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric, and how many images were scored."""
    scored = F.col("error").isNull()
    return rows.agg(
        F.count("*").alias("n_images"), F.count_if(scored).alias("n_scored"),
        *[e for m in metrics for e in (
            F.avg(F.when(scored, _known(m))).alias(f"{m}_mean"), F.stddev_pop(F.when(scored, _known(m))).alias(f"{m}_std"))])


def method_comparison(pairs: DataFrame, image_keys: list[str]) -> DataFrame:
    """Mean image scores per ``method``, best lesion Dice first."""
    shown = ["pixel_acc", "mean_iou", "mean_dice", "lesion_iou", "lesion_dice", "iou_coagulation", "iou_ablation"]
    return (
        image_metrics(pairs, ["method", *image_keys])
        .groupBy("method").agg(F.count("*").alias("n_images"), *[F.avg(c).alias(c) for c in shown])
        .orderBy(F.desc_nulls_last("lesion_dice"))
    )
