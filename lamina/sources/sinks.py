"""Result tables on disk.  Spark's commit protocol makes them appear whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import batch_stats, cohort


def write_lesions(lesions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Full table as Parquet, rounded rows and mean metrics as CSV, by section."""
    lesions.write.mode(mode).partitionBy("section_id").parquet(f"{path}/lesions")
    cohort.summary_rows(lesions).write.mode(mode).partitionBy("section_id").option("header", True).csv(f"{path}/lesion_summary")
    cohort.fence_means(lesions, ["section_id"]).write.mode(mode).option("header", True).csv(f"{path}/mean_metrics")


def write_batch(lesions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Slide, lesion, file and overall tables of a batch; ``lesions`` has filename and lesion_id."""
    named = batch_stats.with_slide(lesions)
    csv = {
        "slide_metrics": batch_stats.group_metrics(named, ["slide_name"]),
        "individual_lesions": named,
        "file_metrics": batch_stats.group_metrics(named, ["filename"]),
        "overall_summary_csv": batch_stats.file_summary(named),
    }
    for name, df in csv.items():
        df.write.mode(mode).option("header", True).csv(f"{path}/{name}")
    batch_stats.file_summary(named).write.mode(mode).json(f"{path}/overall_summary")


def write_per_file(lesions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lesions and statistics partitioned by file, and the master summary."""
    lesions.write.mode(mode).partitionBy("filename").option("header", True).csv(f"{path}/file_lesions")
    stats = batch_stats.group_metrics(lesions, ["filename"])
    stats.write.mode(mode).partitionBy("filename").json(f"{path}/file_statistics")
    stats.write.mode(mode).option("header", True).csv(f"{path}/master_file_summary")
    batch_stats.file_summary(lesions).write.mode(mode).json(f"{path}/overall_means")


def long_form(wide: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, metric, value`` of every other column."""
    rest = [F.col(c).cast("double").alias(c) for c in wide.columns if c not in keys]
    return wide.select(*keys, *rest).unpivot(keys, [c for c in wide.columns if c not in keys], "metric", "value")


def write_evaluation(summary: DataFrame, pairs: DataFrame, keys: list[str], path: str, mode: str = "overwrite") -> None:
    long_form(summary, keys).write.mode(mode).option("header", True).csv(f"{path}/summary")
    pairs.write.mode(mode).option("header", True).csv(f"{path}/lesion_pairs")


def write_ranking(rows: DataFrame, ranked: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-image rows as JSON; the ranked models, one row each, as a single ordered CSV."""
    rows.write.mode(mode).json(f"{path}/per_image_metrics")
    ranked.coalesce(1).sortWithinPartitions("rank").write.mode(mode).option("header", True).csv(f"{path}/model_ranking")
