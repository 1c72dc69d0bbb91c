"""Statistics per slide, file and data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.frames import beside
from ..functions.ids import slide_of_file
from ..functions.ordered import number_in_order
from ..functions.quantiles import exact_quantiles
from .cohort import bin_of

MEASURES = ["ablation_diameter_um", "coagulation_width_um", "lesion_diameter_um", "ablation_area_um2", "coagulation_area_um2"]


def with_slide(lesions: DataFrame) -> DataFrame:
    return lesions.withColumn("slide_name", slide_of_file(F.col("filename")))


def _aggregates():
    out = []
    for m in MEASURES:
        out += [F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}")]
    return out + [F.sum(m).alias(f"total_{m}") for m in MEASURES if m.endswith("um2")]


def group_metrics(lesions: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean and population deviation of the measures, total areas."""
    return lesions.groupBy(*keys).agg(F.count("*").alias("num_lesions"), *_aggregates())


def all_levels(lesions: DataFrame) -> DataFrame:
    """Slides, files and the data set in one pass."""
    return lesions.groupingSets([[F.col("slide_name")], [F.col("filename")], []], F.col("slide_name"), F.col("filename")).agg(
        F.grouping_id("slide_name", "filename").alias("level"), F.count("*").alias("num_lesions"), *_aggregates())


def dataset_metrics(lesions: DataFrame) -> DataFrame:
    """The whole data set, with medians of the first three measures."""
    # the distinct slides are counted from their groups, not inside the wide aggregate
    slides = lesions.select("slide_name").distinct().agg(F.count("*").alias("total_images_processed"))
    frames = [slides, lesions.agg(F.count("*").alias("total_lesions_detected"), *_aggregates())]
    frames += [exact_quantiles(lesions, [], m, {f"median_{m}": 0.5}) for m in MEASURES[:3]]
    out = frames[0]
    for frame in frames[1:]:
        out = beside(out, frame)
    return out


def slide_summary(lesions: DataFrame) -> DataFrame:
    return group_metrics(lesions, ["slide_name"]).agg(
        F.count("*").alias("num_slides"),
        F.avg("mean_ablation_diameter_um").alias("mean_ablation_diameter_across_slides_um"),
        F.stddev_pop("mean_ablation_diameter_um").alias("std_ablation_diameter_across_slides_um"),
        F.avg("mean_coagulation_width_um").alias("mean_coagulation_width_across_slides_um"),
        F.stddev_pop("mean_coagulation_width_um").alias("std_coagulation_width_across_slides_um"),
        F.avg("num_lesions").alias("lesions_per_slide_mean"), F.stddev_pop("num_lesions").alias("lesions_per_slide_std"))


def file_summary(lesions: DataFrame) -> DataFrame:
    spread = []
    for m in MEASURES[:3]:
        name = m.removesuffix("_um")
        spread += [F.avg(f"mean_{m}").alias(f"mean_{name}_across_files_um"),
                   F.stddev_pop(f"mean_{m}").alias(f"std_{name}_across_files_um")]
    return group_metrics(lesions, ["filename"]).agg(
        F.count("*").alias("total_files_processed"), F.sum("num_lesions").alias("total_lesions_all_files"), *spread,
        F.avg("num_lesions").alias("mean_lesions_per_file"), F.stddev_pop("num_lesions").alias("std_lesions_per_file"),
        F.sum("total_ablation_area_um2").alias("total_ablation_area_all_files_um2"),
        F.sum("total_coagulation_area_um2").alias("total_coagulation_area_all_files_um2"))


def lesion_ids(lesions: DataFrame, group: str, order: list, bucket) -> DataFrame:
    """``<group>_lesion_<i>`` in the given order."""
    numbered = number_in_order(lesions, [group], order, bucket, "_i")
    base = F.regexp_replace(F.col(group), r"\.tif$", "")
    return numbered.withColumn("lesion_id", F.concat(base, F.lit("_lesion_"), F.col("_i"))).drop("_i")


def file_means(lesions: DataFrame, files: DataFrame) -> DataFrame:
    """Means per listed file, zeros for files without lesions."""
    shown = [m for m in MEASURES if m != "lesion_diameter_um"]
    stats = lesions.groupBy("filename").agg(
        F.count("*").alias("lesion_count"), *[F.avg(m).alias(f"mean_{m}") for m in shown],
        F.sum("ablation_area_um2").alias("total_ablation_area_um2"))
    return files.join(stats, "filename", "left").fillna(0).orderBy("filename")


def _long(lesions: DataFrame, measures: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])
    return lesions.select(F.explode(pairs).alias("p")).select("p.measure", "p.v").where("v is not null")


def histograms(lesions: DataFrame, measures: list[str], n_bins: int = 30) -> DataFrame:
    """Equal bins over [min, max] per measure, the last closed, with the mean."""
    values = _long(lesions, measures)
    extent = values.groupBy("measure").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"))
    counts = (
        values.join(extent, "measure")
        .select("measure", bin_of(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo"), n_bins).alias("bin"))
        .groupBy("measure", "bin").agg(F.count("*").alias("n"))
    )
    step = (F.col("hi") - F.col("lo")) / n_bins
    frame = extent.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return frame.join(counts, ["measure", "bin"], "left").select(
        "measure", "bin", (F.col("lo") + F.col("bin") * step).alias("bin_from"),
        F.when(F.col("bin") == n_bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * step).alias("bin_to"),
        F.coalesce("n", F.lit(0)).alias("n"), "mean")


def box_numbers(lesions: DataFrame, measures: list[str]) -> DataFrame:
    """Quartiles, whiskers within 1.5 quartile ranges, and the number beyond."""
    values = _long(lesions, measures)
    # a row per measure: sent to all, so that a task never holds all values of a measure
    q = F.broadcast(exact_quantiles(values, ["measure"], "v", {"q1": 0.25, "med": 0.5, "q3": 0.75}, few=True))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    low, high = F.col("v") >= F.col("q1") - reach, F.col("v") <= F.col("q3") + reach
    return values.join(q, "measure").groupBy("measure", "q1", "med", "q3").agg(
        F.min(F.when(low, F.col("v"))).alias("whisker_low"), F.max(F.when(high, F.col("v"))).alias("whisker_high"),
        F.count_if(~(low & high)).alias("n_outliers"))


def correlations(lesions: DataFrame, measures: list[str]) -> DataFrame:
    """Pearson matrix in long form from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(measures) for b in measures[i:]]
    row = lesions.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{x}|{y}`").alias("r"))
        for x, y in pairs for a, b in {(x, y), (y, x)}])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def dashboard(lesions: DataFrame) -> DataFrame:
    files = lesions.select("filename").distinct().agg(F.count("*").alias("total_files"))
    stats = lesions.agg(
        F.count("*").alias("total_lesions"),
        *[e for m in MEASURES[:2] for e in (F.round(F.avg(m), 1).alias(f"mean_{m}"), F.round(F.stddev_pop(m), 1).alias(f"std_{m}"))],
    )
    return beside(files, stats)
