"""File manifests: discovery, pairing, audits and resume.

``list_files`` reads no content: only ``path, length, modificationTime`` of the
binary source are selected, and its scan prunes the content column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.frames import beside
from ..functions.fixed import EXCLUDED_FOLDERS
from ..functions.ids import basename, dirname, stem


def list_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")
    )


def _allowed() -> "F.Column":
    return ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in EXCLUDED_FOLDERS]))


def images_and_masks(files: DataFrame) -> DataFrame:
    """``path, kind`` of images (.tif) and masks (.png) outside the excluded folders."""
    lower = F.lower("path")
    kind = F.when(lower.endswith(".tif"), "image").when(lower.endswith(".png"), "mask")
    return files.where(_allowed()).select("path", kind.alias("kind")).where("kind is not null")


def pair_images_with_masks(files: DataFrame) -> DataFrame:
    """``image, mask``: the mask beside the image, else the one indexed under its parent folder.

    A mask below a folder ``masks`` is also indexed under that folder's parent
    and takes precedence there.
    """
    found = images_and_masks(files).select(
        "path", "kind", dirname(F.col("path")).alias("dir"), stem(F.col("path")).alias("stem"))
    masks = found.where("kind = 'mask'").select("dir", "stem", F.col("path").alias("mask"))
    inner = masks.where(basename(F.col("dir")) == "masks").select(dirname(F.col("dir")).alias("dir"), "stem", "mask")
    index = (
        masks.withColumn("rank", F.lit(0)).unionByName(inner.withColumn("rank", F.lit(1)))
        .groupBy("dir", "stem").agg(F.max_by("mask", F.struct("rank", "mask")).alias("mask"))
    )
    images = found.where("kind = 'image'").select(
        F.col("path").alias("image"), "dir", "stem", dirname(F.col("dir")).alias("parent"))
    beside = index.withColumnRenamed("mask", "m1")
    above = index.select(F.col("dir").alias("parent"), "stem", F.col("mask").alias("m2"))
    return images.join(beside, ["dir", "stem"], "left").join(above, ["parent", "stem"], "left").select(
        "image", F.coalesce("m1", "m2").alias("mask"))


def pair_flat(files: DataFrame, root: str) -> DataFrame:
    """``name, image, mask``: images/*.tif before *.tif, first name wins, samples left out."""
    at = files.select("path", dirname(F.col("path")).alias("dir"), stem(F.col("path")).alias("name"))
    rank = F.when(F.col("dir") == f"{root}/images", 0).when(F.col("dir") == root, 1)
    images = (
        at.where(F.col("path").endswith(".tif") & ~F.contains("name", F.lit("_sample_")))
        .withColumn("rank", rank).where("rank is not null")
        .groupBy("name").agg(F.min_by("path", F.struct("rank", "path")).alias("image"))
    )
    masks = at.where((F.col("dir") == f"{root}/masks") & F.col("path").endswith(".png")).select("name", F.col("path").alias("mask"))
    return images.join(masks, "name")


def sections_to_score(files: DataFrame, root: str, images_only: bool = False) -> DataFrame:
    """``name, path``: the image of each mask, in images/ or else in the root."""
    at = files.select("path", dirname(F.col("path")).alias("dir"), stem(F.col("path")).alias("name"))
    tif = at.where(F.col("path").endswith(".tif"))
    first = tif.where(F.col("dir") == f"{root}/images").select("name", F.col("path").alias("p1"))
    if images_only:
        return first.select("name", F.col("p1").alias("path"))
    second = tif.where(F.col("dir") == root).select("name", F.col("path").alias("p2"))
    masks = at.where((F.col("dir") == f"{root}/masks") & F.col("path").endswith(".png")).select("name")
    return masks.join(first, "name", "left").join(second, "name", "left").select(
        "name", F.coalesce("p1", "p2").alias("path")).where("path is not null")


def tile_manifest(files: DataFrame, sizes: list[int], shift: str = "all") -> DataFrame:
    """``size, shift, stem, tile, mask`` of tiles that have a mask of the same name."""
    parts = F.regexp_extract("path", r"/(tile|mask)_\d+/[^/]+/[^/]+$", 1)
    rows = files.select(
        "path", parts.alias("kind"), F.regexp_extract("path", r"/(?:tile|mask)_(\d+)/[^/]+/[^/]+$", 1).try_cast("int").alias("size"),
        F.regexp_extract("path", r"/(?:tile|mask)_\d+/([^/]+)/[^/]+$", 1).alias("shift"), stem(F.col("path")).alias("stem"),
    ).where(F.col("size").isin(sizes))
    if shift != "all":
        rows = rows.where(F.col("shift") == shift)
    key = ["size", "shift", "stem"]
    tiles = rows.where((F.col("kind") == "tile") & F.col("path").endswith(".tif")).select(*key, F.col("path").alias("tile"))
    masks = rows.where((F.col("kind") == "mask") & F.col("path").endswith(".png")).select(*key, F.col("path").alias("mask"))
    return tiles.join(masks, key)


def prediction_inputs(files: DataFrame) -> DataFrame:
    """Distinct scannable images without already extracted samples."""
    return files.where(F.lower("path").rlike(r"\.(tif|tiff|ndpi)$") & ~F.contains(basename(F.col("path")), F.lit("_sample_"))).select(
        "path").distinct()


def tile_audit(files: DataFrame) -> DataFrame:
    """Files and distinct tasks present per tile size and type."""
    kind = F.regexp_extract("path", r"/(tile|mask)_(\d+)/", 1)
    rows = files.where(F.col("path").rlike(r"/(tile|mask)_\d+/[^/]+/[^/]+\.(tif|png)$")).select(
        kind.alias("type"), F.regexp_extract("path", r"/(tile|mask)_(\d+)/", 2).try_cast("int").alias("size"),
        F.when(basename(F.col("path")).rlike(r"(?i)_(\d+)_(\d+)\.(tif|png)$"),
               F.regexp_replace(basename(F.col("path")), r"(?i)_(\d+)_(\d+)\.(tif|png)$", "")).alias("task"))
    # tasks are grouped first, so that the distinct count never expands rows
    return rows.groupBy("size", "type", "task").agg(F.count("*").alias("n")).groupBy("size", "type").agg(
        F.sum("n").alias("n_files"), F.count("task").alias("n_tasks"))


def not_done(sections: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    return sections.join(done.select(key), key, "left_anti")


def collect_predictions(files: DataFrame, existing: DataFrame, dest: str, overwrite: bool = True) -> DataFrame:
    """``target, source`` of the predictions to collect into ``dest``; the last path of a name wins.

    Without ``overwrite`` names already present stay, and among several sources
    the first is kept.
    """
    preds = files.where(F.col("path").endswith("_pred.png")).select("path").distinct().where(dirname(F.col("path")) != dest)
    named = preds.select(F.concat(F.lit(dest + "/"), basename(F.col("path"))).alias("target"), "path")
    if overwrite:
        return named.groupBy("target").agg(F.max("path").alias("source"))
    return named.join(existing.select(F.col("path").alias("target")), "target", "left_anti").groupBy("target").agg(
        F.min("path").alias("source"))


def complete_members(have: DataFrame, required: DataFrame, member: str, section: str) -> DataFrame:
    """Members present for every required section: a relational division by counts."""
    needed = required.select(section).distinct()
    total = needed.agg(F.count("*").alias("total"))
    counted = have.select(member, section).distinct().join(needed, section, "left_semi").groupBy(member).agg(F.count("*").alias("n"))
    return beside(counted, total).where("n = total").select(member)


def shared_sections(have: DataFrame, members: list[str], member: str, section: str) -> DataFrame:
    """Sections that every one of ``members`` has."""
    return (
        have.where(F.col(member).isin(members)).select(member, section).distinct()
        .groupBy(section).agg(F.count("*").alias("n")).where(F.col("n") == len(members)).select(section)
    )


def missing_members(candidates: DataFrame, available: DataFrame, member: str) -> DataFrame:
    return candidates.select(member).subtract(available.select(member))
