"""Tile lattices, tile membership and blending of tile predictions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import UM_PER_PX_FILTER
from ..functions.scalars import argmax4

OVERLAPS = (20, 40, 60, 80)  # per cent


def _lattices(sizes: list[int], overlaps=OVERLAPS) -> dict[tuple[int, int], list[str]]:
    """The folders of each tile size and step: the unshifted grid and one per overlap."""
    found: dict[tuple[int, int], list[str]] = {}
    for size in sizes:
        found.setdefault((size, size), []).append("no_shift")
        for pct in sorted(p for p in overlaps if 0 < p < 100):
            shift = size * pct // 100
            label = round(100 * shift / size)
            if size - shift > 0 and label in overlaps:
                found.setdefault((size, size - shift), []).append(f"ovlp_{label}" if shift else "no_shift")
    return found


def shift_grids(sizes: list[int], overlaps=OVERLAPS) -> Column:
    """Array of ``size, folder, step``: the unshifted grid and one per overlap."""
    return F.array(*[F.struct(F.lit(s).alias("size"), F.lit(f).alias("folder"), F.lit(st).alias("step"))
                     for (s, st), folders in _lattices(sizes, overlaps).items() for f in folders])


def training_origins(length: Column, size: Column, step: Column) -> Column:
    """Starts every ``step`` and a last one flush with the end."""
    last = F.greatest(length - size, F.lit(0))
    return F.array_union(F.sequence(F.lit(0).cast("int"), last.cast("int"), step.cast("int")), F.array(last.cast("int")))


def training_tiles(sections: DataFrame, sizes: list[int], overlaps=OVERLAPS) -> DataFrame:
    """``section_id, size, folder, step, i, j, name`` of the tiles that lie inside the section."""
    grids = sections.select("section_id", "width", "height", F.explode(shift_grids(sizes, overlaps)).alias("g")).select(
        "section_id", "width", "height", "g.*")
    return (
        grids.withColumn("i", F.explode(training_origins(F.col("height"), F.col("size"), F.col("step"))))
        .withColumn("j", F.explode(training_origins(F.col("width"), F.col("size"), F.col("step"))))
        .where("i + size <= height and j + size <= width")
        .withColumn("name", F.concat_ws("_", "section_id", "i", "j"))
    )


def _covering(pos: Column, length: Column, size: Column, step: Column) -> Column:
    """Origins of the training tiles that cover a position on one axis."""
    last = F.greatest(length - size, F.lit(0))
    low = F.greatest(F.ceil((pos - size + 1) / step), F.lit(0))
    high = F.least(F.floor(pos / step), F.floor(last / step))
    regular = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: (k * step).cast("int")))
    flush = F.when(pos >= last, F.array(last.cast("int")))
    return F.array_union(F.coalesce(regular, F.array().cast("array<int>")), F.coalesce(flush, F.array().cast("array<int>")))


def tile_white_share(pixels: DataFrame, sections: DataFrame, sizes: list[int], overlaps=OVERLAPS,
                     threshold: int = 240, min_share: float = 0.995) -> DataFrame:
    """White share of every training tile and whether it is background.

    Pixels are summed once to cells on whose borders all tiles of the section
    begin and end.  Sums then go along rows, then across them, so a cell is
    repeated once per tile column and only row sums are repeated per tile row.
    """
    grids = shift_grids(sizes, overlaps)
    # tiles begin at multiples of their step, the last at the length less their size; where no side divides these, a cell is a pixel
    common = math.gcd(*[v for size, step in _lattices(sizes, overlaps) for v in (size, step)])
    sides = [d for d in range(1, common + 1) if common % d == 0]

    def cell(length: str) -> Column:
        return F.greatest(F.lit(1), *[F.when(F.col(length) % d == 0, F.lit(d)) for d in sides])

    white = ((F.col("r") > threshold) & (F.col("g") > threshold) & (F.col("b") > threshold)).cast("bigint")
    cells = (
        pixels.select("section_id", "y", "x", white.alias("white")).join(sections.select("section_id", "width", "height", cell("height").alias("_ch"), cell("width").alias("_cw")), "section_id")
        .groupBy("section_id", "width", "height", (F.col("y") - F.col("y") % F.col("_ch")).alias("y"), (F.col("x") - F.col("x") % F.col("_cw")).alias("x"))
        .agg(F.sum("white").alias("white"))
    )
    rows = (
        cells.select("section_id", "y", "x", "white", "width", "height", F.explode(grids).alias("gr")).select("*", "gr.*")
        .where("height >= size and width >= size")
        .select("section_id", "size", "folder", "step", "height", "y", "white",
                F.explode(_covering(F.col("x"), F.col("width"), F.col("size"), F.col("step"))).alias("j"))
        .groupBy("section_id", "size", "folder", "step", "height", "y", "j").agg(F.sum("white").alias("white"))
    )
    tiles = (
        rows.select("*", F.explode(_covering(F.col("y"), F.col("height"), F.col("size"), F.col("step"))).alias("i"))
        .groupBy("section_id", "size", "folder", "i", "j").agg(F.sum("white").alias("white"))
    )
    share = F.col("white") / (F.col("size") * F.col("size"))
    return tiles.select("section_id", "size", "folder", "i", "j", share.alias("white_share"), (share >= min_share).alias("background"))


def inference_tiles(sections: DataFrame, size: int = 512, overlap: int = 128) -> DataFrame:
    """Origins from 0 to the end; the last tiles reach past the section and are padded."""
    step = size - overlap
    return sections.select(
        "section_id", "width", "height",
        F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1, F.lit(step))).alias("tile_y")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1, F.lit(step))).alias("tile_x")).select(
        "section_id", "tile_y", "tile_x",
        F.greatest(F.col("tile_y") + size - F.col("height"), F.lit(0)).alias("pad_y"),
        F.greatest(F.col("tile_x") + size - F.col("width"), F.lit(0)).alias("pad_x"))


def to_tiles(pixels: DataFrame, size: int = 512, overlap: int = 128) -> DataFrame:
    """Every pixel in each inference tile that covers it: at most four when the overlap is under half."""
    step = size - overlap

    def starts(axis: str) -> Column:
        low = F.greatest(F.ceil((F.col(axis) - size + 1) / step), F.lit(0))
        return F.sequence(low.cast("int"), F.floor(F.col(axis) / step).cast("int"))

    rest = [c for c in pixels.columns]
    return (
        pixels.select(*rest, F.explode(starts("y")).alias("_ky")).select("*", F.explode(starts("x")).alias("_kx"))
        .select(*rest, (F.col("_ky") * step).alias("tile_y"), (F.col("_kx") * step).alias("tile_x"),
                (F.col("y") - F.col("_ky") * step).alias("dy"), (F.col("x") - F.col("_kx") * step).alias("dx"))
    )


def feather(dy: Column, dx: Column, size: int, overlap: int) -> Column:
    """Weight of a pixel in its tile: ramps over the overlap, 0 on the outermost rows and columns."""
    if overlap <= 0:
        return F.lit(1.0)
    span = max(overlap - 1, 1)

    def up(d: Column) -> Column:
        return d / F.lit(float(span)) if overlap > 1 else F.lit(0.0)

    def down(d: Column) -> Column:
        return (size - 1 - d) / F.lit(float(span)) if overlap > 1 else F.lit(1.0)

    across = F.when(dx >= size - overlap, down(dx)).when(dx < overlap, up(dx)).otherwise(1.0)
    first = F.when(dy < overlap, up(dy)).otherwise(1.0)
    last = F.when(dy >= size - overlap, down(dy)).otherwise(1.0)
    return across * first * last


def blend(tile_probs: DataFrame, keys: list[str], size: int, overlap: int) -> DataFrame:
    """Weighted mean per pixel and class; partial sums are combined before the shuffle."""
    w = feather(F.col("dy"), F.col("dx"), size, overlap)
    weighed = tile_probs.withColumn("w", w)
    sums = weighed.groupBy(*keys, "y", "x").agg(
        *[F.sum(F.col(f"p{c}") * F.col("w")).alias(f"s{c}") for c in range(4)], F.sum("w").alias("w"))
    safe = F.greatest("w", F.lit(1e-6))
    return sums.select(*keys, "y", "x", *[(F.col(f"s{c}") / safe).alias(f"p{c}") for c in range(4)])


def stitch(tile_probs: DataFrame, keys: list[str], size: int, overlap: int) -> DataFrame:
    """Class per pixel of the blended probabilities; weight 0 everywhere gives class 0."""
    return blend(tile_probs, keys, size, overlap).select(
        *keys, "y", "x", argmax4(*[F.col(f"p{c}") for c in range(4)]).alias("cls"))


def stitch_labels(tile_labels: DataFrame, keys: list[str], size: int, overlap: int) -> DataFrame:
    """Rounded weighted mean of hard labels."""
    w = feather(F.col("dy"), F.col("dx"), size, overlap)
    return tile_labels.withColumn("w", w).groupBy(*keys, "y", "x").agg(
        F.rint(F.sum(F.col("cls") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))).cast("int").alias("cls"))


def section_probabilities(tile_probs: DataFrame, lattice: DataFrame, keys: list[str], size: int, overlap: int) -> DataFrame:
    """Four integers per pixel of the whole section; (255, 0, 0, 0) outside the window."""
    inside = blend(tile_probs, keys, size, overlap).select(
        *keys, "y", "x",
        *[F.least(F.greatest(F.rint(F.col(f"p{c}") * 255), F.lit(0.0)), F.lit(255.0)).cast("int").alias(f"p{c}") for c in range(4)])
    return lattice.select(*keys, "y", "x").join(inside, [*keys, "y", "x"], "left").select(
        *keys, "y", "x", *[F.coalesce(f"p{c}", F.lit(255 if c == 0 else 0)).alias(f"p{c}") for c in range(4)])


def paste(window: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Window coordinates back to the section; ``boxes`` has ``x1, y1``."""
    rest = [c for c in window.columns if c not in (*keys, "y", "x")]
    return window.join(boxes.select(*keys, "x1", "y1"), keys).select(
        *keys, (F.col("y") + F.col("y1")).alias("y"), (F.col("x") + F.col("x1")).alias("x"), *rest)


def merge_augmented(aug_probs: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Mean of predictions on rotated (``k`` quarter turns) and mirrored (``flip``) tiles, mapped back."""
    i = F.col("y")
    j = F.when(F.col("flip"), size - 1 - F.col("x")).otherwise(F.col("x"))
    k = F.col("k")
    back_y = F.when(k == 0, i).when(k == 1, j).when(k == 2, size - 1 - i).otherwise(size - 1 - j)
    back_x = F.when(k == 0, j).when(k == 1, size - 1 - i).when(k == 2, size - 1 - j).otherwise(i)
    moved = aug_probs.select(*keys, back_y.alias("y"), back_x.alias("x"), *[f"p{c}" for c in range(4)])
    return moved.groupBy(*keys, "y", "x").agg(*[F.avg(f"p{c}").alias(f"p{c}") for c in range(4)])


def score_tiles(tiles: DataFrame, model: Callable[[], Callable], schema: str) -> DataFrame:
    """Score batches with a user function; ``model()`` is called once per task and returns ``batch -> batch``."""

    def run(batches):
        predict = model()
        for batch in batches:
            yield predict(batch)

    return tiles.mapInPandas(run, schema)


def tissue_threshold(grey: DataFrame, keys: list[str], col: str = "v", pct: float = 0.98, margin: float = 4.0) -> DataFrame:
    """Brightness that separates tissue from the slide, per section; percentiles over at most 256 grey counts."""
    counts = grey.groupBy(*keys, col).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(
        F.expr(f"least(greatest(percentile({col}, {pct}d, n) - {margin}d, 180d), 252d)").alias("threshold"),
        F.expr(f"least(greatest(percentile({col}, 0.99d, n) - 1d, 180d), 252d)").alias("loose"))


def background_tiles(tiled_grey: DataFrame, thresholds: DataFrame, keys: list[str], size: int, min_share: float = 0.005) -> DataFrame:
    """Share of pixels darker than the section's threshold per inference tile, padding counted as white."""
    dark = tiled_grey.join(thresholds, keys).groupBy(*keys, "tile_y", "tile_x").agg(
        F.count_if(F.col("v") < F.col("threshold")).alias("n"))
    share = F.col("n") / float(size * size)
    return dark.select(*keys, "tile_y", "tile_x", share.alias("tissue_share"), (share < min_share).alias("background"))


def pyramid_level(slides: DataFrame, target: float = UM_PER_PX_FILTER, tol: float = 0.05) -> DataFrame:
    """Level nearest the target if within tolerance, else the coarsest finer one with a resize factor, else level 0.

    ``slides`` has ``slide, mpp0, level_downsamples``; a slide without pixel size is an error.
    """
    checked = slides.withColumn("mpp0", F.when(F.col("mpp0") > 0, F.col("mpp0")).otherwise(
        F.raise_error(F.concat(F.lit("slide has no pixel size: "), F.col("slide").cast("string")))))
    levels = checked.select("slide", F.posexplode("level_downsamples").alias("level", "down"), "mpp0").withColumn(
        "mpp", F.col("mpp0") * F.col("down"))
    picked = levels.groupBy("slide").agg(
        F.min_by(F.struct("level", "mpp"), F.struct(F.abs(F.col("mpp") - target), "level")).alias("near"),
        F.max_by(F.struct("level", "mpp"), F.when(F.col("mpp") < target, F.struct("mpp", -F.col("level")))).alias("finer"),
        F.min_by(F.struct("level", "mpp"), "level").alias("base"))
    close = F.abs(F.col("near.mpp") - target) / target <= tol
    fallback = F.coalesce("finer", "base")
    return picked.select(
        "slide", F.when(close, F.col("near.level")).otherwise(fallback["level"]).alias("level"),
        F.when(close, 1.0).otherwise(fallback["mpp"] / target).alias("resize_factor"),
        F.when(close, F.col("near.mpp")).otherwise(fallback["mpp"]).alias("um_per_px"))
