"""Training splits without leaks, class and sampling weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import beside
from ..functions.ids import punch_of_tile, slide_of_tile
from ..functions.ordered import running_sum
from ..functions.fixed import N_CLASSES


def seeded(key: Column, seed: int) -> Column:
    """Position of a key in the seeded order."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def first_share(items: DataFrame, col: str, share: float, seed: int) -> DataFrame:
    """The first ceil(share * n) of the distinct items in seeded order.

    The cut-off hash is found from counts per leading hash digits, so no task
    ranks all items: whole buckets below the cut are taken, one is ranked.
    """
    hashed = items.select(col).distinct().withColumn("_h", seeded(F.col(col), seed)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    everything = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = beside(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(everything), F.lit(0))),
                    sizes.agg(F.sum("_n").alias("_total"))).drop("_n")
    return (
        hashed.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", col)))
        .join(before, "_b")
        .where(F.col("_before") + F.col("_r") <= F.ceil(F.lit(share) * F.col("_total")))
        .select(col)
    )


def with_groups(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("slide", slide_of_tile(F.col("path"))).withColumn("punch", punch_of_tile(F.col("path")))


def split(tiles: DataFrame, level: str = "punch", val_share: float = 0.2, seed: int = 42,
          exclude: list[str] | None = None, holdout: list[str] | None = None,
          train_slides: list[str] | None = None) -> DataFrame:
    """Adds ``slide, punch, split``: every tile of a group follows its group.

    Excluded groups leave both subsets, held-out ones go to validation whatever
    the draw, and forced training slides win over validation.  Unknown held-out
    groups and empty subsets are errors, checked on grouped counts.
    """
    grouped = with_groups(tiles)
    if exclude:
        grouped = grouped.where(~F.col("slide").isin(exclude) & ~F.col("punch").isin(exclude))
        if grouped.isEmpty():
            raise ValueError(f"excluding {sorted(exclude)} leaves no tile")
    if level == "tile":
        chosen = first_share(grouped, "path", val_share, seed).withColumn("_val", F.lit(True))
        key = "path"
    else:
        chosen = first_share(grouped, level, val_share, seed).withColumn("_val", F.lit(True))
        key = level
        if holdout:
            known = {r[0] for r in grouped.where(F.col(level).isin(holdout)).select(level).distinct().collect()}
            unknown = sorted(set(holdout) - known)
            if unknown:
                raise ValueError(f"held-out groups not found: {unknown}")
            forced = grouped.sparkSession.createDataFrame([(g, True) for g in holdout], f"{level} string, _val boolean")
            chosen = chosen.unionByName(forced).distinct()
    rule = F.when(F.coalesce("_val", F.lit(False)), "val").otherwise("train")
    if train_slides and level != "tile":
        rule = F.when(F.col("slide").isin(train_slides), "train").otherwise(rule)
    return require_both(grouped.join(chosen, key, "left").withColumn("split", rule).drop("_val"))


def require_both(parts: DataFrame) -> DataFrame:
    """Error when a subset is empty; one small aggregate."""
    have = {r["split"] for r in parts.select("split").distinct().collect()}
    if have != {"train", "val"}:
        raise ValueError(f"the split produced an empty subset: {sorted({'train', 'val'} - have)}")
    return parts


def pixel_counts(tile_pixels: DataFrame, tile: str) -> DataFrame:
    """Pixels per tile and class: the only step that reads pixels."""
    return tile_pixels.groupBy(tile, "cls").agg(F.count("*").alias("n"))


def class_distribution(counts: DataFrame, tile: str, n_samples: int | None = None, seed: int = 42,
                       n_classes: int = N_CLASSES) -> DataFrame:
    """Per class: pixels, pixel share, tiles holding it and their share, all classes present."""
    if n_samples is not None:
        chosen = counts.select(tile).distinct().orderBy(seeded(F.col(tile), seed)).limit(n_samples)
        counts = counts.join(chosen, tile, "left_semi")
    totals = counts.groupBy(tile).agg(F.sum("n").alias("n")).agg(
        F.sum("n").alias("total_pixels"), F.count("*").alias("total_samples"))
    per_class = counts.groupBy("cls").agg(F.sum("n").alias("pixels"), F.count_if(F.col("n") > 0).alias("samples"))
    frame = counts.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("cls"))
    return beside(frame.join(per_class, "cls", "left"), totals).select(
        "cls", F.coalesce("pixels", F.lit(0)).alias("pixels"), "total_pixels",
        (F.coalesce("pixels", F.lit(0)) / F.col("total_pixels") * 100).alias("pixel_pct"),
        F.coalesce("samples", F.lit(0)).alias("samples"), "total_samples",
        (F.coalesce("samples", F.lit(0)) / F.col("total_samples") * 100).alias("sample_pct"))


def class_weights(distribution: DataFrame, method: str = "sqrt_inv_freq") -> DataFrame:
    """Loss weights per class divided by the smallest; the windows run over the handful of classes."""
    every = Window.partitionBy()
    n = F.count("*").over(every)
    freq = F.col("pixels") / F.col("total_pixels")
    inverse = F.col("total_pixels") / (n * F.col("pixels") + 1e-6)
    if method == "inv_freq":
        weight = inverse
    elif method == "sqrt_inv_freq":
        weight = F.sqrt(inverse)
    elif method == "median_freq":
        weight = F.expr("percentile(pixels / total_pixels, 0.5)").over(every) / (freq + 1e-6)
    else:
        raise ValueError(f"unknown method: {method}")
    raw = distribution.select("cls", freq.alias("pixel_fraction"), weight.alias("w"))
    return raw.select("cls", "pixel_fraction", (F.col("w") / F.min("w").over(every)).alias("weight"))


def sampling_weights(counts: DataFrame, tile: str, alpha: float = 0.75) -> DataFrame:
    """Weight per tile, raised for tiles with coagulation or ablation, normalised to the number of tiles."""
    per_class = class_distribution(counts, tile).select("cls", (1.0 / (F.col("sample_pct") + 0.01)).alias("w"))
    rare = per_class.agg(
        (F.max(F.when(F.col("cls") == 2, F.col("w"))) / F.sum("w") * F.count("*")).alias("w2"),
        (F.max(F.when(F.col("cls") == 3, F.col("w"))) / F.sum("w") * F.count("*")).alias("w3"))
    tiles = counts.groupBy(tile).agg(
        F.bool_or((F.col("cls") == 2) & (F.col("n") > 0)).alias("coag"),
        F.bool_or((F.col("cls") == 3) & (F.col("n") > 0)).alias("abl"))
    raw = beside(tiles, rare).select(
        tile, (F.when(F.col("coag"), 1 + alpha * F.col("w2")).otherwise(1.0)
               * F.when(F.col("abl"), 1 + alpha * F.col("w3")).otherwise(1.0)).alias("w"))
    return beside(raw, raw.agg(F.sum("w").alias("s"), F.count("*").alias("c"))).select(tile, (F.col("w") / F.col("s") * F.col("c")).alias("weight"))


def weighted_draws(weights: DataFrame, tile: str, bucket: Column, n_draws: DataFrame, seed: int = 42,
                   resolution: int = 1_000_000) -> DataFrame:
    """``draw, tile``: sampling with replacement by weight.

    ``n_draws`` holds the draw numbers.  Weights become whole numbers whose
    running sum lays the tiles side by side; a draw is a seeded point there.
    Points and tiles meet in equal stretches of that line, so the range join is
    an equi-join and a heavy tile is spread over the stretches it covers.
    """
    whole = weights.withColumn("_w", F.rint(F.col("weight") * resolution).cast("bigint"))
    laid = running_sum(whole, [], [tile], "_w", bucket, "_to").withColumn("_from", F.col("_to") - F.col("_w"))
    total = whole.agg(F.sum("_w").alias("_total"), F.count("*").alias("_n"))
    step = F.ceil(F.col("_total") / F.col("_n"))
    spans = beside(laid, total).where("_w > 0").select(
        tile, "_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") / step), F.floor((F.col("_to") - 1) / step))).alias("_s"))
    u = F.conv(F.substring(seeded(F.col("draw"), seed), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))
    points = beside(n_draws, total).select(
        "draw", F.floor(u * F.col("_total")).alias("_at"), F.floor(F.floor(u * F.col("_total")) / step).alias("_s"))
    return points.join(spans, "_s").where("_at >= _from and _at < _to").select("draw", tile)


def tiles_with_class(counts: DataFrame, tile: str, cls: int, n: int, seed: int = 42, min_px: int = 100) -> DataFrame:
    """First ``n`` tiles in seeded order with more than ``min_px`` pixels of a class."""
    return counts.where((F.col("cls") == cls) & (F.col("n") > min_px)).select(tile).orderBy(seeded(F.col(tile), seed)).limit(n)


def balanced_sample(counts: DataFrame, tile: str, n: int, seed: int = 42) -> DataFrame:
    """A quarter with ablation, a quarter with coagulation, the rest from what remains."""
    quarter = n // 4
    abl = tiles_with_class(counts, tile, 3, quarter, seed)
    coag = tiles_with_class(counts, tile, 2, quarter, seed).join(abl, tile, "left_anti")
    taken = abl.withColumn("reason", F.lit("ablation")).unionByName(coag.withColumn("reason", F.lit("coagulation")))
    room = taken.agg((F.lit(n) - F.count("*")).alias("room"))
    # at most n more are needed, so n candidates in seeded order are enough
    rest = counts.select(tile).distinct().join(taken.select(tile), tile, "left_anti").withColumn(
        "_h", seeded(F.col(tile), seed)).orderBy("_h").limit(n)
    ranked = rest.withColumn("_r", F.row_number().over(Window.orderBy("_h")))
    fill = beside(ranked, room).where("_r <= room").select(tile, F.lit("other").alias("reason"))
    return taken.unionByName(fill)


def class_shares(counts: DataFrame, tile: str) -> DataFrame:
    """Share of each class per tile in per cent."""
    wide = counts.groupBy(tile).pivot("cls", list(range(N_CLASSES))).sum("n").fillna(0)
    total = sum((F.col(str(c)) for c in range(1, N_CLASSES)), F.col("0"))
    return wide.select(tile, *[(F.col(str(c)) / total * 100).alias(f"pct_{c}") for c in range(N_CLASSES)])


def display_sample(tiles: DataFrame, col: str, n: int, seed: int = 42) -> DataFrame:
    return tiles.select(col).distinct().orderBy(seeded(F.col(col), seed)).limit(n)
