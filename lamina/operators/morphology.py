"""Raster neighbourhood operators as single-shuffle block steps.

Masks are dense pixel tables; a missing pixel lies outside the section and is
ignored, as the border of a morphological filter is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import blocks
from .blocks import BLOCK, Blocks, Tile, block_map


def _element(shape: str, size: int):
    return blocks.ellipse(size) if shape == "ellipse" else blocks.rectangle(size)


def morph(lattice: DataFrame | Blocks, keys: list[str], op: str, size: int, shape: str = "ellipse",
          times: int = 1, block: int = BLOCK, carry: list[str] = []) -> DataFrame | Blocks:
    """``dilate``, ``erode``, ``close`` or ``open`` of the boolean column ``on``; the columns in ``carry`` stay as they are."""
    offsets = _element(shape, size)
    step = {"dilate": blocks.dilate, "erode": blocks.erode, "close": blocks.close, "open": blocks.open_}[op]
    radius = (size // 2) * times * (2 if op in ("close", "open") else 1)

    def fn(tile: Tile):
        return tile.present, {"on": step(tile["on"], tile.present, offsets, times)} | {c: tile[c] for c in carry}

    if isinstance(lattice, Blocks):
        types = {c: lattice.types[c] for c in carry}
    else:
        types = {c: lattice.schema[c].dataType.simpleString() for c in carry}
        lattice = lattice.withColumn("on", F.col("on").cast("boolean"))
    return block_map(lattice, keys, ["on", *carry], radius, fn, {"on": "boolean"} | types, block)


def class_boundary(mask: DataFrame, keys: list[str], width: int = 3, block: int = BLOCK) -> DataFrame:
    """Pixels where the largest and smallest class of the neighbourhood differ."""
    offsets = blocks.ellipse(width)

    def fn(tile: Tile):
        cls = tile["cls"].astype(np.int16)
        high = blocks.extreme(cls, tile.present, offsets, True)
        low = blocks.extreme(cls, tile.present, offsets, False)
        return tile.present & (high != low), {}

    return block_map(mask, keys, ["cls"], width // 2, fn, {}, block)


def gaussian5(grey: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """5x5 binomial blur of ``v`` with mirrored borders, rounded to an integer."""
    taps = [1, 4, 6, 4, 1]

    def blur(grid: np.ndarray, present: np.ndarray) -> np.ndarray:
        rows, cols = np.flatnonzero(present.any(1)), np.flatnonzero(present.any(0))
        out = np.zeros(present.shape, np.int64)
        crop = grid.astype(np.int64)[rows[0]:rows[-1] + 1, cols[0]:cols[-1] + 1]
        padded = np.pad(crop, 2, mode="reflect" if min(crop.shape) > 2 else "symmetric")
        acc = np.zeros_like(crop)
        for i, wi in enumerate(taps):
            for j, wj in enumerate(taps):
                acc += wi * wj * padded[i:i + crop.shape[0], j:j + crop.shape[1]]
        out[rows[0]:rows[-1] + 1, cols[0]:cols[-1] + 1] = (acc + 128) >> 8
        return out

    def fn(tile: Tile):
        return tile.present, {"v": np.stack([blur(grid, present) for grid, present in zip(tile["v"], tile.present)])}

    # one pixel more than the filter needs, so that mirroring a cut edge never reaches the core
    return block_map(grey, keys, ["v"], 4, fn, {"v": "int"}, block)


def expose_rule(mask: DataFrame | Blocks, keys: list[str], block: int = BLOCK) -> DataFrame | Blocks:
    """Ablation with a background or tissue pixel in its 3x3 becomes coagulation, once."""
    offsets = blocks.rectangle(3)

    def fn(tile: Tile):
        cls = tile["cls"]
        near_outside = blocks.dilate(cls < 2, tile.present, offsets)
        return tile.present, {"cls": np.where((cls == 3) & near_outside, 2, cls)}

    return block_map(mask, keys, ["cls"], 1, fn, {"cls": "int"}, block)


def resolve_blended(pixels: DataFrame, keys: list[str], rounds: int = 20, block: int = BLOCK) -> DataFrame:
    """Class mask of an anti-aliased colour mask.

    A pixel that is neither a class colour nor near-white takes the majority
    class of its known 3x3 neighbours, the lowest on ties, round by round.
    """
    ring = blocks.rectangle(3)

    def fn(tile: Tile):
        r, g, b = tile["r"], tile["g"], tile["b"]
        cls = np.select(
            [(g > 200) & (r < 100) & (b < 100), (b > 200) & (r < 100) & (g < 100), (r > 200) & (g < 100) & (b < 100)],
            [1, 2, 3], 0)
        white = (r > 240) & (g > 240) & (b > 240)
        unknown = (cls == 0) & ~white & tile.present
        for _ in range(rounds):
            if not unknown.any():
                break
            known = tile.present & ~unknown
            votes = np.stack([
                sum(blocks.shifted((known & (cls == c)).astype(np.int8), dy, dx, 0) for dy, dx in ring)
                for c in range(4)])
            settle = unknown & (votes.max(0) > 0)
            cls = np.where(settle, votes.argmax(0), cls)
            unknown &= ~settle
        return tile.present, {"cls": cls}

    return block_map(pixels, keys, ["r", "g", "b"], rounds, fn, {"cls": "int"}, block)


def beside_background(mask: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``keys, y, x, beside`` of the lesion pixels: whether one of the 4-neighbours is background."""
    cross = [(-1, 0), (1, 0), (0, -1), (0, 1)]

    def fn(tile: Tile):
        cls = tile["cls"]
        return tile.present & (cls >= 2), {"beside": blocks.dilate((cls == 0) & tile.present, tile.present, cross)}

    return block_map(mask, keys, ["cls"], 1, fn, {"beside": "boolean"}, block)
