"""Spacing of lesion centres: nearest neighbours and grid lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import UM_PER_PX
from ..functions.ordered import last_marked, neighbours, value_bucket
from ..functions.quantiles import exact_quantiles
from ..session import materialize
from .blocks import map_groups

FEW = 4096   # distinct centres of a section that one task compares with each other
LEVELS = 20  # grid levels: the finest cell is 2**-20 of the section's side


def _spread_bits(v: Column) -> Column:
    """Twenty bits to the even positions of forty."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _shared_level(a: Column, b: Column) -> Column:
    """Finest grid level at which two cell codes agree."""
    differing = a.bitwiseXOR(b)
    bits = F.when(differing == 0, 0).otherwise(F.length(F.bin(differing)))
    return (F.lit(LEVELS) - F.ceil(bits / 2)).cast("int")


def _nearest_of_few(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, center_x, center_y, _d2`` of sections whose centres one task compares with each other, some rows at a time."""

    def run(table: pa.Table) -> pa.Table:
        x, y = table["center_x"].to_numpy(), table["center_y"].to_numpy()
        n = len(x)
        least = np.full(n, np.inf)
        step = max(1, (1 << 20) // n)
        for a in range(0, n, step):
            d2 = (x[a:a + step, None] - x) ** 2 + (y[a:a + step, None] - y) ** 2
            d2[np.arange(len(d2)), np.arange(a, a + len(d2))] = np.inf
            least[a:a + step] = np.fmin.reduce(d2, 1)
        return table.select([*keys, "center_x", "center_y"]).append_column("_d2", pa.array(least, mask=np.isinf(least)))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.select(*keys).schema.fields)
    centres = distinct.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("center_x", "center_y")]).dropna(subset=["center_x", "center_y"])
    return centres.groupBy(*keys).applyInArrow(run, names + ", center_x double, center_y double, _d2 double")


def nearest_neighbour(points: DataFrame, keys: list[str], ids: list[str], few: int = FEW) -> DataFrame:
    """Distance to the nearest other centre of the section, exact, without comparing all pairs of a large one.

    A section of at most ``few`` distinct centres goes to one task as it is.  In
    a larger one a point's search level is the finest quadtree level at which
    its cell holds another point; its neighbour then lies within the 5x5 cells
    around it.  At any level a cell has at most four such seekers, so the
    candidates grow linearly with the points however they cluster.
    """
    at = [*keys, "center_x", "center_y"]
    # read several times below: written once rather than recomputed
    every = materialize(points.groupBy(*at).agg(F.count("*").alias("_copies")))
    large = materialize(every.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > few).select(*keys))
    nearest = _nearest_of_few(every.join(large, keys, "left_anti"), keys)
    if not large.isEmpty():
        nearest = nearest.unionByName(_nearest_of_many(every.join(large, keys, "left_semi"), keys))
    result = every.join(nearest, at, "left").select(
        *at, F.when(F.col("_copies") > 1, 0.0).otherwise(F.sqrt("_d2")).alias("nn_px"))
    return points.select(*at, *ids).join(result, at)


def _nearest_of_many(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, center_x, center_y, _d2`` by search levels, of centres that occur once."""
    at = [*keys, "center_x", "center_y"]
    extent = distinct.groupBy(*keys).agg(
        F.min("center_x").alias("_x0"), F.min("center_y").alias("_y0"),
        F.greatest(F.max("center_x") - F.min("center_x"), F.max("center_y") - F.min("center_y")).alias("_side"))
    top = (1 << LEVELS) - 1

    def index(col: str, origin: str) -> Column:
        return F.when(F.col("_side") > 0, F.least(
            F.floor((F.col(col) - F.col(origin)) / F.col("_side") * (top + 1)), F.lit(top))).otherwise(0).cast("bigint")

    placed = distinct.join(extent, keys).select(
        *at, "_copies", index("center_x", "_x0").alias("_ix"), index("center_y", "_y0").alias("_iy"))
    placed = materialize(placed.withColumn("_code", F.shiftleft(_spread_bits(F.col("_iy")), 1).bitwiseOR(_spread_bits(F.col("_ix")))))
    codes = neighbours(placed.groupBy(*keys, "_code").agg(F.count("*").alias("_in_cell")), keys, "_code")
    level = F.when(F.col("_in_cell") > 1, LEVELS).otherwise(F.greatest(
        F.coalesce(_shared_level(F.col("_code"), F.col("prev")), F.lit(-1)),
        F.coalesce(_shared_level(F.col("_code"), F.col("next")), F.lit(-1))))
    seekers = materialize(placed.where("_copies = 1").join(
        codes.select(*keys, "_code", level.alias("_level")), [*keys, "_code"]).where("_level >= 0"))

    def cell(index_col: str) -> Column:
        return F.expr(f"shiftright({index_col}, {LEVELS} - _level)")

    levels = seekers.select(*keys, "_level").distinct()
    ring = F.sequence(F.lit(-2), F.lit(2))
    wanted = (
        seekers.select(*at, "_level", cell("_ix").alias("_cx"), cell("_iy").alias("_cy"))
        .withColumn("_dx", F.explode(ring)).withColumn("_dy", F.explode(ring))
        .select(*at, "_level", (F.col("_cx") + F.col("_dx")).alias("_cx"), (F.col("_cy") + F.col("_dy")).alias("_cy"))
    )
    others = (
        placed.join(levels, keys)  # at most one row per level in use
        .select(*keys, "_level", cell("_ix").alias("_cx"), cell("_iy").alias("_cy"),
                F.col("center_x").alias("_ox"), F.col("center_y").alias("_oy"))
    )
    return (
        wanted.join(others, [*keys, "_level", "_cx", "_cy"])
        .where("center_x <> _ox or center_y <> _oy")
        .groupBy(*at).agg(F.min(
            (F.col("center_x") - F.col("_ox")) ** 2 + (F.col("center_y") - F.col("_oy")) ** 2).alias("_d2"))
    )


def neighbour_spacing(points: DataFrame, keys: list[str], ids: list[str], scale: float = UM_PER_PX) -> DataFrame:
    """Mean and median nearest distance per section; 0 below two lesions."""
    nn = materialize(nearest_neighbour(points, keys, ids).where("nn_px is not null"))
    means = nn.groupBy(*keys).agg((F.avg("nn_px") * scale).alias("m"))
    medians = exact_quantiles(nn, keys, "nn_px", {"q": 0.5})
    return points.select(*keys).distinct().join(means.join(medians, keys), keys, "left").select(
        *keys, F.coalesce("m", F.lit(0.0)).alias("mean_nearest_neighbor_um"),
        F.coalesce(F.col("q") * scale, F.lit(0.0)).alias("grid_spacing_um"))


def grid_lines(points: DataFrame, keys: list[str], col: str, gap_multiplier: float = 1.5) -> DataFrame:
    """``keys, v, line, start`` for each distinct coordinate: the line that was open when it came.

    A line starts where a coordinate exceeds the start of the current line by
    more than the multiple of the median gap.  A gap wider than that always
    starts a line, so the walk is cut there into independent pieces; each piece
    is walked in order over a stream of batches with one number of state.
    """
    counts = materialize(points.groupBy(*keys, F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n")))
    steps = materialize(neighbours(counts, keys, "v"))
    gaps = steps.select(*keys, (F.col("v") - F.col("prev")).alias("gap"), F.lit(1).alias("times")).where("gap is not null")
    repeats = steps.where("n > 1").select(*keys, F.lit(0.0).alias("gap"), (F.col("n") - 1).alias("times"))
    limits = exact_quantiles(gaps.unionByName(repeats), keys, "gap", {"q": 0.5}, "times").select(
        *keys, (F.col("q") * gap_multiplier).alias("limit"))
    cut = materialize(steps.join(limits, keys).select(
        *keys, "v", "limit", (F.col("prev").isNull() | (F.col("v") - F.col("prev") > F.col("limit"))).alias("starts")))
    key_names = list(keys)

    def walk(batches):
        key, start, limit = None, None, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in key_names]
            out = []
            for *now, v, limit, cuts in zip(*columns, batch["v"].to_pylist(), batch["limit"].to_pylist(),
                                            batch["starts"].to_pylist()):
                if now != key or cuts or v - start > limit:
                    key, start = now, v
                out.append(start)
            arrays = [batch.column(batch.schema.get_field_index(k)) for k in key_names]
            yield pa.RecordBatch.from_arrays(
                [*arrays, batch["v"], pa.array(out, pa.float64())], names=[*key_names, "v", "start"])

    # rows of a piece stay together: the piece is the last cut at or before the row
    bucketed = value_bucket(cut, keys, "v")
    pieces = last_marked(bucketed.withColumn("_mark", F.when(F.col("starts"), F.col("v"))).withColumnRenamed("_b", "_vb"),
                         keys, ["v"], "_mark", F.col("_vb"), "_piece")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*keys).schema.fields)
    walked = (
        pieces.select(*keys, "_piece", "v", "limit", "starts")
        .repartition(*keys, "_piece").sortWithinPartitions(*keys, "_piece", "v")
        .mapInArrow(walk, names + ", v double, start double")
    )
    return materialize(walked)


def line_table(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Grid lines per section with the line before and after."""
    return neighbours(lines.select(*keys, "start").distinct(), keys, "start")


def nearest_line(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, v, at, after``: the nearest line of each coordinate (the lower on ties) and the next line.

    A coordinate lies between the line open at it and the following one.
    """
    table = materialize(line_table(lines, keys))
    placed = lines.join(table.select(*keys, "start", F.col("next").alias("up")), [*keys, "start"])
    at = F.when(F.abs(F.col("v") - F.col("up")) < F.abs(F.col("v") - F.col("start")), F.col("up")).otherwise(F.col("start"))
    chosen = placed.select(*keys, "v", at.alias("at"))
    return chosen.join(table.select(*keys, F.col("start").alias("at"), F.col("next").alias("after")), [*keys, "at"])


def _lines_of_few(v: np.ndarray, gap_multiplier: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the lines of one section, and the index of the nearest one (the lower on ties) for each coordinate."""
    limit = np.quantile(np.diff(np.sort(v)), 0.5) * gap_multiplier
    distinct, place = np.unique(v, return_inverse=True)
    # starts are read by position: a jump goes to the first coordinate beyond the limit
    starts, i = [], 0
    beyond = np.searchsorted(distinct, distinct + limit, "right")
    while i < len(distinct):
        starts.append(i)
        # the rule compares the difference, which may round otherwise than the sum
        i = max(int(beyond[i]) - 1, i + 1)
        while i < len(distinct) and not distinct[i] - distinct[starts[-1]] > limit:
            i += 1
    lines = distinct[starts]
    own = np.searchsorted(lines, distinct, "right") - 1
    after = np.minimum(own + 1, len(lines) - 1)
    nearest = np.where(np.abs(distinct - lines[after]) < np.abs(distinct - lines[own]), after, own)
    return lines, nearest[place]


def _spacing_of_few(points: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """``keys, m`` of sections that fit a task: the same sums per cell of lines."""

    def run(table: pa.Table) -> pa.Table:
        x, y = table["center_x"].to_numpy(), table["center_y"].to_numpy()
        gx, gy = _lines_of_few(x)[1], _lines_of_few(y)[1]
        total, pairs = 0.0, 0
        for here, other, v in ((gx, gy, x), (gy, gx, y)):
            wide = int(here.max()) + 2
            cells, cell = np.unique(other * wide + here, return_inverse=True)
            n, s = np.bincount(cell), np.bincount(cell, weights=v)
            at = np.searchsorted(cells, cells + 1)
            met = np.flatnonzero(cells[np.minimum(at, len(cells) - 1)] == cells + 1)
            total += float((n[met] * s[at[met]] - n[at[met]] * s[met]).sum())
            pairs += int((n[met] * n[at[met]]).sum())
        m = total / pairs * scale if pairs else None
        return pa.table({k: table[k].combine_chunks()[:1] for k in keys} | {"m": pa.array([m], pa.float64())})

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*keys).schema.fields)
    centres = points.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("center_x", "center_y")])
    return map_groups(centres, keys, run, names + ", m double")


def grid_spacing(points: DataFrame, keys: list[str], scale: float = UM_PER_PX, few: int = FEW) -> DataFrame:
    """Mean spacing of centres in one row and neighbouring columns, and the transpose; 0 if none.

    Lines split the axis into intervals, so every centre of the next line lies
    beyond every centre of this one and the sum of differences needs only sums
    and counts per cell, never the pairs.  A section of at most ``few`` centres,
    all of them known, goes to one task as it is.
    """
    known = F.bool_and(F.col("center_x").isNotNull() & F.col("center_y").isNotNull())
    sizes = materialize(points.groupBy(*keys).agg(F.count("*").alias("_n"), known.alias("_known")))
    small = (F.col("_n") <= few) & F.col("_known")
    large = sizes.where((F.col("_n") >= 2) & ~small).select(*keys)
    means = _spacing_of_few(points.join(sizes.where((F.col("_n") >= 2) & small).select(*keys), keys, "left_semi"), keys, scale)
    if not large.isEmpty():
        means = means.unionByName(_spacing_of_many(points.join(large, keys, "left_semi"), keys, scale))
    return sizes.select(*keys).join(means, keys, "left").select(
        *keys, F.coalesce("m", F.lit(0.0)).alias("mean_grid_distance_um"))


def _spacing_of_many(work: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """``keys, m`` of sections of any size."""
    xs = nearest_line(grid_lines(work, keys, "center_x"), keys).select(
        *keys, F.col("v").alias("center_x"), F.col("at").alias("gx"), F.col("after").alias("gx_next"))
    ys = nearest_line(grid_lines(work, keys, "center_y"), keys).select(
        *keys, F.col("v").alias("center_y"), F.col("at").alias("gy"), F.col("after").alias("gy_next"))
    cells = materialize(work.join(xs, [*keys, "center_x"]).join(ys, [*keys, "center_y"]).groupBy(
        *keys, "gx", "gy", "gx_next", "gy_next").agg(
            F.count("*").alias("n"), F.sum("center_x").alias("sx"), F.sum("center_y").alias("sy")))

    def along(axis: str, other: str, s: str) -> DataFrame:
        here = cells.select(*keys, F.col(f"{axis}_next").alias("j"), F.col(other).alias("o"), F.col("n").alias("n1"), F.col(s).alias("s1"))
        there = cells.select(*keys, F.col(axis).alias("j"), F.col(other).alias("o"), F.col("n").alias("n2"), F.col(s).alias("s2"))
        return here.join(there, [*keys, "j", "o"]).select(
            *keys, (F.col("n1") * F.col("s2") - F.col("n2") * F.col("s1")).alias("total"),
            (F.col("n1") * F.col("n2")).alias("pairs"))

    both = along("gx", "gy", "sx").unionByName(along("gy", "gx", "sy"))
    return both.groupBy(*keys).agg((F.sum("total") / F.sum("pairs") * scale).alias("m"))
