"""Connected components of any size, their statistics, and hole filling.

Labels are found per block as runs of pixels and joined across block borders
through an edge table, which holds only the parts that meet at a border.  It is
contracted in two levels: cells of blocks, a bounded task each, then alternating
stars on the edges between cells, so no task holds a section.  Labels come back
as runs; a caller that wants pixels explodes or joins them.
A component's label is ``first_y * 2**24 + first_x`` of its first pixel in
raster order, so labels do not depend on block size or partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .blocks import ARROW, BLOCK, Blocks, Tile, _key_schema, block_runs_map, each_block, map_stacks

STRIDE = 1 << 24           # label = y * STRIDE + x
CELL_BLOCKS = 16           # blocks a side of a cell, the first level of contraction


def _contract(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index per node; hooking on roots with pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


def _runs(y: np.ndarray, x: np.ndarray, diagonal: int):
    """Runs of consecutive pixels, which come in raster order, and the index of the first run of their component."""
    starts = np.flatnonzero(np.r_[True, (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)])
    ends = np.r_[starts[1:] - 1, len(y) - 1]
    ry, x0, x1 = y[starts], x[starts], x[ends]
    first, last = ry * STRIDE + x0, ry * STRIDE + x1
    below = (ry + 1) * STRIDE
    lo = np.searchsorted(last, below + x0 - diagonal, "left")
    hi = np.searchsorted(first, below + x1 + diagonal, "right")
    n_near = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(ry)), n_near)
    b = np.arange(n_near.sum()) - np.repeat(np.cumsum(n_near) - n_near, n_near) + np.repeat(lo, n_near)
    return ry, x0, x1, _contract(len(ry), a, b)


def _block_runs(pixels: DataFrame | Blocks, keys: list[str], connectivity: int, block: int, values: list[str], sums: list[str],
                where: Callable[[Tile], np.ndarray] | None) -> DataFrame:
    diagonal = 1 if connectivity == 8 else 0

    def run(pieces: pa.Table, tile: Tile) -> pa.Table:
        own, y, x = np.nonzero(tile.present & where(tile) if where else tile.present)
        # blocks lie one below the other, an empty line between them
        line = own * (tile.size + 1) + y
        if len(line):
            ry, x0, x1, root = _runs(line, x, diagonal)
        else:
            ry, x0, x1, root = (np.zeros(0, np.int64) for _ in range(4))
        carried = {}
        if len(line) and (values or sums):
            held = {c: tile[c][own, y, x] for c in (*values, *sums)}
            cut = (line[1:] != line[:-1]) | (x[1:] != x[:-1] + 1)
            for v in values:
                cut |= held[v][1:] != held[v][:-1]
            starts = np.flatnonzero(np.r_[True, cut])
            label = np.searchsorted(ry * STRIDE + x0, line[starts] * STRIDE + x[starts], "right") - 1
            first_y, first_x = ry[root[label]], x0[root[label]]
            ry, x0, x1 = line[starts], x[starts], x[np.r_[starts[1:] - 1, len(x) - 1]]
            carried = {v: held[v][starts] for v in values} | {s: np.add.reduceat(held[s].astype(np.int64), starts) for s in sums}
        else:
            first_y, first_x = ry[root], x0[root]
        own = ry // (tile.size + 1)
        y0, x_first = tile.y0[own] - own * (tile.size + 1), tile.x0[own]
        first = pa.array(tile.starts[own])
        columns = {k: pieces[k].combine_chunks().take(first) for k in keys}
        columns.update(y=pa.array((ry + y0).astype(np.int32)), x0=pa.array((x0 + x_first).astype(np.int32)), x1=pa.array((x1 + x_first).astype(np.int32)),
                       part=pa.array((first_y + y0) * STRIDE + first_x + x_first))
        for c in (*values, *sums):
            columns[c] = pa.array(carried.get(c, np.zeros(0, np.int64))).cast(ARROW[types[c]] if c in values else pa.int64())
        return pa.table(columns)

    types = pixels.types if isinstance(pixels, Blocks) else {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    schema = _key_schema(pixels.rows if isinstance(pixels, Blocks) else pixels, keys) + ", y int, x0 int, x1 int, part bigint" + "".join(
        [f", `{v}` {types[v]}" for v in values] + [f", `{s}` bigint" for s in sums])
    asked = list(pixels.types) if isinstance(pixels, Blocks) else [*values, *sums]
    return each_block(pixels, keys, asked, 0, run, schema, block)


def _border_edges(runs: DataFrame, keys: list[str], connectivity: int, block: int) -> DataFrame:
    """Pairs of block labels that meet across a block border, from the runs at the borders; no pixel rows are made."""
    diagonal = 1 if connectivity == 8 else 0
    bx = F.floor(F.col("x0") / block).cast("int")
    at_left, at_right = F.col("x0") % block == 0, F.col("x1") % block == block - 1
    # across a horizontal border: the last row of a block and the first one of the blocks below
    below = F.array(bx)
    if diagonal:
        below = F.array_compact(F.array(bx, F.when(at_left, bx - 1), F.when(at_right, bx + 1)))
    upper = runs.where(F.col("y") % block == block - 1).select(
        *keys, (F.col("y") + 1).alias("_y"), F.explode(below).alias("_bx"), (F.col("x0") - diagonal).alias("_from"), (F.col("x1") + diagonal).alias("_to"), F.col("part").alias("a"))
    lower = runs.where(F.col("y") % block == 0).select(*keys, F.col("y").alias("_y"), bx.alias("_bx"), "x0", "x1", F.col("part").alias("b"))
    down = upper.join(lower, [*keys, "_y", "_bx"]).where("x0 <= _to and x1 >= _from").select(*keys, "a", "b")
    # across a vertical border: runs that end there and runs that start behind it
    rows = F.array(*[F.col("y") + dy for dy in range(-diagonal, diagonal + 1)])
    ending = runs.where(at_right).select(*keys, F.explode(rows).alias("_y"), (F.col("x1") + 1).alias("_x"), F.col("part").alias("a"))
    starting = runs.where(at_left).select(*keys, F.col("y").alias("_y"), F.col("x0").alias("_x"), F.col("part").alias("b"))
    across = ending.join(starting, [*keys, "_y", "_x"]).select(*keys, "a", "b")
    return down.unionByName(across).select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _contract_in_cells(edges: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """``keys, part, label``: the least part that each part reaches by the edges of its cell; many cells at a time in a task."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        n = table.num_rows
        own = np.tile(np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n])), 2)
        part = np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()])
        order = np.lexsort((part, own))
        new = np.r_[True, (part[order][1:] != part[order][:-1]) | (own[order][1:] != own[order][:-1])]
        index = np.empty(2 * n, np.int64)
        index[order] = np.cumsum(new) - 1
        nodes, own = part[order][new], own[order][new]
        root = _contract(len(nodes), index[:n], index[n:])
        out = {k: table[k].combine_chunks().take(pa.array(starts[own])) for k in keys}
        return pa.table(out | {"part": pa.array(nodes), "label": pa.array(nodes[root])})

    named = edges.select(*keys, F.col(cell[0]).getField("cy").alias("_cy"), F.col(cell[0]).getField("cx").alias("_cx"), "a", "b")
    return map_stacks(named, [*keys, "_cy", "_cx"], run, _key_schema(edges, keys) + ", part bigint, label bigint", 1 << 12)


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Ties every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(*keys, "a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, [*keys, "a"]).where("b > a").select(*keys, F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Ties a node and its smaller neighbours to the least of these; edges have a < b."""
    least = edges.groupBy(*keys, "b").agg(F.min("a").alias("m"))
    tied = edges.join(least, [*keys, "b"]).select(*keys, F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
    return tied.unionByName(least.select(*keys, F.col("m").alias("a"), "b")).distinct()


def spread_groups(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, part, label`` of any edges ``a, b``: the least part that each part reaches, by alternating stars.

    No task holds a key's edges: every round is a few joins and groupings on
    (key, part).  A table without edges costs no round.
    """
    now = materialize(edges.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        # an order-free digest of the edges; two equal ones in a row mean that every part is tied to its least one
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if new == state or not new[0]:
            break
        state, now = new, materialize(_small_star(_large_star(now, keys), keys))
    ends = now.select(*keys, F.col("b").alias("part"), F.col("a").alias("label"))
    return ends.unionByName(now.select(*keys, F.col("a").alias("part"), F.col("a").alias("label")).distinct())


def contracted_parts(edges: DataFrame, keys: list[str], block: int = BLOCK, cell_blocks: int = CELL_BLOCKS) -> DataFrame:
    """``keys, part, label`` of parts that meet at block borders, in two levels.

    Edges between parts of one cell (``cell_blocks`` blocks a side) are
    contracted cell by cell; their number is bounded by the cell's inner
    borders.  What is left are edges between cells, with their ends replaced by
    the cells' own labels; those are tied by alternating stars.
    """
    side = block * cell_blocks

    def cell(part: str):
        return F.struct(F.floor(F.col(part) / STRIDE / side).alias("cy"), F.floor(F.col(part) % STRIDE / side).alias("cx"))

    placed = materialize(edges.withColumn("_cell", cell("a")).withColumn("_other", cell("b")))
    inner = materialize(_contract_in_cells(placed.where("_cell = _other"), keys, ["_cell"]))
    crossing = placed.where("_cell <> _other").select(*keys, "a", "b")
    for end in ("a", "b"):
        own = inner.select(*keys, F.col("part").alias(end), F.col("label").alias("_to"))
        crossing = crossing.join(own, [*keys, end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    outer = spread_groups(crossing, keys).select(*keys, F.col("part").alias("_part"), F.col("label").alias("_label"))
    known = inner.unionByName(outer.select(*keys, F.col("_part").alias("part"), F.col("_part").alias("label")).join(
        inner.select(*keys, "part"), [*keys, "part"], "left_anti"))
    return known.withColumn("_part", F.col("label")).join(outer, [*keys, "_part"], "left").select(
        *keys, "part", F.coalesce("_label", "label").alias("label"))


def connected_groups(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, part, label``: the smallest node reachable from each node of the edges ``a, b``."""
    return spread_groups(edges, keys)


def label_runs(
    pixels: DataFrame | Blocks,
    keys: list[str],
    connectivity: int = 8,
    block: int = BLOCK,
    values: list[str] = [],
    sums: list[str] = [],
    where: Callable[[Tile], np.ndarray] | None = None,
) -> DataFrame:
    """Runs ``keys, y, x0, x1, label`` of the components of the given pixels.

    A run lies in one block and has one value of each column in ``values`` and
    the total of each whole-numbered column in ``sums``, so that what is asked
    of components need not be joined to their pixels.  ``where`` chooses among
    the pixels of ``Blocks``.
    """
    runs = materialize(_block_runs(pixels, keys, connectivity, block, values, sums, where))
    mapping = contracted_parts(_border_edges(runs, keys, connectivity, block), keys, block)
    return (
        runs.join(mapping, [*keys, "part"], "left")
        .select(*keys, "y", "x0", "x1", F.coalesce("label", "part").alias("label"), *values, *sums)
    )


def runs_to_pixels(runs: DataFrame, keys: list[str], values: list[str] = []) -> DataFrame:
    """The pixels of the runs; the hint keeps Spark, which takes them for as small as the runs, from sending them to all."""
    return runs.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"), *values, "label").hint("merge")


def label_pixels(pixels: DataFrame, keys: list[str], connectivity: int = 8, block: int = BLOCK) -> DataFrame:
    """``keys, y, x, label`` for every given (foreground) pixel."""
    return runs_to_pixels(label_runs(pixels, keys, connectivity, block), keys)


def run_statistics(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Area, box ``x,y,w,h`` and centroid, from runs: no pixel rows are made."""
    n = (F.col("x1") - F.col("x0") + 1).cast("bigint")
    return runs.groupBy(*keys, "label").agg(
        F.sum(n).alias("area"),
        F.min("x0").alias("x"), F.min("y").alias("y"),
        (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
        (F.sum((F.col("x0") + F.col("x1")) * n / 2) / F.sum(n)).alias("cx"),
        (F.sum(F.col("y") * n) / F.sum(n)).alias("cy"),
    )


def enclosed_runs(foreground: DataFrame, lattice: DataFrame | Blocks, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Runs of the holes of ``foreground``: complement parts that do not reach the border.

    ``lattice`` holds every pixel of the sections with a boolean ``on``; only
    ``lattice`` is read when ``foreground`` is None.
    """
    if isinstance(lattice, Blocks):
        extent, runs = lattice.extent(), label_runs(lattice, keys, 4, block, where=lambda tile: ~tile["on"])
    else:
        complement = (lattice.join(foreground, [*keys, "y", "x"], "left_anti")
                      if foreground is not None else lattice.where(~F.col("on")))
        extent = lattice.groupBy(*keys).agg(F.max("y").alias("_ymax"), F.max("x").alias("_xmax"))
        runs = label_runs(complement.select(*keys, "y", "x"), keys, 4, block)
    open_labels = (
        runs.join(extent, keys)
        .where("y = 0 or x0 = 0 or y = _ymax or x1 = _xmax")
        .select(*keys, "label").distinct()
    )
    return runs.join(open_labels, [*keys, "label"], "left_anti")


def fill_holes(lattice: DataFrame | Blocks, keys: list[str], block: int = BLOCK) -> DataFrame | Blocks:
    """Lattice with ``on`` extended over enclosed holes; adds ``hole``.

    Further columns are numbers or booleans without nulls; they travel packed
    with the pixels, which meet the holes' runs block by block.
    """
    whole = isinstance(lattice, Blocks)
    types = lattice.types if whole else {f.name: f.dataType.simpleString() for f in lattice.schema.fields if f.name not in (*keys, "y", "x")}

    def fill(tile: Tile, covered: np.ndarray, _):
        return tile.present, {n: tile[n] for n in types} | {"on": tile["on"] | covered, "hole": covered}

    return block_runs_map(lattice, keys, list(types), enclosed_runs(None, lattice, keys, block), [], fill, types | {"hole": "boolean"}, block)


def touches_border(runs: DataFrame, extent: DataFrame, keys: list[str], flags: list[str] = []) -> DataFrame:
    """Whether a component's box meets the section border; ``extent`` has width and height.

    ``flags`` are boolean columns of the runs: whether any run of the component has them, in the same pass.
    """
    box = runs.groupBy(*keys, "label").agg(
        F.min("x0").alias("bx0"), F.max("x1").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1"), *[F.bool_or(f).alias(f) for f in flags])
    return box.join(extent, keys).select(
        *keys, "label",
        ((F.col("bx0") == 0) | (F.col("by0") == 0) | (F.col("bx1") == F.col("width") - 1)
         | (F.col("by1") == F.col("height") - 1)).alias("on_border"), *flags)
