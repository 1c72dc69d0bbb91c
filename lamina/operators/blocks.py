"""Neighbourhood steps on square blocks with a halo.

A pixel goes to its own block and to every block within ``radius`` of it, so a
whole chain of neighbourhood steps costs one shuffle and a task never holds
more than a bounded number of blocks, however large the section is.

Pixels do not travel as rows.  Each task packs what it has read for a block into
one piece: a row with the coordinates and values as raw numbers.  The strips
that neighbours need are pieces of their own.  So what is shuffled and sorted
is a row per piece, hundreds to thousands of times fewer than pixels.  ``Blocks``
keeps pixels that way between steps: every step takes pixel rows or ``Blocks``
and gives back what it was given.

Blocks are small beside what one numpy call costs, so a step looks at a stack
of them at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize

BLOCK = 256
ARROW = {"boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
NUMPY = {"boolean": "bool", "tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8"}


#: Pixels that a task gathers before it packs them.
GATHERED = 1 << 19
#: Cells of the blocks that a step looks at in one go.
STACKED = 1 << 18


class Blocks:
    """Pixels packed, one row for each block that has any (several if not ``whole``); ``types`` are the Spark types of the values."""

    def __init__(self, rows: DataFrame, keys: list[str], types: dict[str, str], block: int, whole: bool = True):
        self.rows, self.keys, self.types, self.block, self.whole = rows, keys, types, block, whole

    @property
    def kinds(self) -> dict[str, np.dtype]:
        return {v: np.dtype(NUMPY[t]) for v, t in self.types.items()}

    def stored(self) -> Blocks:
        return Blocks(materialize(self.rows), self.keys, self.types, self.block, self.whole)

    def map(self, fn: Callable[[Tile], tuple[np.ndarray, dict[str, np.ndarray]]], outputs: dict[str, str]) -> Blocks:
        """A step that looks at no neighbours."""
        return block_map(self, self.keys, list(self.types), 0, fn, outputs)

    def pixels(self) -> DataFrame:
        """The pixels as rows."""
        keys, types, kinds = self.keys, self.types, self.kinds

        def run(batches):
            for batch in batches:
                pieces = pa.Table.from_batches([batch])
                if pieces.num_rows:
                    own = np.repeat(np.arange(pieces.num_rows), lengths(pieces, "_y", 4))
                    columns = {k: pieces[k].combine_chunks().take(pa.array(own)) for k in keys}
                    columns |= {c: pa.array(unpacked(pieces, f"_{c}", np.int32)) for c in ("y", "x")}
                    columns |= {v: pa.array(unpacked(pieces, f"_v_{v}", kinds[v])).cast(ARROW[types[v]]) for v in types}
                    yield from pa.table(columns).to_batches()

        return self.rows.mapInArrow(run, _pixel_schema(self.rows, keys, types))

    def tally(self, values: list[str]) -> DataFrame:
        """``keys, values, n``: how many pixels have each combination of whole-numbered values, block by block."""
        keys, types, kinds = self.keys, self.types, self.kinds

        def run(batches):
            for batch in batches:
                pieces = pa.Table.from_batches([batch])
                if pieces.num_rows:
                    code = np.repeat(np.arange(pieces.num_rows), lengths(pieces, "_y", 4))
                    known = []
                    for v in values:
                        given = unpacked(pieces, f"_v_{v}", kinds[v])
                        low, high = int(given.min()), int(given.max())
                        if high - low < 1 << 16:
                            names, index = np.arange(low, high + 1), given.astype(np.int64) - low
                        else:
                            names, index = np.unique(given, return_inverse=True)
                        known.append(names)
                        code = code * len(names) + index
                    code, n = np.unique(code, return_counts=True)
                    columns = {}
                    for v, names in zip(reversed(values), reversed(known)):
                        columns[v] = pa.array(names[code % len(names)]).cast(ARROW[types[v]])
                        code = code // len(names)
                    own = {k: pieces[k].combine_chunks().take(pa.array(code)) for k in keys}
                    yield from pa.table(own | {v: columns[v] for v in values} | {"n": pa.array(n.astype(np.int64))}).to_batches()

        return self.rows.mapInArrow(run, _key_schema(self.rows, keys) + "".join(f", `{v}` {types[v]}" for v in values) + ", n bigint")

    def least(self, by: str, value: str) -> DataFrame:
        """``keys, by, value``: the least value of the pixels with each number in ``by``."""
        keys, types, kinds = self.keys, self.types, self.kinds

        def run(batches):
            for batch in batches:
                pieces = pa.Table.from_batches([batch])
                if pieces.num_rows:
                    own = np.repeat(np.arange(pieces.num_rows), lengths(pieces, "_y", 4))
                    who, what = (unpacked(pieces, f"_v_{c}", kinds[c]) for c in (by, value))
                    order = np.lexsort((who, own))
                    who, own = who[order], own[order]
                    starts = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (own[1:] != own[:-1])])
                    columns = {k: pieces[k].combine_chunks().take(pa.array(own[starts])) for k in keys}
                    yield from pa.table(columns | {by: pa.array(who[starts]), value: pa.array(np.minimum.reduceat(what[order], starts))}).to_batches()

        rows = self.rows.mapInArrow(run, _key_schema(self.rows, keys) + f", `{by}` {types[by]}, `{value}` {types[value]}")
        return rows.groupBy(*keys, by).agg(F.min(value).alias(value))

    def extent(self) -> DataFrame:
        """``keys, _ymax, _xmax``: the last row and column of every section."""

        def run(batches):
            for batch in batches:
                pieces = pa.Table.from_batches([batch])
                if pieces.num_rows:
                    begin = np.cumsum(n := lengths(pieces, "_y", 4)) - n
                    columns = {k: pieces[k] for k in keys}
                    for c in ("y", "x"):
                        columns[f"_{c}"] = pa.array(np.maximum.reduceat(unpacked(pieces, f"_{c}", np.int32), begin))
                    yield from pa.table(columns).to_batches()

        keys = self.keys
        return self.rows.mapInArrow(run, _key_schema(self.rows, keys) + ", _y int, _x int").groupBy(*keys).agg(F.max("_y").alias("_ymax"), F.max("_x").alias("_xmax"))


class Tile:
    """Blocks with their halo as arrays (block, row, column); ``present`` marks pixels inside the section.

    ``starts`` are the rows of ``pieces`` where the blocks begin.
    """

    def __init__(self, pieces: pa.Table, values: dict[str, np.dtype], block: int, radius: int, starts=(0,)):
        self.starts = np.asarray(starts)
        n, self.size = len(self.starts), block + 2 * radius
        self.y0, self.x0 = (pieces[c].to_numpy()[self.starts].astype(np.int64) * block - radius for c in ("_by", "_bx"))
        own = np.repeat(np.arange(n), np.diff(np.r_[self.starts, pieces.num_rows]))
        own = np.repeat(own, lengths(pieces, "_y", 4))
        at = (own * self.size + unpacked(pieces, "_y", np.int32) - self.y0[own]) * self.size + unpacked(pieces, "_x", np.int32) - self.x0[own]
        shape = (n, self.size, self.size)
        self.present = np.zeros(shape, bool)
        self.present.reshape(-1)[at] = True
        self.core = np.zeros(shape[1:], bool)
        self.core[radius:radius + block, radius:radius + block] = True
        self.values = {}
        for name, kind in values.items():
            grid = np.zeros(shape, kind)
            grid.reshape(-1)[at] = unpacked(pieces, f"_v_{name}", kind)
            self.values[name] = grid

    def __getitem__(self, name: str) -> np.ndarray:
        return self.values[name]


def _binary(pieces: pa.Table, column: str) -> tuple[np.ndarray, pa.Array]:
    values = pieces[column]
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32), values


def lengths(pieces: pa.Table, column: str, size: int) -> np.ndarray:
    """How many numbers of ``size`` bytes each piece holds."""
    return np.diff(_binary(pieces, column)[0]) // size


def unpacked(pieces: pa.Table, column: str, kind) -> np.ndarray:
    """The numbers of all pieces, one after the other."""
    ends, values = _binary(pieces, column)
    if ends[-1] == ends[0]:
        return np.zeros(0, kind)
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kind)


def cut(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive stretches of the values as raw numbers, ``counts`` values each."""
    ends = np.zeros(len(counts) + 1, np.int64)
    ends[1:] = np.cumsum(counts) * values.dtype.itemsize
    assert ends[-1] < 1 << 31, "a batch of pieces passes 2 GB"
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def block_pieces(pixels: DataFrame, keys: list[str], values: list[str], radius: int = 0, block: int = BLOCK) -> tuple[DataFrame, dict[str, np.dtype]]:
    """Rows ``keys, _by, _bx`` with packed ``_y``, ``_x`` and values of the pixels in a block or within ``radius`` of it; and the values' types."""
    plain = pixels.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *values)
    kinds = {f.name: np.dtype(NUMPY[f.dataType.simpleString()]) for f in plain.schema.fields if f.name in values}
    names = [*keys, "_by", "_bx", "_y", "_x", *[f"_v_{v}" for v in values]]
    schema = T.StructType([*[plain.schema[k] for k in keys], T.StructField("_by", T.IntegerType()), T.StructField("_bx", T.IntegerType()),
                           *[T.StructField(n, T.BinaryType()) for n in names[len(keys) + 2:]]])

    def pack(table: pa.Table) -> pa.RecordBatch:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        columns = [y.astype(np.int32), x.astype(np.int32), *[table[v].to_numpy(zero_copy_only=False).astype(k) for v, k in kinds.items()]]
        code, kinds_of_key = np.zeros(len(y), np.int64), 1
        for k in keys:
            own = table[k].combine_chunks().dictionary_encode(null_encoding="encode")
            code = code * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False)
            kinds_of_key *= len(own.dictionary)
            if kinds_of_key > 1 << 20:
                known, code = np.unique(code, return_inverse=True)
                kinds_of_key = len(known)
        row, ty, tx, counts = _routed(y, x, code, radius, block)
        first = pa.array(row[np.cumsum(counts) - counts])
        arrays = [*[table[k].combine_chunks().take(first) for k in keys], pa.array(ty, pa.int32()), pa.array(tx, pa.int32()), *[cut(c[row], counts) for c in columns]]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= GATHERED:
                yield pack(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield pack(pa.Table.from_batches(held))

    return plain.mapInArrow(run, schema), kinds


def _routed(y: np.ndarray, x: np.ndarray, code: np.ndarray, radius: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pixels in the order of (code, block), each in every block whose halo holds it; and block and number of pixels of each piece."""
    reach = -(-radius // block)
    by, bx = y // block, x // block
    rows, tys, txs = [], [], []
    # two blocks a side at most where the radius stays below the block
    for dy in range(-reach, reach + 1):
        ty = by + dy
        tall = (ty >= 0) & (y >= ty * block - radius) & (y < (ty + 1) * block + radius) if radius else None
        for dx in range(-reach, reach + 1):
            tx = bx + dx
            at = np.flatnonzero(tall & (tx >= 0) & (x >= tx * block - radius) & (x < (tx + 1) * block + radius)) if radius else np.arange(len(y))
            rows.append(at)
            tys.append(ty[at])
            txs.append(tx[at])
    row, ty, tx = np.concatenate(rows), np.concatenate(tys).astype(np.int64), np.concatenate(txs).astype(np.int64)
    if not len(row):
        return row, ty, tx, np.zeros(0, np.int64)
    high, wide = int(ty.max()) + 1, int(tx.max()) + 1
    piece = (code[row] * high + ty) * wide + tx
    # few pieces: their numbers sort as short integers
    if piece.max() < 1 << 16:
        piece = piece.astype(np.uint16)
    order = np.argsort(piece, kind="stable")
    row, piece = row[order], piece[order]
    starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    return row, ty[order[starts]], tx[order[starts]], np.diff(np.r_[starts, len(row)])


def around(blocks: Blocks, radius: int) -> DataFrame:
    """Pieces of the blocks for every block within ``radius``."""
    kinds, block = {"_y": np.dtype("i4"), "_x": np.dtype("i4")} | {f"_v_{v}": k for v, k in blocks.kinds.items()}, blocks.block

    def run(batches):
        for batch in batches:
            pieces = pa.Table.from_batches([batch])
            for table in _parts(pieces, np.arange(pieces.num_rows), max(1, GATHERED // block ** 2)):
                columns = {c: unpacked(table, c, k) for c, k in kinds.items()}
                row, ty, tx, counts = _routed(columns["_y"], columns["_x"], np.repeat(np.arange(table.num_rows), lengths(table, "_y", 4)), radius, block)
                source = np.repeat(np.arange(table.num_rows), lengths(table, "_y", 4))[row[np.cumsum(counts) - counts]]
                own = {k: table[k].combine_chunks().take(pa.array(source)) for k in blocks_keys}
                own |= {"_by": pa.array(ty, pa.int32()), "_bx": pa.array(tx, pa.int32())} | {c: cut(v[row], counts) for c, v in columns.items()}
                yield from pa.table(own).to_batches()

    blocks_keys = blocks.keys
    return blocks.rows.mapInArrow(run, blocks.rows.schema)


def _parts(table: pa.Table, starts: np.ndarray, at_once: int):
    """The table in parts of so many groups."""
    for i in range(0, len(starts), at_once):
        end = starts[i + at_once] if i + at_once < len(starts) else table.num_rows
        yield table.slice(starts[i], end - starts[i])


def map_stacks(rows: DataFrame, own: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, at_once: int) -> DataFrame:
    """``fn(table, starts)`` of up to ``at_once`` whole groups at a time, for very many small groups.

    A group of its own costs some milliseconds in Spark, a small block far less.
    Groups come sorted, many in a batch (Spark bounds its bytes); only one that
    goes on in the next batch is held.
    """

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            starts = group_starts(table)
            if len(starts) > 1:
                yield from done(table.slice(0, starts[-1]), starts[:-1])
            held = table.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from done(held, np.zeros(1, np.int64))

    def group_starts(table: pa.Table) -> np.ndarray:
        changed = np.zeros(max(table.num_rows - 1, 0), bool)
        for name in own:
            codes = table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            changed |= codes[1:] != codes[:-1]
        return np.r_[0, np.flatnonzero(changed) + 1]

    def done(table: pa.Table, starts: np.ndarray):
        for i, part in enumerate(_parts(table, starts, at_once)):
            yield from fn(part, starts[i * at_once:(i + 1) * at_once] - starts[i * at_once]).combine_chunks().to_batches()

    return rows.repartition(*own).sortWithinPartitions(*own).mapInArrow(run, schema)


def map_groups(rows: DataFrame, own: list[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` of the rows of each group, as ``groupBy(own).applyInArrow``, for very many small groups."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        out = [fn(part) for part in _parts(table, starts, 1)]
        return pa.concat_tables([t for t in out if t.num_rows] or out[:1])

    return map_stacks(rows, own, run, schema, 1 << 12)


def _map_rows(blocks: Blocks, fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, at_once: int) -> DataFrame:
    """``fn(table, starts)`` of blocks where they are."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for part in _parts(table, np.arange(table.num_rows), at_once):
                yield from fn(part, np.arange(part.num_rows)).combine_chunks().to_batches()

    return blocks.rows.mapInArrow(run, schema)


def stacked(size: int) -> int:
    return max(1, STACKED // size ** 2)


def each_block(pixels: DataFrame | Blocks, keys: list[str], values: list[str], radius: int, fn: Callable[[pa.Table, Tile], pa.Table],
               schema: str, block: int) -> DataFrame:
    """``fn(pieces, tile)`` of every block with its halo, many at once."""
    if isinstance(pixels, Blocks):
        assert pixels.block == block, "blocks of another size"
        kinds = {v: k for v, k in pixels.kinds.items() if v in values}
        routed = around(pixels, radius) if radius else pixels.rows
    else:
        routed, kinds = block_pieces(pixels, keys, values, radius, block)

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        return fn(table, Tile(table, kinds, block, radius, starts))

    if isinstance(pixels, Blocks) and pixels.whole and not radius:
        return _map_rows(pixels, run, schema, stacked(block))
    return map_stacks(routed, [*keys, "_by", "_bx"], run, schema, stacked(block + 2 * radius))


def packed(pixels: DataFrame | Blocks, keys: list[str], values: list[str], block: int = BLOCK) -> Blocks:
    """The pixels as ``Blocks``."""
    if isinstance(pixels, Blocks):
        return pixels
    types = {v: pixels.schema[v].dataType.simpleString() for v in values}
    rows = each_block(pixels, keys, values, 0, lambda pieces, tile: _block_rows(pieces, tile, keys, tile.present, tile.values, types), _block_schema(pixels, keys, types), block)
    return Blocks(rows, keys, types, block)


def meet(a: Blocks, b: Blocks, keys: list[str]) -> Blocks:
    """The pixels of ``a`` that lie in ``b`` too, with the values of both; ``a`` may have more keys than ``keys``."""
    types, block, a_keys, a_kinds, b_kinds = a.types | b.types, a.block, a.keys, a.kinds, b.kinds
    own = [*keys, "_by", "_bx"]

    def run(both: pa.Table, starts: np.ndarray) -> pa.Table:
        left = both["_a"].combine_chunks().to_numpy(zero_copy_only=False)
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, both.num_rows]))
        here, first = np.unique(group[~left], return_index=True)
        mine = left & np.isin(group, here)
        if not mine.any():
            return empty
        pieces = both.filter(pa.array(mine))
        tile = Tile(pieces, a_kinds, block, 0, np.arange(pieces.num_rows))
        other = Tile(both.filter(pa.array(~left)), b_kinds, block, 0, first)
        at = np.searchsorted(here, group[mine])
        return _block_rows(pieces, tile, a_keys, tile.present & other.present[at], tile.values | {v: g[at] for v, g in other.values.items()}, types)

    schema = _block_schema(a.rows, a.keys, types)
    # the types of the keys as Spark sends them
    empty = pa.table({f.name: pa.array([], to_arrow_type(f.dataType)) for f in T.StructType([a.rows.schema[k] for k in a.keys] + T.StructType.fromDDL(schema).fields[len(a.keys):])})
    rows = a.rows.withColumn("_a", F.lit(True)).unionByName(b.rows.withColumn("_a", F.lit(False)), allowMissingColumns=True)
    return Blocks(map_stacks(rows, own, run, schema, stacked(block)), a.keys, types, block)


def block_map(
    pixels: DataFrame | Blocks,
    keys: list[str],
    values: list[str],
    radius: int,
    fn: Callable[[Tile], tuple[np.ndarray, dict[str, np.ndarray]]],
    outputs: dict[str, str],
    block: int = BLOCK,
) -> DataFrame | Blocks:
    """Apply ``fn`` to every block; it returns the pixels to emit and their values.

    ``fn(tile) -> (emit, {name: array})``; only core pixels are emitted, and
    arrays are those of many blocks at once.  ``outputs`` gives the Spark type of
    each new column (int, bigint, double, boolean).
    """
    whole = isinstance(pixels, Blocks)
    make, schema, block = (_block_rows, _block_schema(pixels.rows, keys, outputs), pixels.block) if whole else (_pixel_rows, _pixel_schema(pixels, keys, outputs), block)
    out = each_block(pixels, keys, values, radius, lambda pieces, tile: make(pieces, tile, keys, *fn(tile), outputs), schema, block)
    return Blocks(out, keys, outputs, block) if whole else out


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)


def _pixel_schema(pixels: DataFrame, keys: list[str], outputs: dict[str, str]) -> str:
    return _key_schema(pixels, keys) + "".join(f", {c}" for c in ["y int", "x int"] + [f"`{k}` {v}" for k, v in outputs.items()])


def _block_schema(pixels: DataFrame, keys: list[str], outputs: dict[str, str]) -> str:
    return _key_schema(pixels, keys) + ", _by int, _bx int, _y binary, _x binary" + "".join(f", `_v_{k}` binary" for k in outputs)


def _pixel_rows(pieces: pa.Table, tile: Tile, keys: list[str], emit: np.ndarray, arrays: dict[str, np.ndarray], outputs: dict[str, str]) -> pa.Table:
    own, yy, xx = np.nonzero(emit & tile.core)
    first = pa.array(tile.starts[own])
    columns = {k: pieces[k].combine_chunks().take(first) for k in keys}
    columns["y"] = pa.array((yy + tile.y0[own]).astype(np.int32))
    columns["x"] = pa.array((xx + tile.x0[own]).astype(np.int32))
    for name, kind in outputs.items():
        columns[name] = pa.array(arrays[name][own, yy, xx]).cast(ARROW[kind])
    return pa.table(columns)


def _block_rows(pieces: pa.Table, tile: Tile, keys: list[str], emit: np.ndarray, arrays: dict[str, np.ndarray], outputs: dict[str, str]) -> pa.Table:
    own, yy, xx = np.nonzero(emit & tile.core)
    counts = np.bincount(own, minlength=len(tile.starts))
    some = np.flatnonzero(counts)
    first, counts = pa.array(tile.starts[some]), counts[some]
    columns = {k: pieces[k].combine_chunks().take(first) for k in keys}
    # the block of the core, which the pieces name
    columns |= {c: pieces[c].combine_chunks().take(first) for c in ("_by", "_bx")}
    columns["_y"] = cut((yy + tile.y0[own]).astype(np.int32), counts)
    columns["_x"] = cut((xx + tile.x0[own]).astype(np.int32), counts)
    for name, kind in outputs.items():
        columns[f"_v_{name}"] = cut(arrays[name][own, yy, xx].astype(NUMPY[kind]), counts)
    return pa.table(columns)


def block_runs_map(
    pixels: DataFrame | Blocks,
    keys: list[str],
    values: list[str],
    runs: DataFrame,
    marks: list[str],
    fn: Callable[[Tile, np.ndarray, dict[str, np.ndarray]], tuple[np.ndarray, dict[str, np.ndarray]]],
    outputs: dict[str, str],
    block: int = BLOCK,
) -> DataFrame | Blocks:
    """Apply ``fn`` to every block of pixels and the runs ``keys, y, x0, x1`` that cover it.

    ``fn(tile, covered, {mark: array})`` returns what ``fn`` of ``block_map``
    does.  A block's pixels meet its runs packed, so that no pixel is a row of a
    join; a run that crosses blocks is cut at their borders.
    """
    whole = isinstance(pixels, Blocks)
    if whole:
        assert pixels.block == block, "blocks of another size"
        routed, kinds = pixels.rows, {v: k for v, k in pixels.kinds.items() if v in values}
    else:
        routed, kinds = block_pieces(pixels, keys, values, 0, block)
    make, schema = (_block_rows, _block_schema(routed, keys, outputs)) if whole else (_pixel_rows, _pixel_schema(pixels, keys, outputs))
    spans = runs.select(*keys, F.col("y").cast("int").alias("y"), F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"), *marks)
    mark_kinds = {f.name: np.dtype(NUMPY[f.dataType.simpleString()]) for f in spans.schema.fields if f.name in marks}
    spans = spans.withColumn("_by", F.floor(F.col("y") / block).cast("int")).withColumn(
        "_bx", F.explode(F.sequence(F.floor(F.col("x0") / block).cast("int"), F.floor(F.col("x1") / block).cast("int"))))

    def run(both: pa.Table, starts: np.ndarray) -> pa.Table:
        is_piece = pc.is_valid(both["_y"]).to_numpy()
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, both.num_rows]))
        of_piece, of_span = group[is_piece], group[~is_piece]
        # blocks with runs alone go
        here, first = np.unique(of_piece, return_index=True)
        pieces, spans = both.filter(pa.array(is_piece)), both.filter(pa.array(~is_piece & np.isin(group, here)))
        if not len(here):
            return empty
        tile = Tile(pieces, kinds, block, 0, first)
        covered = np.zeros_like(tile.present)
        grids = {m: np.zeros(covered.shape, kind) for m, kind in mark_kinds.items()}
        if spans.num_rows:
            own = np.searchsorted(here, of_span[np.isin(of_span, here)])
            y = spans["_row"].to_numpy() - tile.y0[own]
            x0 = np.maximum(spans["x0"].to_numpy() - tile.x0[own], 0)
            n = np.minimum(spans["x1"].to_numpy() - tile.x0[own], block - 1) - x0 + 1
            at = np.repeat((own * block + y) * block + x0 - (np.cumsum(n) - n), n) + np.arange(n.sum())
            covered.reshape(-1)[at] = True
            for m, grid in grids.items():
                grid.reshape(-1)[at] = np.repeat(spans[f"_m_{m}"].to_numpy(zero_copy_only=False), n)
        return make(pieces, tile, keys, *fn(tile, covered, grids), outputs)

    fields = {f.name: f.dataType for f in T.StructType.fromDDL(schema).fields}
    key_types = {f.name: f.dataType for f in routed.schema.fields if f.name in keys}
    empty = pa.table({n: pa.array([], to_arrow_type(key_types.get(n, t))) for n, t in fields.items()})
    own = [*keys, "_by", "_bx"]
    spans = spans.select(*own, F.col("y").alias("_row"), "x0", "x1", *[F.col(m).alias(f"_m_{m}") for m in marks])
    out = map_stacks(routed.unionByName(spans, allowMissingColumns=True), own, run, schema, stacked(block))
    return Blocks(out, keys, outputs, block) if whole else out


# ---- numpy helpers used inside a block --------------------------------------

def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of the elliptic structuring element of odd ``size``: rows of rounded half-width."""
    r = size // 2
    offsets = []
    for dy in range(-r, r + 1):
        half = int(np.rint(r * np.sqrt((r * r - dy * dy) / (r * r)))) if r else 0
        offsets += [(dy, dx) for dx in range(-half, half + 1)]
    return offsets


def rectangle(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def shifted(grid: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """``out[..., y, x] = grid[..., y + dy, x + dx]``, ``fill`` beyond the edge."""
    out = np.full_like(grid, fill)
    h, w = grid.shape[-2:]
    out[..., max(0, -dy):h - max(0, dy), max(0, -dx):w - max(0, dx)] = grid[
        ..., max(0, dy):h - max(0, -dy), max(0, dx):w - max(0, -dx)]
    return out


NARROW = 3  # steps to either side up to which a window is taken step by step


def window(source: np.ndarray, steps: int, axis: int, pick, ignore) -> np.ndarray:
    """Extreme over up to ``steps`` cells to either side along rows (axis -1) or columns (-2)."""
    if steps <= NARROW:
        out = np.full_like(source, ignore)
        for d in range(-steps, steps + 1):
            out = pick(out, shifted(source, *((0, d) if axis == -1 else (d, 0)), ignore))
        return out
    # a window to one side grows by its own length
    ahead, behind = source.copy(), source.copy()
    front, back = (lambda g, s: g[..., :-s], lambda g, s: g[..., s:]) if axis == -1 else (lambda g, s: g[..., :-s, :], lambda g, s: g[..., s:, :])
    covered = 1
    while covered < steps + 1:
        s = min(covered, steps + 1 - covered)
        if s >= source.shape[axis]:
            break
        front(ahead, s)[...] = pick(front(ahead, s), back(ahead.copy(), s))
        back(behind, s)[...] = pick(back(behind, s), front(behind.copy(), s))
        covered += s
    return pick(ahead, behind)


def extreme(grid: np.ndarray, present: np.ndarray, offsets, largest: bool) -> np.ndarray:
    """Largest (dilation) or smallest (erosion) value over the offsets; outside is ignored."""
    info = np.iinfo(grid.dtype)
    ignore = info.min if largest else info.max
    source = np.where(present, grid, grid.dtype.type(ignore))
    pick = np.maximum if largest else np.minimum
    rows: dict[int, set[int]] = {}
    for dy, dx in offsets:
        rows.setdefault(dy, set()).add(dx)
    half = {dy: max(dxs) for dy, dxs in rows.items()}
    tall = max(rows)
    if all(dxs == set(range(-half[dy], half[dy] + 1)) for dy, dxs in rows.items()):
        wide = {h: window(source, h, -1, pick, ignore) if h else source for h in set(half.values())}
        if len(wide) == 1 and set(rows) == set(range(-tall, tall + 1)):  # a full rectangle is taken along rows and then along columns
            out = window(wide[half[tall]], tall, -2, pick, ignore)
        else:
            out = np.full_like(grid, ignore)
            for dy, h in half.items():
                out = pick(out, shifted(wide[h], dy, 0, ignore))
    else:
        out = np.full_like(grid, ignore)
        for dy, dx in offsets:
            out = pick(out, shifted(source, dy, dx, ignore))
    return np.where(present, out, 0).astype(grid.dtype)


def dilate(on: np.ndarray, present: np.ndarray, offsets, times: int = 1) -> np.ndarray:
    grid = on.astype(np.int8)
    for _ in range(times):
        grid = extreme(grid, present, offsets, True)
    return grid > 0


def erode(on: np.ndarray, present: np.ndarray, offsets, times: int = 1) -> np.ndarray:
    grid = on.astype(np.int8)
    for _ in range(times):
        grid = extreme(grid, present, offsets, False)
    return grid > 0


def close(on: np.ndarray, present: np.ndarray, offsets, times: int = 1) -> np.ndarray:
    return erode(dilate(on, present, offsets, times), present, offsets, times)


def open_(on: np.ndarray, present: np.ndarray, offsets, times: int = 1) -> np.ndarray:
    return dilate(erode(on, present, offsets, times), present, offsets, times)
