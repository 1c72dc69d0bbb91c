"""Similarity join of n-gram sets with prefix trees.

1. A document's set are the 64-bit hashes of its distinct word n-grams. Equal sets are one node.
2. Order. N-grams are ordered globally: those in the lower ``RARE_SHARE`` of the hash space first, by the number of sets that
   hold them (counted over all sets) and then by hash; the others by hash. Of two sets whose similarity reaches the limit, one of
   the first ``n - ceil(limit * n) + 1`` n-grams of the larger is among the (about half as many) first ones that the smaller one
   needs. Under this order the first n-grams are nearly always counted ones, so that only a quarter of all n-grams has to be
   counted, and mostly ones that no other set holds: such a set has no partner and leaves here.
3. Sets that share such an n-gram are a group. A probe is a set sent down a tree of other sets, in which sets with a common
   beginning share their path and so their overlap with the probe; a subtree is left as soon as the overlap plus what remains, of
   the probe or of the longest set below, cannot reach the limit for the shortest set below. First two hubs of every group (of
   those that may be the smaller of a pair: the one that meets most others, and the least by a hash) are sent down trees of the
   group's members, dealt in blocks of ``BLOCK_BYTES``. That links most of a group of copies, with a row or two a member.
4. Groups whose hubs leave untested pairs and that are still in several components have all pairs across components probed,
   blocks against blocks. A first tree holds only each set's first n-grams, in the global order, and leaves pairs that have another
   one before the group's in common; what it prunes has no partner in the tile. Only the members that it leaves meet as whole sets. Groups of equal members count once.

Hubs only spare work: every pair that can reach the limit is in one component or is tested, so components are those of all links.
Rows moved in step 4 grow with the blocks of a group that stays apart, comparisons with its square.

Defined cases: a null text counts as empty; a text without words has an empty set, linked with nothing, and is its own component;
a text of fewer than ``length`` words is one n-gram; a component is named by its least id (null if it has none); repeated rows are
copies; other columns are passed by. Two n-grams are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialize, mix, need, words
from .graph import components

LENGTH, PERCENT, RARE_SHARE, BLOCK_BYTES, SEGMENT, FILTER_BITS = 4, 85, 0.25, 4 << 20, 64, 1 << 26
BASE = np.uint64(0x9FB21C651E98DF25)


def ngram_sets(text: pa.Array, length: int = LENGTH) -> list[np.ndarray]:
    """Of each row the sorted hashes of its distinct word n-grams."""
    encoded, rows = words(pc.ascii_lower(text))
    count = np.bincount(rows, minlength=len(text))
    if not len(rows):
        return [np.zeros(0, np.uint64)] * len(text)
    hashed = mix(pd.util.hash_array(encoded.dictionary.to_numpy(zero_copy_only=False), categorize=False))[encoded.indices.to_numpy(zero_copy_only=False)]
    start = np.cumsum(count) - count
    size = np.maximum(count - length + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(text)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + start[row]
    width = np.minimum(count[row], length)
    rolling = np.zeros(len(row), np.uint64)
    for j in range(length):
        inside = width > j
        rolling[inside] = mix(rolling[inside] * BASE + hashed[at[inside] + j])
    order = np.lexsort((rolling, row))
    row, rolling = row[order], rolling[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (rolling[1:] != rolling[:-1])
    row, rolling = row[new], rolling[new]
    return np.split(rolling, np.cumsum(np.bincount(row, minlength=len(text)))[:-1])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """So many first n-grams, one of which a partner must share."""
    return n - (percent * n + 99) // 100 + 1


def set_table(docs: DataFrame, text_column: str, extra: list[str], length: int, percent: int, share: float, whole: bool) -> DataFrame:
    """The ``extra`` columns with the set's ``key`` and, if ``whole``, its ``ids`` as raw numbers, else its size ``n``, the ``low``
    n-grams below ``share`` of the hash space, and as many ``high`` ones as the prefix can need beside them."""
    own = [T.StructField("ids", T.BinaryType())] if whole else [
        T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("low", "high")]]
    schema = T.StructType([*[docs.schema[c] for c in extra], T.StructField("key", T.BinaryType()), *own])
    bound = np.uint64(int(share * 2**64))

    def lists(parts: list[np.ndarray]) -> pa.Array:
        offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in chunks(batches, text_column):
            sets = ngram_sets(text, length)
            columns = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"" for s in sets], pa.binary())]
            if whole:
                columns.append(pa.array([s.tobytes() for s in sets], pa.binary()))
            else:
                cut = [int(np.searchsorted(s, bound)) for s in sets]
                spare = [max(0, prefix_length(len(s), percent) - c) for s, c in zip(sets, cut, strict=True)]
                columns += [pa.array([len(s) for s in sets], pa.int64()), lists([s[:c] for s, c in zip(sets, cut, strict=True)]),
                            lists([s[c : c + k] for s, c, k in zip(sets, cut, spare, strict=True)])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in extra], *columns], schema.names)

    return docs.mapInArrow(run, schema)


def prefixes(nodes: DataFrame, percent: int) -> DataFrame:
    """node, n, once (first n-grams that no other node holds) and the others of the first ones in order, as ``df`` and ``grams``;
    nodes: node, n, low, high. A node without such others is left out."""
    # counted where they lie: the n-grams move once, and the lists that they come from not again
    low = nodes.select("node", F.explode("low").alias("gram")).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("gram")))
    shared = low.where("df > 1").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("met"))
    found = nodes.select("node", "n", F.size("low").alias("lows"), "high").join(shared, "node", "left").withColumn("met", F.coalesce("met", F.array().cast("array<struct<df:bigint,gram:bigint>>")))
    once = F.col("lows") - F.size("met")
    room = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1 - once
    later = F.transform("high", lambda g: F.struct(F.lit(1 << 60).alias("df"), g.alias("gram")))
    first = F.slice(F.concat("met", later), 1, F.greatest(room, F.lit(0)).cast("int"))
    return found.select("node", "n", once.alias("once"), first.alias("first")).where(F.size("first") > 0).select(
        "node", "n", "once", F.col("first")["df"].alias("df"), F.col("first")["gram"].alias("grams"))


def group_members(first: DataFrame, percent: int) -> DataFrame:
    """gram, df, node, n, place (in the set's order) and ``short``, whether the node can be the smaller of a pair that has this gram
    as its first common one; only groups in which some pair can."""
    each = first.select("node", "n", "once", F.posexplode(F.arrays_zip("df", "grams")).alias("k", "g"))
    place = F.col("once") + F.col("k")
    short = place < F.col("n") - F.floor((2 * percent * F.col("n") + 99 + percent) / (100 + percent)) + 1
    each = each.select(F.col("g.grams").alias("gram"), F.col("g.df").alias("df"), "node", "n", place.alias("place"), short.alias("short"))
    met = each.groupBy("gram").agg(F.count(F.lit(1)).alias("met"), F.count_if("short").alias("shorts"), F.min(F.when(F.col("short"), F.col("n"))).alias("least")).where("met > 1 and shorts > 0")
    # a node that is neither short here nor as large as one that is has no pair to be tested
    return each.join(met, "gram").where("short or n >= least").drop("least")


class Tree:
    """Distinct sets (sorted numbers) as a path-compressed prefix tree in arrays, breadth first; long paths are cut into segments."""

    def __init__(self, sets: list[np.ndarray], segment: int = SEGMENT, rest: list[tuple[int, int]] | None = None):
        """``rest``, where the rows are only the beginnings of sets: how many numbers each has from its first one on, and its set's size."""
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.order = np.array(order, np.int64)
        rows = [sets[i] for i in order]
        size = self.size = np.array([len(r) for r in rows], np.int64)
        common = np.zeros(len(rows), np.int64)  # with the row before
        for k in range(1, len(rows)):
            w = min(size[k - 1], size[k])
            differs = np.flatnonzero(rows[k - 1][:w] != rows[k][:w])
            common[k] = differs[0] if len(differs) else w
        # a node: rows lo to hi, numbers from a to b of row lo; the root has none
        nodes, first, count = [(0, len(rows), 0, 0)], [], []
        for lo, hi, _, depth in nodes:  # grows meanwhile
            first.append(len(nodes))
            inner = common[lo + 1 : hi]
            cuts = [lo, *(np.flatnonzero(inner == depth) + lo + 1).tolist(), hi]
            for a, b in zip(cuts, cuts[1:]):
                # to the next branching, or to the end of a single row
                to = int(common[a + 1 : b].min()) if b - a > 1 else int(size[a]) if b > a else depth
                if to > depth:
                    nodes.append((a, b, depth, min(depth + segment, to)))
            count.append(len(nodes) - first[-1])
        self.lo, self.hi, self.start, self.end = (np.array([x[j] for x in nodes], np.int64) for j in range(4))
        self.first, self.count = np.array(first, np.int64), np.array(count, np.int64)
        held = self.end - self.start
        self.offset = np.cumsum(held) - held
        self.tokens = np.concatenate([np.zeros(0, np.uint64), *[rows[lo][a:b] for lo, _, a, b in nodes[1:]]])
        self.tail, self.whole = (np.array([r[j] for r in rest], np.int64)[self.order] for j in (0, 1)) if rest else (size, size)
        self.longest = np.array([self.tail[a:b].max(initial=0) for a, b, *_ in nodes], np.int64)
        self.shortest = np.array([self.whole[a:b].min(initial=1 << 40) for a, b, *_ in nodes], np.int64)

    def probe(self, x: np.ndarray, percent: int = PERCENT, skip: np.ndarray | None = None, size: int | None = None, tail: int | None = None,
              first: int | None = None) -> np.ndarray:
        """Places (in the given order of the sets) of those whose similarity with ``x`` reaches the limit, or may reach it, where only
        beginnings are known; ``skip``: nodes to leave; ``size``, ``tail``: of the set that ``x`` begins, and from its first number on; sets
        that share a number below ``first`` are left."""
        if not len(self.size) or not len(x):
            return np.zeros(0, np.int64)
        size, tail = (len(x) if v is None else v for v in (size, tail))
        need = lambda n: -(-percent * (size + n) // (100 + percent))
        beyond = tail > len(x)  # numbers behind the known ones may be common too
        at, overlap, unknown, found = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(at):
            number = self.count[at]
            child = np.repeat(self.first[at] - np.cumsum(number) + number, number) + np.arange(number.sum())
            so_far, open_ = np.repeat(overlap, number), np.repeat(unknown, number)
            if skip is not None and len(child):
                stay = ~skip[child]
                child, so_far, open_ = child[stay], so_far[stay], open_[stay]
            if not len(child):
                break
            held = self.end[child] - self.start[child]
            begin = np.cumsum(held) - held
            tokens = self.tokens[np.repeat(self.offset[child] - begin, held) + np.arange(held.sum())]
            place = np.searchsorted(x, tokens)
            hit = x[np.minimum(place, len(x) - 1)] == tokens
            so_far = so_far + np.add.reduceat(hit.astype(np.int64), begin)
            if beyond:
                open_ = open_ + np.add.reduceat((tokens > x[-1]).astype(np.int64), begin)
            left = tail - np.searchsorted(x, tokens[begin + held - 1], "right")
            most = so_far + np.minimum(left, self.longest[child] - self.end[child] + open_)
            alive = most >= need(self.shortest[child])
            if first is not None:
                alive &= ~np.logical_or.reduceat(hit & (tokens < first), begin)
            child, so_far, open_, left = child[alive], so_far[alive], open_[alive], left[alive]
            row = self.lo[child]
            done = (self.size[row] == self.end[child]) & (so_far + np.minimum(left, self.tail[row] - self.end[child] + open_) >= need(self.whole[row]))
            found.append(row[done])
            at, overlap, unknown = child, so_far, open_
        return self.order[np.concatenate(found)] if found else np.zeros(0, np.int64)


def tile_links(ids: list[np.ndarray], component: np.ndarray, probes: np.ndarray, held: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between a probe and a held set of different components, enough of them to join all that any such link joins."""
    held, found = np.flatnonzero(held), []
    tree = Tree([ids[k] for k in held.tolist()])
    component = np.unique(component, return_inverse=True)[1]
    mine = component[held][tree.order]
    lows, highs = (np.array([f(mine[a:b]) for a, b in zip(tree.lo, tree.hi)]) for f in (np.min, np.max))
    for x in np.flatnonzero(probes).tolist():
        for y in held[tree.probe(ids[x], percent, (lows == highs) & (lows == component[x]))].tolist():
            if component[x] != component[y]:
                found.append((x, y))
                old = component[y]
                component[component == old] = component[x]
                lows[lows == old] = component[x]
                highs[highs == old] = component[x]
    return found


def tiles_solved(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of every tile; rows: tile, node, component, probe, held, ids."""

    def solve(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        ids = [np.frombuffer(x, "<u8") for x in table.column("ids").to_pylist()]
        probes, held, component = (table.column(c).to_numpy() for c in ("probe", "held", "component"))
        largest = np.unique(component, return_counts=True)
        # of two sets in different components one at least is outside the largest
        if (probes == held).all():
            probes = probes & (component != largest[0][largest[1].argmax()])
        found = np.array(tile_links(ids, component, probes, held, percent), np.int64).reshape(-1, 2)
        x, y = node[found[:, 0]], node[found[:, 1]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return rows.groupBy("tile").applyInArrow(solve, "a long, b long").distinct()


def hub_tiles(members: DataFrame, sets: DataFrame, block_bytes: int) -> DataFrame:
    """Every hub with the blocks of the sets that it meets; members: gram, node, n, short, met."""
    hubs = members.where("short").groupBy("gram").agg(F.max_by("node", F.struct("met", "node")).alias("first"), F.min_by("node", F.xxhash64("node")).alias("second"))
    star = members.join(hubs, "gram").select("node", "n", F.explode(F.array_distinct(F.array("first", "second"))).alias("hub")).where("node <> hub").distinct()
    # a pair of two hubs once
    both = star.select(F.col("hub").alias("node"), F.col("node").alias("hub")).where("hub < node")
    star = materialize(star.join(both, ["hub", "node"], "left_anti"))
    blocks = star.groupBy("hub").agg(F.ceil(8 * F.sum("n") / block_bytes).cast("int").alias("blocks"))
    met = star.join(blocks, "hub").select(F.struct("hub", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")).alias("tile"), "node", F.lit(False).alias("probe"))
    own = blocks.select(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "hub").select(
        F.struct("hub", "block").alias("tile"), F.col("hub").alias("node"), F.lit(True).alias("probe"))
    return met.unionByName(own).join(sets, "node").select("tile", "node", F.col("node").alias("component"), "probe", (~F.col("probe")).alias("held"), "ids")


def first_grams_meet(df: list[np.ndarray], grams: list[np.ndarray], own: np.ndarray, n: np.ndarray, once: np.ndarray, component: np.ndarray,
                     probes: np.ndarray, held: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of a tile are still in a pair of a probe and a held set of different components, by their first grams alone.

    ``own``: where in its list each row has the group's gram, which must be the first that the two have in common.
    """
    flat_df, flat = np.concatenate(df), np.concatenate(grams)
    order = np.lexsort((flat, flat_df))
    new = np.ones(len(order), bool)
    new[1:] = (flat_df[order][1:] != flat_df[order][:-1]) | (flat[order][1:] != flat[order][:-1])
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.cumsum(new).astype(np.uint64)
    lists = np.split(rank, np.cumsum([len(g) for g in grams])[:-1])
    first = lists[0][own[0]]
    at = np.flatnonzero(held)
    # rows of equal first grams are one row of the tree
    distinct: dict[bytes, list[int]] = {}
    for k in at.tolist():
        distinct.setdefault(lists[k].tobytes(), []).append(k)
    same = list(distinct.values())
    tree = Tree([lists[g[0]] for g in same], rest=[(int((n[g] - once[g]).max()), int(n[g].min())) for g in same])
    low, high = (np.array([f(component[g]) for g in same])[tree.order] for f in (np.min, np.max))
    lows, highs = np.array([low[a:b].min() for a, b in zip(tree.lo, tree.hi)]), np.array([high[a:b].max() for a, b in zip(tree.lo, tree.hi)])
    stays = np.zeros(len(n), bool)
    for x in np.flatnonzero(probes).tolist():
        for k in tree.probe(lists[x], percent, (lows == highs) & (lows == component[x]), int(n[x]), int(n[x] - once[x]), first).tolist():
            for y in same[k]:
                if component[y] != component[x]:
                    stays[x] = stays[y] = True
    return stays


def mixed_tiles(members: DataFrame, first: DataFrame, sets: DataFrame, block_bytes: int, percent: int) -> DataFrame:
    """Groups of several components as pairs of blocks; members: gram, df, node, n, place, short, shorts, component."""
    groups = members.groupBy("gram", "df").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"),
        F.bit_xor(F.when(F.col("short"), F.xxhash64("node", F.lit(2)))).alias("of_short"), F.first("shorts").alias("shorts"),
        F.ceil(8 * F.sum("n") / block_bytes).cast("int").alias("blocks"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("shorts > 2 and lo <> hi")
    # of groups with equal members the first in the order holds the first common gram of each pair
    groups = groups.groupBy("size", "sum", "xor", "of_short").agg(F.min(F.struct("df", "gram"))["gram"].alias("gram"), F.first("blocks").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    dealt = members.join(groups.select("gram", "blocks"), "gram").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # the lower block of a pair probes the higher one, and the other way round, as the smaller of a pair is the probe
    rows = dealt.select(
        F.struct("gram", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).alias("tile"), "node", "n", "place", "component", "short",
        (F.col("own") <= F.col("other")).alias("first_side"), (F.col("own") >= F.col("other")).alias("second_side"))
    listed = rows.join(first.select("node", "once", F.col("df").alias("dfs"), "grams"), "node")

    def thinned(table: pa.Table) -> pa.Table:
        def lists(name: str) -> list[np.ndarray]:
            column = table.column(name).combine_chunks()
            size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            return np.split(column.flatten().to_numpy(), np.cumsum(size)[:-1])

        n, place, once, component, short, one, two = (table.column(c).to_numpy() for c in ("n", "place", "once", "component", "short", "first_side", "second_side"))
        df, grams = lists("dfs"), lists("grams")
        stays = first_grams_meet(df, grams, place - once, n, once, component, one & short, two, percent)
        if (one != two).any():
            stays |= first_grams_meet(df, grams, place - once, n, once, component, two & short, one, percent)
        return table.select(["tile", "node", "component", "first_side", "second_side"]).filter(pa.array(stays))

    kept = listed.groupBy("tile").applyInArrow(thinned, listed.select("tile", "node", "component", "first_side", "second_side").schema)
    return materialize(kept).join(sets, "node").select("tile", "node", "component", F.col("first_side").alias("probe"), F.col("second_side").alias("held"), "ids")


def only_wanted(docs: DataFrame, wanted: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose hash may be among the wanted ones, without moving the others: the wanted hashes as a bitmap of ``bits`` bits, in
    pieces of 4 KB, which is all that is broadcast, at any input size. A full bitmap lets more rows through; a join must follow."""
    slot = F.pmod(F.col(column), F.lit(bits)) + 1
    pieces = wanted.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = docs.withColumn("_piece", F.bitmap_bucket_number(slot)).join(F.broadcast(pieces), "_piece")
    return rows.where(F.getbit(byte, place % 8) == 1).select(*docs.columns)


def linked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, percent: int = PERCENT,
           share: float = RARE_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_shingles and component_id of every document."""
    docs = need(docs, id_column, text_column).withColumn("_row_hash", F.xxhash64(id_column, text_column))
    found = set_table(docs, text_column, [id_column, "_row_hash"], length, percent, share, False)
    table = materialize(found)
    nodes = materialize(table.where("n > 0").groupBy("key").agg(F.min(id_column).alias("least_id"), *[F.first(c).alias(c) for c in ("n", "low", "high")], F.min("_row_hash").alias("_row_hash"))
                        .withColumn("node", F.monotonically_increasing_id()))
    first = materialize(prefixes(nodes.select("node", "n", "low", "high"), percent))
    members = materialize(group_members(first, percent))
    central = members.groupBy("node").agg(F.sum("met").alias("met"))
    wanted = materialize(nodes.join(central.select("node"), "node", "left_semi").select("node", "key", "_row_hash"))
    near = only_wanted(docs, wanted, "_row_hash")
    whole = set_table(near, text_column, [], length, percent, share, True)
    # a node is a key, so that what the join has dealt by key is not dealt again
    sets = materialize(whole.join(wanted.select("node", "key"), "key").dropDuplicates(["key"]).select("node", "ids"))
    links = materialize(tiles_solved(hub_tiles(members.drop("met").join(central, "node"), sets, block_bytes), percent))
    joined = components(links, "a", "b")
    labelled = materialize(members.drop("met").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    more = materialize(tiles_solved(mixed_tiles(labelled, first, sets, block_bytes, percent), percent))
    if not more.isEmpty():
        joined = components(links.unionByName(more), "a", "b")
    of_node = nodes.select("key", "node", "least_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = of_node.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_key = of_node.join(named, "component").select("key", "component_id")
    return table.join(of_key, "key", "left").select(
        id_column, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(id_column)).alias("component_id"))
