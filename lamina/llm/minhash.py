"""Near duplicates by ProbMinHash on weighted word shingles, banding and exact verification.

1. Signatures. A document is the multiset of its five-word shingles; a shingle's weight is its number of occurrences. For
   every shingle a Poisson process of that rate delivers (arrival time, component) pairs; a component keeps its earliest
   shingle. A chunk of documents runs in lockstep in numpy: round t draws the t-th arrival of every shingle that can still
   win, and a shingle stops as soon as its arrival lies behind the latest component of its document. Two documents agree in a
   component with the probability Jaccard similarity of their weights.
2. Exact copies share one node. Components are hashed in bands; a bucket of a band proposes the pairs of its nodes with two
   hubs (the node that meets most others, and the least by hash), so that most nodes of a group come together cheaply.
3. Proposals are verified by the exact probability Jaccard similarity of the shingle multisets. What hubs cannot link is
   settled exactly: a bucket whose nodes are still in different components has all its pairs across components tested. Its
   nodes are dealt into blocks of ``BLOCK_BYTES`` of shingles, and a task tests two blocks at a time from posting lists. Rows
   moved grow with the members and blocks of a bucket, comparisons with the square of a bucket that stays apart.
4. Components of the verified links are the classes.

With 32 bands of 4 a pair of similarity 0.8 shares no bucket with probability 5e-8. Long rows move only for nodes that share a
bucket. Rows are numbered once, in a stored table that holds their texts; every later step reads that table.

Defined cases: a null text counts as empty; texts without a word are copies of each other; a text of one to four words is one
shingle; a class is named by its least id (null if it has none); repeated rows are copies; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialize, mix, need, numbered, repeated, ship_package, words
from .graph import components

SHINGLE, SIMILARITY, BANDS, ROWS, BLOCK_BYTES = 5, 0.8, 32, 4, 4 << 20
BASE = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 64-bit id and weight of every distinct shingle of each row; rows ascend within equal weight classes only."""
    encoded, rows = words(pc.ascii_lower(text))
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    hashed = pd.util.hash_array(encoded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[encoded.indices.to_numpy(zero_copy_only=False)]
    count = np.bincount(rows, minlength=len(text))
    start = np.cumsum(count) - count

    def window(at: np.ndarray, n: int) -> np.ndarray:
        rolling = np.zeros(len(at), np.uint64)
        for j in range(n):
            rolling = rolling * BASE + hashed[at + j]
        return mix(rolling ^ np.uint64(n))

    last = len(rows) - length + 1
    full = np.flatnonzero(rows[: max(0, last)] == rows[length - 1 :]) if last > 0 else np.zeros(0, np.int64)
    where, ids = [rows[full]], [window(full, length)]
    for n in range(1, length):
        short = np.flatnonzero(count == n)
        where.append(short)
        ids.append(window(start[short], n))
    row, ids = np.concatenate(where), np.concatenate(ids)
    key = mix(ids ^ mix(row.astype(np.uint64)))
    often = repeated(key)
    _, first, weight = np.unique(key[often], return_index=True, return_counts=True)
    many = np.flatnonzero(often)[first]
    keep = np.concatenate([np.flatnonzero(~often), many])
    return row[keep], ids[keep], np.concatenate([np.ones(len(keep) - len(many)), weight.astype(float)])


def signatures(row: np.ndarray, ids: np.ndarray, weight: np.ndarray, size: int, components: int) -> np.ndarray:
    """The winning shingle of each component, for each of ``size`` rows; zeros for rows without shingles."""
    best = np.full(size * components, np.inf)
    winner = np.zeros(size * components, np.uint64)
    time, alive, turn = np.zeros(len(ids)), np.arange(len(ids)), 0
    while len(alive):
        draw = mix(ids[alive] + np.uint64(turn * 0xA0761D6478BD642F % 2**64))
        time[alive] -= np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / weight[alive]
        slot = row[alive] * components + (mix(draw) % np.uint64(components)).astype(np.int64)
        np.minimum.at(best, slot, time[alive])
        won = best[slot] == time[alive]
        winner[slot[won]] = ids[alive[won]]
        rows = np.unique(row[alive])
        latest = np.full(size, -np.inf)
        latest[rows] = best.reshape(size, components)[rows].max(axis=1)
        alive = alive[time[alive] < latest[row[alive]]]
        turn += 1
    return winner.reshape(size, components)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets of sorted distinct ids."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    ca, cb = wa[i], wb[j]
    only_a, only_b = wa.sum() - ca.sum(), wb.sum() - cb.sum()
    ratio, which = np.unique(ca / cb, return_inverse=True)
    total = np.array([only_a + r * only_b + np.maximum(ca, r * cb).sum() for r in ratio])
    return float((ca / total[which]).sum())


def signature_table(docs: DataFrame, id_column: str, text_column: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """_row, id, key (equal for copies) and the hash of each band; docs: ``numbered``."""
    schema = T.StructType([T.StructField("_row", T.LongType()), docs.schema[id_column], T.StructField("key", T.BinaryType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in chunks(batches, text_column):
            row, ids, weight = shingles(text)
            full = np.bincount(row, minlength=len(text)) > 0
            parts = signatures(row, ids, weight, len(text), bands * rows).reshape(len(text), bands, rows)
            value = np.zeros((len(text), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
            for j in range(rows):
                value = mix(value * BASE + parts[:, :, j])
            offsets = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
            keys = [xxhash.xxh3_128_digest(x.encode()) if f else b"" for x, f in zip(text.to_pylist(), full, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column(id_column), pa.array(keys, pa.binary()),
                                              pa.ListArray.from_arrays(offsets, pa.array(value[full].ravel().view(np.int64)))], schema.names)

    return docs.mapInArrow(run, schema)


def weighted_sets(docs: DataFrame, text_column: str) -> DataFrame:
    """_row with its sorted shingle ids and their weights, as raw numbers; docs: ``numbered``."""
    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("weights", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in chunks(batches, text_column):
            row, ids, weight = shingles(text)
            order = np.lexsort((ids, row))
            cut = np.cumsum(np.bincount(row, minlength=len(text)))[:-1]
            each = [[x.tobytes() for x in np.split(y[order], cut)] for y in (ids, weight.astype("<u4"))]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *[pa.array(x, pa.binary()) for x in each]], schema.names)

    return docs.mapInArrow(run, schema)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches ``least``."""
    right = pairs.join(sets, pairs["b"] == sets["_row"]).select("a", "b", F.col("ids").alias("ids_b"), F.col("weights").alias("weights_b"))
    both = right.join(sets, right["a"] == sets["_row"]).select("a", "b", "ids", "weights", "ids_b", "weights_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [similarity(np.frombuffer(i, "<u8"), np.frombuffer(w, "<u4").astype(float), np.frombuffer(k, "<u8"), np.frombuffer(v, "<u4").astype(float))
                   for i, w, k, v in zip(*[(x.as_py() for x in batch.column(c)) for c in range(2, 6)], strict=True)]
            # the last digits of the sums do not decide at the limit
            yield batch.select(["a", "b"]).filter(pa.array(np.array(got) >= least - 1e-12))

    return both.mapInArrow(run, "a long, b long")


def links_across(ids: list[np.ndarray], weights: list[np.ndarray], component: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of sets of different components that reach ``least``, enough of them to join all components that any such pair joins."""
    size = np.array([len(x) for x in ids])
    total = np.array([x.sum() for x in weights])
    unit = np.array([bool((x == 1).all()) for x in weights])
    _, term = np.unique(np.concatenate(ids), return_inverse=True)
    first = np.cumsum(size) - size
    order = np.argsort(term, kind="stable")
    owner, mass = np.repeat(np.arange(len(ids)), size)[order], np.concatenate(weights)[order]
    ends = np.cumsum(np.bincount(term))
    begins = np.concatenate([[0], ends[:-1]])
    component, found = np.unique(component, return_inverse=True)[1], []
    # of two sets in different components one at least is outside the largest
    for x in np.flatnonzero(component != np.bincount(component).argmax()).tolist():
        own = term[first[x] : first[x] + size[x]]
        count = ends[own] - begins[own]
        at = np.repeat(begins[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
        of_x = np.bincount(owner[at], np.repeat(weights[x], count), len(ids))
        of_y = np.bincount(owner[at], mass[at], len(ids))
        # the similarity is at most the common share of either set's weight
        near = np.flatnonzero((of_x >= (least - 1e-9) * total[x]) & (of_y >= (least - 1e-9) * total) & (component != component[x]))
        for y in near.tolist():
            if component[x] == component[y]:
                continue
            got = of_x[y] / (total[x] + total[y] - of_x[y]) if unit[x] and unit[y] else similarity(ids[x], weights[x], ids[y], weights[y])
            if got >= least - 1e-12:
                found.append((x, y))
                component[component == component[y]] = component[x]
    return found


def cross_links(members: DataFrame, sets: DataFrame, least: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) that join the components of each bucket as all its pairs across components would; members: bucket, node, component."""
    sized = members.join(sets.select(F.col("_row").alias("node"), F.octet_length("ids").alias("bytes")), "node")
    blocks = sized.groupBy("bucket").agg(F.ceil(F.sum("bytes") / block_bytes).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    # a tile is a pair of blocks (the one block of a small bucket alone), so every pair of nodes meets in one at least
    others = F.when(F.col("blocks") < 2, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array("own")))
    tiled = members.join(blocks, "bucket").withColumn("own", own).withColumn("other", F.explode(others))
    tiled = tiled.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "component")
    rows = tiled.join(sets, tiled["node"] == sets["_row"]).drop("_row").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def solve(tile: pa.Table) -> pa.RecordBatch:
        node = tile.column("node").to_numpy()
        ids, weights = [[np.frombuffer(x, t) for x in tile.column(c).to_pylist()] for c, t in (("ids", "<u8"), ("weights", "<u4"))]
        found = links_across(ids, [w.astype(float) for w in weights], tile.column("component").to_numpy(), least)
        x, y = (node[np.array([f[k] for f in found], np.int64)] for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "lo", "hi")], 1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])).tolist()
            for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if last is not None and tuple(keys[s]) != last:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(s, e - s))
                last = tuple(keys[s])
        if held:
            yield solve(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a long, b long").distinct()


def _ordered(star: DataFrame) -> DataFrame:
    """Distinct pairs a < b of nodes and hubs."""
    return star.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = SIMILARITY) -> DataFrame:
    """_row, id and ``class_row``, the least row of the class, for every row."""
    docs = numbered(need(docs, id_column, text_column))
    return classes_of(docs, id_column, text_column, least)


def classes_of(docs: DataFrame, id_column: str, text_column: str, least: float) -> DataFrame:
    """``classes`` of documents with a stored ``_row``."""
    table = materialize(signature_table(docs, id_column, text_column))
    nodes = materialize(table.groupBy("key").agg(F.min("_row").alias("node"), F.min_by("bands", "_row").alias("bands")))
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(banded.join(shared, "bucket"))
    central = members.groupBy("node").agg(F.sum("n").alias("met"))
    hubs = members.join(central, "node").groupBy("bucket").agg(
        F.max_by("node", F.struct("met", "node")).alias("first"), F.min_by("node", F.xxhash64("node")).alias("second"))
    star = members.join(hubs, "bucket").select("node", F.explode(F.array("first", "second")).alias("hub"))
    pairs = materialize(_ordered(star))
    wanted = members.select(F.col("node").alias("_row")).distinct()
    sets = materialize(weighted_sets(docs.select("_row", text_column).join(wanted, "_row", "left_semi"), text_column))
    links = materialize(verified(pairs, sets, least))
    found = components(links, "a", "b")
    # a bucket of two is settled by its hub; a larger one where all are together needs no test
    labelled = members.where("n > 2").select("bucket", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    more = materialize(cross_links(labelled.join(mixed, "bucket"), sets, least))
    if not more.isEmpty():
        found = components(links.unionByName(more), "a", "b")

    node_class = nodes.select("key", "node").join(found, "node", "left").select("key", F.coalesce("component", "node").alias("class_row"))
    return table.select("_row", id_column, "key").join(node_class, "key").drop("key")


def class_table(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: its id, its class's least id, and the number of documents in the class."""
    rows = materialize(classes(docs, id_column, text_column, least))
    named = rows.groupBy("class_row").agg(F.min(id_column).alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(named, "class_row").select(id_column, "class_id", "class_size")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = SIMILARITY) -> DataFrame:
    """All columns of one document of each class, that with the least id (nulls last, then the least row)."""
    place = "_row"
    while place in docs.columns:
        place += "_"
    ship_package(docs.sparkSession)
    stored = numbered(docs, place)
    named = stored.select(F.col(place).alias("_row"), stored[id_column], stored[text_column])
    rows = materialize(classes_of(named, id_column, text_column, least))
    first = F.min(F.struct(F.col(id_column).isNull(), id_column, "_row"))["_row"].alias("_row")
    kept = rows.groupBy("class_row").agg(first).select(F.col("_row").alias(place))
    return stored.join(kept, place, "left_semi").select(*docs.columns)
