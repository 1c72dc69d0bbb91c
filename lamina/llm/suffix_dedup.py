"""Removal of every byte inside a string of ``LENGTH`` bytes that starts twice or more in the corpus.

1. Anchors. In each window of LENGTH bytes the least hash of its ``GRAM``-byte grams marks an anchor. Equal windows have their
   anchor at the same place, so repeats show as anchors with equal grams: about one suffix in 170 is sorted, not all.
2. Contexts. An anchor's context is the bytes of all windows that it is the anchor of. Where contexts are equal (by gram and by
   the hash of the whole), each is repeated as a whole and one goes on for all, if its gram has a different context too.
3. Suffix order. The suffixes from the anchors of one gram, and the reversed prefixes before them, are sorted by deep-shallow
   sorting: a multikey quicksort on eight-byte characters, vectorized over all groups, down to ``SHALLOW`` bytes, and a blind
   trie for each group that is still equal there. Both orders come with the common prefixes of neighbours.
4. Repeats. Two anchors repeat the bytes of a LENGTH window exactly if their common left and right parts add up to LENGTH. Where
   the least common parts of a group do, each member's best left and right neighbours give its span; otherwise the group
   is split along its tries. No pairs are formed.
5. Spans of a document are merged and cut out.

Hot grams. A gram with more than ``HOT`` anchors is not sorted as one group. Of two anchors that repeat LENGTH bytes, the common
part is three fifths of LENGTH or more on the right or more than two fifths on the left, so such anchors are dealt by the bytes on
either side instead, and anchors that meet no other on either side go no further. Groups that are still larger than HOT (the
edges of a passage in very many documents) are settled by counting: every window of theirs is hashed, each chunk of texts gives
each window once, and windows are summed by gram and hash. A sorted group so has at most HOT contexts of less than
2 * LENGTH bytes, whatever the corpus. Sizes of groups are counted in ``SALTS`` parts, so no task reads a hot gram whole.

Equal texts take part once and share the result; of texts that occur more often, everything is repeated. Matches never cross
documents. Rows are numbered once, in a stored table that holds their texts; every later step reads that table.

Defined cases: a null text counts as empty; texts under LENGTH bytes keep everything; repeated rows are copies; an empty table
gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialize, mix, need, numbered

LENGTH, GRAM, SHALLOW, HELD_BYTES = 400, 64, 128, 12 << 20
#: Most contexts that are sorted as one group, and the parts in which the members of groups are counted.
HOT, SALTS = 4096, 64
LOW = np.uint64(0xFFFFFFFF)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per byte, and the powers of an odd base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15 | 1
    up, down = (np.full(size, np.uint64(b)) for b in (base, pow(base, -1, 2**64)))
    up[0] = down[0] = 1
    return mix(np.arange(256, dtype=np.uint64)), np.cumprod(up), np.cumprod(down)


def _running(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The running sum that stretches are hashed from, and the factors that make a hash free of its place."""
    value, up, down = _powers(1 << max(16, int(len(raw)).bit_length()))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[raw] * down[: len(raw)])]), up


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The hash of the gram at each position, from one running sum."""
    total, up = _running(raw)
    return mix((total[gram:] - total[:-gram]) * up[: len(raw) - gram + 1])


def context_hashes(raw: np.ndarray, at: np.ndarray, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the bytes from each ``lo`` to ``end`` and of how far the anchor lies from both."""
    total, up = _running(raw)
    whole = mix((total[end] - total[lo]) * up[lo])
    return mix(whole + mix((at - lo).astype(np.uint64) << np.uint64(32) | (end - at).astype(np.uint64)))


def anchors(raw: np.ndarray, cut: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Gram hash, anchor, first and last window of each anchor in a buffer of texts that end at ``cut[1:]``."""
    width = length - gram + 1
    size = np.diff(cut)
    starts = np.arange(len(raw)) if len(raw) >= length else np.zeros(0, np.int64)
    starts = starts[np.repeat(cut[1:], size) - starts >= length] if len(starts) else starts
    if not len(starts):
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    hashes = gram_hashes(raw, gram)
    # the hash decides, then the place: the leftmost of equal grams, in every copy of the window
    key = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    padded = padded.reshape(blocks, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(after[starts], before[starts + width - 1]) & LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return hashes[at[new]], at[new], starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the strings, and the common prefix of each with the one before it (0 for the first).

    Nodes keep a depth and their branching bytes only: a search goes down blindly to some leaf, one comparison with that leaf
    gives the true depth of departure, and the new leaf is hung there. The end of a string counts as a byte before all others.
    """
    # a node is [depth, {byte: node}]; a leaf is [-1, places of equal strings]
    byte = lambda s, d: s[d] if d < len(s) else -1
    root = [-1, [0]]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while node[0] >= 0:
            node = node[1].get(byte(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node[1].append(i)
            continue
        up, node = None, root
        while 0 <= node[0] < depth:
            up, node = node, node[1][byte(s, node[0])]
        if node[0] == depth:
            node[1][byte(s, depth)] = [-1, [i]]
        else:
            split = [depth, {byte(s, depth): [-1, [i]], byte(other, depth): node}]
            if up is None:
                root = split
            else:
                up[1][byte(s, up[0])] = split
    order, common, stack, depth = [], [], [(root, 0)], 0
    while stack:
        node, depth = stack.pop()
        if node[0] < 0:
            for k, i in enumerate(node[1]):
                common.append(len(strings[i]) if k else depth)
                order.append(i)
        else:
            branches = sorted(node[1].items(), reverse=True)
            stack += [(child, node[0] if k < len(branches) - 1 else depth) for k, (_, child) in enumerate(branches)]
    return order, common


def deep_shallow(strings: list[bytes], group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, string), and each string's common prefix with the one before it (0 at the start of a group)."""
    size = np.array([len(s) for s in strings], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
    order = np.argsort(group, kind="stable")
    klass = np.cumsum(np.concatenate([[0], np.diff(group[order]) != 0]))  # of the sorted places
    common = np.zeros(len(strings), np.int64)
    start = np.concatenate([[True], np.diff(klass) != 0])
    open_ = np.flatnonzero(~(start & np.concatenate([start[1:], [True]])))
    for depth in range(0, shallow, 8):
        if not len(open_):
            break
        # the next character of eight bytes; bytes behind the end are zero and never count as common
        place = order[open_]
        left = np.clip(size[place] - depth, 0, 8)
        at = np.minimum(first[place] + depth, len(raw) - 8)
        word = raw[at[:, None] + np.arange(8)]
        word = np.where(np.arange(8) < left[:, None], word, 0)
        char = np.ascontiguousarray(word).view(">u8").ravel().astype(np.uint64)
        turn = np.lexsort((left, char, klass[open_]))
        order[open_] = place[turn]
        char, left, k = char[turn], left[turn], klass[open_]
        differ = char[1:] ^ char[:-1]
        equal = np.full(len(differ), 8)
        some = differ > 0
        word = word[turn]
        equal[some] = (word[1:][some] != word[:-1][some]).argmax(axis=1)
        equal = np.minimum(equal, np.minimum(left[1:], left[:-1]))
        inside = k[1:] == k[:-1]
        ends = inside & (equal < 8)
        common[open_[1:][ends]] = depth + equal[ends]
        # classes split where the characters differ; those left alone are done
        new = np.concatenate([[True], ~inside | (equal < 8)])
        klass = klass.copy()
        klass[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))] + len(klass)
        alone = new & np.concatenate([new[1:], [True]])
        open_ = open_[~alone]
    if len(open_):
        bounds = np.flatnonzero(np.concatenate([[True], klass[open_][1:] != klass[open_][:-1], [True]]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            places = open_[a:b]
            turn, shared = blind_trie([strings[i][shallow:] for i in order[places]])
            order[places] = order[places][turn]
            common[places[1:]] = np.array(shared[1:], np.int64) + shallow
    return order, common


def _group_spans(right: np.ndarray, rc: np.ndarray, left: np.ndarray, lc: np.ndarray, length: int, best: np.ndarray) -> None:
    """Best left and right parts of a group whose least common parts are too short: split it along the right-hand trie.

    right, left: members in both orders; rc, lc: common parts with the one before. ``best`` (members x 2) is raised in place.
    """
    todo = [(right, rc, left, lc)]
    while todo:
        right, rc, left, lc = todo.pop()
        if len(right) < 2 or rc[1:].max() + lc[1:].max() < length:
            continue
        r0, l0 = rc[1:].min(), lc[1:].min()
        if r0 + l0 >= length:
            for members, c, side in ((left, lc, 0), (right, rc, 1)):
                c = np.concatenate([[0], c[1:], [0]])
                best[members, side] = np.maximum(best[members, side], np.maximum(c[:-1], c[1:]))
            continue
        # pairs with LENGTH - r0 or more on the left need nothing more on the right: classes of the left order
        # all other pairs have more than r0 on the right: classes of the right order
        for members, c, other, oc, cut in ((left, lc, right, rc, length - r0), (right, rc, left, lc, r0 + 1)):
            label = np.cumsum(np.concatenate([[0], c[1:] < cut]))
            of = dict(zip(members.tolist(), label.tolist(), strict=True))
            there = np.array([of[m] for m in other.tolist()])
            # the other order inside a class: the common part is the least one since the class's member before
            for k in np.flatnonzero(np.bincount(label) > 1):
                own, at = np.flatnonzero(label == k), np.flatnonzero(there == k)
                between = np.array([0] + [oc[a + 1 : b + 1].min() for a, b in zip(at[:-1], at[1:], strict=True)])
                part = (members[own], np.concatenate([[0], c[own[1:]]]))
                rest = (other[at], between)
                todo.append((*rest, *part) if members is left else (*part, *rest))


def spans(group: np.ndarray, contexts: list[bytes], offset: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each context with its anchor at ``offset``: how many bytes left and right of the anchor are repeated (0, 0: none)."""
    n = len(contexts)
    best = np.zeros((n, 2), np.int64)
    right, rc = deep_shallow([c[o:] for c, o in zip(contexts, offset.tolist(), strict=True)], group)
    left, lc = deep_shallow([c[:o][::-1] for c, o in zip(contexts, offset.tolist(), strict=True)], group)
    sorted_group = group[right]
    start = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]]))
    end = np.concatenate([start[1:], [n]])
    many = end - start > 1
    start, end = start[many], end[many]
    if not len(start):
        return best[:, 0], best[:, 1]
    inner = np.zeros(n, bool)
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        inner[s + 1 : e] = True
    pairs = np.stack([start + 1, end], 1).ravel()
    pairs = pairs[:-1] if pairs[-1] == n else pairs
    low = [np.minimum.reduceat(c, pairs)[::2] for c in (rc, lc)]
    high = [np.maximum.reduceat(c, pairs)[::2] for c in (rc, lc)]
    whole = low[0] + low[1] >= length
    some = ~whole & (high[0] + high[1] >= length)
    full = np.repeat(whole, end - start)
    places = np.concatenate([np.arange(s, e) for s, e in zip(start.tolist(), end.tolist(), strict=True)])[full]
    for order, c, side in ((left, lc, 0), (right, rc, 1)):
        c = np.concatenate([np.where(inner, c, 0), [0]])
        best[order[places], side] = np.maximum(c[places], c[places + 1])
    for k in np.flatnonzero(some):
        s, e = int(start[k]), int(end[k])
        _group_spans(right[s:e], rc[s:e], left[s:e], lc[s:e], length, best)
    return best[:, 0], best[:, 1]


def _cut(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a chunk and the offsets of its rows."""
    offsets = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)[: len(text) + 1].astype(np.int64)
    return np.frombuffer(text.buffers()[2], np.uint8)[: offsets[-1]] if text.buffers()[2] else np.zeros(0, np.uint8), offsets


def anchor_table(docs: DataFrame, id_column: str, text_column: str, length: int, gram: int) -> DataFrame:
    """_row, id, key, n_bytes, sha256 of the whole text, and its anchors; docs: ``numbered``."""
    listed = T.ArrayType(T.StructType([T.StructField("gram", T.LongType()), T.StructField("context", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in ("at", "lo", "hi")]]))
    schema = T.StructType([T.StructField("_row", T.LongType()), docs.schema[id_column], T.StructField("key", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("sha256", T.StringType()), T.StructField("anchors", listed)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in chunks(batches, text_column, 2 << 20):
            raw, cut = _buffer(text)
            hashes, at, lo, hi = anchors(raw, cut, length, gram)
            row = np.searchsorted(cut, at, "right") - 1
            places = [pa.array((x - cut[row]).astype(np.int32)) for x in (at, lo, hi)]
            context = context_hashes(raw, at, lo, hi + length).view(np.int64)
            found = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(context), *places], ["gram", "context", "at", "lo", "hi"])
            lists = pa.ListArray.from_arrays(pa.array(_cut(np.bincount(row, minlength=len(text))).astype(np.int32)), found)
            data = memoryview(raw)
            each = [data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("_row"), batch.column(id_column), pa.array([xxhash.xxh3_128_digest(x) for x in each], pa.binary()), pa.array(np.diff(cut)),
                pa.array([hashlib.sha256(x).hexdigest() for x in each]), lists], schema.names)

    return docs.mapInArrow(run, schema)


def _listed(batch: pa.RecordBatch, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StructArray]:
    """A chunk's bytes, where its texts start and end, each listed anchor's row in the chunk, and the anchors."""
    raw, cut = _buffer(text)
    lists = batch.column("anchors")
    return raw, cut, np.repeat(np.arange(len(text)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()


def _contexts(docs: DataFrame, length: int) -> DataFrame:
    """group, _row, at, lo and the bytes of all windows of each listed anchor; docs: _row, text, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in chunks(batches, "text"):
            raw, cut, row, flat = _listed(batch, text)
            group, at, lo, hi = (flat.field(n) for n in ("group", "at", "lo", "hi"))
            data, base = raw.tobytes(), cut[row]
            pieces = [data[a:b] for a, b in zip((base + lo.to_numpy()).tolist(), (base + hi.to_numpy() + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([group, batch.column("_row").take(pa.array(row)), at, lo, pa.array(pieces, pa.binary())], ["group", "_row", "at", "lo", "context"])

    return docs.mapInArrow(run, "group long, _row long, at int, lo int, context binary")


def _sides(docs: DataFrame, length: int) -> DataFrame:
    """Two rows at most for each listed anchor: the hash of the bytes that a partner shares on the right, or on the left.

    Common parts of ``length`` bytes in all leave length - half bytes or more on the right or half + 1 on the left; a side of a
    context that is shorter than that has no such partner.
    """
    half = length * 2 // 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in chunks(batches, "text", 2 << 20):
            raw, cut, row, flat = _listed(batch, text)
            gram, at, lo, hi = (flat.field(n).to_numpy() for n in ("group", "at", "lo", "hi"))
            number = batch.column("_row").to_numpy()[row]
            for side, size, first, enough in ((1, length - half, at, hi + length - at >= length - half), (2, half + 1, at - half - 1, at - lo > half)):
                k = np.flatnonzero(enough)
                if len(k):
                    shared = gram_hashes(raw, size)[(cut[row] + first)[k]]
                    key = mix(shared + mix(gram[k].view(np.uint64) + np.uint64(side)))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), gram[k], number[k], at[k], lo[k], hi[k])], ["group", "gram", "_row", "at", "lo", "hi"])

    return docs.mapInArrow(run, "group long, gram long, _row long, at int, lo int, hi int")


def _counted_repeats(docs: DataFrame, length: int) -> DataFrame:
    """_row, start and end of repeated stretches around listed anchors, by counting their windows; nothing is held by group.

    A window that a chunk holds twice is settled there and only counted elsewhere; all others are met by gram and hash, at most once a
    chunk. Windows of one anchor overlap in its gram, so the first and the last repeated one bound a single stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in chunks(batches, "text", 2 << 20):
            raw, cut, row, flat = _listed(batch, text)
            if not len(row):
                continue
            gram, at, lo, hi = (flat.field(n).to_numpy() for n in ("group", "at", "lo", "hi"))
            size = hi.astype(np.int64) - lo + 1
            own = np.repeat(np.arange(len(size)), size)
            start = np.arange(len(own)) - np.repeat(np.cumsum(size) - size - lo, size)
            hashes = gram_hashes(raw, length)[cut[row][own] + start]
            order = np.lexsort((hashes, gram[own]))
            g, h = gram[own][order], hashes[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])
            first = np.flatnonzero(new)
            count = np.diff(np.concatenate([first, [len(order)]]))
            twice = np.empty(len(order), bool)
            twice[order] = np.repeat(count > 1, count)
            # settled here: the stretch of an anchor's windows that this chunk holds twice
            w = np.flatnonzero(twice)
            left, right = np.full(len(size), np.iinfo(np.int32).max), np.full(len(size), -1)
            np.minimum.at(left, own[w], start[w])
            np.maximum.at(right, own[w], start[w])
            k = np.flatnonzero(right >= 0)
            number = batch.column("_row").to_numpy()[row]
            e = order[first]
            parts = [(np.zeros(len(k), np.int32), gram[k], np.zeros(len(k), np.int64), number[k], at[k], left[k], right[k]),
                     (np.minimum(count, 2), gram[own][e], hashes[e].view(np.int64), number[own][e], at[own][e], start[e], start[e])]
            for part in parts:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                for a in range(0, len(part[0]), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 200_000]).cast(t) for x, t in zip(part, kinds, strict=True)],
                                                     ["n", "gram", "hash", "_row", "at", "first", "last"])

    windows = materialize(docs.mapInArrow(run, "n int, gram long, hash long, _row long, at int, first int, last int"), "zstd")
    often = windows.where("n > 0").groupBy("gram", "hash").agg(F.sum("n").alias("total")).where("total > 1").select("gram", "hash")
    met = windows.where("n = 1").join(often, ["gram", "hash"], "left_semi").groupBy("_row", "at").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    both = met.unionByName(windows.where("n = 0").select("_row", "at", "first", "last"))
    return both.select("_row", F.col("first").alias("start"), (F.col("last") + length).cast("int").alias("end"))


def _sized(rows: DataFrame, *keys: str, least: int = 2) -> DataFrame:
    """Rows of groups of ``least`` or more with their group's size ``n`` and its ``head``, the first row and place in it.

    Groups are counted and joined in parts, so that no task reads a hot group whole.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    parts = rows.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_row", "at")).alias("head"))
    total = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("head").alias("head"), F.collect_list("_salt").alias("_salt")).where(F.col("n") >= least)
    return rows.join(total.select(*keys, "n", "head", F.explode("_salt").alias("_salt")), [*keys, "_salt"]).drop("_salt")


def _repeats(contexts: DataFrame, length: int) -> DataFrame:
    """_row, start and end of repeated stretches; the contexts are dealt and sorted by group; a group has at most HOT of them."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        group, at, lo = (table.column(n).to_numpy() for n in ("group", "at", "lo"))
        left, right = spans(group, table.column("context").to_pylist(), (at - lo).astype(np.int64), length)
        hit = left + right >= length
        return pa.RecordBatch.from_arrays([pa.array(table.column("_row").to_numpy()[hit]), pa.array((at - left)[hit].astype(np.int32)),
                                           pa.array((at + right)[hit].astype(np.int32))], ["_row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > HELD_BYTES:
                table = pa.Table.from_batches(held)
                group = table.column("group").to_numpy()
                done = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
                if done:
                    yield solve(table.slice(0, done))
                    held = table.slice(done).combine_chunks().to_batches()
                    size = sum(x.nbytes for x in held)
        if held:
            yield solve(pa.Table.from_batches(held))

    return contexts.repartition("group").sortWithinPartitions("group").mapInArrow(run, "_row long, start int, end int")


def _by_row(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_row").agg(F.collect_list(F.struct("group", "at", "lo", "hi")).alias("anchors"))


def _hot_repeats(held: DataFrame, length: int, hot: int) -> DataFrame:
    """_row, start and end of repeated stretches around the listed anchors of hot grams; held: _row, text, anchors."""
    sides = materialize(_sized(_sides(held, length), "group"))
    texts = held.select("_row", "text")
    sorted_ = texts.join(_by_row(sides.where(F.col("n") <= hot)), "_row")
    # here the gram is the group: windows are told apart by their gram and their hash
    large = sides.where(F.col("n") > hot).select("_row", F.col("gram").alias("group"), "at", "lo", "hi").distinct()
    return _repeats(_contexts(sorted_, length), length).unionByName(_counted_repeats(texts.join(_by_row(large), "_row"), length))


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM,
                 hot: int = HOT) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and the removed stretches as ``spans``."""
    docs = numbered(need(docs, id_column, text_column))
    table = materialize(anchor_table(docs, id_column, text_column, length, gram))
    texts = materialize(table.groupBy("key").agg(F.min("_row").alias("_row"), F.count(F.lit(1)).alias("copies"), F.min_by("anchors", "_row").alias("anchors")))
    listed = texts.select("_row", F.explode("anchors").alias("x")).select("_row", F.col("x.gram").alias("group"), "x.context", "x.at", "x.lo", "x.hi")
    kinds = materialize(_sized(_sized(listed, "group").drop("n", "head"), "group", "context", least=1))
    equal = kinds.where("n > 1").select("_row", "group", "at", "lo", "hi", F.lit(0).alias("n"))
    heads = _sized(kinds.where(F.col("head") == F.struct("_row", "at")).drop("n", "head"), "group").select(*equal.columns)
    one = F.struct("group", "at", "lo", "hi")
    wanted = heads.unionByName(equal).groupBy("_row").agg(
        *[F.collect_list(F.when(cold, one)).alias(name) for name, cold in (("anchors", F.col("n").between(2, hot)), ("hot", F.col("n") > hot))])
    full = docs.select(F.col(text_column).alias("text"), "_row")
    held = materialize(full.join(wanted, "_row"), "zstd")
    whole = equal.select("_row", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    found = whole.unionByName(_repeats(_contexts(held.where(F.size("anchors") > 0).select("_row", "text", "anchors"), length), length))
    hot_rows = held.where(F.size("hot") > 0).select("_row", "text", F.col("hot").alias("anchors"))
    if not hot_rows.isEmpty():
        found = found.unionByName(_hot_repeats(hot_rows, length, hot))
    found = materialize(found)
    per_text = found.groupBy("_row").agg(F.collect_set(F.struct("start", "end")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text, found in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                raw, kept, merged = text.encode(), hashlib.sha256(), []
                for start, end in sorted((x["start"], x["end"]) for x in found):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([start, end])
                last = 0
                for start, end in merged:
                    kept.update(raw[last:start])
                    last = end
                kept.update(raw[last:])
                rows.append((row, sum(e - s for s, e in merged), kept.hexdigest(), merged))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))))], ["_row", "removed", "cut_sha256", "cut_spans"])

    done = held.select("_row", "text").join(per_text, "_row").mapInArrow(cut, "_row long, removed long, cut_sha256 string, cut_spans array<array<int>>")
    known = materialize(texts.select("key", "_row", "copies").join(done, "_row", "left").drop("_row"))
    out = table.select(id_column, "key", "n_bytes", "sha256").join(known, "key")
    all_of_it = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        id_column, "n_bytes", F.when(all_of_it, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_of_it, 1).otherwise(F.coalesce(F.size("cut_spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_of_it, nothing).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
        F.when(all_of_it, F.array(F.array(F.lit(0), F.col("n_bytes").cast("int")))).otherwise(F.coalesce("cut_spans", F.array().cast("array<array<int>>"))).alias("spans"))
