"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in a normal form: A-Z lower-cased, runs of white space as one space. A test item of m characters may differ
by k = floor(``ERRORS`` * m) edits. It is split into k + 1 pieces, so that at least one piece occurs unchanged in every match.
An Aho-Corasick automaton over the pieces of a block of items finds all of them in one pass over a document. The pieces form
a ring, and some unchanged piece of every match is followed on the ring by one with at most one edit (otherwise the pieces
would hold more than k edits together), so a hit whose next piece differs more is dropped without loss. What is left is
verified with Myers' bit-parallel distance on the stretch around the hit, hits with close starts together.

Items form the stated query set: they are taken in blocks of at most ``BLOCK_CHARS`` characters, one block at a time on the
driver and in the tasks, and documents are scanned once per block, without a shuffle.

Defined cases: null or blank items match nothing; a null text counts as empty and matches nothing; repeated items and rows
each get their own rows; other columns are passed by.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, need

ERRORS, BLOCK_CHARS = 0.1, 1 << 20


def normal(text: pa.Array) -> pa.Array:
    """Lower-cased, with single spaces and none at the ends."""
    return pc.ascii_trim(pc.replace_substring_regex(pc.ascii_lower(text), r"[ \t-\r]+", " "), " ")


def pieces_of(item: str, errors: int) -> list[tuple[int, int]]:
    """Start and end of errors + 1 pieces of nearly equal length."""
    cut = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return list(itertools.pairwise(cut))


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance between the pattern and any substring of the text, and the end of the first such."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(horizontal | plus) & full)
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[object, str]], errors: float = ERRORS):
        self.items = [(key, text, int(errors * len(text))) for key, text in items if text]
        self.pieces = [pieces_of(text, k) for _, text, k in self.items]
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, text, _k) in enumerate(self.items):
            for j, (a, b) in enumerate(self.pieces[i]):
                at[text[a:b]].append((i, j))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, where)
        if at:
            self.automaton.make_automaton()

    def _starts(self, text: str) -> dict[int, set[int]]:
        """For each item where it may start, had it no edits before the unchanged piece."""
        starts: dict[int, set[int]] = defaultdict(set)
        for last, where in self.automaton.iter(text):
            for i, j in where:
                item, pieces, k = self.items[i][1], self.pieces[i], self.items[i][2]
                start = last + 1 - pieces[j][1]
                a, b = pieces[(j + 1) % len(pieces)]
                half = (a + b) // 2
                if j + 1 == len(pieces):  # around the ring: somewhere near the start
                    near = text[max(0, start - k) : max(0, start + b + k)]
                    good = item[a:half] in near or item[half:b] in near
                else:
                    q = last + 1
                    good = text.startswith(item[a:half], q) or item[half:b] in text[q + half - a - 1 : q + b - a + 1]
                if good:
                    starts[i].add(start)
        return starts

    def matches(self, text: str) -> Iterator[tuple[object, int, int]]:
        """Key, least distance and end (in the normal form) for each item that occurs."""
        if not self.items:
            return
        for i, starts in self._starts(text).items():
            key, item, k = self.items[i]
            found: list[tuple[int, int]] = []
            ordered = sorted(starts)
            low = ordered[0]
            for now, after in itertools.pairwise([*ordered, None]):
                if after is None or after - now > k:
                    begin = max(0, low - k)
                    distance, end = myers(item, text[begin : now + len(item) + k])
                    if distance <= k:
                        found.append((distance, begin + end))
                    low = after
            if found:
                yield key, *min(found)


def _blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[object, str]]]:
    """Items in normal form, a bounded block at a time."""
    block, size = [], 0
    for key, text in need(items, id_column, text_column).where(F.col(text_column).isNotNull()).toLocalIterator():
        text = normal(pa.array([text]))[0].as_py()
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((key, text))
        size += len(text)
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  item_id: str = "item_id", item_text: str = "text", errors: float = ERRORS) -> DataFrame:
    """A row per document and item that occurs in it: both ids, edits, and the match's end in the normal form."""
    narrow = need(docs, id_column, text_column)
    schema = T.StructType([T.StructField("doc", narrow.schema[id_column].dataType), T.StructField("item", items.schema[item_id].dataType),
                           T.StructField("edits", T.IntegerType()), T.StructField("match_end", T.IntegerType())])
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, errors)
            for batch, text in chunks(batches, text_column):
                found = [(row, *m) for row, x in enumerate(normal(text).to_pylist()) for m in matcher.matches(x)]
                rows, keys, edits, ends = ([f[c] for f in found] for c in range(4))
                yield pa.RecordBatch.from_arrays([batch.column(id_column).take(pa.array(rows, pa.int64())), pa.array(keys, arrow_id),
                                                  pa.array(edits, pa.int32()), pa.array(ends, pa.int32())], schema.names)

        from pyspark.sql.pandas.types import to_arrow_type

        arrow_id = to_arrow_type(schema["item"].dataType)
        out = out.unionByName(narrow.mapInArrow(run, schema))
    return out.withColumnsRenamed({"doc": id_column, "item": item_id})


def drop_contaminated(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id",
                      item_text: str = "text", errors: float = ERRORS) -> DataFrame:
    """The documents in which no item occurs, with all their columns."""
    need(docs, text_column)
    for block in _blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, errors)
            for batch, text in chunks(batches, text_column):
                yield batch.filter(pa.array([next(matcher.matches(x), None) is None for x in normal(text).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
