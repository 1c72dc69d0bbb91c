"""Best-fit packing of token sequences by the sum-of-squares rule.

Tokenizing: each task encodes every distinct word once (kept in a bounded per-worker table) and gathers the ids of its
documents in numpy, so the tokenizer's cost follows the vocabulary and not the text. Only (document, piece, length, checksum)
rows leave the task.

A text that holds added tokens of the tokenizer (such as an end marker) is cut there first; they are matched in the text as it
stands and have their own ids, as the tokenizer does it.

Packing: pieces of the full length are sequences of their own. The others are dealt into groups of about ``GROUP`` pieces; in
a group each piece goes where the sum of the squared counts of open bins per residual gap becomes smallest (a new bin
included). Bins that end the round open are unpacked, and their pieces form the next round's groups, half as many at most, of
``MOST`` times ``GROUP`` pieces at most. The last round is that of one group, or the one in which that bound keeps the number of
groups, because bins no longer close. There open bins are finally packed again in decreasing order, best fit. So no task holds
more than that bound, whatever the lengths, and sequences left partly empty exist only in the last round.

Defined cases: a null or empty text is the end id alone; a document of more than ``capacity`` ids is cut into pieces of that
length and a rest; repeated rows and null ids are packed like any others; other columns are passed by.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialize, need, words

CAPACITY, END_ID, GROUP = 4096, 1, 20_000
#: A late round's group holds the pieces of so many first ones at most.
MOST = 10
#: Most entries of a worker's table of encoded words; it starts anew beyond them.
KNOWN_WORDS = 600_000
#: A letter next to ASCII punctuation other than the apostrophe: the tokenizer always splits there.
PUNCT = r"[!-&(-/:-@\[-`{-~]"
#: Words that the tokenizer's normalizer leaves alone and that are one piece for its splitter.
PLAIN = re.compile(r"[a-zß-öø-ÿ]+")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    added = {t.content: k for k, t in tokenizer.get_added_tokens_decoder().items()}
    if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values()):
        raise ValueError("added tokens that depend on what stands around them are not supported")
    # what is encoded here lies between added tokens; in lower case it may look like one
    tokenizer.encode_special_tokens = True
    level = ByteLevel(add_prefix_space=False, use_regex=False)
    letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)])}
    return tokenizer, letters, {}, added


def encode_distinct(parts: list[str], path: str) -> list[bytes]:
    """Token ids of each string, as little-endian unsigned 32-bit numbers."""
    tokenizer, letters, known, _ = _tokenizer(path)
    if len(known) > KNOWN_WORDS:
        known.clear()
    odd = [p for p in parts if p not in known and not PLAIN.fullmatch(p)]
    for p, e in zip(odd, tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
        known[p] = np.array(e.ids, "<u4").tobytes()
    model = tokenizer.model
    out = []
    for p in parts:
        if (ids := known.get(p)) is None:
            ids = known[p] = np.array([t.id for t in model.tokenize(p.translate(letters))], "<u4").tobytes()
        out.append(ids)
    return out


def _gather(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` (of the given lengths, one after another) that the codes name, concatenated."""
    starts = np.cumsum(lengths) - lengths
    size = lengths[codes]
    ends = np.cumsum(size)
    return flat[np.repeat(starts[codes] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size


def token_ids(text: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all rows, each row closed by the end id, and the number of ids of each row."""
    added = _tokenizer(path)[3]
    marked = np.zeros(len(text), bool)
    for token in added:
        marked |= pc.match_substring(text, token).to_numpy(zero_copy_only=False)
    if not marked.any():
        return _closed(*_plain_ids(text, path), end_id)
    between = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    parts = [between.split(t) if m else [t] for t, m in zip(text.to_pylist(), marked, strict=True)]
    count = np.array([len(p) for p in parts])
    # every second part of a cut text is an added token
    own = np.array([added[p] if k % 2 else -1 for row in parts for k, p in enumerate(row)], np.int64)
    flat, size = _plain_ids(pa.array(["" if own_id >= 0 else p for own_id, p in zip(own.tolist(), [p for row in parts for p in row], strict=True)], pa.string()), path)
    lengths = np.where(own >= 0, 1, size)
    out = np.empty(lengths.sum(), "<u4")
    begin = np.cumsum(lengths) - lengths
    is_own = np.zeros(len(out), bool)
    is_own[begin[own >= 0]] = True
    out[is_own], out[~is_own] = own[own >= 0], flat
    return _closed(out, np.add.reduceat(lengths, np.cumsum(count) - count), end_id)


def _closed(flat: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id behind each row's."""
    out = np.full(len(flat) + len(lengths), end_id, "<u4")
    out[np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)] = flat
    return out, lengths + 1


def _plain_ids(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all rows, which hold no added token, and the number of ids of each row."""
    encoded, rows = words(pc.ascii_lower(text))
    spaced = encoded.dictionary
    for pattern in (rf"(\p{{L}})({PUNCT})", rf"({PUNCT})(\p{{L}})"):
        spaced = pc.replace_substring_regex(spaced, pattern, r"\1 \2")
    lists = pc.ascii_split_whitespace(spaced)
    parts = lists.flatten().dictionary_encode()
    ids = encode_distinct(parts.dictionary.to_pylist(), path)
    flat, count = _gather(np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64),
                          parts.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])]
    flat, size = _gather(flat, np.diff(ends), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    return flat, np.bincount(rows, weights=size, minlength=len(text)).astype(np.int64)


def token_pieces(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    docs = need(docs, id_column, text_column)
    schema = T.StructType([docs.schema[id_column], T.StructField("piece", T.IntegerType()),
                           *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in chunks(batches, text_column, 4 << 20):
            flat, lengths = token_ids(text, tokenizer_path, end_id)
            first, raw = np.cumsum(lengths) - lengths, memoryview(flat).cast("B")
            count = -(-lengths // capacity)
            row = np.repeat(np.arange(len(lengths)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, lengths[row] - start)
            at = 4 * (first[row] + start)
            crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_column).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start),
                                              pa.array(length), pa.array(crc, pa.int64())], schema.names)

    return docs.mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's gap, placing the items in the given order."""
    count = np.zeros(capacity + 1, np.int64)
    open_bins: dict[int, list[int]] = defaultdict(list)
    bins, offsets, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, s in enumerate(lengths.tolist()):
        here = count[s:]
        # change of the sum: a bin of gap g becomes one of gap g - s; a bin that becomes full leaves the sum
        change = np.where(here > 0, 2 * (count[: capacity + 1 - s] - here) + 2, np.iinfo(np.int64).max)
        if here[0]:
            change[0] = 1 - 2 * here[0]
        k = int(change.argmin())
        if change[k] <= (2 * count[capacity - s] + 1 if s < capacity else 0):
            gap = s + k
            count[gap] -= 1
            b = open_bins[gap].pop()
        else:
            gap, b = capacity, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i], gaps[b] = b, capacity - gap, gap - s
        if gap > s:
            count[gap - s] += 1
            open_bins[gap - s].append(b)
    return bins, offsets, np.array(gaps, np.int64)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, into the fullest bin that has room."""
    room = np.zeros(capacity + 1, np.int64)
    open_bins: dict[int, list[int]] = defaultdict(list)
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        k = int((room[s:] > 0).argmax())
        if room[s + k]:
            gap = s + k
            room[gap] -= 1
            b = open_bins[gap].pop()
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            room[gap - s] += 1
            open_bins[gap - s].append(b)
    return bins, offsets


def _placer(capacity: int, last: bool, level: int):
    """Packs one group; only the last round closes bins that are not full."""

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, gaps = sum_of_squares(lengths, capacity)
        left = np.flatnonzero(gaps[bins] > 0)
        if last and len(left):
            again, at = best_fit_decreasing(lengths[left], capacity)
            if again.max() + 1 < (gaps > 0).sum():
                bins[left], offsets[left] = len(gaps) + again, at
        closed = np.ones(len(rows), bool)
        closed[left] = last
        return rows.drop(columns="deal").assign(sequence_id=(level << 56) + (int(key[0]) << 24) + bins, offset=offsets, closed=closed)

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The pieces (a stored table with ``length``) with ``sequence_id`` and ``offset``."""
    added = {"sequence_id": T.LongType(), "offset": T.LongType(), "closed": T.BooleanType()}
    schema = T.StructType([*pieces.schema, *[T.StructField(n, t) for n, t in added.items()]])
    full = pieces.where(F.col("length") >= capacity)
    out = full.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, groups, last, level = pieces.where(F.col("length") < capacity), None, False, 1
    while not last:
        count = rest.count()
        # at most half as many groups as before, but none of more than ``MOST`` groups' pieces
        fewer = max(1, -(-count // (MOST * group)), min(count // group, groups // 2 if groups else count))
        last, groups = fewer == 1 or fewer == groups, fewer
        # dealt in turn, not by a key: equal rows spread over all groups
        dealt = rest.withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
        placed = materialize(dealt.groupBy("deal").applyInPandas(_placer(capacity, last, level), schema))
        out = out.unionByName(placed.where("closed").drop("closed"))
        rest, level = placed.where("not closed").select(*pieces.columns), level + 1
    return out


def packed_documents(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
                     capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document, with its sequence and its place there."""
    return pack(materialize(token_pieces(docs, tokenizer_path, id_column, text_column, capacity, end_id)), capacity)
