"""Fill-in-the-middle documents, cut between lines, by content-defined chunks and remembered chunk summaries.

1. A rolling hash of the last ``WINDOW`` bytes, taken over a whole slice of texts in numpy, ends a chunk wherever its low bits are
   zero, so a passage that many documents share falls into the same chunks in all of them, wherever it stands.
2. A chunk's summary is its number of code points, the places of its line ends (in bytes and in code points), and whether it holds
   a sentinel. Summaries are kept in a table by content: a chunk counts as known only if its bytes are equal. The table is
   bounded (``KNOWN_BYTES``, two generations), so a task's memory does not follow its input.
3. A document's line count is the sum of its chunks' counts. The chunk that holds a cut is found by bisection in their running
   sum, and the cut's byte and code point from that chunk's line ends. Sentinels that lie across chunks are looked for in the two
   bytes on either side of a border.

One pass over the texts, no shuffle; every task has its own table. Which texts are cut, where and in which order follows from
digests of the seed and the id alone.

Defined cases: a null or empty text is ``plain`` with an empty output; so is a text that holds a sentinel, unchanged; a null id
counts as the word ``null``; repeated rows and ids give repeated rows; other columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, need

SENTINELS = (b"<P>", b"<S>", b"<M>")
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
#: The rolling hash looks at so many bytes (a power of two); a chunk has 2**CUT_BITS bytes on average and LONGEST at most.
WINDOW, CUT_BITS, LONGEST = 32, 10, 8192
#: Bytes of chunks that a task's table of summaries holds in each of its two generations.
KNOWN_BYTES = 32 << 20


def chunk_ends(raw: np.ndarray, text_ends: np.ndarray, window: int = WINDOW, bits: int = CUT_BITS, longest: int = LONGEST) -> np.ndarray:
    """Ends of the chunks of concatenated texts: where the rolling hash says so, at every text's end, and after ``longest`` bytes."""
    rolling, base, span = (raw.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1), 0x01000193, 1
    while span < window:  # a hash of 2s bytes from two of s bytes
        wider = rolling.copy()
        wider[span:] += rolling[:-span] * np.uint32(base)
        rolling, base, span = wider, base * base % 2**32, 2 * span
    found = np.flatnonzero((rolling * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits) == 0) + 1
    ends = np.unique(np.concatenate([found, text_ends[text_ends > 0]]))
    size = np.diff(ends, prepend=0)
    parts = -(-size // longest)
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.minimum(np.repeat(ends - size, parts) + (part + 1) * longest, np.repeat(ends, parts))


class Summaries:
    """Line ends, code points and sentinels of chunks, by content, in a bounded table."""

    def __init__(self, limit: int = KNOWN_BYTES):
        self.limit, self.size, self.new, self.old, self.hits = limit, 0, {}, {}, 0

    def __getitem__(self, chunk: bytes) -> tuple[int, np.ndarray, np.ndarray, bool]:
        got = self.new.get(chunk)
        if got is not None:
            self.hits += 1
            return got
        got = self.old.get(chunk)
        if got is not None:
            self.hits += 1
        else:
            raw = np.frombuffer(chunk, np.uint8)
            lines = np.flatnonzero(raw == 10) + 1
            points = np.cumsum((raw & 0xC0) != 0x80)
            got = int(points[-1]), lines, points[lines - 1], any(s in chunk for s in SENTINELS)
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[chunk] = got
        self.size += len(chunk)
        return got


def draws(seed: int, key) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def cuts(parts: list[bytes], known: Summaries) -> tuple[int, bool, callable]:
    """Number of lines, whether a sentinel occurs, and a function from a number of lines to its end in bytes and code points."""
    found = [known[p] for p in parts]
    marked, edge = any(f[3] for f in found), b""
    for p in parts:
        marked = marked or any(s in edge + p[:2] for s in SENTINELS)
        edge = (edge + p)[-2:]
    lines = np.cumsum([len(f[1]) for f in found])
    first_byte, first_point = np.cumsum([0, *map(len, parts)]), np.cumsum([0, *[f[0] for f in found]])
    total = int(lines[-1]) + (not parts[-1].endswith(b"\n"))

    def end(count: int) -> tuple[int, int]:
        if count > lines[-1]:
            return int(first_byte[-1]), int(first_point[-1])
        if count == 0:
            return 0, 0
        k = int(np.searchsorted(lines, count))
        at = count - 1 - (int(lines[k - 1]) if k else 0)
        return int(first_byte[k] + found[k][1][at]), int(first_point[k] + found[k][2][at])

    return total, marked, end


def transformed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED,
                fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars and output of every document."""
    docs = need(docs, id_column, text_column)
    schema = T.StructType([docs.schema[id_column], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                           T.StructField("output", T.StringType())])
    before_prefix, before_suffix, before_middle = SENTINELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Summaries()
        for batch, text in chunks(batches, text_column):
            offsets = np.frombuffer(text.buffers()[1], np.int32)[: len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
            data = text.buffers()[2]
            raw = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
            view = memoryview(raw)
            ends = chunk_ends(raw, offsets[1:])
            place = np.searchsorted(ends, offsets, "right")
            rows = []
            for i, key in enumerate(batch.column(id_column).to_pylist()):
                a, b = int(offsets[i]), int(offsets[i + 1])
                whole = bytes(view[a:b])
                if a == b:
                    rows.append((0, "plain", None, None, whole))
                    continue
                stops = [a, *ends[place[i] : place[i + 1]].tolist()]
                n, marked, end = cuts([bytes(view[x:y]) for x, y in zip(stops, stops[1:])], known)
                h = draws(seed, key)
                if marked or h[2] % 100 >= fim_percent:
                    rows.append((n, "plain", None, None, whole))
                    continue
                (p, p_chars), (m, m_chars) = (end(x) for x in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                prefix, middle, suffix = whole[:p], whole[p:m], whole[m:]
                if h[3] % 100 < spm_percent:
                    form, out = "spm", (before_suffix, suffix, before_prefix, prefix, before_middle, middle)
                else:
                    form, out = "psm", (before_prefix, prefix, before_suffix, suffix, before_middle, middle)
                rows.append((n, form, p_chars, m_chars - p_chars, b"".join(out)))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
            columns[-1] = columns[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *columns], schema.names)

    return docs.mapInArrow(run, schema)


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output was made from; no part holds a sentinel, so each stands once."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    body, middle = F.substring_index(output, "<M>", 1), F.substring_index(output, "<M>", -1)
    # what stands before the second sentinel, without the first, and what stands behind the second
    prefix, suffix = F.substring(F.substring_index(body, "<S>", 1), 4, 2**31 - 1), F.substring_index(body, "<S>", -1)
    suffix_first, prefix_last = F.substring(F.substring_index(body, "<P>", 1), 4, 2**31 - 1), F.substring_index(body, "<P>", -1)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_last, middle, suffix_first))
            .otherwise(output))
