"""Helpers that several of the text operators share: chunking, words, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import ship_package, stored as materialize

__all__ = ["chunks", "docs_of", "materialize", "mix", "need", "numbered", "repeated", "ship_package", "words"]

#: Text bytes that one numpy pass works on; bounds a task's memory, whatever the batch size.
CHUNK_BYTES = 8 << 20


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Those columns alone, by name; extra columns never get into an operator's working set."""
    ship_package(df.sparkSession)
    return df.select(*[df[c] for c in columns])


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """``docs`` with a number for each row, stored, so that all that reads it later sees the same numbers.

    The number itself depends on how a scan is split, and the split on the cores registered at that time.
    """
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "zstd")


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of at most ``limit`` text bytes (one row at least) with their text, null as empty."""
    for batch in batches:
        text = pc.fill_null(batch.column(column), "")
        size = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        start, base = 0, 0
        while start < len(size):
            end = max(start + 1, int(np.searchsorted(size, base + limit, "right")))
            # the concat gives the slice buffers of its own, starting at offset 0
            yield batch.slice(start, end - start), pa.concat_arrays([text.slice(start, end - start)])
            start, base = end, size[end - 1]


def docs_of(lists: pa.ListArray) -> np.ndarray:
    """For each flattened element the number of its row."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def words(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words (maximal runs free of ASCII white space) of all rows, and each word's row."""
    lists = pc.ascii_split_whitespace(text)
    flat, rows = lists.flatten(), docs_of(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    return pc.filter(flat, full).dictionary_encode(), rows[full.to_numpy(zero_copy_only=False)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64): spreads every input bit over the word."""
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys occur twice or more; a coarse count first, so that few keys are sorted."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    bits = max(10, int(len(keys)).bit_length() + 2)
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
    order = maybe[np.argsort(keys[maybe], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
