"""Quality rules on repetition: characters inside duplicated n-grams and duplicated lines.

Each task slices its rows into chunks of bounded bytes, turns the words of a chunk into codes and marks, for several
n-gram lengths, all words inside a window that the same document holds twice or more: windows are rolling 64-bit hashes in
numpy, so the cost per word does not depend on how often anything repeats. There is no shuffle.

Defined cases: a null text counts as empty; an empty text has no words, fails the base rule and is not kept; identical rows
get identical results; other columns of the input are passed by, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, docs_of, mix, need, repeated, words


@dataclass(frozen=True)
class Rules:
    """Limits. Shares are of all word characters; first occurrences count as covered."""

    min_words: int = 50
    base_gram: int = 3
    max_base_percent: int = 50
    gram_shares: tuple[tuple[int, float], ...] = ((5, 0.45), (7, 0.40), (10, 0.35))
    max_line_share: float = 0.30


MEASURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
    + [T.StructField(n, T.DoubleType()) for n in ("dup_line_share", "dup_gram_share")]
)

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _covered(codes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Words inside an n-word window that occurs twice or more in their row."""
    out = np.zeros(len(codes), bool)
    if len(codes) < n:
        return out
    last = len(codes) - n + 1
    rolling = np.zeros(last, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    hashed = mix(codes.astype(np.uint64))
    for j in range(n):
        rolling = rolling * base + hashed[j : j + last]
    inside = np.flatnonzero(rows[:last] == rows[n - 1 :])
    twice = inside[repeated(mix(rolling[inside] ^ mix(rows[inside].astype(np.uint64) + np.uint64(1 << 40))))]
    step = np.bincount(twice, minlength=len(codes) + 1) - np.bincount(twice + n, minlength=len(codes) + 1)
    return np.cumsum(step)[: len(codes)] > 0


def measure(text: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """All measures and verdicts of a chunk of texts without nulls."""
    size = len(text)
    per_row = lambda rows, w=None: np.bincount(rows, weights=w, minlength=size)
    encoded, rows = words(text)
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    letters = pc.utf8_length(encoded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(codes) else codes
    n_words, chars = per_row(rows).astype(np.int64), per_row(rows, letters).astype(np.int64)

    offsets = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)[: size + 1]
    raw = np.frombuffer(text.buffers()[2], np.uint8)[: offsets[-1]] if text.buffers()[2] else np.zeros(0, np.uint8)
    table = np.zeros(256, np.int64)
    table[list(SYMBOLS.encode())] = 1
    symbols = np.diff(np.concatenate([[0], np.cumsum(table[raw])])[offsets])

    lines = pc.split_pattern(text, "\n")
    flat, line_rows = lines.flatten(), docs_of(lines)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0)
    flat, line_rows = pc.filter(flat, full), line_rows[full.to_numpy(zero_copy_only=False)]
    line_codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, first = np.unique(line_rows * (len(flat) + 1) + line_codes, return_index=True)
    again = np.ones(len(flat), bool)
    again[first] = False
    long = pc.utf8_length(flat).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    dup_lines = per_row(line_rows[again]).astype(np.int64)
    line_share = per_row(line_rows[again], long[again]) / np.maximum(1, per_row(line_rows, long))

    n_repeat = per_row(rows[_covered(codes, rows, rules.base_gram)]).astype(np.int64)
    failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_base_percent * n_words)
    bad, worst = line_share > rules.max_line_share, np.zeros(size)
    for n, most in rules.gram_shares:
        hit = _covered(codes, rows, n)
        share = per_row(rows[hit], letters[hit]) / np.maximum(1, chars)
        bad |= share > most
        worst = np.maximum(worst, share)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": n_repeat,
            "base_failed": failed, "kept": ~failed & ~bad, "dup_line_share": line_share, "dup_gram_share": worst}


def quality_table(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: its id, the measures, and the verdict ``kept``."""
    docs = need(docs, id_column, text_column)
    schema = T.StructType([docs.schema[id_column], *MEASURES])
    names = MEASURES.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in chunks(batches, text_column):
            found = measure(text, rules)
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *[pa.array(found[n]) for n in names]], [id_column, *names])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_column: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    need(docs, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in chunks(batches, text_column):
            yield batch.filter(pa.array(measure(text, rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
