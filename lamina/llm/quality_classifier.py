"""Quality by hierarchical empirical Bayes: a document's own evidence and what is known of its site and path.

1. Document evidence. Words and shapes are hashed into ``BUCKETS`` features; a logistic regression per label is fitted on a
   bounded sample of labelled rows (``SAMPLE``, by hash of the id) and calibrated on a fifth of it. Its weights have a fixed
   size, the only thing broadcast.
2. Sites. Labels, and calibrated probabilities where there is no label, are summed per path and host in grouped aggregations
   over all documents. A beta prior around the global rate is fitted to the hosts by the method of moments, and one around
   each host's posterior to its paths, so a sparse path leans on its host and a sparse host on the corpus.
3. A document's log odds are its evidence plus what its path's posterior adds to the global prior. A document is not counted
   in its own path's rate.

Defined cases: a null text counts as empty; null hosts and paths are sites of their own; without labels of both values a label
has evidence 0 and the global rate decides; repeated rows count as often as they occur; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialize, need, words

BUCKETS, SAMPLE, MIN_DOCS, MIN_GAIN = 1 << 18, 20_000, 4, 15.0
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Upper bounds of the share classes that shapes and repetition are put into.
SHARES = np.array([0.001, 0.02, 0.1, 0.3, 0.6])
EPSILON = 1e-6


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every distinct feature of each row: its words without punctuation, shares of shapes, repetition."""
    encoded, rows = words(text)
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kinds, size = encoded.dictionary, len(text)
    if not len(codes):
        return np.arange(size), np.zeros(size, np.int64)
    bare = pc.utf8_trim(pc.utf8_lower(kinds), PUNCTUATION)
    bucket = (pd.util.hash_array(bare.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(BUCKETS - 1024)).astype(np.int64) + 1024
    tests = [pc.utf8_is_upper(kinds), pc.match_substring_regex(kinds, r"[#*$%&|<>!]$"), pc.match_substring_regex(kinds, r"[0-9]"),
             pc.equal(bare, "")]
    pairs = [rows * BUCKETS + bucket[codes]]
    count = np.bincount(rows, minlength=size)
    first = np.unique(rows * (len(kinds) + 1) + codes)
    shares = [np.bincount(rows, x.to_numpy(zero_copy_only=False).astype(float)[codes], size) for x in tests]
    shares.append(count - np.bincount(first // (len(kinds) + 1), minlength=size))
    for k, share in enumerate(shares):
        pairs.append(np.arange(size) * BUCKETS + 1 + k * 16 + np.searchsorted(SHARES, share / np.maximum(1, count)))
    pairs.append(np.arange(size) * BUCKETS + 1 + 160 + np.minimum(15, np.log2(count + 1).astype(np.int64)))
    flat = np.unique(np.concatenate(pairs))
    return flat // BUCKETS, flat % BUCKETS


def _telling(buckets: np.ndarray, label: np.ndarray, rate: float) -> np.ndarray:
    """Features in MIN_DOCS rows or more whose share of positive rows departs from the rate by a G statistic of MIN_GAIN."""
    n = np.bincount(buckets, minlength=BUCKETS).astype(float)
    yes = np.bincount(buckets[label], minlength=BUCKETS).astype(float)
    gain = sum(2 * x * np.log(np.maximum(x, 1e-9) / np.maximum(n * r, 1e-9)) for x, r in ((yes, rate), (n - yes, 1 - rate)))
    return (n >= MIN_DOCS) & (gain >= MIN_GAIN)


def fit(rows: np.ndarray, buckets: np.ndarray, label: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, float, float]:
    """Weights, slope and shift: log odds = slope * sum of weights + shift. Rows 0 mod 5 calibrate, the others fit."""
    size = len(label)
    weights = np.zeros(BUCKETS)
    train = np.arange(size) % 5 > 0
    if min(label[train].sum(), (~label[train]).sum()) < 2:
        return weights, 0.0, 0.0
    use = _telling(buckets[train[rows]], label[rows][train[rows]], label[train].mean())[buckets]
    rows, buckets = rows[use], buckets[use]
    target, own = label.astype(float), train[rows]
    bias, seen = np.log(target[train].mean() / (1 - target[train].mean())), np.full(BUCKETS, EPSILON)
    for _ in range(rounds):
        odds = bias + np.bincount(rows, weights[buckets], size)
        error = np.where(train, 1 / (1 + np.exp(-odds)) - target, 0)
        slope = np.bincount(buckets[own], error[rows[own]], BUCKETS) + 0.05 * weights
        seen += slope**2
        weights -= 0.5 * slope / np.sqrt(seen)
        bias -= 2 * error.sum() / train.sum()
    odds = bias + np.bincount(rows, weights[buckets], size)
    held, truth = odds[~train], target[~train]
    scale, shift = 1.0, 0.0
    for _ in range(200):  # Platt's two numbers, by gradient, with a weak pull to (1, 0)
        error = 1 / (1 + np.exp(-(scale * held + shift))) - truth
        spread = max(1.0, float((held**2).mean())) if len(held) else 1.0
        scale -= (float((error * held).mean()) + 0.01 * (scale - 1)) / spread if len(held) else 0.0
        shift -= float(error.mean()) + 0.01 * shift if len(held) else 0.0
    return weights, max(scale, 0.05), scale * bias + shift


def _sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, names: list[str]) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Features and labels of at most SAMPLE labelled documents."""
    chosen = labels.select(id_column, *names).dropna().orderBy(F.xxhash64(id_column), id_column).limit(SAMPLE)
    picked = need(docs, id_column, text_column).join(F.broadcast(chosen), id_column).limit(2 * SAMPLE)
    schema = T.StructType([*[T.StructField(n, T.LongType()) for n in names], T.StructField("found", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in chunks(batches, text_column):
            rows, buckets = features(text)
            cut = np.cumsum(np.bincount(rows, minlength=len(text)))[:-1]
            found = [x.astype("<i4").tobytes() for x in np.split(buckets, cut)]
            yield pa.RecordBatch.from_arrays([*[pc.cast(batch.column(n), pa.int64()) for n in names], pa.array(found, pa.binary())], schema.names)

    got = picked.mapInArrow(run, schema).toPandas().sort_values("found", kind="stable", ignore_index=True)
    # an order that depends on the rows alone, then mixed so that the calibration fifth is not a stretch of it
    got = got.sample(frac=1, random_state=1, ignore_index=True) if len(got) else got
    each = [np.frombuffer(x, "<i4") for x in got["found"]]
    rows = np.repeat(np.arange(len(each)), [len(x) for x in each]) if each else np.zeros(0, np.int64)
    return rows, np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64), got


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), p))
    return F.log(p / (1 - p))


def _strength(rate: Column, n: Column, mean: Column) -> list[Column]:
    """Aggregates for the prior's strength by the method of moments, over sites with n observations and a rate."""
    spread = F.sum(n * (rate - mean) ** 2) / F.sum(n)
    noise = F.count(n) / F.sum(n)
    return [spread.alias("spread"), noise.alias("noise")]


def classified(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
               path_column: str = "lang", names: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """One row per document: id, and for each label its evidence (log odds), site rate and final probability."""
    names = list(names)
    spark = docs.sparkSession
    rows, buckets, got = _sample(docs, labels, id_column, text_column, names)
    models = [fit(rows, buckets, got[n].to_numpy() > 0) for n in names]
    shared = spark.sparkContext.broadcast([(w.astype(np.float32), a, b) for w, a, b in models])
    narrow = need(docs, id_column, text_column, host_column, path_column).toDF("_id", "_text", "_host", "_path")
    schema = T.StructType([*[f for f in narrow.schema if f.name != "_text"], *[T.StructField(f"e_{n}", T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in chunks(batches, "_text"):
            row, bucket = features(text)
            odds = [pa.array(a * np.bincount(row, w[bucket].astype(float), len(text)) + b) for w, a, b in shared.value]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_host"), batch.column("_path"), *odds], schema.names)

    known = labels.select(F.col(id_column).alias("_id"), *[F.col(n).cast("double").alias(f"y_{n}") for n in names])
    known = known.groupBy("_id").agg(*[F.max(f"y_{n}").alias(f"y_{n}") for n in names])
    scored = materialize(narrow.mapInArrow(run, schema).join(known, "_id", "left"))
    for n in names:
        scored = scored.withColumn(f"v_{n}", F.coalesce(f"y_{n}", 1 / (1 + F.exp(-F.col(f"e_{n}")))))
    paths = materialize(scored.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"v_{n}").alias(f"s_{n}") for n in names]))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("host_n"), *[F.sum(f"s_{n}").alias(f"host_{n}") for n in names])
    sites = paths.join(hosts, paths["_host"].eqNullSafe(hosts["_host"])).drop(hosts["_host"])
    for n in names:
        mean = paths.agg(F.sum(f"s_{n}") / F.sum("n")).scalar()

        def prior(spread: DataFrame, mean: Column = mean) -> Column:
            """Strength in documents: between-site variance is the spread less the sampling noise."""
            noise = F.col("noise") * mean * (1 - mean)
            extra = F.greatest(F.col("spread") - noise, mean * (1 - mean) / 1000 + EPSILON**2)
            return spread.select(F.greatest(F.lit(1.0), mean * (1 - mean) / extra)).scalar()

        host_prior = prior(hosts.agg(*_strength(F.col(f"host_{n}") / F.col("host_n"), F.col("host_n"), mean)))
        path_prior = prior(sites.agg(*_strength(F.col(f"s_{n}") / F.col("n"), F.col("n"), F.col(f"host_{n}") / F.col("host_n"))))
        sites = sites.withColumns({f"mean_{n}": mean, f"k_{n}": path_prior,
                                   f"hp_{n}": (F.col(f"host_{n}") + host_prior * mean) / (F.col("host_n") + host_prior)})
    sites = materialize(sites)
    out = scored.join(sites, scored["_host"].eqNullSafe(sites["_host"]) & scored["_path"].eqNullSafe(sites["_path"]))
    columns = [F.col("_id").alias(id_column)]
    for n in names:
        rate = (F.col(f"s_{n}") - F.col(f"v_{n}") + F.col(f"k_{n}") * F.col(f"hp_{n}")) / (F.col("n") - 1 + F.col(f"k_{n}"))
        odds = F.col(f"e_{n}") + _logit(rate) - _logit(F.col(f"mean_{n}"))
        columns += [F.col(f"e_{n}").alias(f"evidence_{n}"), rate.alias(f"site_{n}"), (1 / (1 + F.exp(-odds))).alias(f"p_{n}")]
    return out.select(*columns)
