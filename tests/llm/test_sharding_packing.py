import os
import random
import zlib
from functools import lru_cache
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import packing, sharding

from .conftest import make_docs, prose

PATH = __import__("public_tokenizers").path("word_bpe_49k.json")


def test_shards(spark, odd_docs, odd_texts, no_docs):
    rnd = random.Random(5)
    texts = [prose(rnd, rnd.randrange(1, 200)) for _ in range(1500)]
    for docs, all_texts in ((odd_docs, odd_texts), (make_docs(spark, texts), texts)):
        rows = sharding.sharded(docs).collect()
        assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in all_texts)
        places = defaultdict(list)
        for r in rows:
            places[r["shard"]].append(r["slot"])
        assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(16))
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert len(load) == 16 and max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)
    assert sharding.sharded(no_docs).count() == 0


def test_map_is_greedy_and_rebalancing_moves_into_the_new_shard_only(spark):
    rnd = random.Random(1)
    sizes = [(k, rnd.randrange(1, 1000), rnd.randrange(1, 9)) for k in range(300)]
    frame = spark.createDataFrame(sizes, "virtual_slot int, bytes long, rows long")
    first = sharding.balanced_map(frame, 5)
    loads, want = [0] * 5, {}
    for b, k in sorted(((b, k) for k, b, _ in sizes), reverse=True):
        want[k] = loads.index(min(loads))
        loads[want[k]] += b
    old = {r["virtual_slot"]: r for r in first.collect()}
    assert {k: r["shard"] for k, r in old.items()} == want
    new = {r["virtual_slot"]: r for r in sharding.rebalanced(first, 5).collect()}
    assert all(r["version"] == 2 and r["shard"] in (old[k]["shard"], 5) for k, r in new.items())
    grown = Counter()
    for r in new.values():
        grown[r["shard"]] += r["bytes"]
    mean = sum(loads) / 6
    assert abs(grown[5] - mean) < 5 * 1000 and all(grown[k] >= mean - 1 for k in range(5))


@lru_cache
def plain_tokenizer():
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(PATH)


def reference_ids(text):
    tokenizer = plain_tokenizer()
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_the_tokenizers(odd_texts):
    tricky = ["it's don't 'tis we'LL x's", "A.B,C!d?e", "İstanbul ΑΣ ΣΑΣ ﬁ", "éa̸ ≠ a.́b", "naïve café!! ÀÉ çß÷ñ", "<|endoftext|> <|startoftext|>", "end here <|endoftext|> next", "A<|endoftext|>É.<|startoftext|><|startoftext|>x", "<|ENDOFTEXT|> a<|EndOfText|>b", "a b c",
              "x1y22z 3.14 #tag", "日本語 テスト。", "…!… a…b", "'s 's' ''s", "a-b_c", "\x00\x01 a\x1cb", "😀😀a 😀"]
    texts = [t or "" for t in odd_texts] + tricky
    flat, lengths = packing.token_ids(pa.array(texts), PATH)
    for t, ids in zip(texts, np.split(flat, np.cumsum(lengths)[:-1]), strict=True):
        assert ids.tolist() == reference_ids(t), t[:80]


@pytest.mark.parametrize("seed", range(4))
def test_sum_of_squares_places_by_its_rule(seed):
    rnd = random.Random(seed)
    capacity, lengths = 20, [rnd.randrange(1, 20) for _ in range(200)]
    bins, offsets, gaps = packing.sum_of_squares(np.array(lengths), capacity)
    fill: dict[int, int] = {}
    for s, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        square = lambda f: sum(n * n for n in Counter(capacity - x for x in f.values() if x < capacity).values())
        options = [square({**fill, k: x + s}) for k, x in fill.items() if x + s <= capacity] + [square({**fill, -1: s})]
        assert o == fill.get(b, 0)
        fill[b] = fill.get(b, 0) + s
        assert fill[b] <= capacity and square(fill) == min(options)
    assert gaps.tolist() == [capacity - fill[b] for b in range(len(gaps))]


def test_packed(spark, odd_docs, odd_texts, no_docs):
    rnd = random.Random(2)
    texts = [prose(rnd, rnd.randrange(1, 700)) for _ in range(400)] + odd_texts
    docs = make_docs(spark, texts)
    for group in (packing.GROUP, 150):
        pieces = packing.materialize(packing.token_pieces(docs, PATH))
        rows = packing.pack(pieces, group=group).collect()
        inside = defaultdict(list)
        for r in rows:
            inside[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in inside.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
        by = defaultdict(list)
        for r in rows:
            by[r["doc_id"]].append(r)
        for i, t in enumerate(texts):
            ids = reference_ids(t)
            cut = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
            got = sorted(by[i], key=lambda r: r["piece"])
            assert [(r["start"], r["length"], r["ids_crc32"]) for r in got] == [(4096 * k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(cut)]
        assert len(inside) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    assert packing.packed_documents(odd_docs, PATH).count() >= len(odd_texts)
    assert packing.packed_documents(no_docs, PATH).count() == 0


def test_groups_are_bounded_where_no_bin_closes(spark):
    pieces = packing.materialize(spark.range(30_000).select("id", F.lit(3000).cast("long").alias("length")))
    rows = packing.pack(pieces, group=1000).groupBy(F.shiftright("sequence_id", 24).alias("group")).agg(F.count("*").alias("n"), F.countDistinct("sequence_id").alias("bins")).collect()
    assert sum(r["bins"] for r in rows) == 30_000 and 1000 <= max(r["n"] for r in rows) <= 10_100
