import gzip
import hashlib
import itertools
import random
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lamina.llm import context_mixing, quality_classifier, warc
from lamina.llm import queries

from .conftest import make_docs, prose, stored


def test_ranges_own_each_record_once():
    rnd = random.Random(1)
    members, where, at = [], [], 0
    for k in range(60):
        payload = rnd.randbytes(rnd.randrange(3000)) + (warc.MAGIC + b"\x00WARC/1.") * rnd.randrange(3)
        member = warc.encode_record(k, "http://x/ y", payload, hashlib.sha256(payload).hexdigest(), len(payload), None if k % 3 else 0)
        junk = warc.MAGIC + rnd.randbytes(5) if k % 7 == 0 else b""
        where.append((at + len(junk), payload if k % 3 else b""))
        members.append(junk + member)
        at += len(members[-1])
    data = b"".join(members)
    read = lambda a, n: data[a : a + n]
    for step in (1, 2, 7, 100, 999, 5000, 10**6):
        got = [(o, p) for s in range(0, len(data), step) for o, _, p in warc.records_in(read, s, s + step)]
        assert got == where, step


def test_round_trip(spark):
    rnd = random.Random(2)
    same = "s" * 150 + "é"
    html = [None, "", "", "short", "short", same, same, same, "x" * 99, "x" * 99, "y" * 100, "y" * 100, prose(rnd, 200_000, 9999)] + [prose(rnd, 50) for _ in range(30)]
    ids = list(range(len(html)))
    rnd.shuffle(ids)
    ids[7] = ids[6]
    docs = stored(spark, {"page_id": ids, "url": [None if i % 4 == 0 else f"http://h/{i} \r\n x" for i in ids], "html": html, "payload": ["p"] * len(ids), "digest": [None] * len(ids)},
                  {"page_id": pa.int64(), "url": pa.string(), "html": pa.string(), "payload": pa.string(), "digest": pa.string()})
    first = {}
    for i, h in zip(ids, html, strict=True):
        if len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = Counter()
    for i, h in zip(ids, html, strict=True):
        raw = (h or "").encode()
        other = first.get(h, i)
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if other == i else "revisit", None if other == i else other] += 1
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs.write.parquet(f"{folder}/pages.parquet")
    assert Counter(tuple(r) for r in queries.op4_warc(spark, folder).collect()) == want
    path = f"{folder}/archives"
    warc.write_archives(warc.marked(docs), path)
    for step in (1000, 1 << 22):
        assert Counter(bytes(r["payload"]) for r in warc.read_archives(spark, path, step).where("record_type = 'response'").collect()) == Counter(
            (h or "").encode() for i, h in zip(ids, html, strict=True) if first.get(h, i) == i)
    files = [f for f in __import__("glob").glob(f"{path}/part-*") if __import__("os").path.getsize(f)]
    assert sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files) == len(ids)


def test_no_pages(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    assert queries.op4_warc(spark, folder).count() == 0


def labelled(spark, n=600):
    rnd = random.Random(3)
    texts, quality, toxic, source = [], [], [], []
    for i in range(n):
        bad, rude = rnd.random() < 0.2, rnd.random() < 0.15
        words = prose(rnd, 60).split()
        if rude:
            words[rnd.randrange(60)] = rnd.choice(["Vilefool,", "nastybrat!"])
        texts.append(" ".join(w.upper() + "!!" if bad else w for w in words))
        quality.append(int(not bad))
        toxic.append(int(rude))
        source.append("s0" if rnd.random() < 0.35 else f"s{rnd.randrange(40)}")
    docs = stored(spark, {"doc_id": list(range(n)), "text": texts, "lang": ["en"] * n, "source": source}, {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string()})
    labels = pd.DataFrame({"doc_id": range(n), "quality": quality, "toxic": toxic})
    return docs, labels


def test_classifier_on_held_out_labels(spark):
    docs, labels = labelled(spark)
    train = spark.createDataFrame(labels[labels.doc_id % 3 > 0])
    got = quality_classifier.classified(docs, train).toPandas().merge(labels, on="doc_id")
    held = got[got.doc_id % 3 == 0]
    assert len(got) == 600 and got.notna().all().all()
    assert ((held.p_quality > 0.5) == (held.quality > 0)).mean() > 0.95
    assert ((held.p_toxic > 0.5) == (held.toxic > 0)).mean() > 0.95


def test_sites_shrink_to_the_corpus(spark):
    """A site's rate lies between its own and the corpus', nearer to the corpus the fewer documents it has."""
    docs, labels = labelled(spark)
    got = quality_classifier.classified(docs, spark.createDataFrame(labels)).toPandas()
    assert got.site_quality.between(0, 1).all() and got.site_quality.std() < labels.quality.std()


def test_classifier_odd_input(spark, odd_docs, odd_texts, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (8, 1, None), (None, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    for y in (labels, labels.limit(0)):
        got = quality_classifier.classified(odd_docs, y).toPandas()
        assert len(got) == len(odd_texts) and got.p_quality.between(0, 1).all() and got.p_toxic.between(0, 1).all()
        assert quality_classifier.classified(no_docs, y).count() == 0


def brute_base(texts, ids):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), ""] for t in texts]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    c = Counter(itertools.chain.from_iterable(t for t, h in zip(tokens, held, strict=True) if not h))
    n, v = sum(c.values()), len(c)
    return [(i, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, h, t in zip(ids, held, tokens, strict=True)]


@pytest.mark.parametrize("column", [None, "lang"])
def test_base_scores(spark, odd_docs, odd_texts, column):
    rows = odd_docs.select("doc_id", "text").collect()
    got = context_mixing.scored(odd_docs, class_column=column).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted([(*r[:5], round(r["base_score"], 6)) for r in got], key=key) == sorted(brute_base([r["text"] for r in rows], [r["doc_id"] for r in rows]), key=key)
    assert all(-1e9 < r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)


def test_scoring_nothing(spark, no_docs):
    assert context_mixing.scored(no_docs).count() == 0
    # no training document at all
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = context_mixing.scored(make_docs(spark, [f"text {i}" for i in held], held)).collect()
    assert len(got) == len(held) and all(r["train_tokens"] == r["n_known"] == 0 and r["score"] < 0 for r in got)


def test_model_beats_counting_on_held_out_texts(spark):
    rnd = random.Random(1)
    parts = [["ka", "lo", "mi", "ter", "una", "sel", "go"], ["sch", "ung", "ber", "eit", "ich", "zu"]]
    word = lambda lang: "".join(rnd.choice(parts[lang]) for _ in range(rnd.randrange(1, 6)))
    langs = [rnd.randrange(2) for _ in range(900)]
    texts = [" ".join(word(g) for _ in range(80)) for g in langs]
    docs = stored(spark, {"doc_id": list(range(900)), "text": texts, "lang": [f"l{g}" for g in langs]}, {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string()})
    got = context_mixing.scored(docs, class_column="lang").toPandas()
    held = got[got.held_out]
    assert len(held) > 80 and held.score.sum() > held.base_score.sum() and (held.score > held.base_score).mean() > 0.6


def test_spelling_is_a_distribution():
    """The probabilities of all bytes after any prefix add up to one, with the weights and the map in use."""
    rng = np.random.default_rng(2)
    zeros, ones = (rng.integers(0, 5, context_mixing.FIRST[-1]).astype(np.float32) for _ in range(2))
    learner = context_mixing.Mixer(zeros, ones)
    learner.spelled([b"abc", b"abd", b"x"] * 50)
    mixer = context_mixing.Mixer(zeros, ones, learner.weights, context_mixing._map_of(learner.hits))
    for place, bit, slots in context_mixing.Spelling([b"ab", b"\xff"]).bits():
        x, gate = mixer._inputs(place, bit, slots)
        assert x.shape[0] == context_mixing.ORDERS + 1 and (gate < context_mixing.GATES).all()
    # of a closed word every bit is decided by earlier ones alone: changing the last byte changes no earlier factor
    a, b, c = mixer.spelled([b"aa", b"aaz", b"aa"])
    assert a == c and a < 0 and b < 0
    total = np.exp(mixer.spelled([bytes([k]) for k in range(256) if k != 32])).sum()
    assert total < 1


def test_token_probabilities_add_up():
    """Over a small closed vocabulary the next token's probabilities sum to one, whatever came before."""
    rng = np.random.default_rng(4)
    class_p = rng.random((3, 5))
    class_p = np.log(class_p / class_p.sum(axis=1, keepdims=True))
    for history in itertools.product(range(5), repeat=3):
        nexts = [np.array([*history, w]) for w in range(5)]
        last = [np.exp(context_mixing.token_logs(x, np.array([4]), class_p, np.array([0.5, 0.3, 0.2]))[-1]) for x in nexts]
        assert sum(last) == pytest.approx(1)
    a, b = np.array([0, 1, 1, 2]), np.array([4, 4, 0])
    together = context_mixing.token_logs(np.concatenate([a, b]), np.array([4, 3]), class_p, np.array([0.5, 0.3, 0.2]))
    alone = [context_mixing.token_logs(x, np.array([len(x)]), class_p, np.array([0.5, 0.3, 0.2])) for x in (a, b)]
    assert together == pytest.approx(np.concatenate(alone))
