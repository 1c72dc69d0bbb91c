import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lamina.llm import graph, minhash, suffix_dedup

from .conftest import make_docs, prose


def bags(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        out.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)]) if w else Counter())
    return out


def brute_similarity(a, b):
    both = set(a) & set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in set(a) | set(b)) for d in both)


def test_probability_jaccard():
    rnd = random.Random(4)
    for _ in range(60):
        a, b = (Counter({rnd.randrange(30): rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 20))}) for _ in range(2))
        x, y = sorted(a), sorted(b)
        got = minhash.similarity(np.array(x, np.uint64), np.array([float(a[k]) for k in x]), np.array(y, np.uint64), np.array([float(b[k]) for k in y]))
        assert got == pytest.approx(brute_similarity(a, b))


def test_signature_estimates_it():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    b = np.concatenate([a[:40], rng.integers(1, 1 << 62, 15).astype(np.uint64)])
    wa, wb = (rng.integers(1, 6, len(x)).astype(float) for x in (a, b))
    signature = minhash.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 8192)
    i, j = np.argsort(a), np.argsort(b)
    assert (signature[0] == signature[1]).mean() == pytest.approx(minhash.similarity(a[i], wa[i], b[j], wb[j]), abs=0.025)


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(2000, 2100)]
    parent = {k: k for e in edges for k in e}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: root(k) for e in edges if e[0] != e[1] for k in e}


def class_of(texts, least=0.8):
    """Brute force: all pairs, then components."""
    bag, parent = bags(texts), list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in itertools.combinations(range(len(texts)), 2):
        if bag[i] == bag[j] or brute_similarity(bag[i], bag[j]) >= least - 1e-9:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def copies():
    rnd = random.Random(11)
    texts = []
    for _ in range(12):
        base = prose(rnd, rnd.randrange(30, 120)).split()
        for _ in range(rnd.randrange(1, 7)):  # near copies at any distance, so that some links join what others do not
            other = list(base)
            for _ in range(rnd.randrange(0, 5)):
                other[rnd.randrange(len(other))] = f"z{rnd.randrange(99)}"
            texts.append(" ".join(other))
    rnd.shuffle(texts)
    return texts + ["", None, " ", "a b", "A  b", "a b c"] + texts[:4]


def test_classes(spark, copies):
    docs = make_docs(spark, copies)
    rows = {r["doc_id"]: r for r in minhash.class_table(docs).collect()}
    want = class_of(copies)
    assert {i: r["class_id"] for i, r in rows.items()} == dict(enumerate(want))
    assert all(r["class_size"] == want.count(r["class_id"]) for r in rows.values())
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_odd_classes(odd_docs, odd_texts, no_docs):
    assert minhash.class_table(odd_docs).count() == len(odd_texts) and minhash.class_table(no_docs).count() == 0
    kept = minhash.keep_one(odd_docs)
    assert kept.schema == odd_docs.schema and kept.count() == len(set(class_of(odd_texts)))
    assert minhash.keep_one(no_docs).count() == 0


def brute_cut(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    for r in raws:
        spans = []
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + r[at:a], b
        yield len(r), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + r[at:]).hexdigest()


def test_suffix_dedup(spark, odd_docs, odd_texts, no_docs):
    rnd = random.Random(6)
    shared = [prose(rnd, n) for n in (90, 120, 200)]
    texts = [" ".join(rnd.choice([prose(rnd, rnd.randrange(5, 60)), rnd.choice(shared)[rnd.randrange(100) :]]) for _ in range(rnd.randrange(1, 6))) for _ in range(80)]
    texts += [x[: rnd.randrange(380, 430)] for x in texts[:20] * 3]
    for docs, all_texts in ((make_docs(spark, texts), texts), (odd_docs, odd_texts)):
        got = Counter(tuple(r)[1:] for r in suffix_dedup.deduplicated(docs).drop("spans").collect())
        assert got == Counter(brute_cut(all_texts, 400))
    assert suffix_dedup.deduplicated(no_docs).count() == 0


@pytest.mark.parametrize("hot", [1, 4, 20])
def test_suffix_dedup_splits_hot_grams(spark, hot):
    """A passage in most documents, whole and cut, runs of one byte, and repeats inside a document; every group above ``hot`` is split."""
    rnd = random.Random(hot)
    passage, line = prose(rnd, 150), prose(rnd, 14)
    texts = []
    for k in range(70):
        a, b = prose(rnd, rnd.randrange(5, 60)), prose(rnd, rnd.randrange(5, 60))
        cut = passage[rnd.randrange(len(passage) // 2) if k % 3 == 0 else 0 :][: rnd.randrange(300, 900) if k % 4 == 0 else None]
        texts.append(f"{a} {line} {cut} {line} {b}" if k % 5 else f"{a} {line} {b} {line}")
    texts += ["a" * n for n in (399, 400, 650, 1300)] + ["b" * 1000 + prose(rnd, 20), prose(rnd, 90) * 3, None, ""]
    got = Counter(tuple(r)[1:] for r in suffix_dedup.deduplicated(make_docs(spark, texts), hot=hot).drop("spans").collect())
    assert got == Counter(brute_cut(texts, 400))


def test_deep_shallow_and_spans_against_all_pairs():
    rnd = random.Random(1)
    for _ in range(150):
        n = rnd.randint(1, 25)
        group = np.array([rnd.choice([-5, 3, 9]) for _ in range(n)])
        contexts, offset = [], []
        for _ in range(n):
            a, b = ("".join(rnd.choice("ab\0") for _ in range(rnd.randint(0, m))) for m in (14, 30))
            if contexts and rnd.random() < 0.5:
                k = rnd.randrange(len(contexts))
                c = contexts[k].decode()
                a, b = (a + c[: offset[k]])[-14:], (c[offset[k] :] + b)[: rnd.randint(0, 40)]
            contexts.append((a + b).encode())
            offset.append(len(a))
        order, common = suffix_dedup.deep_shallow(contexts, group, 8)
        assert [(group[i], contexts[i]) for i in order] == sorted(zip(group, contexts, strict=True))
        for x, y, c in zip(order[:-1], order[1:], common[1:], strict=True):
            assert group[x] != group[y] or c == suffix_dedup.common_prefix(contexts[x], contexts[y])
        for length in (6, 10, 15):
            left, right = suffix_dedup.spans(group, contexts, np.array(offset), length)
            for i in range(n):
                best = [(0, 0)]
                for j in range(n):
                    if i != j and group[i] == group[j]:
                        r = suffix_dedup.common_prefix(contexts[i][offset[i] :], contexts[j][offset[j] :])
                        k = suffix_dedup.common_prefix(contexts[i][: offset[i]][::-1], contexts[j][: offset[j]][::-1])
                        best.append((k, r) if k + r >= length else (0, 0))
                assert (left[i], right[i]) == tuple(max(x) for x in zip(*best, strict=True))


def test_anchors_agree_in_equal_windows():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 100, 6000).astype(np.uint8)
    raw[4000:5500] = raw[500:2000]
    _, at, lo, hi = suffix_dedup.anchors(raw, np.array([0, 3000, 3000, 6000]), 200, 40)
    anchor = {}
    for a, s, e in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
        for p in range(s, e + 1):
            anchor[p] = a - p
    assert sorted(anchor) == [*range(2801), *range(3000, 5801)]
    groups = defaultdict(set)
    for p, o in anchor.items():
        groups[raw[p : p + 200].tobytes()].add(o)
    assert all(len(x) == 1 for x in groups.values())


def edited(seed, n, words=100):
    """Copies of one text with a few words changed each: most are too far from each other, and some links miss every hub."""
    rnd = random.Random(seed)
    base, texts = prose(rnd, words).split(), []
    for _ in range(n):
        other = list(base)
        for _ in range(rnd.randrange(2, 5)):
            other[rnd.randrange(len(other))] = f"z{rnd.randrange(10**6)}"
        texts.append(" ".join(other))
    return texts


def set_class_of(texts):
    """``class_of`` for texts whose shingles all occur once."""
    bag, parent = [set(b) for b in bags(texts)], list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(bag[i] & bag[j])
        if both >= 0.8 * (len(bag[i]) + len(bag[j]) - both):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(k) for k in range(len(texts))]


def test_links_that_miss_every_hub(spark):
    texts = edited(2, 400)
    got = {r["doc_id"]: r["class_id"] for r in minhash.class_table(make_docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == set_class_of(texts)


def test_cross_links_of_many_blocks(spark):
    texts = edited(5, 60) + copies_with_weights()
    sets = minhash.weighted_sets(make_docs(spark, texts).withColumn("_row", minhash.F.col("doc_id")), "text").cache()
    members = spark.createDataFrame([(7, i, i // 2 if i < 20 else i) for i in range(len(texts))], "bucket long, node long, component long")
    want = class_of(texts)
    for block_bytes in (1 << 20, 4000):
        links = [tuple(r) for r in minhash.cross_links(members, sets, 0.8, block_bytes).collect()]
        bag = bags(texts)
        assert all(a < b and brute_similarity(bag[a], bag[b]) >= 0.8 - 1e-9 for a, b in links)
        label = list(range(len(texts)))
        for a, b in links + [(k, k + 1) for k in range(0, 20, 2)]:
            label = [label[a] if x == label[b] else x for x in label]
        joined = {(want[k], want[k + 1]) for k in range(0, 20, 2)}
        merged = list(want)
        for a, b in joined:
            x, y = merged[want.index(a)], merged[want.index(b)]
            merged = [x if m == y else m for m in merged]
        assert all((label[i] == label[j]) == (merged[i] == merged[j]) for i, j in itertools.combinations(range(len(texts)), 2))


def copies_with_weights():
    """Texts with repeated shingles, similar by weight."""
    rnd = random.Random(3)
    line = prose(rnd, 12)
    return [" ".join([line] * rnd.randrange(2, 6) + prose(rnd, 2).split()) for _ in range(12)]


@pytest.fixture
def unsteady_scans(spark, monkeypatch):
    """Every step plans its scan for another number of cores, as after the loss of an executor."""
    turns = itertools.cycle([1, 64])
    names = ["spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    for module in (minhash, suffix_dedup):
        def step(*args, materialize=module.materialize, **kw):
            spark.conf.set(names[0], 0)
            spark.conf.set(names[1], next(turns))
            return materialize(*args, **kw)
        monkeypatch.setattr(module, "materialize", step)
    yield
    for n in names:
        spark.conf.unset(n)


def test_rows_keep_their_numbers(spark, copies, unsteady_scans):
    docs = make_docs(spark, copies)
    assert sorted(r["doc_id"] for r in minhash.keep_one(docs).collect()) == sorted(set(class_of(copies)))
    rnd = random.Random(8)
    shared = prose(rnd, 150)
    texts = [prose(rnd, rnd.randrange(20, 90)) + (shared if k % 3 else "") + prose(rnd, 30) for k in range(40)]
    got = Counter(tuple(r)[1:] for r in suffix_dedup.deduplicated(make_docs(spark, texts)).drop("spans").collect())
    assert got == Counter(brute_cut(texts, 400))
