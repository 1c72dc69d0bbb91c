"""Fill-in-middle, Merkle proofs and the prefix-tree join beside brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import fill_in_middle, merkle, prefix_tree
from lamina.llm.common import materialize

from .conftest import make_docs, prose

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def forms(key, text):
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    d = H(f"7:{'null' if key is None else key}")
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(lines)
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def lined(rnd, n):
    return "".join(rnd.choice(["word ", "é", "x", "😀", "\n", "\n\n", "<", "P>", "<S", ">", "a\r\n", "line of some length "]) for _ in range(n))


def test_chunks_follow_contents():
    rng = np.random.default_rng(0)
    shared, ends = rng.integers(0, 255, 60_000).astype(np.uint8), []
    for lead in (0, 777, 20_011):
        raw = np.concatenate([rng.integers(0, 255, lead).astype(np.uint8), shared])
        got = fill_in_middle.chunk_ends(raw, np.array([len(raw)]))
        assert got[-1] == len(raw) and (np.diff(got, prepend=0) <= fill_in_middle.LONGEST).all() and (np.diff(got) > 0).all()
        ends.append({int(e) - lead for e in got if e > lead + 20_000})
    assert len(ends[0] & ends[1] & ends[2]) >= 0.9 * len(ends[0]) > 20
    got = fill_in_middle.chunk_ends(np.zeros(50_000, np.uint8), np.array([0, 10, 10, 50_000]))
    assert {10, 50_000} <= set(got.tolist()) and np.diff(got, prepend=0).max() <= fill_in_middle.LONGEST


@pytest.mark.parametrize("limit", [fill_in_middle.KNOWN_BYTES, 3000])
def test_summaries_locate_lines(limit):
    rnd, known = random.Random(3), fill_in_middle.Summaries(limit)
    passage = lined(rnd, 4000)
    for _ in range(60):
        text = lined(rnd, rnd.randrange(1, 60)) + passage[: rnd.randrange(9000)] + lined(rnd, 3)
        raw = np.frombuffer(text.encode(), np.uint8)
        stops = [0, *fill_in_middle.chunk_ends(raw, np.array([len(raw)]), bits=rnd.choice([2, 5, 8])).tolist()]
        n, marked, end = fill_in_middle.cuts([raw[a:b].tobytes() for a, b in zip(stops, stops[1:])], known)
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert n == len(lines) and marked == any(s in text for s in ("<P>", "<S>", "<M>"))
        for k in {0, n, rnd.randrange(n + 1), rnd.randrange(n + 1)}:
            head = "".join(lines[:k])
            assert end(k) == (len(head.encode()), len(head))
    assert known.hits > 0


def test_fill_in_middle(spark, odd_docs, odd_texts, no_docs):
    rnd = random.Random(5)
    shared = lined(rnd, 3000).replace("<", "(")
    texts = [*odd_texts, *[lined(rnd, rnd.randrange(200)) for _ in range(150)], *[prose(rnd, 5).replace(" ", "\n") + shared for _ in range(20)],
             "\n", "\n\n", "no end", "<<P", "<P>", "a<", "<S\n>", shared * 300]
    ids = [None, *range(1, len(texts))]
    docs = make_docs(spark, texts, ids)
    out = fill_in_middle.transformed(docs)
    rows = {r["doc_id"]: r for r in out.withColumn("back", fill_in_middle.restored()).collect()}
    assert len(rows) == len(texts)
    for key, text in zip(ids, texts, strict=True):
        r = rows[key]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == forms(key, text), text and text[:50]
        assert r["back"] == (text or "")
    assert {r["form"] for r in rows.values()} == {"plain", "psm", "spm"}
    assert fill_in_middle.transformed(odd_docs).count() == len(odd_texts) and fill_in_middle.transformed(no_docs).count() == 0
    assert {r["form"] for r in fill_in_middle.transformed(docs, fim_percent=0).collect()} == {"plain"}


def leaf_of(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def own_path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 8 * 8
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
        at //= 8
    return out


def brute_proofs(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of([r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top, out = brute_tree([trees[g][-1][0] for g in names]), []
    for k, g in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = own_path(trees[g], at) + own_path(top, k)
            fold, key = leaf, r["doc_id"]
            if key is not None and zlib.crc32(str(key).encode()) % 3 == 0:
                low = r["text"] and re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])
                fold = leaf_of([key, r["source"], g, r["n_chars"], low])
            for left, right in path:
                fold = H(left + fold + right)
            out.append((key, leaf, trees[g][-1][0], top[-1][0], H("".join(a + b for a, b in path)), fold))
    return out


def proof_rows(docs):
    lowered = F.translate("text", merkle.LETTERS, merkle.LETTERS.lower())
    got = merkle.proofs(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": lowered}, F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(), merkle.folded(F.coalesce("other", "leaf"))).collect()]


def canonical(rows):
    return sorted(rows, key=repr)


def test_merkle(spark, odd_docs, no_docs):
    rnd = random.Random(1)
    wide = make_docs(spark, [prose(rnd, 6).title() for _ in range(700)])
    names = F.concat(F.lit("é"), (F.col("doc_id") % 70).cast("string"))
    cases = [odd_docs, wide.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, "en").when(F.col("doc_id") % 12 > 0, names)).withColumn("doc_id", F.col("doc_id") % 300),
             wide.where("doc_id = 7"), wide.where("doc_id < 8").withColumn("lang", F.lit(None).cast("string"))]
    for docs in cases:
        docs = materialize(docs)
        got, want = proof_rows(docs), brute_proofs([r.asDict() for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
        assert canonical(got) == canonical(want)
    assert proof_rows(no_docs) == []


def test_merkle_notices_every_change(spark):
    docs = make_docs(spark, [f"Text {k}" if k % 2 else f"text {k}" for k in range(200)])
    for r in proof_rows(docs):
        changed = r[0] % 2 and zlib.crc32(str(r[0]).encode()) % 3 == 0
        assert (r[5] == r[3]) != bool(changed)


def brute_components(ids, texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, key in enumerate(ids):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted([(key, len(s), least.get(root(i))) for i, (key, s) in enumerate(zip(ids, sets, strict=True))], key=repr)


def test_sets_are_the_words(odd_texts):
    texts = [t or "" for t in odd_texts]
    for got, (_, n, _) in zip(prefix_tree.ngram_sets(pa.array(texts)), [brute_components([0], [t])[0] for t in texts], strict=True):
        assert len(got) == n and (np.diff(got.astype(object)) > 0).all()


@pytest.mark.parametrize("seed", range(6))
def test_tree_finds_all_partners(seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64) for _ in range(6)]
    sets = {tuple(b[rng.random(len(b)) > rng.choice([0, 0.03, 0.1])].tolist()) for b in base for _ in range(25)} | {tuple(b.tolist()) for b in base}
    sets |= {tuple(b[: len(b) // 2].tolist()) for b in base}
    sets = [np.array(s, np.uint64) for s in sets if s]
    tree = prefix_tree.Tree(sets, segment=int(rng.choice([1, 7, 64])))
    for i in [*range(0, len(sets), 5)]:
        x = set(sets[i].tolist())
        want = [j for j, s in enumerate(sets) if 100 * len(x & set(s.tolist())) >= 85 * len(x | set(s.tolist()))]
        assert sorted(tree.probe(sets[i]).tolist()) == want
    assert len(prefix_tree.Tree([]).probe(sets[0])) == 0


@pytest.fixture(scope="module")
def near_texts():
    rnd = random.Random(12)
    out, base = [], prose(rnd, 150, 4000).split()
    template = prose(rnd, 60, 4000)
    for k in range(130):  # a group of edited copies, a few edits at least, so that not all are near to each other
        w = list(base)
        for _ in range(rnd.randrange(1, 7)):
            w[rnd.randrange(len(w))] = f"edit{k}{rnd.randrange(99)}"
        out.append(" ".join(w))
    out += [f"{template} {prose(rnd, rnd.randrange(8, 90), 4000)}" for _ in range(40)]
    out += [prose(rnd, rnd.randrange(1, 12), 6) for _ in range(50)]
    out += [out[0], out[0].upper(), *out[200:210]]
    return out


def test_join(spark, near_texts, odd_docs, odd_texts, no_docs):
    ids = [None, None, *range(2, len(near_texts))]
    ids[20] = 30
    want = brute_components(ids, near_texts)
    docs = make_docs(spark, near_texts, ids)
    for block in (prefix_tree.BLOCK_BYTES, 20_000):
        assert sorted(map(tuple, prefix_tree.linked(docs, block_bytes=block).collect()), key=repr) == want
    rows = odd_docs.select("doc_id", "text").collect()
    assert sorted(map(tuple, prefix_tree.linked(odd_docs).collect()), key=repr) == brute_components(*zip(*rows))
    assert prefix_tree.linked(no_docs).count() == 0


def test_first_ngrams_move_once(spark):
    sets = {0: [3, 5, 9], 1: [5, 9, 11], 2: [7], 3: [5], 4: []}
    nodes = materialize(spark.createDataFrame([(k, 20, low, [100 + k, 200 + k]) for k, low in sets.items()], "node long, n long, low array<long>, high array<long>"))
    first = prefix_tree.prefixes(nodes, 85)
    plan = first._jdf.queryExecution().executedPlan().toString()
    # exploded n-grams are neither joined with their counts nor sent to all, and the lists are not dealt by node again
    assert "[gram" not in "".join(re.findall(r"Join \[[^\]]*", plan)) and len(re.findall(r"Exchange hashpartitioning\(gram", plan)) == 1
    df = {g: sum(g in low for low in sets.values()) for low in sets.values() for g in low}
    want = []
    for k, low in sets.items():
        met = sorted((df[g], g) for g in low if df[g] > 1)
        room = prefix_tree.prefix_length(20) - (len(low) - len(met))
        kept = [*met, (1 << 60, 100 + k), (1 << 60, 200 + k)][:max(0, room)]
        if kept:
            want.append((k, 20, len(low) - len(met), [d for d, _ in kept], [g for _, g in kept]))
    assert sorted(map(tuple, first.collect())) == want
