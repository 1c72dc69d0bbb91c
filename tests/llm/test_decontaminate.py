import random

import pyarrow as pa
import pytest

from lamina.llm import decontaminate

from .conftest import make_docs, prose, stored


def search_distance(pattern, text):
    """Least edit distance of the pattern to a substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(rnd, text, n):
    text = list(text)
    for _ in range(n):
        at = rnd.randrange(len(text))
        kind = rnd.randrange(3)
        text[at : at + (kind < 2)] = ["" if kind == 0 else rnd.choice("xyzé ")] if kind < 2 else [rnd.choice("xyz"), text[at]]
        text = list("".join(text))
    return "".join(text)


def test_myers():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abé") for _ in range(rnd.randrange(1, n))) for n in (90, 60))
        distance, end = decontaminate.myers(a, b)
        assert distance == search_distance(a, b) and 0 <= end <= len(b)


@pytest.mark.parametrize("seed", range(3))
def test_every_match_is_found(seed):
    rnd = random.Random(seed)
    items = [(k, decontaminate.normal(pa.array([prose(rnd, rnd.randrange(3, 30), 30)]))[0].as_py()) for k in range(25)]
    matcher = decontaminate.Matcher(items)
    for _ in range(60):
        key, item = rnd.choice(items)
        text = f"{prose(rnd, rnd.randrange(20), 30)} {edited(rnd, item, rnd.randrange(int(len(item) * 0.16) + 1))} {prose(rnd, rnd.randrange(20), 30)}"
        text = decontaminate.normal(pa.array([text]))[0].as_py()
        got = {k: d for k, d, _ in matcher.matches(text)}
        for k, other in items:
            distance = search_distance(other, text)
            assert (got.get(k) == distance) if distance <= int(0.1 * len(other)) else k not in got, (k, key)


def test_tables(spark, odd_docs, odd_texts, no_docs):
    rnd = random.Random(8)
    passage = prose(rnd, 25)
    items = stored(spark, {"item_id": [1, 2, 3, None, 5, 5], "text": [passage, None, " ", "words that nobody wrote at all", "once more and again", "once more and again"]}, {"item_id": pa.int64(), "text": pa.string()})
    texts = [prose(rnd, 30) + "\n" + passage.upper().replace(" ", "  ") + " " + prose(rnd, 5), prose(rnd, 50), passage[:-3], passage[: len(passage) // 2], "Once more\tand again", None, ""]
    docs = make_docs(spark, texts)
    rows = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.contamination(docs, items).collect())
    assert rows == [(0, 1, 0), (2, 1, 3), (4, 5, 0), (4, 5, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()) == [1, 3, 5, 6]
    assert decontaminate.drop_contaminated(odd_docs, items).schema == odd_docs.schema
    assert decontaminate.drop_contaminated(odd_docs, items).count() == len(odd_texts)
    nothing = items.where("item_id > 99")
    assert decontaminate.contamination(docs, nothing).count() == decontaminate.contamination(no_docs, items).count() == 0
    assert decontaminate.drop_contaminated(docs, nothing).count() == len(texts)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    rnd = random.Random(5)
    texts = [prose(rnd, 12) for _ in range(9)]
    items = stored(spark, {"item_id": list(range(9)), "text": texts}, {"item_id": pa.int64(), "text": pa.string()})
    docs = make_docs(spark, texts + [prose(rnd, 40)])
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, items).collect()) == [(k, k) for k in range(9)]
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()] == [9]
