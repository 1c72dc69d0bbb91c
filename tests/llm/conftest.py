import random
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

#: Columns with the names of the operators' own columns.
CLASHING = ["_row", "key", "word", "node", "bands", "size", "spans", "bucket", "shard", "slot", "piece", "length", "chunk", "n_words", "kept", "held_out", "page", "payload"]


def stored(spark, columns: dict, types: dict):
    """A Parquet table read back, in two files; the operators name rows by their place in it."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    table = pa.table({n: pa.array(v, types[n]) for n, v in columns.items()})
    half = (table.num_rows + 1) // 2
    for k, part in enumerate((table.slice(0, half), table.slice(half))):
        pq.write_table(part, f"{folder}/part-{k}.parquet")
    return spark.read.parquet(folder)


def prose(rnd: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rnd.randrange(vocabulary)}{'abcdefg'[rnd.randrange(7)]}" for _ in range(n))


def make_docs(spark, texts, ids=None, extra=True):
    n = len(texts)
    columns = {"doc_id": list(range(n)) if ids is None else ids, "text": texts, "lang": [None if i % 7 == 0 else "en" for i in range(n)],
               "source": [None if i % 5 == 0 else "s" for i in range(n)], "n_chars": [None] * n}
    types = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
    for c in CLASHING if extra else []:
        columns[c], types[c] = [f"{c}{i}" for i in range(n)], pa.string()
    return stored(spark, columns, types)


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, copies, near copies, one very long text, repeats inside texts, control characters."""
    rnd = random.Random(7)
    long = prose(rnd, 120)
    near = long.split()
    near[60] = "changed"
    passage = prose(rnd, 110)
    return [None, "", " \n\t", None, "one", "one two", "ONE two", "a b c d", long, long, long, " ".join(near), prose(rnd, 60) + " " + passage, passage + " " + prose(rnd, 70),
            "é ü\x00 \x1c x y ß " * 30, "line of words here\n" * 40, prose(rnd, 30_000, 3000), "x" * 3000, "ab" * 1500, passage, "# | < > !!" * 20, prose(rnd, 55)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts with repeated, null and tied ids, and columns of clashing names."""
    ids = [None, 1, 2, None, *range(4, len(odd_texts))]
    ids[9] = ids[8]
    return make_docs(spark, odd_texts, ids)


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])
