import random
import tempfile

import pyarrow as pa

import corpus_pipeline
from lamina.llm import queries

from .conftest import make_docs, prose, stored


def folder_with(spark, texts, items):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    make_docs(spark, texts, extra=False).write.parquet(f"{folder}/documents.parquet")
    stored(spark, {"item_id": list(range(len(items))), "text": items}, {"item_id": pa.int64(), "text": pa.string()}).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark):
    rnd = random.Random(4)
    item, base = prose(rnd, 20), prose(rnd, 90)
    near = base.split()
    near[3] = "other"
    texts = [prose(rnd, 80), base, " ".join(near), base, prose(rnd, 60) + " " + item, "too short", "same line again\n" * 40, prose(rnd, 70) + " mail a@b.co", None]
    folder = folder_with(spark, texts, [item])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        if name == "pii":
            assert [r["text"][-12:] for r in docs.where("doc_id = 7").collect()] == ["mail <EMAIL>"]
    assert kept == [[0, 1, 2, 3, 4, 7], [0, 1, 4, 7], [0, 1, 7], [0, 1, 7], [0, 1, 7]]
    rows = corpus_pipeline.run(spark, folder)
    assert sorted(r["doc_id"] for r in rows.collect()) == [0, 1, 7]


def test_empty_and_odd(spark, odd_docs, odd_texts):
    folder = folder_with(spark, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    odd_docs.write.parquet(f"{folder}/documents.parquet")
    folder_with(spark, [], [])
    stored(spark, {"item_id": [None], "text": [None]}, {"item_id": pa.int64(), "text": pa.string()}).write.parquet(f"{folder}/benchmark.parquet")
    assert 0 < corpus_pipeline.run(spark, folder).count() < len(odd_texts) + 60


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
