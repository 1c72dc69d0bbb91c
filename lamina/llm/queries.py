"""The operators bound to the given tables, with production parameters, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import scratch_root

from . import context_mixing, decontaminate, fill_in_middle, merkle, minhash, packing, pii, prefix_tree, quality_classifier, quality_rules, sharding, suffix_dedup, warc
from .oracles import ORACLE  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.class_table(table(spark, sf_dir, "documents"))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored(table(spark, sf_dir, "documents"), class_column="lang")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("kept", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.marked(table(spark, sf_dir, "pages")), path)
    records = warc.read_archives(spark, path)
    own, head = F.col("record_type") == "response", F.col("headers")
    return records.select(
        head["X-Page-Id"].cast("long").alias("page_id"),
        F.when(own, F.octet_length("payload")).otherwise(head["X-Payload-Bytes"]).cast("long").alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.substring_index(head["WARC-Payload-Digest"], ":", -1)).alias("payload_digest"),
        "record_type", head["X-Refers-To-Page"].cast("long").alias("refers_to"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_table(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_table(table(spark, sf_dir, "documents"))


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.transformed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", merkle.LETTERS, merkle.LETTERS.lower())
    rows = merkle.proofs(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": lowered},
                         F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest().alias("proof_sha256"),
                       merkle.folded(F.coalesce("other", "leaf")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree.linked(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_context_mixing, op3_quality_classifier, op4_warc, op5_suffix_dedup, op7_decontamination, op6_pii, op8_quality_rules,
                                   op9_virtual_slots, op10_packing, op11_fill_in_middle, op12_merkle, op13_prefix_tree)}
