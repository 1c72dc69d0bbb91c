"""Sharding by fixed virtual slots, in DataFrame operations only.

Every record is hashed into one of ``SLOTS`` virtual slots, whatever the number of shards. Bytes and rows are summed per slot,
and a small versioned table maps slots to shards: version 1 gives the slots, largest first, each to the lightest shard, so
shard sizes come out nearly equal (law ``bytes``). Rebalancing edits the map alone: a new version moves just enough slots into
the added shard and leaves all others where they are.

Only narrow rows (id, size, checksum, slot) are shuffled. The map has ``SLOTS`` rows, a bound fixed by a parameter; it is the
only thing broadcast and the only thing one task folds over. Places in a shard are counted per virtual slot and shifted by
the rows of the shard's earlier slots, so no task sorts a whole shard.

Defined cases: a null text has size 1 and the checksum of the empty text; null ids and repeated rows are sharded like others
(equal records share a slot); an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.session import stored as materialize

SLOTS = 4096


def slotted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", slots: int = SLOTS) -> DataFrame:
    """Narrow rows: id, size, text_crc32, virtual_slot."""
    text = F.coalesce(docs[text_column], F.lit("")).cast("binary")
    narrow = docs.select(docs[id_column], (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return narrow.withColumn("virtual_slot", F.pmod(F.xxhash64(id_column, "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot in use."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def balanced_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: largest slot first, each to the shard with the fewest bytes so far."""
    ordered = sizes.agg(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "rows")), asc=False).alias("slots"))

    def give(state: Column, slot: Column) -> Column:
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda load, i: F.when(i == lightest, load + slot["bytes"]).otherwise(load)).alias("loads"),
            F.concat(state["chosen"], F.array(lightest)).alias("chosen"),
        )

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("chosen"))
    chosen = ordered.select("slots", F.aggregate("slots", start, give, lambda s: s["chosen"]).alias("chosen"))
    pairs = chosen.select(F.explode(F.arrays_zip("slots", "chosen")).alias("x"))
    return pairs.select("x.slots.virtual_slot", "x.slots.bytes", "x.slots.rows", F.col("x.chosen").alias("shard"), F.lit(1).alias("version"))


def rebalanced(slot_map: DataFrame, shards: int) -> DataFrame:
    """The map's next version for one shard more: every old shard hands over its smallest slots beyond the new mean."""
    mean = slot_map.agg(F.sum("bytes") / F.lit(shards + 1)).scalar()
    now = slot_map.agg(F.max("version")).scalar()
    small = W.partitionBy("shard").orderBy("bytes", "virtual_slot")
    held = slot_map.withColumn("given", F.sum("bytes").over(small)).withColumn("own", F.sum("bytes").over(W.partitionBy("shard")))
    moves = F.col("given") <= F.col("own") - mean
    return held.select("virtual_slot", "bytes", "rows", F.when(moves, F.lit(shards)).otherwise(F.col("shard")).alias("shard"),
                         (now + 1).alias("version"))


def placed(rows: DataFrame, slot_map: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Every row with its shard and its place there, gapless from 0."""
    earlier = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    lookup = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    inside = W.partitionBy("virtual_slot").orderBy(id_column, "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(inside))
    return ranked.join(F.broadcast(lookup), "virtual_slot").withColumn("slot", F.col("before") + F.col("rank") - 1).drop("before", "rank")


def sharded(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text", slots: int = SLOTS) -> DataFrame:
    """id, size, text_crc32, virtual_slot, shard, slot; the narrow rows and the map are stored first."""
    rows = materialize(slotted(docs, id_column, text_column, slots))
    slot_map = materialize(balanced_map(slot_sizes(rows), shards))
    return placed(rows, slot_map, id_column)
