"""Merkle manifest of a table: a hash tree over the rows of each group, a tree over the groups, and a proof for every row.

Slot pivot: a parent is one grouped row whose ``FANOUT`` columns are conditional aggregates, one for each slot of its children.
The columns concatenated are what its hash is taken of; the columns to the left and to the right of a child's own are its
siblings. So a level up is one grouping, and a level down one join of the (eight times fewer) parents; no row is ever joined
with rows of its own level.

* Places. Rows are stored once as digests with a number of their own, ordered by ranges of (group, key), and counted by range;
  a place is the rank in the range plus the counts of the ranges before it. No group has to fit in one task.
* Up. Level by level while a group has several nodes; each level is stored and has an eighth of the rows of the one below.
* Down. From the root each level hands its children the path to the root: left and right siblings by level.
* A proof is checked by folding the path over a leaf, an aggregate over the path's array.

Everything is DataFrame operations. Digests are lowercase hex SHA-256.

Defined cases: null fields are hashed as ``-``, other ones with their length; rows of equal keys (null ones first) follow their
digests; a null group comes first; a table of one row has its leaf as subroot and root and the digest of nothing as proof; an
empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FANOUT = 8
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    """Of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` (stored) with ``idx``, the place from 0 in their group, and ``n``, the group's size; ``order`` tells all rows apart."""
    ranges = materialize(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = sizes.select(*group, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
                          F.sum("_rows").over(Window.partitionBy(*group)).alias("n"))
    ranked = ranges.withColumn("_rank", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)))
    return ranked.join(counts, [*group, "_range"]).withColumn("idx", F.col("_rank") - 1 + F.col("_before")).drop("_range", "_rank", "_before")


def _families(nodes: DataFrame, group: list[str]) -> DataFrame:
    """One row per parent: group, idx, n (nodes of the group on the parent's level), and its children in the columns c0 to c7."""
    child = [F.first(F.when(F.col("idx") % FANOUT == k, F.struct("h", "body")), ignorenulls=True).alias(f"c{k}") for k in range(FANOUT)]
    return nodes.where("n > 1").groupBy(*group, "n", F.floor(F.col("idx") / FANOUT).alias("idx")).agg(*child).withColumn(
        "n", F.ceil(F.col("n") / FANOUT))


def _hash_of(slots: list[int]) -> Column:
    return F.concat(*[F.coalesce(F.col(f"c{k}.h"), F.lit("")) for k in slots]) if slots else F.lit("")


def tree(leaves: DataFrame, group: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The stored families of each level, lowest first, and the last node of each group with its ``height``."""
    levels, ends, nodes = [], leaves.where("n = 1").select(*group, "idx", "h", F.lit(0).alias("height")), leaves
    while not nodes.where("n > 1").isEmpty():
        levels.append(materialize(_families(nodes, group)))
        nodes = levels[-1].select(*group, "idx", "n", digest(_hash_of(list(range(FANOUT)))).alias("h"), F.lit(None).cast(leaves.schema["body"].dataType).alias("body"))
        ends = ends.unionByName(nodes.where("n = 1").select(*group, "idx", "h", F.lit(len(levels)).alias("height")))
    return levels, ends


def _children(families: DataFrame, above: DataFrame, group: list[str], carried: list[str]) -> DataFrame:
    """All children with their path: the own siblings in front of the parent's path."""
    both = families.drop("n").join(above, [*group, "idx"])
    slots = F.array(*[F.when(F.col(f"c{k}").isNotNull(), F.struct(
        F.lit(k).alias("slot"), F.col(f"c{k}.h").alias("h"), F.col(f"c{k}.body").alias("body"),
        _hash_of(list(range(k))).alias("left"), _hash_of(list(range(k + 1, FANOUT))).alias("right"))) for k in range(FANOUT)])
    one = both.select(*group, "idx", *carried, "path", F.explode(F.array_compact(slots)).alias("c"))
    return one.select(*group, (F.col("idx") * FANOUT + F.col("c.slot")).alias("idx"), *carried, F.col("c.h").alias("h"), F.col("c.body").alias("body"),
                      F.concat(F.array(F.struct("c.left", "c.right")), "path").alias("path"))


def descended(levels: list[DataFrame], tops: DataFrame, leaves: DataFrame, group: list[str], carried: list[str]) -> DataFrame:
    """The leaves with their paths; ``tops``: the last node of each group with its place, ``height``, ``path`` and what is carried down."""
    state = None
    for height in range(len(levels), -1, -1):
        here = tops.where(F.col("height") == height).select(*group, "idx", *carried, "path")
        if height < len(levels):
            below = _children(levels[height], state, group, carried)
            if height == 0:
                # groups of one row have no family; their row comes from the leaves themselves
                alone = leaves.where("n = 1").select(*group, "idx", "h", "body").join(here, [*group, "idx"])
                return below.unionByName(alone.select(*below.columns))
            here = here.unionByName(below.select(*here.columns))
        state = here
    return leaves.select(*group, "idx", "h", "body").join(state, [*group, "idx"])


def proofs(docs: DataFrame, columns: list[str], group: str, key: str, edit: dict[str, Column] | None = None, edited: Column | None = None) -> DataFrame:
    """key, leaf, subroot, root and path (left and right siblings, lowest level first) of every row.

    ``other`` is the leaf that a row would have with the columns of ``edit`` in place of its own, null where ``edited`` does not hold.
    """
    leaf, other = digest(*[field(docs[c]) for c in columns]), F.lit(None).cast("string")
    if edit:
        other = F.when(edited, digest(*[field(edit.get(c, docs[c])) for c in columns]))
    # the group as two columns without nulls, so that it can be joined on
    by = ["_has", "_group"]
    rows = materialize(docs.select(docs[key].alias("_key"), docs[group].isNotNull().alias("_has"), F.coalesce(docs[group].cast("string"), F.lit("")).alias("_group"),
                                   leaf.alias("h"), other.alias("_other"), F.monotonically_increasing_id().alias("_row")))
    leaves = materialize(placed(rows, by, ["_key", "h", "_row"]).select(*by, "idx", "n", "h", F.struct(F.col("_key").alias("key"), F.col("_other").alias("other")).alias("body")))
    levels, ends = tree(leaves, by)
    # the groups' own tree: a subroot is a leaf there, and its body says which group it stands for
    ends = materialize(ends.withColumnRenamed("idx", "last"))
    groups = materialize(placed(ends, [], by).select("idx", "n", "h", F.struct(*by, F.col("last").alias("idx"), "height").alias("body")))
    top_levels, top = tree(groups, [])
    root = top.select("idx", F.col("h").alias("root"), "height", F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("path"))
    subroots = descended(top_levels, root, groups, [], ["root"])
    tops = subroots.select("body.*", F.col("h").alias("subroot"), "root", "path")
    found = descended(levels, tops, leaves, by, ["subroot", "root"])
    return found.select(F.col("body.key").alias(key), F.col("h").alias("leaf"), "subroot", "root", "path", F.col("body.other").alias("other"))


def siblings_digest(path: str = "path") -> Column:
    """Of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda below, s: digest(s["left"], below, s["right"]))
