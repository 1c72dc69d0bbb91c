"""Section rasters derived from the given tables, one section per supplier.

Every value is integer arithmetic on the supplier's columns and the pixel's
position, so the same text can be evaluated by another SQL engine.  ``DIV`` is
replaced by the integer division of the dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

SIDE = 64
DRAWN = 1 << 20  # pixels that one task draws, whatever the number of sections
BLOCK = 32  # blocks smaller than the section, so that block borders matter

# one row per cell of 21 pixels, with the lesion that lies there
CELLS = """
select section_id, nk, ac, c, cy, cx,
       21 * cy + 10 + ((section_id * 7 + c * 3) % 5 - 2) as oy,
       21 * cx + 10 + ((nk * 3 + c * 5 + ac) % 5 - 2) as ox,
       5 + (section_id + c * 2) % 5 as ro,
       case when (c + section_id) % 7 = 0 then -1 else 1 + (section_id * 3 + c + ac) % 4 end as rc,
       case when (section_id + c * 5) % 11 <> 0 then 1 else 0 end as there
from (select section_id, nk, ac, c, c DIV 3 as cy, c % 3 as cx
      from (select s_suppkey as section_id, cast(s_nationkey as bigint) as nk,
                   cast(round(abs(s_acctbal) * 100) as bigint) as ac,
                   SERIES(cast(0 as bigint), cast(8 as bigint)) as c
            from supplier) l00) l0
"""

LATTICE = """
select *, SERIES(21 * cx, case when cx = 2 then cast(63 as bigint) else 21 * cx + 20 end) as x
from (select *, SERIES(21 * cy, case when cy = 2 then cast(63 as bigint) else 21 * cy + 20 end) as y
      from ({cells}) l1) l11
"""

# reference mask
GT = """
select section_id, nk, ac, y, x,
       cast(case when there = 1 and rc >= 0 and (y-oy)*(y-oy) + (x-ox)*(x-ox) <= rc*rc then 3
            when there = 1 and (y-oy)*(y-oy) + (x-ox)*(x-ox) <= ro*ro then 2
            when (y-32)*(y-32) + (x-32)*(x-32) <= 900 then 1 else 0 end as int) as cls
from ({inner}) l2
"""

# predicted mask: moved by a pixel, some lesions missing or invented, some with a hole
PRED = """
select section_id, nk, ac, y, x,
       cast(case when seen = 1 and c % 4 = 1 and (y-oy)*(y-oy) + (x-px)*(x-px) <= 1 then 1
            when seen = 1 and rc >= 0 and (y-oy)*(y-oy) + (x-px)*(x-px) <= rc*rc + 1 then 3
            when seen = 1 and (y-oy)*(y-oy) + (x-px)*(x-px) <= (ro - c % 2)*(ro - c % 2) then 2
            when (y-32)*(y-32) + (x-33)*(x-33) <= 900 then 1 else 0 end as int) as cls
from (select *, ox + 1 as px,
             case when there = 1 and (section_id + c) % 9 = 4 then 0
                  when there = 0 and (section_id + c) % 3 = 0 then 1 else there end as seen
      from ({inner}) l2) l3
"""

# both masks of a pixel at once, and from them that of each member, without a union: pixels stay dealt by section
MASKS = """
select section_id, nk, ac, y, x, member, case when member = 1 then gcls else pcls end as cls
from (select *, SERIES(cast(0 as bigint), cast(2 as bigint)) as member
      from (select *, {gt} as gcls, {pred} as pcls
            from (select *, ox + 1 as px, {seen} as seen from ({inner}) l2) l3) l31) l32
"""

# member probabilities around a predicted mask: four integers that sum to 255
PROBS = """
select section_id, member, y, x,
       cast(case when cls = 0 then 255 - n1 - n2 - n3 else n0 end as int) as p0,
       cast(case when cls = 1 then 255 - n0 - n2 - n3 else n1 end as int) as p1,
       cast(case when cls = 2 then 255 - n0 - n1 - n3 else n2 end as int) as p2,
       cast(case when cls = 3 then 255 - n0 - n1 - n2 else n3 end as int) as p3
from (select section_id, member, y, x, cls,
             (y*7 + x*13 + section_id*5 + member*11) % (40 + 20*member) as n0,
             (y*14 + x*13 + section_id*5 + member*22) % (40 + 20*member) as n1,
             (y*21 + x*17 + section_id*3 + member*33) % (40 + 20*member) as n2,
             (y*28 + x*19 + section_id*2 + member*44) % (40 + 20*member) as n3
      from ({inner}) l4) l5
"""

# stained image of the reference mask, and its annotation with blended class borders
IMAGE = """
select section_id, y, x, cls,
       cast(case cls when 0 then 240 when 1 then 212 when 2 then 120 else 190 end + (y*5 + x*3 + section_id) % 4 as int) as r,
       cast(case cls when 0 then 239 when 1 then 200 when 2 then 84 else 70 end + (y*3 + x*7 + ac) % 5 as int) as g,
       cast(case cls when 0 then 241 when 1 then 206 when 2 then 180 else 62 end + (y + x*2 + nk) % 6 as int) as b
from ({inner}) l4
"""

BLENDED = """
select section_id, y, x, cls,
       cast((case when cls in (0, 3) then 255 else 0 end + case when nx in (0, 3) then 255 else 0 end) DIV 2 as int) as r,
       cast((case when cls in (0, 1) then 255 else 0 end + case when nx in (0, 1) then 255 else 0 end) DIV 2 as int) as g,
       cast((case when cls in (0, 2) then 255 else 0 end + case when nx in (0, 2) then 255 else 0 end) DIV 2 as int) as b
from (select *, coalesce(lead(cls) over (partition by section_id, y order by x), cls) as nx from ({inner}) l4) l5
"""


def raster_sql(kind: str, spark: bool) -> str:
    """SQL text of a raster: gt, pred, probs, image or blended."""
    base = LATTICE.format(cells=CELLS)
    if kind == "gt":
        text = GT.format(inner=base)
    elif kind == "pred":
        text = PRED.format(inner=base)
    elif kind == "probs":
        masks = (
            f"select *, SERIES(cast(0 as bigint), cast(2 as bigint), 2) as member from ({PRED.format(inner=base)}) q1 "
            f"union all select *, cast(1 as bigint) as member from ({GT.format(inner=base)}) q2")
        if spark:
            masks = MASKS.format(inner=base, gt=_expression(GT, "cast(", " as cls"), pred=_expression(PRED, "cast(", " as cls"),
                                 seen=_expression(PRED, "case when there", " as seen"))
        text = PROBS.format(inner=masks)
    elif kind == "image":
        text = IMAGE.format(inner=GT.format(inner=base))
    elif kind == "blended":
        text = BLENDED.format(inner=GT.format(inner=base))
    else:
        raise ValueError(kind)
    text = text.replace("cast(2 as bigint), 2)", "cast(2 as bigint), cast(2 as bigint))")
    series = "explode(sequence(" if spark else "unnest(generate_series("
    text = re.sub(r"SERIES\(", series, text)
    text = _close_series(text, series)
    return text.replace("DIV", "div" if spark else "//")


def _expression(text: str, first: str, last: str) -> str:
    """The part of a mask's text from ``first`` up to before ``last``."""
    begin = text.index(first)
    return text[begin:text.index(last, begin)]


def _close_series(text: str, opening: str) -> str:
    """Add the second closing bracket of every generator call."""
    out, i = [], 0
    while (j := text.find(opening, i)) >= 0:
        depth, k = 2, j + len(opening)
        while depth > 1:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        out.append(text[i:k] + ")")
        i = k
    return "".join(out) + text[i:]


def spread_suppliers(spark: SparkSession, sf_dir: str, pixels: int) -> DataFrame:
    """The suppliers, dealt by key to as many tasks as their sections of ``pixels`` pixels need.

    Rows are few and each grows to a whole section.  A grouping that has the
    section among its keys then needs no further shuffle, and a task holds a
    bounded number of pixels at any input size.
    """
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal")
    tasks = max(spark.sparkContext.defaultParallelism, -(-suppliers.count() * pixels // DRAWN))
    return suppliers.repartition(tasks, "s_suppkey")


def drawn(pixels: DataFrame) -> DataFrame:
    """Pixels that a generator has made: Spark takes their size for that of the rows they come from and would broadcast them."""
    return pixels.hint("merge")


def raster(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The raster as a pixel table; int coordinates."""
    view = f"supplier_rows_{abs(hash(sf_dir)) % 10**9}"
    spread_suppliers(spark, sf_dir, SIDE * SIDE).createOrReplaceTempView(view)
    out = spark.sql(raster_sql(kind, True).replace("from supplier)", f"from {view})"))
    return drawn(out.withColumn("y", F.col("y").cast("int")).withColumn("x", F.col("x").cast("int")))


def sections(spark: SparkSession, sf_dir: str, height: int = SIDE, width: int = SIDE) -> DataFrame:
    """The sides of every section."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("section_id"), F.lit(height).alias("height"), F.lit(width).alias("width"))


def raster_cte(kind: str, name: str) -> str:
    """``name as materialized (...)`` for the other engine."""
    return f"{name} as materialized ({raster_sql(kind, False)})"
