"""Queries over tile lattices, blending, tissue windows and decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import colour
from ..operators import blocks, components, decode, tiling, windowing
from .raster_queries import AT, BLUR, DIST, GREY, HOLES, K, LAT, W, dilate_sql, erode_sql, grey, labels_sql, values
from .rasters import BLOCK, drawn, raster, spread_suppliers
from .registry import query, table

SIZES, PCTS = [256, 448, 512], (20, 40, 60, 80)


def _sections(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("section_id"), (F.col("p_size") * 31 + F.col("p_partkey") % 500 + 100).cast("int").alias("width"),
        (F.col("p_size") * 17 + F.col("p_partkey") % 300 + 200).cast("int").alias("height"))


_SECT = "sec as materialized (select p_partkey as section_id, cast(p_size * 31 + p_partkey % 500 + 100 as int) as width, cast(p_size * 17 + p_partkey % 300 + 200 as int) as height from part)"
_GRIDS = """gr as materialized (select size, 'no_shift' as folder, size as step from (select unnest([{s}]) as size) union all
  select size, 'ovlp_' || round(100 * (size * pct // 100) / size)::int, size - size * pct // 100 from (select unnest([{s}]) as size), (select unnest([20, 40, 60, 80]) as pct)
   where round(100 * (size * pct // 100) / size)::int in (20, 40, 60, 80))"""


@query("c1_shift_grids", f"with {_SECT}, {_GRIDS.format(s='256, 448, 512')} select section_id, cast(size as int) as size, folder, cast(step as int) as step from sec, gr where width >= size and height >= size")
def _(spark, sf):
    return _sections(spark, sf).select("*", F.explode(tiling.shift_grids(SIZES)).alias("g")).select("*", "g.*").where(
        "width >= size and height >= size").select("section_id", "size", "folder", "step")


_ORIG = "(select {v} as {v}, section_id, size, folder from (select section_id, size, folder, unnest(generate_series(0, greatest({d} - size, 0), step)) as {v} from sec, gr union select section_id, size, folder, greatest({d} - size, 0) from sec, gr))"


@query("c3_training_tiles", f"""with {_SECT}, {_GRIDS.format(s='448, 512')}, i as materialized {_ORIG.format(v='i', d='height')}, j as materialized {_ORIG.format(v='j', d='width')}
select section_id, cast(size as int) as size, folder, cast(i as int) as i, cast(j as int) as j, section_id || '_' || i || '_' || j as name
from i join j using (section_id, size, folder) join sec using (section_id) where i + size <= height and j + size <= width""")
def _(spark, sf):
    return tiling.training_tiles(_sections(spark, sf), SIZES[1:]).select("section_id", "size", "folder", "i", "j", "name")


@query("c2_tile_positions", f"""with {_SECT}, {_GRIDS.format(s='256, 512')}, i as materialized {_ORIG.format(v='i', d='height')} select section_id, cast(size as int) as size, folder, cast(count(*) as int) as n, cast(max(i) as int) as last from i group by all""")
def _(spark, sf):
    g = _sections(spark, sf).select("*", F.explode(tiling.shift_grids([256, 512])).alias("g")).select("*", "g.*")
    at = tiling.training_origins(F.col("height"), F.col("size"), F.col("step"))
    return g.select("section_id", "size", "folder", F.size(at).alias("n"), F.array_max(at).alias("last"))


@query("c4_background_tiles", f"""{W('image')}, sec as (select distinct section_id, 64 as width, 64 as height from image), {_GRIDS.format(s='20')},
i as materialized {_ORIG.format(v='i', d='height')}, j as materialized {_ORIG.format(v='j', d='width')},
w as materialized (select section_id, y, x, case when r > 240 and g > 238 and b > 240 then 1 else 0 end as white from (select section_id, y, x, r, g + 0 as g, b from image)),
rw as materialized (select w.section_id, size, folder, y, j.j, sum(white) as white from w join j on j.section_id = w.section_id and w.x between j.j and j.j + size - 1 group by 1, 2, 3, 4, 5),
tl as (select section_id, size, folder, i.i, j, sum(white) as white from rw join i using (section_id, size, folder) where rw.y between i.i and i.i + size - 1 group by 1, 2, 3, 4, 5)
select section_id, cast(size as int) as size, folder, cast(i as int) as i, cast(j as int) as j, round(white / (size * size), 6) as white_share, white / (size * size) >= 0.9 as background from tl""")
def _(spark, sf):
    px = raster(spark, sf, "image").withColumn("g", F.col("g") + 2)
    sec = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("section_id"), F.lit(64).alias("width"), F.lit(64).alias("height"))
    out = tiling.tile_white_share(px, sec, [20], min_share=0.9)
    return out.withColumn("white_share", F.round("white_share", 6))


@query("c5_inference_tiles", f"""with {_SECT}, y as (select section_id, width, height, unnest(generate_series(0, height - 1, 384)) as ty from sec),
t as (select *, unnest(generate_series(0, width - 1, 384)) as tx from y)
select section_id, cast(ty as int) as tile_y, cast(tx as int) as tile_x, cast(greatest(ty + 512 - height, 0) as int) as pad_y, cast(greatest(tx + 512 - width, 0) as int) as pad_x from t""")
def _(spark, sf):
    return tiling.inference_tiles(_sections(spark, sf), 512, 128)


# tiles of 32 with overlap 8 of the first member; scores differ between the tiles that share a pixel
_TP = f"""{W('probs')}, ys as (select cast(y as bigint) as y, ty from range(64) a(y), range(0, 64, 24) b(ty) where y between ty and ty + 31), xs as (select cast(y as bigint) as x, ty as tx from ys),
tp as materialized (select section_id, y, x, ty as tile_y, tx as tile_x, y - ty as dy, x - tx as dx, {", ".join(f"p{c} + ((ty + tx) // 24 * {c + 1}) % 5 as p{c}" for c in range(4))}
 from (select * from probs where member = 2) join ys using (y) join xs using (x)),
wt as materialized (select *, (case when dx >= 24 then (31 - dx) / 7.0e0 when dx < 8 then dx / 7.0e0 else 1.0e0 end) * (case when dy < 8 then dy / 7.0e0 else 1.0e0 end)
   * (case when dy >= 24 then (31 - dy) / 7.0e0 else 1.0e0 end) as w from tp),
bl as materialized (select section_id, y, x, {", ".join(f"sum(p{c} * w) / greatest(sum(w), 1e-6) as p{c}" for c in range(4))} from wt group by section_id, y, x)"""


def _tile_probs(spark, sf):
    tiles = tiling.to_tiles(raster(spark, sf, "probs").where("member = 2").drop("member"), 32, 8)
    k = F.expr("(tile_y + tile_x) div 24")
    return tiles.select("section_id", "y", "x", "tile_y", "tile_x", "dy", "dx",
                        *[(F.col(f"p{c}") + (k * (c + 1)) % 5).alias(f"p{c}") for c in range(4)])


@query("c6_pixel_to_tiles", f"{_TP} select section_id, cast(tile_y as int) as tile_y, cast(tile_x as int) as tile_x, count(*) as n, cast(sum(dy * 32 + dx) as bigint) as place from tp group by all")
def _(spark, sf):
    return _tile_probs(spark, sf).groupBy("section_id", "tile_y", "tile_x").agg(
        F.count("*").alias("n"), F.sum(F.col("dy") * 32 + F.col("dx")).alias("place"))


@query("c7_feather_weights", f"{_TP} select cast(dy as int) as dy, cast(dx as int) as dx, round(avg(w), 6) as w, count(*) as n from wt group by all")
def _(spark, sf):
    w = tiling.feather(F.col("dy"), F.col("dx"), 32, 8)
    return _tile_probs(spark, sf).groupBy(F.col("dy").cast("int").alias("dy"), F.col("dx").cast("int").alias("dx")).agg(
        F.round(F.avg(w), 6).alias("w"), F.count("*").alias("n"))


@query("c8_blend_probabilities", f"{_TP} select section_id, y, x, {', '.join(f'round(p{c}, 6) as p{c}' for c in range(4))} from bl")
def _(spark, sf):
    out = tiling.blend(_tile_probs(spark, sf), K, 32, 8)
    return out.select("section_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), *[F.round(f"p{c}", 6).alias(f"p{c}") for c in range(4)])


@query("c8_stitch", f"{_TP}, c as (select section_id, list_position([round(p0, 6), round(p1, 6), round(p2, 6), round(p3, 6)], greatest(round(p0, 6), round(p1, 6), round(p2, 6), round(p3, 6))) - 1 as cls, y, x from bl) select section_id, cast(cls as int) as cls, count(*) as n, cast(sum(y * 64 + x) as bigint) as place from c group by 1, 2")
def _(spark, sf):
    from ..functions.scalars import argmax4

    out = tiling.blend(_tile_probs(spark, sf), K, 32, 8)
    return out.select("section_id", "y", "x", argmax4(*[F.round(f"p{c}", 6) for c in range(4)]).alias("cls")).groupBy("section_id", "cls").agg(
        F.count("*").alias("n"), F.sum(F.col("y") * 64 + F.col("x")).cast("bigint").alias("place"))


@query("c9_stitch_labels", f"""{W('gt')}, ys as (select cast(y as bigint) as y, ty from range(64) a(y), range(0, 64, 24) b(ty) where y between ty and ty + 31), xs as (select cast(y as bigint) as x, ty as tx from ys),
wt as (select section_id, y, x, cls, y - ty as dy, x - tx as dx from gt join ys using (y) join xs using (x)),
ww as (select *, (case when dx >= 24 then (31 - dx) / 7.0e0 when dx < 8 then dx / 7.0e0 else 1.0e0 end) * (case when dy < 8 then dy / 7.0e0 else 1.0e0 end) * (case when dy >= 24 then (31 - dy) / 7.0e0 else 1.0e0 end) as w from wt),
c as (select section_id, y, x, round_even(round(sum(cls * w) / greatest(sum(w), 1e-6), 9), 0) as cls from ww group by 1, 2, 3)
select section_id, cast(cls as int) as cls, count(*) as n from c group by 1, 2""")
def _(spark, sf):
    tiles = tiling.to_tiles(raster(spark, sf, "gt").select(*AT, "cls"), 32, 8)
    return tiling.stitch_labels(tiles, K, 32, 8).groupBy("section_id", "cls").agg(F.count("*").alias("n"))


@query("c10_section_probabilities", f"""{_TP}, q as (select section_id, y + 10 as y, x + 6 as x, {", ".join(f"cast(least(greatest(round_even(p{c} / 257.3e0 * 255, 0), 0), 255) as int) as p{c}" for c in range(4))} from bl where y < 50 and x < 50),
l as (select distinct section_id, y, x from probs)
select section_id, y, x, coalesce(p0, 255) as p0, coalesce(p1, 0) as p1, coalesce(p2, 0) as p2, coalesce(p3, 0) as p3 from l left join q using (section_id, y, x)""")
def _(spark, sf):
    # a window of the section is blended, pasted back, and the rest is background
    scaled = _tile_probs(spark, sf).where("y < 50 and x < 50").select(
        "section_id", "y", "x", "dy", "dx", *[(F.col(f"p{c}") / 257.3).alias(f"p{c}") for c in range(4)])
    moved = scaled.withColumn("y", F.col("y") + 10).withColumn("x", F.col("x") + 6)
    out = tiling.section_probabilities(moved, raster(spark, sf, "gt"), K, 32, 8)
    return out.withColumn("y", F.col("y").cast("bigint")).withColumn("x", F.col("x").cast("bigint"))


@query("c11_tissue_threshold", f"{W('image')}, {GREY} select section_id, least(greatest(quantile_cont(v, 0.98) - 4, 180), 252) as threshold, least(greatest(quantile_cont(v, 0.99) - 1, 180), 252) as loose from grey group by section_id")
def _(spark, sf):
    return tiling.tissue_threshold(grey(spark, sf), K)


@query("c12_background_test", f"""{W('image')}, {GREY}, th as (select section_id, least(greatest(quantile_cont(v, 0.98) - 4, 180), 252) as t from grey group by 1),
ys as (select cast(y as bigint) as y, ty from range(64) a(y), range(0, 64, 12) b(ty) where y between ty and ty + 15), xs as (select cast(y as bigint) as x, ty as tx from ys)
select section_id, cast(ty as int) as tile_y, cast(tx as int) as tile_x, round(count(*) filter (v < t) / 256.0, 6) as tissue_share, count(*) filter (v < t) / 256.0 < 0.005 as background
from grey join ys using (y) join xs using (x) join th using (section_id) group by all""")
def _(spark, sf):
    g = grey(spark, sf)
    out = tiling.background_tiles(tiling.to_tiles(g, 16, 4), tiling.tissue_threshold(g, K), K, 16)
    return out.withColumn("tissue_share", F.round("tissue_share", 6))


@query("c13_tissue_window")
def _(spark, sf):
    from ..operators import morphology
    from ..session import materialize

    blurred = materialize(morphology.gaussian5(grey(spark, sf), K, BLOCK))
    return windowing.tissue_window(blurred, K, padding=3, min_span=20, kernel=5, block=BLOCK)


_SLIDE = """select s_suppkey as section_id, y, x, cast(case when y >= 6 + s_suppkey % 4 and y < 34 and ((x >= 10 + s_suppkey % 7 and x < 118)
   or (x >= 140 and x < 246 - s_suppkey % 5 and s_nationkey % 6 <> 0)) then 90 + (x * 3 + y * 5 + s_suppkey) % 60 else 255 end as int) as v from {src}"""
_SLIDES = "sl as materialized (" + _SLIDE.format(src="supplier, range(40) a(y), range(256) b(x)") + ")"


def _slides(spark, sf):
    view = f"slide_rows_{abs(hash(sf)) % 10**9}"
    spread_suppliers(spark, sf, 40 * 256).createOrReplaceTempView(view)
    return drawn(spark.sql(_SLIDE.format(src=f"{view} lateral view explode(sequence(0, 39)) a as y lateral view explode(sequence(0, 255)) b as x")))


@query("c14_sample_regions", f"""with {_SLIDES}, co as materialized (select section_id, x, round(avg(v), 9) as v from sl group by 1, 2), th as (select section_id, quantile_cont(v, 0.85) t from co group by 1),
dk as (select section_id, x from co join th using (section_id) where v < t), cu as (select *, case when x - lag(x) over w - 1 >= 5 then 1 else 0 end c from dk window w as (partition by section_id order by x)),
ru as (select section_id, g, min(x) lo, max(x) hi from (select *, sum(c) over (partition by section_id order by x) g from cu) group by 1, 2),
ke as materialized (select section_id, lo, hi from ru where hi - lo + 1 >= 100 or section_id not in (select section_id from ru where hi - lo + 1 >= 100)),
ro as materialized (select k.section_id, k.lo, k.hi, y, round(avg(v), 9) v from ke k join sl on sl.section_id = k.section_id and sl.x between k.lo and k.hi group by 1, 2, 3, 4),
rt as (select section_id, lo, quantile_cont(v, 0.75) t from ro group by 1, 2), rd as (select ro.* from ro join rt using (section_id, lo) where v < t),
rc as (select *, case when y - lag(y) over w - 1 >= 5 then 1 else 0 end c from rd window w as (partition by section_id, lo order by y)),
rb as (select section_id, lo, g, min(y) a, max(y) b from (select *, sum(c) over (partition by section_id, lo order by y) g from rc) group by 1, 2, 3),
be as (select section_id, lo, arg_max(a, (b - a, -a)) a, arg_max(b, (b - a, -a)) b from rb group by 1, 2)
select k.section_id, cast(greatest(k.lo - 60, 0) as int) x1, cast(greatest(coalesce(a, 0) - 5, 0) as int) y1, cast(least(k.hi + 60, 256) as int) x2, cast(least(coalesce(b, 39) + 5, 40) as int) y2 from ke k left join be using (section_id, lo)
union all select distinct section_id, 0, 0, 256, 40 from co where section_id not in (select section_id from ke)""")
def _(spark, sf):
    px = _slides(spark, sf).select(*AT, F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"))
    return windowing.sample_regions(px, K)


@query("c15_trim_white", f"""with {_SLIDES}, b as (select section_id, min(y) y0, max(y) y1, min(x) x0, max(x) x1 from sl where v < 250 group by 1)
select section_id, cast(y - y0 as int) as y, cast(x - x0 as int) as x, v from sl join b using (section_id) where y between y0 and y1 and x between x0 and x1""")
def _(spark, sf):
    return windowing.trim_white(_slides(spark, sf), K)


@query("c16_pyramid_level", """with s as (select p_partkey as slide, p_size * 0.011 + p_partkey % 7 * 0.03 as mpp0 from part), l as (select slide, i as level, mpp0 * pow(2, i) as mpp from s, range(5) t(i)),
n as (select slide, arg_min(level, (abs(mpp - 0.8832), level)) lv, arg_min(mpp, (abs(mpp - 0.8832), level)) m, coalesce(arg_max(level, mpp) filter (mpp < 0.8832), 0) fl, coalesce(max(mpp) filter (mpp < 0.8832), min(mpp)) fm from l group by 1)
select slide, cast(case when abs(m - 0.8832) / 0.8832 <= 0.05 then lv else fl end as int) as level, round(case when abs(m - 0.8832) / 0.8832 <= 0.05 then 1 else fm / 0.8832 end, 6) as resize_factor,
 round(case when abs(m - 0.8832) / 0.8832 <= 0.05 then m else fm end, 6) as um_per_px from n""")
def _(spark, sf):
    slides = table(spark, sf, "part").select(
        F.col("p_partkey").alias("slide"), (F.col("p_size") * 0.011 + F.col("p_partkey") % 7 * 0.03).alias("mpp0"),
        F.array(*[F.lit(float(2 ** i)) for i in range(5)]).alias("level_downsamples"))
    out = tiling.pyramid_level(slides)
    return out.select("slide", "level", F.round("resize_factor", 6).alias("resize_factor"), F.round("um_per_px", 6).alias("um_per_px"))


@query("c17_paste_window", f"{W('gt')} select section_id, y + section_id % 9 as y, x + nk as x, cls from gt where cls > 0")
def _(spark, sf):
    gt = raster(spark, sf, "gt").where("cls > 0").select("section_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "cls")
    boxes = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("section_id"), F.col("s_nationkey").cast("bigint").alias("x1"), (F.col("s_suppkey") % 9).alias("y1"))
    return tiling.paste(gt, boxes, K)


@query("c18_merge_augmented", f"""{W('probs')}, a as (select section_id, k, f, y, x, {", ".join(f"(p{c} + (k * 3 + f) * {c}) / 255.0 as p{c}" for c in range(4))} from probs, range(4) k(k), range(2) f(f) where member = 0),
b as (select *, case when f = 1 then 63 - x else x end as xx from a),
o as (select section_id, case k when 0 then y when 1 then xx when 2 then 63 - y else 63 - xx end as oy, case k when 0 then xx when 1 then 63 - y when 2 then 63 - xx else y end as ox, p0, p1, p2, p3 from b)
select section_id, oy as y, ox as x, {", ".join(f"round(avg(p{c}), 6) as p{c}" for c in range(4))} from o group by 1, 2, 3""")
def _(spark, sf):
    augs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("f")) for k in range(4) for f in range(2)])
    p = raster(spark, sf, "probs").where("member = 0").select(*AT, "p0", "p1", "p2", "p3", F.explode(augs).alias("a")).select("*", "a.*")
    aug = p.select(*AT, "k", (F.col("f") == 1).alias("flip"), *[((F.col(f"p{c}") + (F.col("k") * 3 + F.col("f")) * c) / 255.0).alias(f"p{c}") for c in range(4)])
    out = tiling.merge_augmented(aug, K, 64)
    return out.select("section_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), *[F.round(f"p{c}", 6).alias(f"p{c}") for c in range(4)])


def _linear_model():
    """Stand-in for a network: a soft-max of four fixed combinations of the colours."""
    import numpy as np

    weights = np.array([[1, 1, 1], [-1, 2, 0], [0, -1, 2], [2, -1, -1]], float) / 64

    def predict(batch: pd.DataFrame) -> pd.DataFrame:
        z = batch[["r", "g", "b"]].to_numpy(float) @ weights.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        out = batch[["section_id", "y", "x"]].copy()
        for c in range(4):
            out[f"p{c}"] = p[:, c]
        return out

    return predict


_Z = ["(r + g + b) / 64.0e0", "(2 * g - r) / 64.0e0", "(2 * b - g) / 64.0e0", "(2 * r - g - b) / 64.0e0"]


@query("c19_score_tiles", f"""{W('image')}, z as (select section_id, y, x, {", ".join(f"exp({z}) as e{c}" for c, z in enumerate(_Z))} from image)
select section_id, y, x, {", ".join(f"round(e{c} / (e0 + e1 + e2 + e3), 6) as p{c}" for c in range(4))} from z""")
def _(spark, sf):
    px = raster(spark, sf, "image").select(*AT, "r", "g", "b")
    out = tiling.score_tiles(px, _linear_model, "section_id long, y long, x long, p0 double, p1 double, p2 double, p3 double")
    return out.select("section_id", "y", "x", *[F.round(f"p{c}", 6).alias(f"p{c}") for c in range(4)])


# ---- decoding ---------------------------------------------------------------------


def _member(spark, sf, m):
    return raster(spark, sf, "probs").where(F.col("member") == m).drop("member")


NESTED = f"""pr as materialized (select section_id, y, x, p2 + p3 > p0 + p1 as les, p3 > p2 as hot, case when p1 >= p0 then 1 else 0 end as outr from probs where member = 2),
nl as materialized (select section_id, y, x from pr where not les), {labels_sql('nl', 'nc', 4)}, {HOLES.format(n='nc')},
le as materialized (select section_id, y, x, hot from pr where les union all select h.section_id, h.y, h.x, hot from nch h join pr using (section_id, y, x)),
ot as materialized (select section_id, y, x from pr except select section_id, y, x from le),
rowd as materialized (select l.section_id, l.y, l.x, o.y is null as isle,
    least(l.x - max(o.x) over (partition by l.section_id, l.y order by l.x rows between unbounded preceding and current row),
          min(o.x) over (partition by l.section_id, l.y order by l.x rows between current row and unbounded following) - l.x) as dx from pr l left join ot o using (section_id, y, x)),
nearby as materialized (select distinct a.section_id, a.y, a.x from (select * from le where hot) a, range(-11, 12) p(dy), rowd r
   where r.section_id = a.section_id and r.y = a.y + dy and r.x = a.x and dy * dy + r.dx * r.dx <= 128),
nd as materialized (select pr.section_id, pr.y, pr.x, cast(case when le.y is null then outr when le.hot and nb.y is null then 3 else 2 end as int) as cls
  from pr left join le using (section_id, y, x) left join nearby nb using (section_id, y, x))"""


@query("d10_nested_decode", f"{W('probs', recursive=True)}, {NESTED} select section_id, cls, count(*) as n, cast(sum(y * 64 + x) as bigint) as place from nd group by 1, 2")
def _(spark, sf):
    return decode.nested_decode(_member(spark, sf, 2), K, block=BLOCK).groupBy("section_id", "cls").agg(
        F.count("*").alias("n"), F.sum(F.col("y") * 64 + F.col("x")).alias("place"))


@query("d10_nested_decode_rim", f"{W('probs', recursive=True)}, {NESTED.replace('<= 128', '<= 5')} select section_id, cls, count(*) as n, cast(sum(y * 64 + x) as bigint) as place from nd group by 1, 2")
def _(spark, sf):
    return decode.nested_decode(_member(spark, sf, 2), K, rim_um=2.0, block=BLOCK).groupBy("section_id", "cls").agg(
        F.count("*").alias("n"), F.sum(F.col("y") * 64 + F.col("x")).alias("place"))


@query("d10_interior_background")
def _(spark, sf):
    return decode.nested_decode(_member(spark, sf, 2), K, interior_background=True, fill_crater=True, block=BLOCK).groupBy("section_id", "cls").agg(
        F.count("*").alias("n"), F.sum(F.col("y") * 64 + F.col("x")).alias("place"))


_P1 = f"""{W('pred', recursive=True)}, a as materialized (select section_id, y, x from pred where cls < 2), {labels_sql('a', 'cl', 4)}, {HOLES.format(n='cl')},
nn as materialized (select h.section_id, h.y, h.x, min((h.y - p.y) ** 2 + (h.x - p.x) ** 2) filter (p.cls = 2) as c, min((h.y - p.y) ** 2 + (h.x - p.x) ** 2) filter (p.cls = 3) as a
   from clh h join pred p on p.section_id = h.section_id and p.cls >= 2 group by 1, 2, 3),
f1 as materialized (select p.section_id, p.y, p.x, cast(case when nn.y is null then cls when nn.a is not null and (nn.c is null or nn.a <= nn.c) then 3 else 2 end as int) as cls, cls >= 2 or nn.y is not null as inside
   from pred p left join nn using (section_id, y, x))"""


@query("d11_fill_lesion_holes", f"{_P1} select section_id, y, x, cls from f1 where inside")
def _(spark, sf):
    out = decode.fill_lesion_holes(raster(spark, sf, "pred"), K, BLOCK).where("inside")
    return out.select("section_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "cls")


@query("d12_bridge_fragments")
def _(spark, sf):
    noisy = decode.nested_decode(_member(spark, sf, 2), K, rim_um=0.0, block=BLOCK).withColumn("inside", F.col("cls") >= 2)
    from ..session import materialize

    return decode.bridge_fragments(materialize(noisy), K, BLOCK).groupBy("section_id", "cls").agg(
        F.count("*").alias("n"), F.sum(F.col("y") * 64 + F.col("x")).alias("place"))


_E5 = blocks.ellipse(5)


@query("d13_fill_ablation", f"""{W('pred', 'gt', recursive=True)}, {LAT}, ab as materialized (select section_id, y, x from pred where cls = 3),
u as materialized ({dilate_sql('ab', _E5)}), k as materialized ({erode_sql('u', _E5)}), nk as materialized (select section_id, y, x from lat except select section_id, y, x from k),
{labels_sql('nk', 'nc', 4)}, {HOLES.format(n='nc')}, inn as materialized (select * from k union select * from nch)
select p.section_id, p.y, p.x from pred p join inn using (section_id, y, x) where cls in (1, 2)""")
def _(spark, sf):
    from ..session import materialize

    mask = materialize(raster(spark, sf, "pred").select(*AT, "cls", (F.col("cls") >= 1).alias("inside")))
    after = decode.fill_ablation(mask, K, BLOCK).select(*AT, F.col("cls").alias("new"))
    return mask.where("cls < 3").join(after.where("new = 3"), AT).select("section_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))


@query("d11_d14_clean_mask")
def _(spark, sf):
    return decode.clean_mask(raster(spark, sf, "pred").select(*AT, "cls"), K, BLOCK).groupBy("section_id", "cls").agg(
        F.count("*").alias("n"), F.sum(F.col("y") * 64 + F.col("x")).alias("place"))


@query("d16_otsu_tissue", f"""{W('image')}, {GREY}, {BLUR}, h as (select section_id, v, count(*) n from blur group by 1, 2),
c as (select section_id, v, sum(n) over w n0, sum(n * v) over w s0, sum(n) over (partition by section_id) nt, sum(n * v) over (partition by section_id) st from h window w as (partition by section_id order by v)),
b as (select section_id, v, case when nt > n0 then round(n0 / nt * (1 - n0 / nt) * (s0 / n0 - (st - s0) / (nt - n0)) * (s0 / n0 - (st - s0) / (nt - n0)), 9) else 0 end as q from c),
t as (select section_id, arg_max(v, (q, -v)) t from b group by 1)
select section_id, cast(case when v <= t then 1 else 0 end as int) as cls, count(*) as n, cast(sum(y * 64 + x) as bigint) as place from blur join t using (section_id) group by 1, 2""")
def _(spark, sf):
    from ..operators import morphology

    blurred = morphology.gaussian5(grey(spark, sf), K, BLOCK)
    return windowing.otsu_tissue(blurred, K).groupBy("section_id", "cls").agg(F.count("*").alias("n"), F.sum(F.col("y") * 64 + F.col("x")).alias("place"))
