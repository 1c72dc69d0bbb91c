"""Queries over section rasters: colours, neighbourhoods, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import colour, scalars
from ..functions.fixed import CLASS_NAMES, PALETTE
from ..operators import blocks, components, distance, evaluation, morphology
from .rasters import BLOCK, raster, raster_cte, sections
from .registry import query

K = ["section_id"]


def W(*kinds: str, recursive: bool = False) -> str:
    """``with`` clause naming the rasters: gt, pred, probs, image, blended."""
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(raster_cte(k, k) for k in kinds)


def values(offsets) -> str:
    return "(values " + ", ".join(f"({dy},{dx})" for dy, dx in offsets) + ") o(dy, dx)"


def dilate_sql(src: str, offsets, extra: str = "") -> str:
    """Pixels of the section within the offsets of ``src``."""
    return (f"select distinct section_id, {extra} y + dy as y, x + dx as x from {src}, {values(offsets)} "
            f"where y + dy between 0 and 63 and x + dx between 0 and 63")


def erode_sql(src: str, offsets, extra: str = "") -> str:
    """Pixels all of whose neighbours inside the section belong to ``src``."""
    off = f"(select section_id, {extra} y, x from lat where (section_id, y, x) not in (select section_id, y, x from {src}))"
    return f"select section_id, y, x from lat except {dilate_sql(off, offsets)}"


LAT = "lat as materialized (select section_id, y, x from gt)"
AT = ["section_id", "y", "x"]


def pairs(spark, sf):
    return evaluation.paired(raster(spark, sf, "gt"), raster(spark, sf, "pred"), K)


PAIR = f"{W('gt', 'pred')}, pair as materialized (select section_id, y, x, gt.cls as gt, pred.cls as pred from gt join pred using (section_id, y, x))"
RGB = "case when g > 200 and r < 100 and b < 100 then 1 when b > 200 and r < 100 and g < 100 then 2 when r > 200 and g < 100 and b < 100 then 3 else 0 end"


@query("b1_rgb_to_class", f"{W('blended')} select section_id, cast({RGB} as int) as cls, count(*) as n, cast(sum(y * 64 + x) as bigint) as place from blended group by 1, 2")
def _(spark, sf):
    return raster(spark, sf, "blended").groupBy("section_id", colour.rgb_class(F.col("r"), F.col("g"), F.col("b")).alias("cls")).agg(
        F.count("*").alias("n"), F.sum(F.col("y") * 64 + F.col("x")).alias("place"))


@query("b2_class_to_rgb", f"""{W('gt')}, pal(cls, r, g, b) as (values {", ".join(f"({c},{r},{g},{b})" for c, (r, g, b) in PALETTE.items())})
select section_id, y, x, r, g, b from (select section_id, cast(y as int) y, cast(x as int) x, cls from gt) join pal using (cls)""")
def _(spark, sf):
    return raster(spark, sf, "gt").select(*AT, colour.class_rgb(F.col("cls")).alias("c")).select(*AT, "c.r", "c.g", "c.b")


@query("b3_tolerant_match", f"""{W('blended')}, h as (select section_id, c, case when c = 0 then r > 240 and g > 240 and b > 240
   else abs(r - case c when 3 then 255 else 0 end) < 30 and abs(g - case c when 1 then 255 else 0 end) < 30 and abs(b - case c when 2 then 255 else 0 end) < 30 end as hit
  from blended, range(4) t(c))
select section_id, cast(c as int) as cls, round(avg(cast(hit as int)) * 100, 6) as pct from h group by all having avg(cast(hit as int)) * 100 > 0.05""")
def _(spark, sf):
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    shares = raster(spark, sf, "blended").groupBy("section_id").agg(
        *[(F.avg(colour.tolerant_match(c, *rgb).cast("int")) * 100).alias(f"p{c}") for c in range(4)])
    return shares.select("section_id", F.posexplode(F.array("p0", "p1", "p2", "p3")).alias("cls", "pct")).where("pct > 0.05").select(
        "section_id", "cls", F.round("pct", 6).alias("pct"))


@query("b4_luma", f"{W('image')} select section_id, grey, count(*) as n from (select section_id, cast(trunc(0.299e0 * r + 0.587e0 * g + 0.114e0 * b) as int) as grey from image) where grey < 250 group by 1, 2")
def _(spark, sf):
    grey = raster(spark, sf, "image").select("section_id", colour.luma(F.col("r"), F.col("g"), F.col("b")).alias("grey"))
    # a condition on the key would be moved below the grouping and spell out the whole drawing of a pixel, too long to be compiled
    return grey.groupBy("section_id", "grey").agg(F.count("*").alias("n"), F.max("grey").alias("same")).where("same < 250").drop("same")


@query("b17_difference_codes", f"""{PAIR} select section_id, case when gt = pred then 'agree' when pred > gt then 'fp_' || pred else 'fn_' || gt end as code, count(*) as n from pair group by all""")
def _(spark, sf):
    return pairs(spark, sf).groupBy("section_id", scalars.difference_code(F.col("gt"), F.col("pred")).alias("code")).agg(F.count("*").alias("n"))


@query("b18_overlap_codes", f"""{PAIR} select section_id, cast(c as int) as cls, case when gt = c and pred = c then 'both' when gt = c then 'gt_only' when pred = c then 'pred_only' else 'none' end as code, count(*) as n
 from pair, range(1, 4) t(c) group by all""")
def _(spark, sf):
    # counts per class pair first, so that the three classes multiply a handful of rows
    counts = pairs(spark, sf).groupBy("section_id", "gt", "pred").agg(F.count("*").alias("m"))
    return counts.withColumn("cls", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).groupBy(
        "section_id", "cls", scalars.overlap_code(F.col("gt") == F.col("cls"), F.col("pred") == F.col("cls")).alias("code")).agg(
        F.sum("m").alias("n"))


HSV_SQL = """d as (select *, greatest(r, g, b) as hi, greatest(r, g, b) - least(r, g, b) as de from image),
e as (select *, floor(((case when hi = r then g - b when hi = g then b - r + 2 * de else r - g + 4 * de end) * round_even(122880.0e0 / greatest(de, 1), 0) + 2048) / 4096) as h0,
        floor((de * round_even(1044480.0e0 / greatest(hi, 1), 0) + 2048) / 4096) as s from d),
hsv as materialized (select *, case when h0 < 0 then h0 + 180 else h0 end as h from e)"""


@query("b19_hsv_labels", f"""{W('image')}, {HSV_SQL}
select section_id, cast(case when hi < 225 and s > 60 and (h < 12 or h > 168) then 3 when hi < 225 and s > 50 and h > 110 and h < 145 then 2 when hi < 225 then 1 else 0 end as int) as label,
 count(*) as n, cast(sum(y * 64 + x) as bigint) as place from hsv group by 1, 2""")
def _(spark, sf):
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    fg = F.greatest(*rgb) < 225
    return raster(spark, sf, "image").groupBy("section_id", colour.hsv_class(fg, *rgb).alias("label")).agg(
        F.count("*").alias("n"), F.sum(F.col("y") * 64 + F.col("x")).alias("place"))


@query("b21_nearest_resize", f"""{W('gt')} select section_id, cast(ty as int) as y, cast(tx as int) as x, cls
from range(48) a(ty), range(100) b(tx) join gt on gt.y = ty * 64 // 48 and gt.x = tx * 64 // 100""")
def _(spark, sf):
    from ..operators import resample

    return resample.nearest(raster(spark, sf, "gt"), K, (64, 64), (48, 100))


@query("b22_area_downscale", f"""{W('image')} select section_id, y // 2 as y, x // 2 as x, round(avg(r), 6) as r, round(avg(g), 6) as g, round(avg(b), 6) as b from image group by all""")
def _(spark, sf):
    from ..operators import resample

    out = resample.area_mean(raster(spark, sf, "image"), K, sections(spark, sf), 32)
    return out.select("section_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"),
                      *[F.round(c, 6).alias(c) for c in ("r", "g", "b")])


@query("b23_subsample_centroid", f"""{W('gt')} select section_id, round((avg((x - 4) / 8.0e0) + 0.5) * 8, 6) as cx, round((avg((y - 4) / 8.0e0) + 0.5) * 8, 6) as cy
 from gt where y % 8 = 4 and x % 8 = 4 and cls <> 0 group by section_id""")
def _(spark, sf):
    from ..operators import resample

    return resample.tissue_centroid(raster(spark, sf, "gt"), K, sections(spark, sf), 8).select(
        "section_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


#: Sides that differ and are no multiples of anything here.
TALL, WIDE = 67, 90


def uneven(name: str, columns: str) -> str:
    """CTE of a raster stretched to ``TALL`` by ``WIDE`` pixels."""
    return f"{name}_u as materialized (select section_id, ty as y, tx as x, {columns} from range({TALL}) a(ty), range({WIDE}) b(tx) join {name} on {name}.y = ty * 64 // {TALL} and {name}.x = tx * 64 // {WIDE})"


def uneven_raster(spark, sf, kind):
    from ..operators import resample

    return resample.nearest(raster(spark, sf, kind), K, (64, 64), (TALL, WIDE))


_LATTICE_U = f"""seen as (select section_id, t, u from range({TALL // 8}) p(t), range({WIDE // 8}) q(u) join gt_u on y = floor((t + 0.5) * ({TALL}.0e0 / {TALL // 8})) and x = floor((u + 0.5) * ({WIDE}.0e0 / {WIDE // 8})) where cls <> 0),
cen as (select section_id, (avg(u) + 0.5) * 8 as cx, (avg(t) + 0.5) * 8 as cy from seen group by 1)"""


@query("b23_subsample_centroid_uneven", f"{W('gt')}, {uneven('gt', 'cls')}, {_LATTICE_U} select section_id, round(cx, 6) as cx, round(cy, 6) as cy from cen")
def _(spark, sf):
    from ..operators import resample

    # stored without background, so that the mask's own rows do not tell its sides
    mask = uneven_raster(spark, sf, "gt").where("cls <> 0")
    return resample.tissue_centroid(mask, K, sections(spark, sf, TALL, WIDE), 8).select("section_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def _shares(axis: str, side: int, cells: int) -> str:
    return (f"{axis}s as materialized (select {axis}, c{axis}, least({axis} + 1, (c{axis} + 1) * {side}.0e0 / {cells}) - greatest({axis}, c{axis} * {side}.0e0 / {cells}) as s{axis} "
            f"from range({side}) p({axis}), range({cells}) q(c{axis}) where s{axis} > 1e-9)")


@query("b22_area_downscale_uneven", f"""{W('image')}, {uneven('image', 'r, g, b')}, {_shares('y', TALL, int(TALL * (40 / WIDE)))}, {_shares('x', WIDE, int(WIDE * (40 / WIDE)))}
select section_id, cy as y, cx as x, {', '.join(f'round(sum({c} * sy * sx) / sum(sy * sx), 6) as {c}' for c in 'rgb')} from image_u join ys using (y) join xs using (x) group by all""")
def _(spark, sf):
    from ..operators import resample

    out = resample.area_mean(uneven_raster(spark, sf, "image"), K, sections(spark, sf, TALL, WIDE), 40)
    return out.select("section_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), *[F.round(c, 6).alias(c) for c in ("r", "g", "b")])


# ---- neighbourhood ------------------------------------------------------------

E3, E5, E7 = blocks.ellipse(3), blocks.ellipse(5), blocks.ellipse(7)
LESION = f"{W('gt')}, {LAT}, a as materialized (select section_id, y, x from gt where cls >= 2)"


def _on(spark, sf):
    return raster(spark, sf, "gt").select(*AT, (F.col("cls") >= 2).alias("on"))


def _set(df):
    return df.where("on").select("section_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))


@query("d1_dilate", f"{LESION} {dilate_sql('a', E5)}")
def _(spark, sf):
    return _set(morphology.morph(_on(spark, sf), K, "dilate", 5, block=BLOCK))


@query("d1_erode", f"{LESION} {erode_sql('a', blocks.rectangle(3))}")
def _(spark, sf):
    return _set(morphology.morph(_on(spark, sf), K, "erode", 3, "rectangle", block=BLOCK))


@query("d2_close", f"{LESION}, u as materialized ({dilate_sql('a', E7)}) {erode_sql('u', E7)}")
def _(spark, sf):
    return _set(morphology.morph(_on(spark, sf), K, "close", 7, block=BLOCK))


@query("d2_open", f"{LESION}, u as materialized ({erode_sql('a', E5)}) {dilate_sql('u', E5)}")
def _(spark, sf):
    return _set(morphology.morph(_on(spark, sf), K, "open", 5, block=BLOCK))


def labels_sql(src: str, name: str, conn: int = 8, keys: str = "section_id") -> str:
    """CTEs ``<name>`` (pixel labels) and ``<name>_runs`` of the components of ``src``."""
    d = 1 if conn == 8 else 0
    on = " and ".join(f"b.{k} = a.{k}" for k in keys.split(", "))
    ak = ", ".join(f"a.{k}" for k in keys.split(", "))
    ek = ", ".join(f"e.{k}" for k in keys.split(", "))
    one = " and ".join(f"e.{k} = cc.{k}" for k in keys.split(", "))
    two = " and ".join(f"r.{k} = e.{k}" for k in keys.split(", "))
    return f"""
{name}_r as materialized (select {keys}, y, min(x) as x0, max(x) as x1, cast(y * 16777216 + min(x) as bigint) as id
  from (select {keys}, y, x, x - row_number() over (partition by {keys}, y order by x) as grp from {src}) group by {keys}, y, grp),
{name}_p as materialized (select {ak}, a.id as p, b.id as q from {name}_r a join {name}_r b on {on} and b.y = a.y + 1 and b.x0 <= a.x1 + {d} and b.x1 >= a.x0 - {d}),
{name}_e as materialized (select {keys}, p, q from {name}_p union all select {keys}, q, p from {name}_p),
{name}_cc({keys}, id, lab) using key ({keys}, id) as (
  select {keys}, id, id from {name}_r
  union
  select {ek}, e.q, min(cc.lab) from {name}_cc cc join {name}_e e on {one} and e.p = cc.id
    join recurring.{name}_cc r on {two} and r.id = e.q where cc.lab < r.lab group by {ek}, e.q),
{name}_runs as materialized (select {name}_r.*, lab as label from {name}_r join {name}_cc using ({keys}, id)),
{name} as materialized (select {keys}, y, unnest(generate_series(x0, x1)) as x, label from {name}_runs)"""


LESION_R = LESION.replace("with ", "with recursive ", 1)


@query("d3_component_labels", f"{LESION_R}, {labels_sql('a', 'lab')} select section_id, y, x, label from lab")
def _(spark, sf):
    return components.label_pixels(_on(spark, sf).where("on"), K, 8, BLOCK).select(
        "section_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "label")


@query("d4_component_statistics", f"""{LESION_R}, {labels_sql('a', 'lab')}
select section_id, label, count(*) as area, cast(min(x) as int) as x, cast(min(y) as int) as y, cast(max(x) - min(x) + 1 as int) as w, cast(max(y) - min(y) + 1 as int) as h,
 round(avg(x), 6) as cx, round(avg(y), 6) as cy from lab group by section_id, label""")
def _(spark, sf):
    runs = components.label_runs(_on(spark, sf).where("on"), K, 8, BLOCK)
    return components.run_statistics(runs, K).select(
        "section_id", "label", "area", "x", "y", "w", "h", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


DIST = """nr as materialized (select section_id, y, x, cls, min(abs(x - ox)) as dx from (select section_id, y, x, cls from {src}) g
  left join (select section_id, y, x as ox from {src} where {off}) z using (section_id, y) group by all),
di as materialized (select a.section_id, a.y, a.x, min(b.dx * b.dx + (a.y - b.y) * (a.y - b.y)) as d2
  from nr a join nr b on a.section_id = b.section_id and a.x = b.x where a.dx > 0 or a.dx is null group by all)"""


@query("d5_distance", f"""{W('gt')}, {DIST.format(src='gt', off='cls = 0')} select section_id, y, x, cast(d2 as bigint) as d2, round(sqrt(d2), 6) as dist from di""")
def _(spark, sf):
    on = raster(spark, sf, "gt").select(*AT, (F.col("cls") != 0).alias("on"))
    return distance.distance_squared(on, K).select(
        "section_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "d2", F.round(F.sqrt("d2"), 6).alias("dist"))


HOLES = """{n}o as (select distinct section_id, label from {n} where y in (0, 63) or x in (0, 63)),
{n}h as materialized (select section_id, y, x from {n} where (section_id, label) not in (select section_id, label from {n}o))"""


@query("d6_fill_holes", f"""{W('pred', recursive=True)}, a as materialized (select section_id, y, x from pred where cls < 2), {labels_sql('a', 'cl', 4)}, {HOLES.format(n='cl')}
select section_id, y, x from clh""")
def _(spark, sf):
    lattice = raster(spark, sf, "pred").select(*AT, (F.col("cls") >= 2).alias("on"))
    return components.fill_holes(lattice, K, BLOCK).where("hole").select(
        "section_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))


# the four neighbours and the pixel itself make the 3x3 ellipse
_EDGE = """select section_id, y, x from (select section_id, y, x, cls, lag(cls) over r a, lead(cls) over r b, lag(cls) over c c, lead(cls) over c d from {n}
  window r as (partition by section_id, y order by x), c as (partition by section_id, x order by y)) where cls <> coalesce(a, cls) or cls <> coalesce(b, cls) or cls <> coalesce(c, cls) or cls <> coalesce(d, cls)"""


@query("d7_class_boundary", f"{W('gt')} {_EDGE.format(n='gt')}")
def _(spark, sf):
    return morphology.class_boundary(raster(spark, sf, "gt"), K, 3, BLOCK).select(
        "section_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))


GREY = "grey as materialized (select section_id, y, x, (r * 4899 + g * 9617 + b * 1868 + 8192) // 16384 as v from image)"
BLUR = """tap(d, w) as (values (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)),
bx as materialized (select a.section_id, a.y, a.x, sum(w * b.v) as v from grey a, tap, grey b where b.section_id = a.section_id and b.y = a.y
   and b.x = case when a.x + d < 0 then -(a.x + d) when a.x + d > 63 then 126 - (a.x + d) else a.x + d end group by all),
blur as materialized (select a.section_id, a.y, a.x, cast((sum(w * b.v) + 128) // 256 as int) as v from bx a, tap, bx b where b.section_id = a.section_id and b.x = a.x
   and b.y = case when a.y + d < 0 then -(a.y + d) when a.y + d > 63 then 126 - (a.y + d) else a.y + d end group by all)"""


def grey(spark, sf):
    return raster(spark, sf, "image").select(*AT, colour.luma_rounded(F.col("r"), F.col("g"), F.col("b")).alias("v"))


@query("d8_gaussian_blur", f"{W('image')}, {GREY}, {BLUR} select section_id, v, count(*) as n, cast(sum(y * 64 + x) as bigint) as place from blur group by all")
def _(spark, sf):
    return morphology.gaussian5(grey(spark, sf), K, BLOCK).groupBy("section_id", "v").agg(
        F.count("*").alias("n"), F.sum(F.col("y") * 64 + F.col("x")).alias("place"))


@query("d9_resolve_blended", f"""{W('blended', recursive=True)},
k as materialized (select section_id, y, x, {RGB} as c, r > 240 and g > 240 and b > 240 as white from blended),
f(step, section_id, y, x, cls) as (
  select 0, section_id, y, x, case when c = 0 and not white then -1 else c end from k
  union all
  select step + 1, section_id, y, x, case when cls >= 0 or best is null then cls else best end
  from (select a.step, a.section_id, a.y, a.x, any_value(a.cls) as cls,
          case when greatest(count(*) filter (b.cls = 0), count(*) filter (b.cls = 1), count(*) filter (b.cls = 2), count(*) filter (b.cls = 3)) = 0 then null
               when count(*) filter (b.cls = 0) >= greatest(count(*) filter (b.cls = 1), count(*) filter (b.cls = 2), count(*) filter (b.cls = 3)) then 0
               when count(*) filter (b.cls = 1) >= greatest(count(*) filter (b.cls = 2), count(*) filter (b.cls = 3)) then 1
               when count(*) filter (b.cls = 2) >= count(*) filter (b.cls = 3) then 2 else 3 end as best
        from f a, {values(blocks.rectangle(3))}, f b
        where b.section_id = a.section_id and b.y = a.y + dy and b.x = a.x + dx and a.step < 3
        group by a.step, a.section_id, a.y, a.x))
select section_id, cast(cls as int) as cls, count(*) as n, cast(sum(y * 64 + x) as bigint) as place from f where step = 3 group by 1, 2""")
def _(spark, sf):
    return morphology.resolve_blended(raster(spark, sf, "blended"), K, 20, BLOCK).groupBy("section_id", "cls").agg(
        F.count("*").alias("n"), F.sum(F.col("y") * 64 + F.col("x")).alias("place"))


@query("d14_exposed_ablation", f"""{W('pred')}, ex as (select distinct a.section_id, a.y, a.x from pred a, {values(blocks.rectangle(3))}, pred b
  where a.cls = 3 and b.section_id = a.section_id and b.y = a.y + dy and b.x = a.x + dx and b.cls < 2)
select section_id, y, x from ex""")
def _(spark, sf):
    mask = raster(spark, sf, "pred")
    after = morphology.expose_rule(mask, K, BLOCK).select(*AT, F.col("cls").alias("new"))
    return mask.where("cls = 3").join(after.where("new = 2"), AT).select(
        "section_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))


@query("d15_border_and_ring", f"""{LESION_R}, {labels_sql('a', 'lab')},
ring as (select distinct l.section_id, l.label from lab l, {values(E3)}, gt b where b.section_id = l.section_id and b.y = l.y + dy and b.x = l.x + dx and b.cls = 0)
select section_id, label, min(y) = 0 or min(x) = 0 or max(y) = 63 or max(x) = 63 as on_border,
 (section_id, label) in (select section_id, label from ring) as meets_background from lab group by section_id, label""")
def _(spark, sf):
    mask = raster(spark, sf, "gt")
    runs = components.label_runs(morphology.beside_background(mask, K, BLOCK), K, 8, BLOCK, ["beside"])
    extent = mask.groupBy("section_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return components.touches_border(runs, extent, K, ["beside"]).withColumnRenamed("beside", "meets_background")


# ---- scores -------------------------------------------------------------------

CM = f"""{PAIR}, frame as (select section_id, g.c as gt, p.c as pred from (select distinct section_id from gt), range(4) g(c), range(4) p(c)),
cm as materialized (select f.section_id, cast(f.gt as int) as gt, cast(f.pred as int) as pred, count(pair.y) as n
  from frame f left join pair on pair.section_id = f.section_id and pair.gt = f.gt and pair.pred = f.pred group by all)"""
CLS = """cl as materialized (select section_id, cast(c as int) as cls, cast(sum(n) filter (gt = c and pred = c) as bigint) tp, cast(sum(n) filter (gt <> c and pred = c) as bigint) fp,
  cast(sum(n) filter (gt = c and pred <> c) as bigint) fn from cm, range(4) t(c) group by section_id, c),
me as materialized (select *, tp / nullif(tp + fp + fn, 0) as iou, 2 * tp / nullif(2 * tp + fp + fn, 0) as dice, tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as recall from cl)"""


@query("f1_confusion_matrix", f"{CM} select section_id, gt, pred, n, round(case when sum(n) over w > 0 then n / sum(n) over w else 0 end, 6) as row_share from cm window w as (partition by section_id, gt)")
def _(spark, sf):
    m = evaluation.confusion(pairs(spark, sf), K)
    return m.select("section_id", "gt", "pred", "n", F.round("row_share", 6).alias("row_share"))


@query("f2_class_metrics", f"{CM}, {CLS} select section_id, cls, tp, fp, fn, round(iou, 6) as iou, round(dice, 6) as dice, round(precision, 6) as precision, round(recall, 6) as recall from me")
def _(spark, sf):
    m = evaluation.class_metrics(evaluation.confusion(pairs(spark, sf), K), K)
    return m.select("section_id", "cls", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("iou", "dice", "precision", "recall")])


@query("f3_overall_metrics", f"""{CM}, {CLS} select section_id, round(sum(tp) / sum(tp + fn), 6) as pixel_accuracy, round(coalesce(avg(iou), 0), 6) as mean_iou_all,
 round(coalesce(avg(iou) filter (cls > 0), 0), 6) as mean_iou_fg, round(sum((tp + fn) * iou) / sum(tp + fn), 6) as weighted_iou from me group by section_id""")
def _(spark, sf):
    m = evaluation.overall_metrics(evaluation.confusion(pairs(spark, sf), K), K)
    return m.select("section_id", *[F.round(c, 6).alias(c) for c in ("pixel_accuracy", "mean_iou_all", "mean_iou_fg", "weighted_iou")])


def _per_class(metric, expr):
    return ", ".join(f"round(max({expr}) filter (cls = {c}), 6) as {metric}_{n.lower()}" for c, n in enumerate(CLASS_NAMES))


IMAGE_SQL = f"""select section_id, {_per_class('iou', 'iou')}, {_per_class('dice', 'dice')},
 {", ".join(f"round(sum(tp + fn) filter (cls = {c}) / sum(tp + fn), 6) as gt_frac_{n.lower()}" for c, n in enumerate(CLASS_NAMES))},
 round(sum(tp) / sum(tp + fn), 6) as pixel_acc, round(avg(iou) filter (tp + fn > 0), 6) as mean_iou, round(avg(dice) filter (tp + fn > 0), 6) as mean_dice,
 round(avg(iou) filter (tp + fn > 0 and cls >= 2), 6) as lesion_iou, round(avg(dice) filter (tp + fn > 0 and cls >= 2), 6) as lesion_dice from me group by section_id"""


@query("f4_image_metrics", f"{CM}, {CLS} {IMAGE_SQL}")
def _(spark, sf):
    m = evaluation.image_metrics(pairs(spark, sf), K)
    return m.select("section_id", *[F.round(c, 6).alias(c) for c in m.columns if c != "section_id"])


def _bound(name):
    return f"{name}b as materialized ({_EDGE.format(n=name)})"


def _near(src, other, t):
    return f"""(select count(*) n, a.section_id from {src} a where exists (select 1 from {other}{t} d where d.section_id = a.section_id and d.y = a.y and d.x = a.x) group by a.section_id)"""


_TOL = ", ".join(f"gtb{t} as materialized ({dilate_sql('gtb', blocks.ellipse(2 * t + 1))}), predb{t} as materialized ({dilate_sql('predb', blocks.ellipse(2 * t + 1))})" for t in (1, 3, 5))
_PR = " union all ".join(f"""select s.section_id, {t} as tol, coalesce(p.n / nullif(pb.n, 0), 0) as p, coalesce(r.n / nullif(gb.n, 0), 0) as r
 from (select distinct section_id from gt) s left join (select section_id, count(*) n from predb group by 1) pb using (section_id)
 left join (select section_id, count(*) n from gtb group by 1) gb using (section_id)
 left join {_near('predb', 'gtb', t)} p using (section_id) left join {_near('gtb', 'predb', t)} r using (section_id)""" for t in (1, 3, 5))


@query("f5_boundary_metrics", f"""{W('gt', 'pred')}, {_bound('gt')}, {_bound('pred')}, {_TOL}, pr as ({_PR})
select section_id, tol, round(p, 6) as boundary_precision, round(r, 6) as boundary_recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as boundary_f1 from pr""")
def _(spark, sf):
    m = evaluation.boundary_metrics(pairs(spark, sf), K, block=BLOCK)
    return m.select("section_id", "tol", *[F.round(c, 6).alias(c) for c in ("boundary_precision", "boundary_recall", "boundary_f1")])


@query("f11_class_distribution", f"""{PAIR} select section_id, cast(c as int) as cls, count(*) filter (gt = c) as gt_px, count(*) filter (pred = c) as pred_px from pair, range(4) t(c) group by section_id, c""")
def _(spark, sf):
    counts = pairs(spark, sf).groupBy("section_id", "gt", "pred").agg(F.count("*").alias("n"))
    both = counts.select("section_id", F.explode(F.array(
        F.struct(F.col("gt").alias("cls"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("p")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("g"), F.col("n").alias("p")))).alias("s"))
    frame = counts.select("section_id").distinct().withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(3))))
    stats = both.groupBy("section_id", "s.cls").agg(F.sum("s.g").alias("gt_px"), F.sum("s.p").alias("pred_px"))
    return frame.join(stats, ["section_id", "cls"], "left").fillna(0)


@query("f15_macro_dice", f"""{CM}, pool as (select gt, pred, cast(sum(n) as bigint) n from cm group by all),
c as (select c, sum(n) filter (gt = c and pred = c) tp, sum(n) filter (gt <> c and pred = c) fp, sum(n) filter (gt = c and pred <> c) fn from pool, range(4) t(c) group by c)
select round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)), 6) as macro_dice from c""")
def _(spark, sf):
    return evaluation.macro_dice(evaluation.confusion(pairs(spark, sf), []), []).select(F.round("macro_dice", 6).alias("macro_dice"))
