"""Queries over manifests, training splits and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ids, scalars
from ..operators import dataset, evaluation, training_log
from ..session import materialize
from ..sources import discovery, sinks, tables
from .raster_queries import AT, K, W, pairs
from .rasters import raster
from .registry import query, table

# ---- manifests: several files per order ----------------------------------------

_SERIES = "case o_custkey % 5 when 0 then 'PVcont' when 1 then 'cvb' when 2 then 'CPBSV' when 3 then 'H' else '20H' end"
_SLIDE = "case when o_custkey % 30 = 0 then '' else cast(o_custkey % 30 as varchar(9)) end"
_NAME = f"concat({_SERIES}, {_SLIDE}, '_0', cast(o_orderkey % 4 as varchar(9)))"
_SECTION = f"concat({_NAME}, '_k', cast(o_orderkey as varchar(9)))"
FILES = f"""
select concat('/data/raw/images/', {_SECTION}, '.tif') as path from orders where o_orderkey % 3 <> 2
union all select concat('/data/raw/', {_SECTION}, '.tif') from orders where o_orderkey % 4 = 1
union all select concat('/data/raw/images/', {_SECTION}, '_sample_01.TIF') from orders where o_orderkey % 7 = 3
union all select concat('/data/raw/masks/', {_SECTION}, '.png') from orders where o_orderkey % 5 <> 0
union all select concat('/data/raw/images/', {_SECTION}, '.png') from orders where o_orderkey % 11 = 0
union all select concat('/data/predictions/', {_SECTION}, '/images/', {_SECTION}, '_pred.png') from orders where o_orderkey % 6 < 4
union all select concat('/data/test/', {_SECTION}, '.tif') from orders where o_orderkey % 13 = 0
union all select concat('/data/collected/', {_SECTION}, '_pred.png') from orders where o_orderkey % 9 = 0
union all select concat('/data/tile_', cast(256 + 192 * (o_orderkey % 2) as varchar(9)), '/', case when o_custkey % 3 = 0 then 'ovlp_20' else 'no_shift' end,
   '/', {_NAME}, '_', cast(o_orderkey as varchar(9)), '_', cast(o_custkey as varchar(9)), '.tif') from orders
union all select concat('/data/mask_', cast(256 + 192 * (o_orderkey % 2) as varchar(9)), '/', case when o_custkey % 3 = 0 then 'ovlp_20' else 'no_shift' end,
   '/', {_NAME}, '_', cast(o_orderkey as varchar(9)), '_', cast(o_custkey as varchar(9)), '.png') from orders where o_orderkey % 8 <> 0
"""
FCTE = f"""with files as materialized ({FILES}),
f as materialized (select path, regexp_replace(path, '/[^/]*$', '') as dir, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') as stem from files)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    view = f"orders_rows_{abs(hash(sf)) % 10**9}"
    table(spark, sf, "orders").select("o_orderkey", "o_custkey").createOrReplaceTempView(view)
    # a manifest is a stored table: written once, then read by every branch of a pairing
    return materialize(spark.sql(FILES.replace("from orders", f"from {view}").replace("varchar(9)", "string")))


@query("a1_discover_files", f"""{FCTE} select path, case when lower(path) like '%.tif' then 'image' else 'mask' end as kind from f
 where not (path like '%/tile_mask_bkp/%' or path like '%/predictions/%' or path like '%/test/%') and (lower(path) like '%.tif' or lower(path) like '%.png')""")
def _(spark, sf):
    return discovery.images_and_masks(files(spark, sf))


@query("a2_pair_masks", f"""{FCTE}, ok as (select * from f where not (path like '%/predictions/%' or path like '%/test/%')),
i as (select path, dir, stem, regexp_replace(dir, '/[^/]*$', '') as parent from ok where lower(path) like '%.tif'),
x as (select dir, stem, path, 0 as k from ok where lower(path) like '%.png' union all
      select regexp_replace(dir, '/[^/]*$', ''), stem, path, 1 from ok where lower(path) like '%.png' and dir like '%/masks'),
m as (select dir, stem, arg_max(path, (k, path)) as mask from x group by 1, 2)
select i.path as image, coalesce(a.mask, b.mask) as mask from i left join m a on a.dir = i.dir and a.stem = i.stem
 left join m b on b.dir = i.parent and b.stem = i.stem""")
def _(spark, sf):
    return discovery.pair_images_with_masks(files(spark, sf))


@query("a3_pair_flat", f"""{FCTE}, i as (select stem as name, arg_min(path, (case when dir = '/data/raw/images' then 0 else 1 end, path)) as image from f
  where path like '%.tif' and dir in ('/data/raw/images', '/data/raw') and stem not like '%\\_sample\\_%' escape '\\' group by 1)
select name, image, path as mask from i join f on f.stem = i.name and f.dir = '/data/raw/masks'""")
def _(spark, sf):
    return discovery.pair_flat(files(spark, sf), "/data/raw")


@query("a4_sections_to_score", f"""{FCTE} select m.stem as name, coalesce(a.path, b.path) as path from f m
 left join f a on a.stem = m.stem and a.dir = '/data/raw/images' and a.path like '%.tif' left join f b on b.stem = m.stem and b.dir = '/data/raw' and b.path like '%.tif'
 where m.dir = '/data/raw/masks' and coalesce(a.path, b.path) is not null""")
def _(spark, sf):
    return discovery.sections_to_score(files(spark, sf), "/data/raw")


_TILES = """t as (select path, cast(regexp_extract(path, '/(tile|mask)_(\\d+)/', 2) as int) as size, regexp_extract(path, '/(tile|mask)_(\\d+)/', 1) as kind,
  regexp_extract(path, '_\\d+/([^/]+)/', 1) as shift, stem from f where path like '/data/tile%' or path like '/data/mask%')"""


@query("a5_tile_manifest", f"""{FCTE}, {_TILES} select a.size, a.shift, a.stem, a.path as tile, b.path as mask from t a join t b
 on a.size = b.size and a.shift = b.shift and a.stem = b.stem and a.kind = 'tile' and b.kind = 'mask' where a.shift = 'no_shift'""")
def _(spark, sf):
    return discovery.tile_manifest(files(spark, sf), [256, 448], "no_shift")


@query("a6_prediction_inputs", f"{FCTE} select distinct path from f where regexp_matches(lower(path), '\\.(tif|tiff|ndpi)$') and stem not like '%\\_sample\\_%' escape '\\'")
def _(spark, sf):
    return discovery.prediction_inputs(files(spark, sf))


@query("a7_lesion_summaries", """with l as (select l_suppkey, 'CP' || (l_suppkey % 40) || '_sample_0' || (l_suppkey % 4) as section_id, l_orderkey, l_linenumber, cast(l_partkey as double) as center_x, l_quantity from lineitem)
select section_id, regexp_extract(section_id, '^([A-Za-z]+\\d+)_sample', 1) as punch_id, l_orderkey, l_linenumber, center_x, l_quantity * 4 as ablation_diameter_um from l""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.expr("concat('/pred/CP', l_suppkey % 40, '_sample_0', l_suppkey % 4, '/csv/lesion_summary.csv')").alias("path"),
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("double").alias("Center_X_px"), F.lit(0.0).alias("Center_Y"),
        (F.col("l_quantity") * 4).alias("Ablation_Diameter_um"))
    out = tables.snake_case(rows).withColumn("section_id", tables.section_of_path(F.col("path")))
    return out.select("section_id", ids.punch_of_section(F.col("section_id")).alias("punch_id"), "l_orderkey", "l_linenumber",
                      "center_x", "ablation_diameter_um")


@query("a8_json_settings", "select event_id, cast(json_extract_string(props, '$.k') as int) as k, cast(i as int) as cls, round(cast(json_extract_string(props, '$.k') as int) / (i + 1.0), 6) as weight from events, range(4) t(i)")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.from_json("props", "k int").alias("j"))
    weights = F.array(*[F.col("j.k") / (i + 1.0) for i in range(4)])
    return ev.select("event_id", F.col("j.k").alias("k"), F.posexplode(weights).alias("cls", "weight")).withColumn("weight", F.round("weight", 6))


@query("a9_tile_audit", f"""{FCTE}, {_TILES} select size, kind as type, count(*) as n_files, count(distinct regexp_replace(stem, '_\\d+_\\d+$', '')) as n_tasks from t group by 1, 2""")
def _(spark, sf):
    return discovery.tile_audit(files(spark, sf)).select("size", "type", "n_files", "n_tasks")


@query("a10_resume", f"""{FCTE} select stem as name from f where dir = '/data/raw/masks' and stem not in (select regexp_replace(stem, '_pred$', '') from f where stem like '%\\_pred' escape '\\')""")
def _(spark, sf):
    at = files(spark, sf).select("path", ids.stem(F.col("path")).alias("name"))
    done = at.where(F.col("path").endswith("_pred.png")).select(F.regexp_replace("name", "_pred$", "").alias("name")).distinct()
    return discovery.not_done(at.where(ids.dirname(F.col("path")) == "/data/raw/masks").select("name"), done)


@query("a11_collect_predictions", f"""{FCTE}, p as (select distinct '/data/collected/' || stem || '.png' as target, path from f where path like '%\\_pred.png' escape '\\' and dir <> '/data/collected')
select target, min(path) as source from p where target not in (select path from f where dir = '/data/collected') group by target""")
def _(spark, sf):
    fs = files(spark, sf)
    return discovery.collect_predictions(fs, fs.where(ids.dirname(F.col("path")) == "/data/collected"), "/data/collected", overwrite=False)


_HAVE = "have as (select distinct o_orderpriority as member, o_custkey % 50 as section from orders where o_custkey % 50 <> length(o_orderpriority) or o_orderpriority < '3')"


@query("a12_complete_members", f"with {_HAVE} select member from have group by member having count(distinct section) = (select count(distinct o_custkey % 50) from orders)")
def _(spark, sf):
    have, need = _have(spark, sf)
    return discovery.complete_members(have, need, "member", "section")


def _have(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("member"), (F.col("o_custkey") % 50).alias("section"))
    return orders.where((F.col("section") != F.length("member")) | (F.col("member") < "3")), orders


@query("a12_shared_sections", f"with {_HAVE} select section from have where member in ('1-URGENT', '5-LOW') group by section having count(distinct member) = 2")
def _(spark, sf):
    return discovery.shared_sections(_have(spark, sf)[0], ["1-URGENT", "5-LOW"], "member", "section")


@query("a13_missing_members", f"with {_HAVE} select distinct o_orderpriority as member from orders except (select member from have group by member having count(distinct section) = (select count(distinct o_custkey % 50) from orders))")
def _(spark, sf):
    have, need = _have(spark, sf)
    return discovery.missing_members(need, discovery.complete_members(have, need, "member", "section"), "member")


@query("a17_long_form", """select o_orderpriority as model, metric, round(value, 4) as value from (select o_orderpriority, cast(count(*) as double) as n, avg(o_totalprice) as mean_price, max(o_totalprice) as top_price from orders group by 1)
 unpivot (value for metric in (n, mean_price, top_price))""")
def _(spark, sf):
    wide = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("top_price"))
    return sinks.long_form(wide, ["model"]).withColumn("value", F.round("value", 4))


@query("b6_b7_tile_names", f"""{FCTE}, s as (select path, regexp_replace(stem, '_\\d+_\\d+$', '') as slide from f where path like '/data/tile%'),
b as (select *, regexp_replace(slide, '_\\d+$', '') as base from s)
select path, slide, coalesce(nullif(regexp_replace(base, '\\d+$', ''), ''), base) as punch from b""")
def _(spark, sf):
    return dataset.with_groups(files(spark, sf).where(F.col("path").startswith("/data/tile")))


@query("b8_punch_of_section", f"""{FCTE} select stem, case when regexp_matches(stem, '^(.+)_sample_(\\d+)$') then
   coalesce(nullif(regexp_extract(stem, '^([A-Za-z]+\\d+)', 1), ''), regexp_extract(stem, '^(.+)_sample_(\\d+)$', 1))
  when regexp_matches(stem, '^(.+?)_(\\d+)$') then regexp_extract(stem, '^(.+?)_(\\d+)$', 1) else stem end as punch_id from f""")
def _(spark, sf):
    at = files(spark, sf).select(ids.stem(F.col("path")).alias("stem"))
    return at.select("stem", ids.punch_of_section(F.col("stem")).alias("punch_id"))


@query("b9_slide_of_file", f"""{FCTE} select stem, case when regexp_matches(stem, '^[A-Za-z]+\\d+_\\d+') then regexp_extract(stem, '^([A-Za-z]+\\d+)_\\d+', 1)
  when stem like '%\\_%' escape '\\' then regexp_replace(stem, '_[^_]*$', '') else stem end as slide_name from f""")
def _(spark, sf):
    at = files(spark, sf).select(ids.stem(F.col("path")).alias("stem"))
    return at.select("stem", ids.slide_of_file(F.col("stem")).alias("slide_name"))


@query("b5_um_scale", "select p_partkey, round(p_retailprice * 0.884, 6) as length_um, round(p_retailprice * (0.884 * 0.884), 6) as area_um2, round(p_retailprice * 0.8832, 6) as length_filter_um from part")
def _(spark, sf):
    p = F.col("p_retailprice")
    return table(spark, sf, "part").select(
        "p_partkey", F.round(scalars.px_to_um(p), 6).alias("length_um"), F.round(scalars.px2_to_um2(p), 6).alias("area_um2"),
        F.round(scalars.px_to_um(p, 0.8832), 6).alias("length_filter_um"))


@query("b14_keep_rule", """select l_orderkey, l_linenumber, l_partkey, l_quantity * 4 >= 80 and 1 - l_discount * 4 >= 0.8 and not (l_extendedprice % 200 < 50 and l_quantity * 4 < 150) as keep from lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.keep_component(
        F.col("l_quantity") * 4, 1 - F.col("l_discount") * 4, F.col("l_extendedprice") % 200, F.lit(0.8), F.lit(50.0)).alias("keep"))


@query("b20_relative_difference", """select l_orderkey, l_linenumber, l_partkey, round(case when l_discount > 0 then (l_tax - l_discount) / l_discount * 100 else 0 end, 6) as diff_pct from lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(scalars.relative_difference(F.col("l_discount"), F.col("l_tax")), 6).alias("diff_pct"))


# ---- class scores from embeddings ---------------------------------------------

_P = ", ".join(f"exp(cast(embedding[{i}] as double)) / (exp(cast(embedding[1] as double)) + exp(cast(embedding[2] as double)) + exp(cast(embedding[3] as double)) + exp(cast(embedding[4] as double))) as p{i - 1}" for i in range(1, 5))


def _softmax(spark, sf):
    logits = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", "label", scalars.softmax(logits).alias("p"))


@query("b12_softmax_argmax", f"""with s as (select vec_id, {_P} from embeddings)
select vec_id, round(p0, 6) as p0, round(p1, 6) as p1, round(p2, 6) as p2, round(p3, 6) as p3, cast(list_position([p0, p1, p2, p3], greatest(p0, p1, p2, p3)) - 1 as int) as cls from s""")
def _(spark, sf):
    return _softmax(spark, sf).select("vec_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(4)], scalars.argmax(F.col("p")).alias("cls"))


@query("b13_quantise", f"""with s as (select vec_id, {_P} from embeddings) select vec_id, {", ".join(f"cast(least(greatest(round_even(p{i} * 255, 0), 0), 255) as int) as q{i}" for i in range(4))} from s""")
def _(spark, sf):
    return _softmax(spark, sf).select("vec_id", *[scalars.quantise(F.col("p")[i]).alias(f"q{i}") for i in range(4)])


_ROWS = """rows as (select o_orderpriority as model, o_orderkey as image, case when o_orderkey % 17 = 0 then null else o_totalprice / 500000 end as mean_dice,
  case when o_orderkey % 5 = 0 then null else (o_totalprice / 600000) end as mean_iou, case when o_orderkey % 23 = 0 then 'failed' end as error from orders)"""


def _rows(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("model"), k.alias("image"),
        F.when(k % 17 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 500000).alias("mean_dice"),
        F.when(k % 5 != 0, F.col("o_totalprice") / 600000).alias("mean_iou"), F.when(k % 23 == 0, "failed").alias("error"))


@query("f12_model_ranking", f"""with {_ROWS}, a as (select model, count(*) as n_images, avg(mean_dice) as mean_dice, avg(mean_iou) as mean_iou from rows where error is null group by model)
select model, n_images, round(mean_dice, 6) as mean_dice, round(mean_iou, 6) as mean_iou, cast(row_number() over (order by mean_dice desc nulls last, model) as int) as rank from a""")
def _(spark, sf):
    return evaluation.model_ranking(_rows(spark, sf), ["mean_dice", "mean_iou"]).select(
        "model", "n_images", F.round("mean_dice", 6).alias("mean_dice"), F.round("mean_iou", 6).alias("mean_iou"), "rank")


@query("f13_report_summary", f"""with {_ROWS} select count(*) as n_images, count(*) filter (error is null) as n_scored,
 round(avg(mean_dice) filter (error is null), 6) as mean_dice_mean, round(stddev_pop(mean_dice) filter (error is null), 6) as mean_dice_std,
 round(avg(mean_iou) filter (error is null), 6) as mean_iou_mean, round(stddev_pop(mean_iou) filter (error is null), 6) as mean_iou_std from rows""")
def _(spark, sf):
    out = evaluation.report_summary(_rows(spark, sf), ["mean_dice", "mean_iou"])
    return out.select("n_images", "n_scored", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


# ---- training data --------------------------------------------------------------

_GROUPS = f"""{FCTE}, s as (select path, regexp_replace(stem, '_\\d+_\\d+$', '') as slide from f where path like '/data/tile%'),
b as (select *, regexp_replace(slide, '_\\d+$', '') as base from s),
g0 as (select path, slide, coalesce(nullif(regexp_replace(base, '\\d+$', ''), ''), base) as punch from b)"""


def _draw(col, src, share=0.2):
    return f"(select {col} from (select {col}, row_number() over (order by md5({col} || ':42'), {col}) r, count(*) over () n from (select distinct {col} from {src})) where r <= ceil({share} * n))"


def _tiles(spark, sf):
    return files(spark, sf).where(F.col("path").startswith("/data/tile"))


@query("i1_split_by_punch", f"{_GROUPS} select path, slide, punch, case when punch in {_draw('punch', 'g0')} then 'val' else 'train' end as split from g0")
def _(spark, sf):
    return dataset.split(_tiles(spark, sf), "punch")


@query("i1_split_by_slide", f"{_GROUPS} select path, slide, punch, case when slide in {_draw('slide', 'g0')} then 'val' else 'train' end as split from g0")
def _(spark, sf):
    return dataset.split(_tiles(spark, sf), "slide")


@query("i2_i4_forced_groups", f"""{_GROUPS}, g as materialized (select * from g0 where slide not in ('20H', 'H5_01') and punch not in ('20H', 'H5_01'))
select path, slide, punch, case when slide in ('PVcont5_01', 'cvb1_02') then 'train' when slide in {_draw('slide', 'g')} or slide in ('CPBSV2_01') then 'val' else 'train' end as split from g""")
def _(spark, sf):
    tiles = _tiles(spark, sf)
    slides = dataset.with_groups(tiles)
    held = ["CPBSV2_01"] if not slides.where("slide = 'CPBSV2_01'").isEmpty() else []
    return dataset.split(tiles, "slide", exclude=["20H", "H5_01"], holdout=held, train_slides=["PVcont5_01", "cvb1_02"])


@query("i5_tile_split", f"{_GROUPS} select path, slide, punch, case when path in {_draw('path', 'g0')} then 'val' else 'train' end as split from g0")
def _(spark, sf):
    return dataset.split(_tiles(spark, sf), "tile")


_TP = "section_id * 16 + (y // 16) * 4 + x // 16"
_COUNTS = f"{W('gt')}, counts as materialized (select {_TP} as tile, cls, count(*) as n from gt group by 1, 2)"
_DISTRIBUTION = """tot as (select cast(sum(n) as bigint) as total_pixels, count(distinct tile) as total_samples from {c}),
di as materialized (select cast(k as int) as cls, cast(coalesce(sum(n), 0) as bigint) as pixels, any_value(total_pixels) as total_pixels, coalesce(sum(n), 0) / any_value(total_pixels) * 100 as pixel_pct,
  count(tile) as samples, any_value(total_samples) as total_samples, count(tile) / any_value(total_samples) * 100 as sample_pct from tot, range(4) t(k) left join {c} on cls = k group by k)"""
_DCOLS = "cls, pixels, total_pixels, round(pixel_pct, 6) as pixel_pct, samples, total_samples, round(sample_pct, 6) as sample_pct"


def _counts(spark, sf):
    tile = F.col("section_id") * 16 + F.floor(F.col("y") / 16) * 4 + F.floor(F.col("x") / 16)
    return dataset.pixel_counts(raster(spark, sf, "gt").select(tile.alias("tile"), "cls"), "tile")


@query("i6_class_distribution", f"{_COUNTS}, {_DISTRIBUTION.format(c='counts')} select {_DCOLS} from di")
def _(spark, sf):
    d = dataset.class_distribution(_counts(spark, sf), "tile")
    return d.withColumn("pixel_pct", F.round("pixel_pct", 6)).withColumn("sample_pct", F.round("sample_pct", 6))


@query("i6_class_distribution_sample", f"""{_COUNTS}, ch as (select tile from (select distinct tile from counts) order by md5(tile || ':42') limit 100), sub as materialized (select * from counts where tile in (select tile from ch)),
 {_DISTRIBUTION.format(c='sub')} select {_DCOLS} from di""")
def _(spark, sf):
    d = dataset.class_distribution(_counts(spark, sf), "tile", 100)
    return d.withColumn("pixel_pct", F.round("pixel_pct", 6)).withColumn("sample_pct", F.round("sample_pct", 6))


def _weights_sql(method, expr):
    return f"select '{method}' as method, cls, round(pixels / total_pixels, 6) as pixel_fraction, round(w / min(w) over (), 6) as weight from (select *, {expr} as w from di)"


@query("i7_class_weights", f"{_COUNTS}, {_DISTRIBUTION.format(c='counts')} " + " union all ".join([
    _weights_sql("inv_freq", "total_pixels / (4 * pixels + 1e-6)"), _weights_sql("sqrt_inv_freq", "sqrt(total_pixels / (4 * pixels + 1e-6))"),
    _weights_sql("median_freq", "(select quantile_cont(pixels / total_pixels, 0.5) from di) / (pixels / total_pixels + 1e-6)")]))
def _(spark, sf):
    d = dataset.class_distribution(_counts(spark, sf), "tile")
    parts = [dataset.class_weights(d, m).select(
        F.lit(m).alias("method"), "cls", F.round("pixel_fraction", 6).alias("pixel_fraction"), F.round("weight", 6).alias("weight"))
        for m in ("inv_freq", "sqrt_inv_freq", "median_freq")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("i8_training_class_weights", f"""{W('gt')}, grp as (select distinct section_id, cast(nk as varchar) as punch from gt), va as {_draw('punch', 'grp')},
counts as materialized (select section_id as tile, cls, count(*) as n from gt where cast(nk as varchar) not in (select punch from va) group by 1, 2), {_DISTRIBUTION.format(c='counts')}
{_weights_sql('sqrt_inv_freq', 'sqrt(total_pixels / (4 * pixels + 1e-6))')}""")
def _(spark, sf):
    gt = raster(spark, sf, "gt")
    groups = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("section_id"), F.col("s_nationkey").cast("string").alias("punch"))
    val = dataset.first_share(groups, "punch", 0.2, 42)
    train = groups.join(val, "punch", "left_anti")
    counts = dataset.pixel_counts(gt.join(train, "section_id", "left_semi").withColumnRenamed("section_id", "tile"), "tile")
    d = dataset.class_distribution(counts, "tile")
    return dataset.class_weights(d).select(F.lit("sqrt_inv_freq").alias("method"), "cls", F.round("pixel_fraction", 6).alias("pixel_fraction"), F.round("weight", 6).alias("weight"))


_SAMPLING = f"""{_COUNTS}, {_DISTRIBUTION.format(c='counts')}, cw as (select cls, 1 / (sample_pct + 0.01) as w from di), r as (select max(w) filter (cls = 2) / sum(w) * 4 as w2, max(w) filter (cls = 3) / sum(w) * 4 as w3 from cw),
raw as (select tile, case when bool_or(cls = 2) then 1 + 0.75 * any_value(w2) else 1 end * case when bool_or(cls = 3) then 1 + 0.75 * any_value(w3) else 1 end as w from counts, r group by tile),
sw as materialized (select tile, w / sum(w) over () * count(*) over () as weight from raw)"""


@query("i9_sampling_weights", f"{_SAMPLING} select tile, round(weight, 6) as weight from sw")
def _(spark, sf):
    return dataset.sampling_weights(_counts(spark, sf), "tile").select("tile", F.round("weight", 6).alias("weight"))


@query("i10_weighted_draws", f"""{_SAMPLING}, z as (select tile, cast(round_even(round(weight, 6) * 1000000, 0) as bigint) as w from sw),
c as materialized (select tile, cast(sum(w) over (order by tile) as bigint) as hi, w from z), t as (select cast(sum(w) as bigint) as tot from z),
d as (select o_orderkey as draw, cast(floor(cast('0x' || substr(md5(o_orderkey || ':42'), 1, 12) as bigint) / 281474976710656.0e0 * tot) as bigint) as pos from orders, t)
select draw, tile from d asof join (select tile, hi - w as lo from c where w > 0) c on d.pos >= c.lo""")
def _(spark, sf):
    w = dataset.sampling_weights(_counts(spark, sf), "tile").select("tile", F.round("weight", 6).alias("weight"))
    draws = table(spark, sf, "orders").select(F.col("o_orderkey").alias("draw")).distinct()
    return dataset.weighted_draws(w, "tile", F.floor(F.col("tile") / 10_000), draws)


@query("i11_tiles_with_class", f"{_COUNTS} select tile from (select tile from counts where cls = 3 and n > 20 order by md5(tile || ':42') limit 25)")
def _(spark, sf):
    return dataset.tiles_with_class(_counts(spark, sf), "tile", 3, 25, min_px=20)


@query("i12_balanced_sample", f"""{_COUNTS}, a as materialized (select tile from counts where cls = 3 and n > 100 order by md5(tile || ':42') limit 10),
c as materialized (select tile from (select tile from counts where cls = 2 and n > 100 order by md5(tile || ':42') limit 10) where tile not in (select tile from a)),
o as materialized (select tile from (select distinct tile from counts) where tile not in (select tile from a) and tile not in (select tile from c))
select tile, 'ablation' as reason from a union all select tile, 'coagulation' from c
union all select tile, 'other' from (select tile, row_number() over (order by md5(tile || ':42')) r from o) where r <= 40 - (select count(*) from a) - (select count(*) from c)""")
def _(spark, sf):
    return dataset.balanced_sample(_counts(spark, sf), "tile", 40)


@query("i13_class_shares", f"{_COUNTS} select tile, " + ", ".join(f"round(coalesce(sum(n) filter (cls = {c}), 0) / sum(n) * 100, 6) as pct_{c}" for c in range(4)) + " from counts group by tile")
def _(spark, sf):
    d = dataset.class_shares(_counts(spark, sf), "tile")
    return d.select("tile", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


@query("i14_display_sample", f"{FCTE} select path from (select distinct path from f where path like '/data/tile_256/no%') order by md5(path || ':42') limit 16")
def _(spark, sf):
    return dataset.display_sample(files(spark, sf).where(F.col("path").startswith("/data/tile_256/no")), "path", 16)


# ---- training logs ----------------------------------------------------------------

_HIST = "hist as materialized (select user_id as run, cast(row_number() over (partition by user_id order by ts, event_id) as int) as epoch, value as val_loss from events)"


def _history(spark, sf):
    from ..functions.ordered import number_in_order

    ev = table(spark, sf, "events").select(F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("val_loss"))
    return number_in_order(ev, ["run"], ["ts", "event_id"], F.to_date("ts"), "epoch").select("run", "epoch", "val_loss")


_STOP = f"""with {_HIST}, m as (select *, min(val_loss) over w as earlier from hist window w as (partition by run order by epoch rows between unbounded preceding and 1 preceding)),
i as (select *, earlier is null or val_loss < earlier as improved, least(coalesce(earlier, val_loss), val_loss) as best_loss from m),
s as materialized (select run, epoch, val_loss, improved, best_loss, cast(max(epoch) filter (improved) over (partition by run order by epoch) as int) as best_epoch from i),
st as materialized (select *, cast(epoch - best_epoch as int) as epochs_no_improve from s)"""


@query("j1_early_stopping", f"{_STOP} select * from st")
def _(spark, sf):
    return training_log.early_stopping(_history(spark, sf)).select(
        "run", "epoch", "val_loss", "improved", "best_loss", F.col("best_epoch").cast("int").alias("best_epoch"), "epochs_no_improve")


@query("j1_stop_epoch", f"{_STOP} select run, cast(min(epoch) filter (epochs_no_improve >= 10) as int) as stop_epoch from st group by run")
def _(spark, sf):
    return training_log.stop_epoch(training_log.early_stopping(_history(spark, sf)))


_BATCH = """bt as (select event_type as run, cast(epoch_ms(ts) // 86400000 as bigint) as epoch, event_id, value as loss, (event_id * 7) % 4091 as correct, 4091 as pixels from events)"""


def _batches(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("run"), F.unix_date(F.to_date("ts")).cast("bigint").alias("epoch"), "event_id",
        F.col("value").alias("loss"), ((F.col("event_id") * 7) % 4091).alias("correct"), F.lit(4091).cast("bigint").alias("pixels"))


@query("j2_running_means", f"""with {_BATCH} select run, epoch, event_id, round(avg(loss) over w, 6) as running_loss, round(avg(correct / pixels) over w, 6) as running_accuracy
 from bt window w as (partition by run, epoch order by event_id rows between 19 preceding and current row)""")
def _(spark, sf):
    return training_log.running_batch_means(_batches(spark, sf), "run", ["event_id"]).select(
        "run", "epoch", "event_id", F.round("running_loss", 6).alias("running_loss"), F.round("running_accuracy", 6).alias("running_accuracy"))


@query("j3_epoch_metrics", f"with {_BATCH} select run, epoch, round(avg(loss), 6) as loss, round(sum(correct) / sum(pixels), 6) as accuracy from bt group by run, epoch")
def _(spark, sf):
    return training_log.epoch_metrics(_batches(spark, sf), "run").select(
        "run", "epoch", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query("j4_history_table", f"with {_BATCH} select run, epoch, count(*) as n_batches, round(min(loss), 6) as best_batch_loss from bt group by run, epoch")
def _(spark, sf):
    # the stored form nests epochs in a run; here the nesting is made and undone on per-epoch rows
    per_epoch = _batches(spark, sf).groupBy("run", "epoch").agg(F.count("*").alias("n_batches"), F.round(F.min("loss"), 6).alias("best_batch_loss"))
    nested = per_epoch.groupBy("run").agg(F.collect_list(F.struct("epoch", "n_batches", "best_batch_loss")).alias("epochs"))
    return nested.select("run", F.explode("epochs").alias("e")).select("run", "e.*")


@query("j6_grid_parameters", """select s_nationkey, tau, d, count(*) filter (s_acctbal >= tau * 10000 and not s_acctbal < d * 10) as n from supplier,
 (select unnest([0.0e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0, 0.95e0]) as tau), (select unnest([0.0e0, 50.0e0, 100.0e0, 150.0e0]) as d) group by all""")
def _(spark, sf):
    from ..operators.component_filter import grid

    return table(spark, sf, "supplier").select("s_nationkey", "s_acctbal", F.explode(grid()).alias("g")).select("s_nationkey", "s_acctbal", "g.*").groupBy(
        "s_nationkey", "tau", "d").agg(
        F.count_if((F.col("s_acctbal") >= F.col("tau") * 10000) & ~(F.col("s_acctbal") < F.col("d") * 10)).alias("n"))
