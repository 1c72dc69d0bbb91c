"""Queries over the lesion table: cohort analysis, spacing, batch statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars
from ..operators import batch_stats, cohort, spacing
from ..operators.cohort import bin_of
from .registry import query, r6, table

# one lesion per line item; the same text in both dialects
LESIONS = """
select cast(l_suppkey as bigint) as section_id, l_orderkey, l_linenumber,
       cast(l_partkey as double) as center_x, cast(l_orderkey % 997 as double) as center_y,
       l_quantity * 4 as ablation_diameter_um, l_discount * 1000 as coagulation_width_um,
       l_quantity * 4 + l_discount * 2000 as lesion_diameter_um,
       l_quantity * l_quantity * 12.5e0 as ablation_area_um2,
       l_discount * l_quantity * 2500 + l_tax * 100 as coagulation_area_um2,
       l_returnflag = 'R' as touches_edge,
       case when l_tax = 0.08e0 then null
            else (cast(round(l_extendedprice * 100) as bigint) % 100000) / 100.0e0 end as dist_to_edge_um,
       concat('PV', cast(l_suppkey % 40 as varchar(9)), '_', cast(l_linenumber as varchar(9)), '.tif') as filename
from lineitem
"""
CTE = f"with lesions as materialized ({LESIONS})"


def lesions(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = f"lineitem_rows_{abs(hash(sf_dir)) % 10**9}"
    table(spark, sf_dir, "lineitem").createOrReplaceTempView(view)
    return spark.sql(LESIONS.replace("from lineitem", f"from {view}").replace("varchar(9)", "string"))


K = ["section_id"]
MEANS = ["mean_ablation_diameter_um", "mean_coagulation_width_um", "mean_lesion_diameter_um",
         "mean_ablation_area_um2", "mean_coagulation_area_um2"]


@query("e6_fence_means", f"""{CTE},
q as (select section_id, quantile_cont(ablation_area_um2, 0.25) a1, quantile_cont(ablation_area_um2, 0.75) a3,
             quantile_cont(coagulation_area_um2, 0.25) c1, quantile_cont(coagulation_area_um2, 0.75) c3
      from lesions group by section_id),
f as (select l.*, ablation_area_um2 between a1 - 1.5*(a3-a1) and a3 + 1.5*(a3-a1) as a,
             coagulation_area_um2 between c1 - 1.5*(c3-c1) and c3 + 1.5*(c3-c1) as c
      from lesions l join q using (section_id))
select section_id, round(avg(ablation_diameter_um) filter (a), 6) as mean_ablation_diameter_um,
       round(avg(coagulation_width_um) filter (c), 6) as mean_coagulation_width_um,
       round(avg(lesion_diameter_um), 6) as mean_lesion_diameter_um,
       round(avg(ablation_area_um2) filter (a), 6) as mean_ablation_area_um2,
       round(avg(coagulation_area_um2) filter (c), 6) as mean_coagulation_area_um2
from f group by section_id""")
def _(spark, sf):
    return cohort.fence_means(lesions(spark, sf), K).select(
        "section_id", *[F.round(m, 6).alias(m) for m in MEANS])


@query("e7_nearest_neighbour", f"""{CTE},
p as (select section_id, center_x, center_y, count(*) n from lesions group by all),
d as (select a.section_id, a.center_x, a.center_y, any_value(a.n) n,
             min((a.center_x-b.center_x)**2 + (a.center_y-b.center_y)**2) d2
      from p a left join p b on a.section_id = b.section_id and (a.center_x <> b.center_x or a.center_y <> b.center_y)
      group by a.section_id, a.center_x, a.center_y),
nn as (select d.section_id, case when n > 1 then 0 else sqrt(d2) end nn from d join lesions using (section_id, center_x, center_y))
select section_id, round(coalesce(avg(nn), 0) * 0.884, 6) as mean_nearest_neighbor_um,
       round(coalesce(quantile_cont(nn, 0.5), 0) * 0.884, 6) as grid_spacing_um
from nn group by section_id""")
def _(spark, sf):
    return spacing.neighbour_spacing(lesions(spark, sf), K, ["l_orderkey", "l_linenumber"]).select(
        "section_id", F.round("mean_nearest_neighbor_um", 6).alias("mean_nearest_neighbor_um"),
        F.round("grid_spacing_um", 6).alias("grid_spacing_um"))


GRID_SQL = """
{axis}v as materialized (select section_id, {col} as v, row_number() over (partition by section_id order by {col}) i from lesions),
{axis}t as materialized (select section_id, 1.5 * quantile_cont(g, 0.5) t from
       (select section_id, v - lag(v) over (partition by section_id order by i) g from {axis}v) where g is not null group by section_id),
{axis}d as materialized (select distinct section_id, v from {axis}v),
{axis}j as materialized (select d.section_id, d.v, n.v as nv from (select d.*, t.t from {axis}d d join {axis}t t using (section_id)) d
       asof join {axis}d n on n.section_id = d.section_id and d.v + d.t < n.v),
{axis}l(section_id, start) as (
  select section_id, min(v) from {axis}d group by section_id
  union all
  select l.section_id, j.nv from {axis}l l join {axis}j j on j.section_id = l.section_id and j.v = l.start),
{axis}n as materialized (select section_id, start, row_number() over (partition by section_id order by start) k from {axis}l)"""
X_LINES, Y_LINES = GRID_SQL.format(axis="x", col="center_x"), GRID_SQL.format(axis="y", col="center_y")
REC = CTE.replace("with lesions", "with recursive lesions")


@query("e8_grid_lines", f"""{REC}, {X_LINES}, {Y_LINES}
select section_id, 'x' as axis, cast(k as bigint) as line, start as position from xn
union all select section_id, 'y', cast(k as bigint), start from yn""")
def _(spark, sf):
    from ..functions.ordered import number_in_order

    out = None
    for axis in ("x", "y"):
        lines = spacing.grid_lines(lesions(spark, sf), K, f"center_{axis}").select("section_id", "start").distinct()
        part = number_in_order(lines, K, ["start"], F.floor(F.col("start") / 100_000), "line").select(
            "section_id", F.lit(axis).alias("axis"), F.col("line").cast("bigint").alias("line"),
            F.col("start").alias("position"))
        out = part if out is None else out.unionByName(part)
    return out


@query("e9_grid_spacing", f"""{REC}, {X_LINES}, {Y_LINES},
ax as materialized (select v.section_id, v.v as center_x, arg_min(n.k, (abs(v.v - n.start), n.k)) kx
       from xd v join xn n using (section_id) group by v.section_id, v.v),
ay as materialized (select v.section_id, v.v as center_y, arg_min(n.k, (abs(v.v - n.start), n.k)) ky
       from yd v join yn n using (section_id) group by v.section_id, v.v),
g as materialized (select l.section_id, l.center_x, l.center_y, kx, ky from lesions l
       join ax using (section_id, center_x) join ay using (section_id, center_y)),
d as (select a.section_id, abs(a.center_x - b.center_x) d from g a join g b
        on a.section_id = b.section_id and a.ky = b.ky and b.kx = a.kx + 1
      union all
      select a.section_id, abs(a.center_y - b.center_y) from g a join g b
        on a.section_id = b.section_id and a.kx = b.kx and b.ky = a.ky + 1)
select s.section_id, round(coalesce(avg(d), 0) * 0.884, 6) as mean_grid_distance_um
from (select distinct section_id from lesions) s left join d using (section_id) group by s.section_id""")
def _(spark, sf):
    return spacing.grid_spacing(lesions(spark, sf), K).select(
        "section_id", F.round("mean_grid_distance_um", 6).alias("mean_grid_distance_um"))


RADIAL = f"""{CTE},
o as (select section_id, avg(center_x) ox, avg(center_y) oy from lesions group by section_id),
r0 as (select l.*, ox, oy, sqrt((center_x-ox)**2 + (center_y-oy)**2) * 0.884 as radius_um from lesions l join o using (section_id)),
m as (select section_id, max(radius_um) mx from r0 group by section_id),
r as materialized (select r0.*, mx, case when mx > 0 then radius_um / mx else 0 end as radius_frac,
             greatest(mx, 1e-6) as top from r0 join m using (section_id))"""


@query("e14_radial_position", f"""{RADIAL}
select section_id, l_orderkey, l_linenumber, round(ox, 6) as origin_x, round(oy, 6) as origin_y,
       round(radius_um, 6) as radius_um, round(radius_frac, 6) as radius_frac from r""")
def _(spark, sf):
    return cohort.radial_position(lesions(spark, sf), K).select(
        "section_id", "l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in
                                                      ("origin_x", "origin_y", "radius_um", "radius_frac")])


@query("e14_radial_position_origin", f"""{CTE},
o as (select s_suppkey section_id, cast(s_nationkey as double) ox, s_acctbal oy from supplier where s_acctbal > 0),
r as (select l.*, ox, oy, sqrt((center_x-ox)**2 + (center_y-oy)**2) * 0.884 as radius_um from lesions l left join o using (section_id)),
m as (select section_id, max(radius_um) mx from r group by section_id)
select section_id, l_orderkey, l_linenumber, ox as origin_x, oy as origin_y, round(radius_um, 6) as radius_um,
       round(case when radius_um is null then null when mx > 0 then radius_um / mx else 0 end, 6) as radius_frac
from r join m using (section_id)""")
def _(spark, sf):
    origin = table(spark, sf, "supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("section_id"), F.col("s_nationkey").cast("double").alias("cx"), F.col("s_acctbal").alias("cy"))
    return cohort.radial_position(lesions(spark, sf), K, origin=origin).select(
        "section_id", "l_orderkey", "l_linenumber", "origin_x", "origin_y",
        F.round("radius_um", 6).alias("radius_um"), F.round("radius_frac", 6).alias("radius_frac"))


def _cv(c):
    return f"case when count(*) < 2 or avg({c}) = 0 then 0 else stddev_pop({c}) / avg({c}) end"


BINS = f"""{RADIAL},
e as (select section_id, top, cast(b as int) as bin_index, b * (top / 10) as lo,
             case when b = 9 then top else (b + 1) * (top / 10) end as hi
      from (select distinct section_id, top from r), range(10) t(b)),
bins as materialized (
 select e.section_id, e.bin_index, round(lo, 6) as bin_min_um, round(hi, 6) as bin_max_um,
        (e.bin_index + 0.5e0) / 10 as bin_center_frac, count(r.section_id) as n_lesions,
        {", ".join(f"round({_cv(cohort.column_of(m)).replace('count(*)', 'count(r.section_id)')}, 6) as cv_{m}" for m in cohort.RADIAL_MEASURES)},
        {", ".join(f"round(case when count(r.section_id) >= 2 then avg({m}_um) end, 6) as mean_{m}_um" for m in cohort.RADIAL_MEASURES[:3])},
        {", ".join(f"round(case when count(r.section_id) >= 2 then stddev_pop({m}_um) end, 6) as std_{m}_um" for m in cohort.RADIAL_MEASURES[:2])}
 from e left join r on r.section_id = e.section_id and r.radius_um >= e.lo
      and (r.radius_um < e.hi or (e.bin_index = 9 and r.radius_um <= e.hi))
 group by e.section_id, e.bin_index, lo, hi)"""


def _bins(spark, sf):
    bins = cohort.radial_bins(lesions(spark, sf), K)
    return bins.select(*[F.round(c, 6).alias(c) if c.startswith(("cv_", "mean_", "std_", "bin_m")) else c for c in bins.columns])


@query("e15_radial_bins", f"{BINS} select * from bins")
def _(spark, sf):
    return _bins(spark, sf)


@query("e16_zone_summary", f"""{BINS},
z as (select section_id, cv_lesion_diameter c, case when bin_center_frac <= 0.25 then 'Central' when bin_center_frac <= 0.5 then 'Stable'
        when bin_center_frac <= 0.75 then 'Transition' else 'Peripheral' end as zone from bins)
select section_id, zone, round(coalesce(100 * avg(c) filter (c > 0), 0), 6) as mean_cv_pct from z group by all""")
def _(spark, sf):
    return cohort.zone_summary(_bins(spark, sf), K).select("section_id", "zone", F.round("mean_cv_pct", 6).alias("mean_cv_pct"))


PAIRS = f"""{CTE},
w as (select * from lesions where not coalesce(touches_edge, false) and ablation_diameter_um is not null and dist_to_edge_um is not null),
g as (select section_id, count(*) filter (dist_to_edge_um > 500) n_central, count(*) filter (dist_to_edge_um <= 500) n_peripheral,
        avg(ablation_diameter_um) filter (dist_to_edge_um > 500) mean_central,
        avg(ablation_diameter_um) filter (dist_to_edge_um <= 500) mean_peripheral from w group by section_id),
p as (select *, 100.0 * (mean_peripheral - mean_central) / mean_central as pct_increase from g
      where n_central >= 1 and n_peripheral >= 1 and mean_central <> 0)"""


@query("e17_paired_contrast", f"""{PAIRS}
select section_id, n_central, n_peripheral, round(mean_central, 6) as mean_central,
       round(mean_peripheral, 6) as mean_peripheral, round(pct_increase, 6) as pct_increase from p""")
def _(spark, sf):
    return cohort.paired_contrast(lesions(spark, sf), "section_id", drop_edge=True).select(
        "section_id", "n_central", "n_peripheral",
        *[F.round(c, 6).alias(c) for c in ("mean_central", "mean_peripheral", "pct_increase")])


@query("e18_contrast_summary", f"""{PAIRS},
s as (select count(*) n, avg(pct_increase) m, stddev_samp(pct_increase) sd,
             avg(mean_peripheral - mean_central) / (stddev_samp(mean_peripheral - mean_central) / sqrt(count(*))) t from p),
f as (select n, m, sd, t, n - 1 as v, abs(t) / 20000 as h,
             exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt((n - 1) * pi()) as k from s),
i as (select sum((case when j in (0, 20000) then 1 when j % 2 = 1 then 4 else 2 end)
             * k * pow(1 + (j * h) * (j * h) / v, -(v + 1) / 2.0)) * any_value(h) / 3 as a from f, range(20001) r(j))
select n as n_groups, round(m, 6) as mean_pct_increase, round(sd, 6) as sd_pct_increase, round(t, 6) as t_stat,
       round(1 - 2 * a, 6) as p_value, (select count(*) from w) as n_lesions,
       (select count(*) from lesions where touches_edge) as n_edge_dropped
from f, i""")
def _(spark, sf):
    out = cohort.contrast_summary(lesions(spark, sf), "section_id", drop_edge=True)
    return out.select("n_groups", *[F.round(c, 6).alias(c) for c in
                                    ("mean_pct_increase", "sd_pct_increase", "t_stat", "p_value")],
                      "n_lesions", "n_edge_dropped")


@query("e19_size_by_radius", f"""{RADIAL},
e as (select cast(b as int) as bin_index, b * 0.1e0 as lo, (b + 1) * 0.1e0 as hi from range(10) t(b)),
j as (select e.bin_index, r.section_id, r.ablation_diameter_um v, r.radius_um from e join r
      on r.radius_frac >= e.lo and (r.radius_frac < e.hi or (e.bin_index = 9 and r.radius_frac <= e.hi))),
g as (select bin_index, section_id, avg(v) g, count(*) n, sum(radius_um) rs from j group by all)
select e.bin_index, round(lo, 6) as bin_lo_frac, round(hi, 6) as bin_hi_frac,
       cast(coalesce(sum(n), 0) as bigint) as n_lesions, count(g.section_id) as n_groups, round(avg(g), 6) as mean_um,
       round(case when count(g.section_id) >= 2 then stddev_samp(g) end, 6) as sd_um, round(sum(rs) / sum(n), 6) as mean_radius_um
from e left join g using (bin_index) group by e.bin_index, lo, hi""")
def _(spark, sf):
    placed = cohort.radial_position(lesions(spark, sf), K)
    out = cohort.size_by_radius(placed, "section_id")
    return out.select("bin_index", *[F.round(c, 6).alias(c) for c in ("bin_lo_frac", "bin_hi_frac")], "n_lesions", "n_groups",
                      *[F.round(c, 6).alias(c) for c in ("mean_um", "sd_um", "mean_radius_um")])


@query("b15_complete_lesions", f"""{CTE} select section_id, count(*) as n_complete,
 cast(sum(l_orderkey) as bigint) as key_sum from lesions where not coalesce(touches_edge, false) group by section_id""")
def _(spark, sf):
    return lesions(spark, sf).where(scalars.is_complete(F.col("touches_edge"))).groupBy("section_id").agg(
        F.count("*").alias("n_complete"), F.sum("l_orderkey").alias("key_sum"))


@query("b16_plausible_lesions", f"""{CTE} select section_id, l_orderkey, l_linenumber, coagulation_area_um2, coagulation_width_um
 from lesions where coagulation_area_um2 >= 25 and coagulation_width_um >= 1.0""")
def _(spark, sf):
    return lesions(spark, sf).where(scalars.is_plausible(F.col("coagulation_area_um2"), F.col("coagulation_width_um"))).select(
        "section_id", "l_orderkey", "l_linenumber", "coagulation_area_um2", "coagulation_width_um")


@query("j5_summary_rows", f"""{CTE}
select section_id, l_orderkey, l_linenumber, round_even(coagulation_width_um, 2) as coagulation_width_um,
 case when ablation_diameter_um > 0 then round_even(ablation_diameter_um, 2) else 0 end as ablation_diameter_um,
 ablation_diameter_um > 0 as has_ablation, round_even(lesion_diameter_um, 2) as lesion_diameter_um,
 round_even(coagulation_area_um2, 2) as coagulation_area_um2,
 case when ablation_diameter_um > 0 then round_even(ablation_area_um2, 2) else 0 end as ablation_area_um2,
 round_even(center_x, 1) as center_x_px, round_even(center_y, 1) as center_y_px,
 coalesce(touches_edge, false) as touches_edge, round_even(dist_to_edge_um, 2) as dist_to_edge_um from lesions""")
def _(spark, sf):
    keyed = lesions(spark, sf).withColumn("lesion_id", F.struct("l_orderkey", "l_linenumber"))
    return cohort.summary_rows(keyed).select(
        "section_id", F.col("lesion_id.l_orderkey"), F.col("lesion_id.l_linenumber"),
        "coagulation_width_um", "ablation_diameter_um", "has_ablation", "lesion_diameter_um", "coagulation_area_um2",
        "ablation_area_um2", "center_x_px", "center_y_px", "touches_edge", "dist_to_edge_um")


@query("b11_coefficient_of_variation", f"""{CTE} select section_id,
 {", ".join(f"round({_cv(cohort.column_of(m))}, 6) as cv_{m}" for m in cohort.RADIAL_MEASURES)} from lesions group by section_id""")
def _(spark, sf):
    return lesions(spark, sf).groupBy("section_id").agg(
        *[F.round(scalars.cv(F.col(cohort.column_of(m))), 6).alias(f"cv_{m}") for m in cohort.RADIAL_MEASURES])


@query("b10_zone_of_bin", """select p_partkey, p_size, cast(p_partkey % 12 as int) as bin_index,
 case when p_size % 12 = 0 then 'Central'
      when (p_partkey % 12 + 0.5) / (p_size % 12) <= 0.25 then 'Central' when (p_partkey % 12 + 0.5) / (p_size % 12) <= 0.5 then 'Stable'
      when (p_partkey % 12 + 0.5) / (p_size % 12) <= 0.75 then 'Transition' else 'Peripheral' end as zone from part""")
def _(spark, sf):
    parts = table(spark, sf, "part")
    b, n = (F.col("p_partkey") % 12).cast("int"), F.col("p_size") % 12
    return parts.select("p_partkey", "p_size", b.alias("bin_index"), scalars.zone_of_bin(b, n).alias("zone"))


# ---- batch statistics --------------------------------------------------------

MEASURES = batch_stats.MEASURES
_AGG = ", ".join(
    [f"round(avg({m}), 6) as mean_{m}, round(stddev_pop({m}), 6) as std_{m}" for m in MEASURES]
    + [f"round(sum({m}), 4) as total_{m}" for m in MEASURES if m.endswith("um2")])
SLIDES = f"{CTE}, named as materialized (select *, regexp_extract(filename, '^([A-Za-z]+\\d+)_\\d+', 1) as slide_name from lesions)"


def _rounded(df, *keep):
    return df.select(*[
        F.round(c, 4 if c.startswith("total_") and c.endswith("um2") else 6).alias(c)
        if c not in keep and dict(df.dtypes)[c] == "double" else F.col(c) for c in df.columns])


def named(spark, sf):
    return batch_stats.with_slide(lesions(spark, sf))


@query("h1_slide_metrics", f"{SLIDES} select slide_name, count(*) as num_lesions, {_AGG} from named group by slide_name")
def _(spark, sf):
    return _rounded(batch_stats.group_metrics(named(spark, sf), ["slide_name"]))


@query("h4_file_metrics", f"{SLIDES} select filename, count(*) as num_lesions, {_AGG} from named group by filename")
def _(spark, sf):
    return _rounded(batch_stats.group_metrics(named(spark, sf), ["filename"]))


@query("h2_dataset_metrics", f"""{SLIDES} select count(distinct slide_name) as total_images_processed, count(*) as total_lesions_detected, {_AGG},
 {", ".join(f"round(quantile_cont({m}, 0.5), 6) as median_{m}" for m in MEASURES[:3])} from named""")
def _(spark, sf):
    return _rounded(batch_stats.dataset_metrics(named(spark, sf)))


@query("h3_slide_summary", f"""{SLIDES}, s as (select slide_name, count(*) n, avg(ablation_diameter_um) a, avg(coagulation_width_um) c from named group by 1)
select count(*) as num_slides, round(avg(a), 6) as mean_ablation_diameter_across_slides_um, round(stddev_pop(a), 6) as std_ablation_diameter_across_slides_um,
 round(avg(c), 6) as mean_coagulation_width_across_slides_um, round(stddev_pop(c), 6) as std_coagulation_width_across_slides_um,
 round(avg(n), 6) as lesions_per_slide_mean, round(stddev_pop(n), 6) as lesions_per_slide_std from s""")
def _(spark, sf):
    return _rounded(batch_stats.slide_summary(named(spark, sf)))


@query("h5_file_summary", f"""{SLIDES}, s as (select filename, count(*) n, avg(ablation_diameter_um) a, avg(coagulation_width_um) c, avg(lesion_diameter_um) l,
  sum(ablation_area_um2) ta, sum(coagulation_area_um2) tc from named group by 1)
select count(*) as total_files_processed, cast(sum(n) as bigint) as total_lesions_all_files,
 round(avg(a), 6) as mean_ablation_diameter_across_files_um, round(stddev_pop(a), 6) as std_ablation_diameter_across_files_um,
 round(avg(c), 6) as mean_coagulation_width_across_files_um, round(stddev_pop(c), 6) as std_coagulation_width_across_files_um,
 round(avg(l), 6) as mean_lesion_diameter_across_files_um, round(stddev_pop(l), 6) as std_lesion_diameter_across_files_um,
 round(avg(n), 6) as mean_lesions_per_file, round(stddev_pop(n), 6) as std_lesions_per_file,
 round(sum(ta), 4) as total_ablation_area_all_files_um2, round(sum(tc), 4) as total_coagulation_area_all_files_um2 from s""")
def _(spark, sf):
    return _rounded(batch_stats.file_summary(named(spark, sf)))


@query("h5_grouping_sets", f"""{SLIDES} select slide_name, filename, cast(grouping(slide_name, filename) as bigint) as level, count(*) as num_lesions, {_AGG}
 from named group by grouping sets ((slide_name), (filename), ())""")
def _(spark, sf):
    return _rounded(batch_stats.all_levels(named(spark, sf)))


@query("h6_lesion_ids", f"""{SLIDES} select slide_name, l_orderkey, l_linenumber, center_x, ablation_diameter_um, filename,
 slide_name || '_lesion_' || row_number() over (partition by slide_name order by l_orderkey, l_linenumber, center_x, ablation_diameter_um, filename, coagulation_width_um, dist_to_edge_um) as lesion_id from named""")
def _(spark, sf):
    order = ["l_orderkey", "l_linenumber", "center_x", "ablation_diameter_um", "filename", "coagulation_width_um"]
    return batch_stats.lesion_ids(
        named(spark, sf), "slide_name", [*order, F.asc_nulls_last("dist_to_edge_um")], F.floor(F.col("l_orderkey") / 20_000)
    ).select("slide_name", *order[:5], "lesion_id")


@query("h7_file_means", f"""{SLIDES}, files as (select distinct 'PV' || (s_suppkey % 40) || '_' || k || '.tif' as filename from supplier, range(0, 10) r(k))
select f.filename, count(n.filename) as lesion_count, {", ".join(f"round(coalesce(avg({m}), 0), 6) as mean_{m}" for m in MEASURES if m != "lesion_diameter_um")},
 round(coalesce(sum(ablation_area_um2), 0), 4) as total_ablation_area_um2 from files f left join named n using (filename) group by f.filename""")
def _(spark, sf):
    files = table(spark, sf, "supplier").select(
        F.expr("concat('PV', s_suppkey % 40)").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select(
        F.concat("s", F.lit("_"), "k", F.lit(".tif")).alias("filename")).distinct()
    return _rounded(batch_stats.file_means(named(spark, sf), files))


@query("h8_histograms", f"""{CTE}, v as (select 'ablation_diameter_um' as measure, ablation_diameter_um v from lesions
  union all select 'coagulation_width_um', coagulation_width_um from lesions union all select 'ablation_area_um2', ablation_area_um2 from lesions),
m as (select measure, min(v) lo, max(v) hi, avg(v) mean from v group by measure),
e as (select measure, cast(b as int) as bin, lo + b * ((hi - lo) / 30) as a, case when b = 29 then hi else lo + (b + 1) * ((hi - lo) / 30) end as z, mean from m, range(30) r(b))
select e.measure, e.bin, round(a, 6) as bin_from, round(z, 6) as bin_to, count(v.v) as n, round(mean, 6) as mean
from e left join v on v.measure = e.measure and v.v >= a and (v.v < z or (e.bin = 29 and v.v <= z)) group by e.measure, e.bin, a, z, mean""")
def _(spark, sf):
    return _rounded(batch_stats.histograms(lesions(spark, sf), ["ablation_diameter_um", "coagulation_width_um", "ablation_area_um2"]))


@query("h9_box_numbers", f"""{CTE}, v as (select 'ablation_diameter_um' as measure, ablation_diameter_um v from lesions
  union all select 'coagulation_width_um', coagulation_width_um from lesions union all select 'ablation_area_um2', ablation_area_um2 from lesions),
q as (select measure, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.5) med, quantile_cont(v, 0.75) q3 from v group by measure)
select measure, round(q1, 6) as q1, round(med, 6) as med, round(q3, 6) as q3,
 round(min(v) filter (v >= q1 - 1.5 * (q3 - q1)), 6) as whisker_low, round(max(v) filter (v <= q3 + 1.5 * (q3 - q1)), 6) as whisker_high,
 count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as n_outliers
from v join q using (measure) group by measure, q1, med, q3""")
def _(spark, sf):
    return _rounded(batch_stats.box_numbers(lesions(spark, sf), ["ablation_diameter_um", "coagulation_width_um", "ablation_area_um2"]))


_CORR = ["ablation_diameter_um", "coagulation_width_um", "ablation_area_um2", "coagulation_area_um2"]


@query("h10_correlations", f"{CTE} " + " union all ".join(
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lesions" for a in _CORR for b in _CORR))
def _(spark, sf):
    return _rounded(batch_stats.correlations(lesions(spark, sf), _CORR))


@query("h11_dashboard", f"""{SLIDES} select count(distinct filename) as total_files, count(*) as total_lesions,
 round(avg(ablation_diameter_um), 1) as mean_ablation_diameter_um, round(stddev_pop(ablation_diameter_um), 1) as std_ablation_diameter_um,
 round(avg(coagulation_width_um), 1) as mean_coagulation_width_um, round(stddev_pop(coagulation_width_um), 1) as std_coagulation_width_um from named""")
def _(spark, sf):
    return batch_stats.dashboard(named(spark, sf))
